"""Review memos as tables.

The review tool asks a hosted model for a 7-field memo per selected row and falls back
to a rule-built memo when the answer is missing or fails validation. Here the hosted
call is out of scope: candidates, if any, arrive as a table ``(position, memo_json)``
produced elsewhere; this module ranks rows, builds the prompts, builds the rule memos,
validates candidates (first failure is the reason), keeps one valid candidate per position
(the greatest text where several are valid) and attaches one memo to each row of the queue.
Everything is column expressions and joins over the rows asked for, by default the whole
queue. The wording of the rule memos is this library's own (constants).
"""
from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import (AMOUNT_PLACEHOLDER, ASSERTION_DEFAULT, ASSERTION_MAP, BANNED_PHRASES, COSO_DEFAULT,
                         COSO_MAP, DISCLAIMER, FLAGS_PLACEHOLDER, FOLLOW_UP_BASE, FOLLOW_UP_CONDITIONAL,
                         FOLLOW_UP_ITEM_LENGTH, FOLLOW_UP_ITEMS, FOLLOW_UP_OVERRIDE, LIKELIHOOD_FEW,
                         LIKELIHOOD_MANY, MAGNITUDE_LARGE, MAGNITUDE_OPEN, MAGNITUDE_SMALL, MEMO_ASSERTIONS,
                         MEMO_CONTROLS, MEMO_FIELDS, MEMO_LENGTH_BOUNDS, MEMO_SUMMARY, NAME_LEAK_PATTERNS,
                         PROMPT_HEAD, PROMPT_MEMO, PROMPT_SUMMARY, STATUS_CANDIDATE, STATUS_FALLBACK,
                         STATUS_NONE, SUMMARY_CLOSE, SUMMARY_COMBINED, SUMMARY_LARGE, SUMMARY_OVERRIDE,
                         SUMMARY_SMALL, TIER_MEMO_RANK, TIER_MEMO_RANK_UNKNOWN)
from ..functions.position import with_position
from ..functions.text import fill, stripped
from ..functions.tiers import money_text, two_decimals

def memo_rank(queue: DataFrame, top_n: int | None = None) -> DataFrame:
    """The queue in review order, numbered from 0 as ``position``; its first ``top_n`` rows, or all.

    Keys: tier (High, Medium, Low, Monitor, other), override first, co-occurrence first,
    anomaly score ascending, signed amount descending (NULL as 0); then the queue's own
    columns so that the choice is deterministic. Numbers come from a range-partitioned sort and
    the row counts of its partitions, so no task holds the queue."""
    if top_n is not None and top_n < 1:
        raise ValueError("top_n must be at least 1, or None for the whole queue")
    keys = [_tier_key(),
            F.when(F.coalesce(F.col("is_qualitative_override"), F.lit(0)) == 1, 0).otherwise(1),
            F.when(F.coalesce(F.col("fraud_risk_flag"), F.lit(0)) == 1, 0).otherwise(1),
            F.coalesce(F.col("anomaly_score"), F.lit(0.0)),
            -F.coalesce(F.col("amount"), F.lit(0.0))]
    ties = [c for c in ("journal_ref", "date", "account_name", "vendor", "amount", "row_id")
            if c in queue.columns]
    queue = queue.drop("position")
    ordered = queue.select("*", *[k.alias(f"_k{i}") for i, k in enumerate(keys)])
    order = [F.col(f"_k{i}").asc_nulls_first() for i in range(len(keys))] + \
        [F.col(c).asc_nulls_first() for c in ties]
    if top_n is not None:
        ordered = ordered.orderBy(*order).limit(top_n)
    return with_position(ordered, order).withColumn("position", F.col("position").cast("int")) \
        .drop(*[f"_k{i}" for i in range(len(keys))])


def _tier_key() -> Column:
    expr = None
    for t, r in TIER_MEMO_RANK.items():
        expr = F.when(F.col("final_tier") == t, F.lit(r)) if expr is None else \
            expr.when(F.col("final_tier") == t, F.lit(r))
    return expr.otherwise(F.lit(TIER_MEMO_RANK_UNKNOWN))


def memo_keys(ranked: DataFrame) -> DataFrame:
    return ranked.select("position", "date", "account_name", "vendor", "amount")


# ----------------------------------------------------------------------------- text parts
def flag_parts() -> Column:
    parts = F.filter(F.transform(F.split(F.coalesce(F.col("active_flags"), F.lit("")), ";"),
                                 lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.size(parts) == 0, F.array(F.lit(FLAGS_PLACEHOLDER))).otherwise(parts)


def flags_clause() -> Column:
    p = F.transform(flag_parts(), lambda x: F.lower(x))
    n = F.size(p)
    return (F.when(n == 1, F.get(p, 0))
             .when(n == 2, F.concat(F.get(p, 0), F.lit(" and "), F.get(p, 1)))
             .otherwise(F.concat(F.array_join(F.slice(p, 1, n - 1), ", "), F.lit(", and "),
                                 F.element_at(p, -1))))


def amount_text() -> Column:
    return F.when(F.col("amount").isNull(), F.lit(AMOUNT_PLACEHOLDER)).otherwise(money_text(F.col("amount")))


def _flags_lower() -> Column:
    return F.lower(F.coalesce(F.col("active_flags"), F.lit("")))


def _pick_two(mapping, default) -> Column:
    text = _flags_lower()
    picks = F.flatten(F.array(*[F.when(text.contains(pat), F.array(*[F.lit(x) for x in vals]))
                               .otherwise(F.array().cast("array<string>")) for pat, vals in mapping]))
    chosen = F.slice(F.array_distinct(picks), 1, 2)
    return F.when(F.size(chosen) == 0, F.array(*[F.lit(x) for x in default])).otherwise(chosen)


def assertions() -> Column:
    return _pick_two(ASSERTION_MAP, ASSERTION_DEFAULT)


def coso_components() -> Column:
    return _pick_two(COSO_MAP, COSO_DEFAULT)


def _mentions_any(text: Column, patterns) -> Column:
    cond = F.lit(False)
    for p in patterns:
        cond = cond | text.contains(p)
    return cond


def follow_ups() -> Column:
    """Three base procedures, then one per matching condition in fixed order; distinct,
    at most five."""
    text = _flags_lower()
    cond = [F.when(_mentions_any(text, pats), F.lit(item)) for pats, item in FOLLOW_UP_CONDITIONAL]
    cond.append(F.when(F.coalesce(F.col("is_qualitative_override"), F.lit(0)) == 1,
                       F.lit(FOLLOW_UP_OVERRIDE)))
    items = F.concat(F.array(*[F.lit(x) for x in FOLLOW_UP_BASE]), F.array_compact(F.array(*cond)))
    return F.slice(F.array_distinct(items), 1, FOLLOW_UP_ITEMS[1])


def _override() -> Column:
    return F.coalesce(F.col("is_qualitative_override"), F.lit(0)) == 1


def _materiality_kind() -> Column:
    m = F.lower(F.trim(F.coalesce(F.col("materiality_annotation"), F.lit(""))))
    return F.when((m != "") & m.contains("exceeds"), F.lit("exceeds")) \
            .when((m != "") & m.contains("below"), F.lit("below")).otherwise(F.lit("other"))


def _two(items: Column) -> Column:
    return F.array_join(items, " and ")


def risk_summary() -> Column:
    """Short form, used when only a summary is requested: what was raised, why it moved up, how its
    size compares, and what the result is not."""
    why = F.when(_override(), F.lit(SUMMARY_OVERRIDE)) \
        .when(F.coalesce(F.col("fraud_risk_flag"), F.lit(0)) == 1, F.lit(SUMMARY_COMBINED)).otherwise("")
    kind = _materiality_kind()
    size = F.when(kind == "exceeds", SUMMARY_LARGE).when(kind == "below", SUMMARY_SMALL).otherwise("")
    return F.concat(fill(MEMO_SUMMARY, amount=amount_text(), flags=flags_clause()), why, size, F.lit(SUMMARY_CLOSE))


def full_memo() -> Column:
    """The seven memo fields as a struct (always passes :func:`validate_memos`)."""
    amount, kind, n_flags = amount_text(), _materiality_kind(), F.size(flag_parts())
    summary = fill(MEMO_SUMMARY, amount=amount, flags=flags_clause())
    assertion = fill(MEMO_ASSERTIONS, assertions=_two(assertions()))
    magnitude = (F.when(kind == "exceeds", fill(MAGNITUDE_LARGE, amount=amount))
                 .when(kind == "below", fill(MAGNITUDE_SMALL, amount=amount))
                 .otherwise(fill(MAGNITUDE_OPEN, amount=amount)))
    likelihood = F.when(_override() | (n_flags >= 3), F.lit(LIKELIHOOD_MANY)).otherwise(fill(LIKELIHOOD_FEW, n=n_flags))
    control = fill(MEMO_CONTROLS, components=_two(coso_components()))
    return F.struct(summary.alias("risk_summary"), assertion.alias("assertion_consideration"),
                    magnitude.alias("magnitude_assessment"), likelihood.alias("likelihood_assessment"),
                    control.alias("control_or_coso_consideration"),
                    follow_ups().alias("recommended_follow_up"), F.lit(DISCLAIMER).alias("disclaimer"))


# ----------------------------------------------------------------------------- prompts
def memo_prompts(ranked: DataFrame, entity_type: str, period_start: str, period_end: str) -> DataFrame:
    """The request text per selected row: entity context plus 11 observable facts; one
    row per (position, kind) with kind ``summary`` or ``memo`` (two closings)."""
    likeness = F.when(F.col("fraud_probability").isNotNull(), two_decimals(F.col("fraud_probability")))
    money = F.when(F.col("amount").isNotNull(), money_text(F.col("amount")))
    yes_no = lambda c: F.when(F.coalesce(F.col(c), F.lit(0)) == 1, "yes").otherwise("no")
    facts = {"sum": money, "ledger account": F.col("account_name"), "counterparty": F.col("vendor"),
             "checks": F.col("active_flags"), "queue label": F.col("pcaob_label"), "tier": F.col("final_tier"),
             "size note": F.col("materiality_annotation"), "control gaps of 2": F.coalesce("control_gap_score", F.lit(0)),
             "checks combine": yes_no("fraud_risk_flag"), "raised by combination": yes_no("is_qualitative_override"),
             "likeness to rule-flagged entries, 0 to 1": likeness}
    body = F.concat(fill(PROMPT_HEAD, entity=F.lit(entity_type), start=F.lit(period_start), end=F.lit(period_end)),
                    *[F.concat(F.lit(f"{k} = "), F.coalesce(v.cast("string"), F.lit("unknown")), F.lit("\n"))
                      for k, v in facts.items()])
    closings = F.array(F.struct(F.lit("summary").alias("kind"), F.lit(PROMPT_SUMMARY).alias("closing")),
                       F.struct(F.lit("memo").alias("kind"), F.lit(PROMPT_MEMO).alias("closing")))
    return ranked.select("position", body.alias("_body"), F.explode(closings).alias("_c")).select(
        "position", F.col("_c.kind").alias("kind"),
        F.concat(F.col("_body"), F.col("_c.closing")).alias("prompt"))


# ----------------------------------------------------------------------------- validator
_PY_TYPE = [("OBJECT", "dict"), ("ARRAY", "list"), ("STRING", "str"), ("BIGINT", "int"),
            ("INT", "int"), ("SMALLINT", "int"), ("TINYINT", "int"), ("DECIMAL", "float"),
            ("DOUBLE", "float"), ("FLOAT", "float"), ("BOOLEAN", "bool"), ("VOID", "NoneType")]


def _py_type(s: Column) -> Column:
    """The Python type's name for a ``schema_of_variant``."""
    expr = None
    for prefix, name in _PY_TYPE:
        cond = s.startswith(prefix)
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    return expr.otherwise(F.lower(s))


def _py_list(arr: Column) -> Column:
    return F.concat(F.lit("['"), F.array_join(arr, "', '"), F.lit("']"))


def _first_match(text: Column, phrases: list[str]) -> Column:
    """The first of the phrases that the text contains, or NULL: compiled tests, each of which passes over the text's
    bytes once."""
    return F.coalesce(*[F.when(F.contains(text, F.lit(p)), F.lit(p)) for p in phrases])


def validate_memos(candidates: DataFrame, json_col: str = "memo_json") -> DataFrame:
    """Adds ``is_valid`` and ``reason`` (first failed check, "" when valid). Each text is parsed once and each
    field read once: what the checks share is a column of the projection before them."""
    cols = [F.col(f"`{c}`") for c in candidates.columns]
    follow = "recommended_follow_up"
    df = candidates.select("*", F.try_parse_json(F.col(json_col)).alias("_v"),
                           F.json_object_keys(F.col(json_col)).alias("_keys"))
    v, keys = F.col("_v"), F.col("_keys")
    fields = F.struct(*[F.struct(F.schema_of_variant(F.variant_get(v, f"$.{f}", "variant")).alias("s")).alias(f) for f in MEMO_FIELDS])
    df = df.select(*cols, "_v", "_keys", F.schema_of_variant(v).alias("_s"), fields.alias("_f"))
    df = df.select(*cols, "_v", "_keys", _py_type(F.col("_s")).alias("_t"),
                   *[_py_type(F.col(f"_f.{f}.s")).alias(f"_t_{f}") for f in MEMO_FIELDS])
    # a value is read as text (or list) only where it is one
    kind = {f: F.col(f"_t_{f}") for f in MEMO_FIELDS}
    items = F.when(kind[follow] == "list", F.variant_get(v, f"$.{follow}", "array<variant>"))
    items = F.transform(items, lambda x: F.struct(F.schema_of_variant(x).alias("s"), F.variant_get(x, "$", "string").alias("text")))
    df = df.select("*", items.alias("_read"), *[F.when(kind[f] == "str", F.variant_get(v, f"$.{f}", "string")).alias(f"_x_{f}")
                                                for f in MEMO_FIELDS if f != follow])
    df = df.select("*", F.transform("_read", lambda x: F.struct(
        _py_type(x["s"]).alias("t"), x["text"].alias("text"), F.char_length(stripped(x["text"])).alias("n"))).alias("_items"),
        *[F.char_length(stripped(F.col(f"_x_{f}"))).alias(f"_n_{f}") for f in MEMO_FIELDS if f != follow])
    texts = [F.col(f"_x_{f}") for f in MEMO_FIELDS if f != follow]
    strings = F.transform(F.filter("_items", lambda x: (x["t"] == "str") & x["text"].isNotNull()), lambda x: x["text"])
    # the source joins fields in field order: 5 texts, follow-up items, disclaimer
    df = df.select("*", F.lower(F.concat_ws("\n", *texts[:5], F.array_join(strings, "\n"), texts[5])).alias("_all"))

    required = F.array(*[F.lit(f) for f in MEMO_FIELDS])
    missing = F.array_sort(F.array_except(required, keys))
    extra = F.array_sort(F.array_except(keys, required))
    key_reason = F.concat_ws("; ", F.when(F.size(missing) > 0, F.concat(F.lit("missing keys: "), _py_list(missing))),
                             F.when(F.size(extra) > 0, F.concat(F.lit("extra keys: "), _py_list(extra))))
    checks = [
        F.when(v.isNull(), F.lit("not valid JSON")),
        F.when(F.col("_t") != "dict", F.concat(F.lit("top-level value is not a JSON object (got "), F.col("_t"), F.lit(")"))),
        F.when(key_reason != "", key_reason),
    ]
    lo_n, hi_n = FOLLOW_UP_ITEMS
    lo_i, hi_i = FOLLOW_UP_ITEM_LENGTH
    for f in MEMO_FIELDS:
        if f == follow:
            n = F.size("_items")
            item_reasons = F.filter(F.transform("_items", lambda x, i: (
                F.when(x["t"] != "str", F.concat(F.lit(f"{follow}["), i.cast("string"), F.lit("] must be a string")))
                 .when(x["n"] == 0, F.concat(F.lit(f"{follow}["), i.cast("string"), F.lit("] is empty")))
                 .when((x["n"] < lo_i) | (x["n"] > hi_i),
                       F.concat(F.lit(f"{follow}["), i.cast("string"), F.lit("] length "), x["n"].cast("string"),
                                F.lit(f" out of bounds [{lo_i}, {hi_i}]"))))),
                lambda r: r.isNotNull())
            checks += [
                F.when(kind[f] != "list", F.concat(F.lit(f"{f} must be a list, got "), kind[f])),
                F.when((n < lo_n) | (n > hi_n), F.concat(F.lit(f"{f} has "), n.cast("string"),
                                                         F.lit(f" items, expected {lo_n}-{hi_n}"))),
                F.get(item_reasons, 0),
            ]
        else:
            n = F.col(f"_n_{f}")
            checks += [
                F.when(kind[f] != "str", F.concat(F.lit(f"{f} must be a string, got "), kind[f])),
                F.when(n == 0, F.lit(f"{f} is empty")),
            ]
            if f in MEMO_LENGTH_BOUNDS:
                lo, hi = MEMO_LENGTH_BOUNDS[f]
                checks.append(F.when((n < lo) | (n > hi), F.concat(F.lit(f"{f} length "), n.cast("string"),
                                                                   F.lit(f" out of bounds [{lo}, {hi}]"))))
    checks.append(F.when(stripped(F.col("_x_disclaimer")) != F.lit(DISCLAIMER),
                         F.lit("disclaimer does not match the required verbatim string")))
    # the dearest checks come last: a text that failed another one is not searched
    checks.append(F.concat(F.lit("banned phrase detected: '"), _first_match(F.col("_all"), BANNED_PHRASES), F.lit("'")))
    checks.append(F.concat(F.lit("name-leakage pattern detected: '"), _first_match(F.col("_all"), NAME_LEAK_PATTERNS), F.lit("'")))
    # the observed count keeps a filter on the outcome from being copied into every step above
    df = df.select(*cols, F.coalesce(*checks).alias("_reason")).observe(f"checked-{uuid.uuid4().hex}", F.count(F.lit(1)).alias("rows"))
    return df.select(*cols, F.col("_reason").isNull().alias("is_valid"), F.coalesce(F.col("_reason"), F.lit("")).alias("reason"))


def phrase_scan(text: Column) -> tuple[Column, Column]:
    """(first banned phrase, first name pattern) found in ``text``, case-blind, or NULL."""
    low = F.lower(text)
    return _first_match(low, BANNED_PHRASES), _first_match(low, NAME_LEAK_PATTERNS)


# ----------------------------------------------------------------------------- assembly
MEMO_SCHEMA = ("struct<risk_summary:string,assertion_consideration:string,magnitude_assessment:string,"
               "likelihood_assessment:string,control_or_coso_consideration:string,"
               "recommended_follow_up:array<string>,disclaimer:string>")


def accept_or_fallback(ranked: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    """One memo per selected position: a valid candidate (``STATUS_CANDIDATE``) else the rule
    memo (``STATUS_FALLBACK``)."""
    base = ranked.select("*", full_memo().alias("_rule"))
    if candidates is None:
        out = base.select("*", F.col("_rule").alias("memo"), F.lit(STATUS_FALLBACK).alias("narrative_status"))
    else:
        # validity folded into the value (no filter): keeps the optimizer from deriving
        # constraints out of the validator's long expression across the join
        checked = validate_memos(candidates).select(
            "position", F.when(F.col("is_valid"), F.col("memo_json")).alias("_json"))
        checked = checked.groupBy("position").agg(F.max("_json").alias("_json")).select(
            "position", F.from_json("_json", MEMO_SCHEMA).alias("_cand"))
        out = base.join(checked, "position", "left").select(
            "*", F.coalesce(F.col("_cand"), F.col("_rule")).alias("memo"),
            F.when(F.col("_cand").isNotNull(), STATUS_CANDIDATE).otherwise(STATUS_FALLBACK)
             .alias("narrative_status"))
        out = out.drop("_cand")
    return out.drop("_rule")


def memo_table(queue: DataFrame, top_n: int | None = None,
               candidates: DataFrame | None = None, ranked: DataFrame | None = None) -> DataFrame:
    """position, keys, narrative_status and the seven memo fields for the first ``top_n`` rows, or all.
    ``ranked`` is the outcome of ``memo_rank(queue, top_n)`` where it was made before (for the candidates)."""
    m = accept_or_fallback(memo_rank(queue, top_n) if ranked is None else ranked, candidates)
    return m.select("position", *[c for c in ("row_id", "journal_ref") if c in queue.columns],
                    "date", "account_name", "vendor", "amount", "narrative_status",
                    *[F.col(f"memo.{f}").alias(f) for f in MEMO_FIELDS])


def memo_tallies(memos: DataFrame) -> DataFrame:
    return memos.agg(F.count(F.lit(1)).alias("top_n_used"),
                     F.count_if(F.col("narrative_status") == STATUS_CANDIDATE).alias("n_gpt"),
                     F.count_if(F.col("narrative_status") == STATUS_FALLBACK).alias("n_fallback"))


def attach_memos(queue: DataFrame, memos: DataFrame, by: str = "row_id") -> DataFrame:
    """Queue rows with their memo (``Not generated`` when none); never more rows than the queue.

    ``by="row_id"`` joins on row identity. ``by="keys"`` joins on (date, account, vendor,
    amount) as the source's table does. Of several memos for a row the one of the last position
    stays. Spark broadcasts the memos only below its own size threshold."""
    fields = ["narrative_status"] + MEMO_FIELDS
    if by == "row_id":
        m = memos.groupBy("row_id").agg(F.max_by(F.struct(*fields), F.col("position")).alias("_m"))
        m = m.select("row_id", *[F.col(f"_m.{f}").alias(f) for f in fields])
        out = queue.join(m, "row_id", "left")
    else:
        keys = ["date", "account_name", "vendor", "amount"]
        m = memos.groupBy(*keys).agg(F.max_by(F.struct(*fields), F.col("position")).alias("_m"))
        m = m.select(*[F.col(k).alias(f"_mk_{k}") for k in keys],
                     *[F.col(f"_m.{f}").alias(f) for f in fields])
        cond = None
        for k in keys:
            c = F.col(k).eqNullSafe(F.col(f"_mk_{k}"))
            cond = c if cond is None else cond & c
        out = queue.join(m, cond, "left").drop(*[f"_mk_{k}" for k in keys])
    return out.withColumn("narrative_status", F.coalesce(F.col("narrative_status"), F.lit(STATUS_NONE)))
