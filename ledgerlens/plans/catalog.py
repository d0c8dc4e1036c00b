"""Registered queries: one per operator of the inventory, each ``(spark, sf_dir) -> DataFrame``.

Every query reads the driver's tables through the fixture ledger and runs over all of
their rows. Floating outputs are rounded to 6 places (money to 4) so that a value hash
does not depend on summation order.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import integrity as I
from ..operators import summary as S
from ..operators.scoring import materiality
from ..session import apart
from ..sources.fixture import FIXTURE_PARAMS
from ..sources.sinks import nonfinite_to_null
from .ledger import FixtureLedger, r6

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def L(spark, sf_dir, **kw) -> FixtureLedger:
    return FixtureLedger.get(spark, sf_dir, **kw)


# ---------------------------------------------------------------- 2.1 sources/sinks
@query("clean_gl")
def q_clean_gl(spark, sf_dir):
    c = L(spark, sf_dir).clean
    return c.select("journal_ref", "date", "amount", "abs_amount", "account_code", "account_name",
                    "vendor", "description", "debit_amount", "credit_amount", "dr_cr_pattern")


@query("nonfinite_to_null")
def q_nonfinite(spark, sf_dir):
    # period-over-period is the one feature that can be non-finite (0 -> x growth)
    f = L(spark, sf_dir).feat
    out = nonfinite_to_null(f.select("journal_ref", "period_over_period_pct"))
    return out.select("journal_ref", r6("period_over_period_pct").alias("period_over_period_pct"),
                      F.col("period_over_period_pct").isNull().cast("int").alias("is_null"))


# ---------------------------------------------------------------- 2.2 tier 1
def _feat_cols(spark, sf_dir, *cols, **kw):
    f = L(spark, sf_dir, **kw).feat
    out = [F.col("journal_ref")]
    for c in cols:
        dtype = f.schema[c].dataType.simpleString()
        out.append(r6(c).alias(c) if dtype == "double" else F.col(c))
    return f.select(*out)


@query("round_number")
def q_round(spark, sf_dir):
    return _feat_cols(spark, sf_dir, "abs_amount", "is_round_number")


@query("weekend_posting")
def q_weekend(spark, sf_dir):
    return _feat_cols(spark, sf_dir, "date", "is_weekend_posting")


@query("missing_description")
def q_missing(spark, sf_dir):
    return _feat_cols(spark, sf_dir, "description", "missing_description")


@query("vendor_txn_count")
def q_vendor_count(spark, sf_dir):
    return _feat_cols(spark, sf_dir, "vendor", "vendor_txn_count")


@query("new_vendor")
def q_new_vendor(spark, sf_dir):
    return _feat_cols(spark, sf_dir, "vendor", "is_new_vendor")


@query("near_threshold")
def q_near(spark, sf_dir):
    return _feat_cols(spark, sf_dir, "abs_amount", "is_near_approval_threshold")


@query("amount_zscore")
def q_z(spark, sf_dir):
    return _feat_cols(spark, sf_dir, "account_name", "amount_zscore_by_account")


T1 = ["amount_zscore_by_account", "is_round_number", "is_weekend_posting", "missing_description",
      "vendor_txn_count", "is_new_vendor", "is_near_approval_threshold"]
T2 = ["control_gap_score", "fraud_flag_count", "fraud_risk_flag", "period_over_period_pct",
      "vendor_concentration_pct", "is_year_end_concentration", "is_non_standard_pattern"]


@query("tier1_features")
def q_t1(spark, sf_dir):
    return _feat_cols(spark, sf_dir, *T1)


# ---------------------------------------------------------------- 2.3 tier 2
@query("control_gap_score")
def q_gap(spark, sf_dir):
    return _feat_cols(spark, sf_dir, "control_gap_score")


@query("fraud_flag_count")
def q_ffc(spark, sf_dir):
    return _feat_cols(spark, sf_dir, "fraud_flag_count")


@query("fraud_risk_flag")
def q_frf(spark, sf_dir):
    return _feat_cols(spark, sf_dir, "fraud_risk_flag")


@query("period_over_period")
def q_pop(spark, sf_dir):
    return _feat_cols(spark, sf_dir, "account_name", "date", "period_over_period_pct")


@query("vendor_concentration_debit")
def q_vc_debit(spark, sf_dir):
    return _feat_cols(spark, sf_dir, "vendor", "vendor_concentration_pct")


@query("vendor_concentration_code")
def q_vc_code(spark, sf_dir):
    return _feat_cols(spark, sf_dir, "vendor", "account_code", "vendor_concentration_pct",
                      with_debit=False)


@query("year_end_window")
def q_ye(spark, sf_dir):
    return _feat_cols(spark, sf_dir, "date", "is_year_end_concentration")


@query("year_end_window_default")
def q_ye_default(spark, sf_dir):
    return _feat_cols(spark, sf_dir, "date", "is_year_end_concentration", default_period_end=True)


@query("non_standard_pattern")
def q_nsp(spark, sf_dir):
    return _feat_cols(spark, sf_dir, "dr_cr_pattern", "is_non_standard_pattern")


@query("tier2_features")
def q_t2(spark, sf_dir):
    return _feat_cols(spark, sf_dir, *T2)


@query("engineer_features")
def q_feat(spark, sf_dir):
    return _feat_cols(spark, sf_dir, "date", "amount", "abs_amount", "account_code", "account_name",
                      "vendor", *T1, *T2)


@query("feature_firing")
def q_firing(spark, sf_dir):
    return S.feature_firing(L(spark, sf_dir).feat)


@query("firing_summary")
def q_firing_summary(spark, sf_dir):
    return S.firing_summary(S.feature_firing(L(spark, sf_dir).feat))


# ---------------------------------------------------------------- 2.5 scoring rules
def _scored_cols(spark, sf_dir, *cols):
    s = L(spark, sf_dir).scored_given
    out = [F.col("journal_ref")]
    for c in cols:
        dtype = s.schema[c].dataType.simpleString()
        out.append(r6(c).alias(c) if dtype == "double" else F.col(c))
    return s.select(*out)


@query("materiality")
def q_materiality(spark, sf_dir):
    # the engagement thresholds and the postings of the ledger that reach them
    from ..operators.scoring import materiality_population
    m = materiality(FIXTURE_PARAMS["entity_type"], FIXTURE_PARAMS["benchmark_figure"])
    return materiality_population(L(spark, sf_dir).clean, m).select(
        "threshold", r6("amount").alias("amount"), "n_over", F.round("sum_over", 4).alias("sum_over"))


@query("raw_tier")
def q_raw_tier(spark, sf_dir):
    return _scored_cols(spark, sf_dir, "anomaly_score", "raw_tier")


@query("shift_tier")
def q_shift(spark, sf_dir):
    from ..functions.tiers import downgrade_tier, upgrade_tier
    s = L(spark, sf_dir).scored_given
    return s.select("journal_ref", "raw_tier", downgrade_tier(F.col("raw_tier")).alias("tier_down"),
                    upgrade_tier(F.col("raw_tier")).alias("tier_up"),
                    downgrade_tier(F.col("final_tier")).alias("final_down"),
                    upgrade_tier(F.col("final_tier")).alias("final_up"))


@query("materiality_filter")
def q_mat_filter(spark, sf_dir):
    from ..operators.scoring import materiality_filter
    led = L(spark, sf_dir)
    s = led.scored_given
    return s.select("journal_ref", r6("abs_amount").alias("abs_amount"), "raw_tier",
                    materiality_filter(F.col("raw_tier"), F.col("abs_amount"), led.perf, led.txn)
                    .alias("materiality_tier"))


@query("materiality_annotation")
def q_mat_annot(spark, sf_dir):
    return _scored_cols(spark, sf_dir, "abs_amount", "materiality_annotation")


@query("active_flags")
def q_active(spark, sf_dir):
    return _scored_cols(spark, sf_dir, "active_flags")


@query("qualitative_override")
def q_override(spark, sf_dir):
    return _scored_cols(spark, sf_dir, "raw_tier", "fraud_flag_count", "is_qualitative_override",
                        "qualitative_override_note")


@query("supervised_escalation")
def q_escalation(spark, sf_dir):
    return _scored_cols(spark, sf_dir, "fraud_probability", "final_tier", "is_supervised_escalation",
                        "supervised_escalation_note")


@query("review_label")
def q_label(spark, sf_dir):
    return _scored_cols(spark, sf_dir, "final_tier", "pcaob_label")


@query("flagged_status")
def q_flagged_status(spark, sf_dir):
    return _scored_cols(spark, sf_dir, "final_tier", "flagged_status")


APPLY_COLS = ["anomaly_score", "fraud_probability", "raw_tier", "final_tier", "pcaob_label",
              "materiality_annotation", "active_flags", "flagged_status", "is_qualitative_override",
              "qualitative_override_note", "is_supervised_escalation", "supervised_escalation_note"]


@query("apply_scoring")
def q_apply(spark, sf_dir):
    return _scored_cols(spark, sf_dir, *APPLY_COLS)


@query("flagged_queue")
def q_queue(spark, sf_dir):
    q = S.flagged_queue(L(spark, sf_dir).flagged_given, positions=True).drop("row_id")
    return q.select(*[r6(c).alias(c) if q.schema[c].dataType.simpleString() == "double" else F.col(c)
                      for c in q.columns])


# ---------------------------------------------------------------- 2.6 integrity
def _report(spark, sf_dir, **kw):
    return I.integrity_report(L(spark, sf_dir, **kw).stats)


def _with_detail(finding, *keys):
    """A finding with the numbers of its detail as columns."""
    return finding.select("*", *[F.round(F.col("detail")[k].cast("double"), 4).alias(k) for k in keys]).drop("detail")


@query("hash_total")
def q_hash(spark, sf_dir):
    return _with_detail(I.hash_total(L(spark, sf_dir).stats), "sum_abs", "sum_dc", "diff")


@query("hash_total_skipped")
def q_hash_skip(spark, sf_dir):
    return I.hash_total(L(spark, sf_dir, with_debit=False).stats).drop("detail")


@query("cross_footing")
def q_cross(spark, sf_dir):
    return _with_detail(I.cross_footing(L(spark, sf_dir).stats), "sum_d", "sum_c", "diff", "pct")


@query("date_in_period")
def q_period(spark, sf_dir):
    return _with_detail(I.date_in_period(L(spark, sf_dir).stats), "n_total", "n_out_of_bounds", "n_null")


@query("account_mapping_codes")
def q_map_codes(spark, sf_dir):
    return I.mapping_breaks(L(spark, sf_dir).stats)[0]


@query("account_mapping_names")
def q_map_names(spark, sf_dir):
    return I.mapping_breaks(L(spark, sf_dir).stats)[1]


@query("account_mapping")
def q_mapping(spark, sf_dir):
    return _with_detail(I.account_mapping(L(spark, sf_dir).stats), "n_bad_codes", "n_bad_names")


@query("integrity_report")
def q_report(spark, sf_dir):
    return _report(spark, sf_dir).drop("detail")


@query("integrity_counts")
def q_icounts(spark, sf_dir):
    return I.integrity_counts(_report(spark, sf_dir))


@query("quality_exceptions")
def q_exceptions(spark, sf_dir):
    return I.quality_exceptions(_report(spark, sf_dir)).drop("detail")


# ---------------------------------------------------------------- 2.7 result aggregates
@query("review_summary")
def q_summary(spark, sf_dir):
    return S.review_summary(L(spark, sf_dir).scored_given)


@query("tier_distribution")
def q_dist(spark, sf_dir):
    return S.tier_distribution(L(spark, sf_dir).scored_given)


@query("top_accounts")
def q_top_accounts(spark, sf_dir):
    return S.top_accounts(L(spark, sf_dir).flagged_given)


@query("escalation_counts")
def q_esc_counts(spark, sf_dir):
    return S.escalation_counts(L(spark, sf_dir).scored_given)


@query("train_guards")
def q_guards(spark, sf_dir):
    return S.train_guards(L(spark, sf_dir).feat)


@query("top_drivers")
def q_drivers(spark, sf_dir):
    return S.top_drivers(S.flagged_queue(L(spark, sf_dir).flagged_given, order=False))


@query("suggested_action")
def q_action(spark, sf_dir):
    return S.suggested_action(S.flagged_queue(L(spark, sf_dir).flagged_given, order=False))


@query("packet_header")
def q_header(spark, sf_dir):
    led = L(spark, sf_dir)
    return S.packet_header(S.review_summary(led.scored_given), I.integrity_counts(_report(spark, sf_dir)),
                           FIXTURE_PARAMS["period_start"], FIXTURE_PARAMS["period_end"])


# ---------------------------------------------------------------- 2.8 memo tables
def _queue(spark, sf_dir):
    return S.flagged_queue(L(spark, sf_dir).flagged_given, order=False)


def _ranked(spark, sf_dir, top_n: int | None = None):
    from ..operators.memos import memo_rank
    return memo_rank(_queue(spark, sf_dir), top_n)


MUTATIONS = ["good", "missing_key", "wrong_type", "too_few_items", "banned_phrase",
             "wrong_disclaimer", "name_leak", "not_json", "extra_key", "short_text", "empty_item"]


def memo_candidates(ranked: DataFrame) -> DataFrame:
    """Candidate memos for the queue: a valid one (with a second valid one for the same position)
    and ten deliberate faults (the validator's test set), one kind per position in turn."""
    from ..constants import MEMO_FIELDS as fields
    from ..operators.memos import full_memo
    m = ranked.select("position", full_memo().alias("m"))
    kind = F.element_at(F.array(*[F.lit(k) for k in MUTATIONS]), (F.col("position") % len(MUTATIONS)) + 1)
    def with_(**over):
        columns = [over.get(f, F.col(f"m.{f}")).alias(f) for f in fields if over.get(f, "") is not None]
        return F.to_json(F.struct(*columns, *[v.alias(k) for k, v in over.items() if k not in fields]))
    js = (F.when(kind == "missing_key", with_(likelihood_assessment=None))
           .when(kind == "wrong_type", with_(recommended_follow_up=F.array_join("m.recommended_follow_up", "; ")))
           .when(kind == "too_few_items", with_(recommended_follow_up=F.slice("m.recommended_follow_up", 1, 2)))
           .when(kind == "banned_phrase", with_(risk_summary=F.concat("m.risk_summary", F.lit(" This proves fraud."))))
           .when(kind == "wrong_disclaimer", with_(disclaimer=F.lit("This analysis is indicative only.")))
           .when(kind == "name_leak", with_(control_or_coso_consideration=F.concat(
               "m.control_or_coso_consideration", F.lit(" The manager should explain the entry."))))
           .when(kind == "not_json", F.lit("not json"))
           .when(kind == "extra_key", with_(note=F.lit("x")))
           .when(kind == "short_text", with_(risk_summary=F.lit("Too short.")))
           .when(kind == "empty_item", with_(recommended_follow_up=F.concat(
               F.array(F.lit(" ")), F.slice("m.recommended_follow_up", 2, 9))))
           .otherwise(with_(risk_summary=F.concat(F.lit("Second reading: "), F.col("m.risk_summary")))))
    twins = m.where(F.col("position") % len(MUTATIONS) == 0).select(
        "position", F.lit("twin").alias("mutation"), with_().alias("memo_json"))
    return apart(m.select("position", kind.alias("mutation"), js.alias("memo_json")).unionAll(twins))


@query("memo_rank")
def q_memo_rank(spark, sf_dir):
    r = _ranked(spark, sf_dir, 20)
    return r.select("position", "journal_ref", "final_tier", "is_qualitative_override", "fraud_risk_flag",
                    r6("anomaly_score").alias("anomaly_score"), r6("amount").alias("amount"))


@query("memo_keys")
def q_memo_keys(spark, sf_dir):
    from ..operators.memos import memo_keys
    k = memo_keys(_ranked(spark, sf_dir))
    return k.select("position", "date", "account_name", "vendor", r6("amount").alias("amount"))


@query("flags_clause")
def q_flags_clause(spark, sf_dir):
    from ..operators.memos import amount_text, flags_clause
    return _ranked(spark, sf_dir).select("position", "active_flags", flags_clause().alias("flags_clause"),
                                         amount_text().alias("amount_text"))


@query("assertions")
def q_assertions(spark, sf_dir):
    from ..operators.memos import assertions
    return _ranked(spark, sf_dir).select("position", "active_flags",
                                         F.array_join(assertions(), "|").alias("assertions"))


@query("coso_components")
def q_coso(spark, sf_dir):
    from ..operators.memos import coso_components
    return _ranked(spark, sf_dir).select("position", "active_flags",
                                         F.array_join(coso_components(), "|").alias("coso_components"))


@query("follow_ups")
def q_follow_ups(spark, sf_dir):
    from ..operators.memos import follow_ups
    return _ranked(spark, sf_dir).select("position", "active_flags", "is_qualitative_override",
                                         F.array_join(follow_ups(), "; ").alias("recommended_follow_up"))


@query("risk_summary")
def q_risk_summary(spark, sf_dir):
    from ..operators.memos import risk_summary
    return _ranked(spark, sf_dir).select("position", risk_summary().alias("risk_summary"))


MEMO_TEXT = ["risk_summary", "assertion_consideration", "magnitude_assessment",
             "likelihood_assessment", "control_or_coso_consideration"]


@query("full_memo")
def q_full_memo(spark, sf_dir):
    from ..operators.memos import full_memo
    m = _ranked(spark, sf_dir).select("position", full_memo().alias("m"))
    return m.select("position", *[F.col(f"m.{f}").alias(f) for f in MEMO_TEXT],
                    F.array_join("m.recommended_follow_up", "; ").alias("recommended_follow_up"),
                    F.col("m.disclaimer").alias("disclaimer"))


@query("memo_prompts")
def q_prompts(spark, sf_dir):
    from ..operators.memos import memo_prompts
    p = FIXTURE_PARAMS
    return memo_prompts(_ranked(spark, sf_dir), p["entity_type"], p["period_start"], p["period_end"])


@query("phrase_scan")
def q_phrase_scan(spark, sf_dir):
    from ..operators.memos import phrase_scan
    c = memo_candidates(_ranked(spark, sf_dir))
    banned, leak = phrase_scan(F.col("memo_json"))
    return c.select("position", "mutation", banned.alias("banned_phrase"), leak.alias("name_pattern"))


@query("validate_memos")
def q_validate(spark, sf_dir):
    from ..operators.memos import validate_memos
    v = validate_memos(memo_candidates(_ranked(spark, sf_dir)))
    return v.select("position", "mutation", "is_valid", "reason")


@query("accept_or_fallback")
def q_accept(spark, sf_dir):
    from ..operators.memos import memo_table
    ranked = _ranked(spark, sf_dir)
    t = memo_table(_queue(spark, sf_dir), None, memo_candidates(ranked), ranked)
    return t.select("position", "journal_ref", "narrative_status", "risk_summary", "disclaimer")


@query("memo_tallies")
def q_tallies(spark, sf_dir):
    from ..operators.memos import memo_table, memo_tallies
    ranked = _ranked(spark, sf_dir)
    return memo_tallies(memo_table(_queue(spark, sf_dir), None, memo_candidates(ranked), ranked))


@query("attach_memos")
def q_attach(spark, sf_dir):
    from ..operators.memos import attach_memos, memo_table
    q = _queue(spark, sf_dir)
    a = attach_memos(q, memo_table(q))
    return a.select("journal_ref", "narrative_status", "risk_summary")


@query("attach_memos_by_keys")
def q_attach_keys(spark, sf_dir):
    from ..operators.memos import attach_memos, memo_table
    q = _queue(spark, sf_dir)
    a = attach_memos(q, memo_table(q), by="keys")
    return a.select("journal_ref", "narrative_status", "risk_summary")


# ---------------------------------------------------------------- 2.1 sources and sinks
@query("read_gl_csv")
def q_read_csv(spark, sf_dir):
    """Round trip: the fixture ledger written as CSV (dates as text), read back by the
    CSV source and cleaned."""
    from ..operators.clean import clean_gl
    from ..session import scratch_path
    from ..sources.csv_gl import read_gl_csv
    gl = L(spark, sf_dir).gl.drop("row_id")
    path = scratch_path(spark, "gl-csv")
    (gl.select(*[F.col(c).cast("string").alias(c) for c in gl.columns])
       .write.option("header", True).option("escape", '"').csv(path))
    c = clean_gl(read_gl_csv(spark, path))
    return c.select("journal_ref", F.col("date").cast("date").alias("date"), r6("amount").alias("amount"),
                    "account_code", "account_name", "vendor", "description",
                    r6("debit_amount").alias("debit_amount"), r6("credit_amount").alias("credit_amount"),
                    "dr_cr_pattern")


def _us_csv(spark, sf_dir):
    """The fixture ledger as CSV with dates as month/day/year, read back."""
    from ..session import scratch_path
    from ..sources.csv_gl import read_gl_csv
    gl = L(spark, sf_dir).gl.drop("row_id").withColumn("date", F.date_format("date", "M/d/yyyy"))
    path = scratch_path(spark, "gl-csv-us")
    (gl.select(*[F.col(c).cast("string").alias(c) for c in gl.columns])
       .write.option("header", True).option("escape", '"').csv(path))
    return read_gl_csv(spark, path)


@query("read_gl_csv_us_dates")
def q_read_csv_us(spark, sf_dir):
    """The round trip with dates as month/day/year and no format given."""
    from ..operators.clean import clean_gl
    c = clean_gl(_us_csv(spark, sf_dir))
    return c.select("journal_ref", F.col("date").cast("date").alias("date"), r6("amount").alias("amount"),
                    "account_code", "account_name", "vendor", "description",
                    r6("debit_amount").alias("debit_amount"), r6("credit_amount").alias("credit_amount"),
                    "dr_cr_pattern")


@query("date_votes")
def q_date_votes(spark, sf_dir):
    """For each candidate format the rows that it parses."""
    from ..operators.dates import date_votes
    return date_votes(_us_csv(spark, sf_dir)).drop("nth")


@query("export_csv")
def q_export(spark, sf_dir):
    """The exported queue (16 columns + 8 memo columns) written as CSV and read back."""
    from ..operators.memos import attach_memos, memo_table
    from ..session import scratch_path
    from ..sources.sinks import export_csv
    q = S.flagged_queue(L(spark, sf_dir).flagged_given, positions=True)
    path = export_csv(attach_memos(q, memo_table(q)), scratch_path(spark, "export"))
    from ..functions.position import with_position
    back = (spark.read.option("header", True).option("escape", '"').option("multiLine", True)
            .csv(path).select("*", F.col("_metadata.file_name").alias("_file"), F.monotonically_increasing_id().alias("_row")))
    back = with_position(back, ["_file", "_row"]).drop("_file", "_row")     # a file is read whole by one task
    kinds = q.schema
    return back.select("position", *[
        r6(F.col(c).cast("double")).alias(c) if c in kinds.names and kinds[c].dataType.typeName() == "double" else
        F.col(c).cast("int").alias(c) if c in kinds.names and kinds[c].dataType.typeName() in ("integer", "long") else F.col(c)
        for c in back.columns if c != "position"])


@query("write_packet")
def q_write_packet(spark, sf_dir):
    """The packet's tables written, read back through the manifest (which checks rows and content), and counted."""
    from functools import reduce

    from ..session import scratch_path
    from ..sources.sinks import read_packet, write_packet
    from .oracle import PACKET
    path = scratch_path(spark, "packet")
    write_packet({name: QUERIES[name](spark, sf_dir) for name in PACKET}, path)
    counts = [df.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("n_rows")) for name, df in read_packet(spark, path).items()]
    return reduce(DataFrame.unionAll, counts)


# ---------------------------------------------------------------- 2.4 model layer
def _review(spark, sf_dir):
    key = ("review", spark.sparkContext.applicationId, sf_dir)
    from .ledger import _CACHE
    if key not in _CACHE:
        from .review import review_fixture
        _CACHE[key] = review_fixture(spark, sf_dir)
    return _CACHE[key]


@query("standard_scale")
def q_scale(spark, sf_dir):
    from ..operators.scale import standard_scale
    f = L(spark, sf_dir).feat
    cols = ["amount_zscore_by_account", "is_round_number", "is_weekend_posting", "missing_description",
            "is_new_vendor", "is_near_approval_threshold"]
    s = standard_scale(f, cols)
    return s.select("journal_ref", *[r6(c).alias(c) for c in cols])


@query("iforest_fit")
def q_if_fit(spark, sf_dir):
    """Node table of the fitted isolation forest (bounded: trees x (2 psi - 1) rows)."""
    fr = _review(spark, sf_dir).forest
    return spark.createDataFrame(fr.node_table)


@query("iforest_score")
def q_if_score(spark, sf_dir):
    pk = _review(spark, sf_dir)
    return pk.scored.select("journal_ref", "anomaly_score", "anomaly_label", "raw_tier")


@query("order_by_anomaly")
def q_order(spark, sf_dir):
    """Ledger ordered by anomaly score (most anomalous first) with its queue position."""
    from ..functions.position import with_position
    from ..session import materialize
    s = L(spark, sf_dir).scored_given
    p = with_position(materialize(s.select("journal_ref", "anomaly_score", "row_id"), "anomaly"),
                      ["anomaly_score", "journal_ref", "row_id"], "queue_position")
    return p.select("queue_position", "journal_ref", r6("anomaly_score").alias("anomaly_score"))


@query("weak_label_train")
def q_wl_train(spark, sf_dir):
    info = _review(spark, sf_dir).similarity.info
    return spark.createDataFrame([(info.get("status"), info.get("n_positive"), info.get("n_negative"),
                                   ",".join(info.get("feature_cols", [])))],
                                 "status string, n_positive long, n_negative long, feature_cols string")


@query("feature_importance")
def q_importance(spark, sf_dir):
    from ..operators.similarity import feature_importance
    return feature_importance(_review(spark, sf_dir).similarity, spark)


@query("similarity_score")
def q_similarity(spark, sf_dir):
    return _review(spark, sf_dir).scored.select("journal_ref", "fraud_probability")


@query("hybrid_pipeline")
def q_hybrid(spark, sf_dir):
    return _review(spark, sf_dir).scored.select(
        "journal_ref", "anomaly_score", "anomaly_label", "raw_tier", "fraud_probability",
        "final_tier", "flagged_status")


@query("review_queue")
def q_review_queue(spark, sf_dir):
    """The flagship: the flagged queue of the full review (real model scores)."""
    return _review(spark, sf_dir).flagged.drop("row_id")


# A fixed three-tree forest over the tier-1 features, used to check the scoring
# mechanics (complete-tree layout, Arrow UDF, path-length average) against SQL.
LITERAL_FOREST = [
    # (tree_id, node_id, feature, threshold, left, right, n_node, value)
    (0, 0, 0, 1.0, 1, 2, 256, 0.0), (0, 1, 1, 0.5, 3, 4, 250, 0.0), (0, 2, -1, 0.0, -1, -1, 6, 0.0),
    (0, 3, -1, 0.0, -1, -1, 240, 0.0), (0, 4, -1, 0.0, -1, -1, 10, 0.0),
    (1, 0, 2, 0.5, 1, 2, 256, 0.0), (1, 1, 5, 0.5, 3, 4, 180, 0.0), (1, 2, -1, 0.0, -1, -1, 76, 0.0),
    (1, 3, -1, 0.0, -1, -1, 178, 0.0), (1, 4, -1, 0.0, -1, -1, 2, 0.0),
    (2, 0, 4, 0.5, 1, 2, 256, 0.0), (2, 1, 0, -0.5, 3, 4, 255, 0.0), (2, 2, -1, 0.0, -1, -1, 1, 0.0),
    (2, 3, -1, 0.0, -1, -1, 100, 0.0), (2, 4, -1, 0.0, -1, -1, 155, 0.0),
]


def literal_forest():
    import numpy as np
    import pandas as pd

    from ..constants import TIER1_FEATURES
    from ..operators.iforest import IsolationForestModel, _full_layout, c_factor
    cols = ["tree_id", "node_id", "feature", "threshold", "left", "right", "n_node", "value"]
    nodes = pd.DataFrame(LITERAL_FOREST, columns=cols)
    depth_of = {}
    for t, n, f, th, lft, rgt, *_ in LITERAL_FOREST:
        depth_of.setdefault((t, 0), 0)
        if f >= 0:
            depth_of[(t, lft)] = depth_of[(t, n)] + 1
            depth_of[(t, rgt)] = depth_of[(t, n)] + 1
    nodes["value"] = [depth_of[(t, n)] + float(c_factor([k])[0]) if f < 0 else 0.0
                      for t, n, f, k in zip(nodes.tree_id, nodes.node_id, nodes.feature, nodes.n_node)]
    lay = _full_layout(nodes, 3, 2)
    return IsolationForestModel(list(TIER1_FEATURES), 3, 256, 2, lay, np.arange(3), 0.05)


@query("iforest_score_literal")
def q_if_literal(spark, sf_dir):
    from ..operators.iforest import raw_score_column
    f = L(spark, sf_dir).feat
    m = literal_forest()
    return f.select("journal_ref", r6(raw_score_column(m, spark)).alias("raw_score"))


@query("read_gl_parquet")
def q_read_parquet(spark, sf_dir):
    """Round trip: the fixture ledger written as parquet, read back by the parquet source
    (row identity from the file position) and cleaned."""
    from ..operators.clean import clean_gl
    from ..session import scratch_path
    from ..sources.csv_gl import read_gl_parquet
    path = scratch_path(spark, "gl-parquet")
    L(spark, sf_dir).gl.drop("row_id").write.parquet(path)
    c = clean_gl(read_gl_parquet(spark, path))
    return c.select("journal_ref", "date", r6("amount").alias("amount"), "account_code", "account_name",
                    "vendor", "description", r6("debit_amount").alias("debit_amount"),
                    r6("credit_amount").alias("credit_amount"), "dr_cr_pattern")
