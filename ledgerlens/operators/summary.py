"""Review tables: summary, tier distribution, top accounts, escalation counts,
review drivers, suggested action, packet header, flagged queue, feature firing.

All are global or low-cardinality aggregates over the scored ledger with partial
(map-side) aggregation; nothing is collected per row.
"""
from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import (ACTION_BOTH, ACTION_NONE, ACTION_ONE, FLAG_TEXTS, HIGH_ITEMS, LABEL_ORDER,
                         MEDIUM_ITEMS, NO_FLAGS_TEXT, POPULATION_TEXT, QUALITY_TEXT, QUEUE_ORDER, QUEUE_TEXT,
                         RATING_ELEVATED_ABOVE, RATING_MODERATE_ABOVE, TOP_ACCOUNTS_N,
                         TOP_DRIVERS_N, UNUSUAL_AMOUNT_TEXT)
from ..functions.text import fill
from .exact import sum_by

QUEUE_COLUMNS = ["row_id", "journal_ref", "date", "account_name", "vendor", "amount",
                 "anomaly_score", "raw_tier", "final_tier", "pcaob_label",
                 "materiality_annotation", "active_flags", "control_gap_score", "fraud_risk_flag",
                 "period_over_period_pct", "vendor_concentration_pct", "is_year_end_concentration",
                 "is_non_standard_pattern", "fraud_probability", "is_qualitative_override",
                 "qualitative_override_note", "is_supervised_escalation",
                 "supervised_escalation_note"]

FIRING_T1 = ["is_round_number", "is_weekend_posting", "missing_description", "is_new_vendor",
             "is_near_approval_threshold"]
FIRING_T2 = ["control_gap_ge_1", "fraud_risk_flag", "is_year_end_concentration",
             "is_non_standard_pattern"]


def flagged_queue(scored: DataFrame, order: bool = True, positions: bool = False) -> DataFrame:
    """Flagged rows with the queue columns, most anomalous first.

    ``positions=True`` adds ``queue_position`` (0 = most anomalous; ties by journal_ref,
    then row_id) computed by a distributed sort + per-partition offsets."""
    cols = [c for c in QUEUE_COLUMNS if c in scored.columns]
    q = scored.filter(F.col("flagged_status") == "Flagged").select(*cols)
    keys = [c for c in QUEUE_ORDER if c in cols]
    if positions:
        from ..functions.position import with_position
        return with_position(q, keys, "queue_position")
    return q.orderBy(*keys) if order else q


def feature_firing(feat: DataFrame) -> DataFrame:
    """5 tier-1 and 4 tier-2 firing counts as (tier, feature_order, feature, n) rows."""
    sums = [F.sum(c).alias(c) for c in FIRING_T1] + [
        F.count_if(F.col("control_gap_score") >= 1).alias("control_gap_ge_1"),
        F.sum("fraud_risk_flag").alias("fraud_risk_flag"),
        F.sum("is_year_end_concentration").alias("is_year_end_concentration"),
        F.sum("is_non_standard_pattern").alias("is_non_standard_pattern")]
    wide = feat.agg(*sums)
    pairs = [f"'t1', {i}, '{c}', cast(coalesce(`{c}`, 0) as bigint)" for i, c in enumerate(FIRING_T1)] + \
            [f"'t2', {i}, '{c}', cast(coalesce(`{c}`, 0) as bigint)" for i, c in enumerate(FIRING_T2)]
    stack = f"stack({len(pairs)}, {', '.join(pairs)}) as (tier, feature_order, feature, n)"
    return wide.selectExpr(stack)


def firing_summary(firing: DataFrame) -> DataFrame:
    """Active features per tier and total firings (one row)."""
    return firing.agg(
        F.count_if((F.col("tier") == "t1") & (F.col("n") > 0)).alias("t1_active"),
        F.count_if((F.col("tier") == "t2") & (F.col("n") > 0)).alias("t2_active"),
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("total_firings"))


def review_summary(scored: DataFrame) -> DataFrame:
    a = scored.agg(F.count(F.lit(1)).alias("total"),
                   F.count_if(F.col("flagged_status") == "Flagged").alias("flagged"))
    pct = F.when(F.col("total") > 0, F.col("flagged") / F.col("total") * 100.0).otherwise(F.lit(0.0))
    return a.select(
        "total", "flagged", F.round(pct, 2).alias("flagged_pct"),
        F.when(pct > RATING_ELEVATED_ABOVE, "Elevated").when(pct > RATING_MODERATE_ABOVE, "Moderate")
         .otherwise("Low").alias("risk_rating"))


def tier_distribution(scored: DataFrame) -> DataFrame:
    """The three review labels in fixed order, zero-filled, over all rows."""
    labels = scored.sparkSession.createDataFrame(
        [(i, lab) for i, lab in enumerate(LABEL_ORDER)], "label_order int, label string")
    counts = scored.groupBy(F.col("pcaob_label").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return labels.join(F.broadcast(counts), "label", "left").select(
        "label_order", "label", F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("count"))


def top_accounts(scored: DataFrame, n: int = TOP_ACCOUNTS_N) -> DataFrame:
    """Flagged abs amount per account, top n descending (NULL account dropped)."""
    flagged = scored.filter((F.col("flagged_status") == "Flagged") & F.col("account_name").isNotNull())
    top = sum_by(flagged, ["account_name"], "abs_amount", "_s").orderBy(F.desc("_s"), "account_name").limit(n)
    return top.select("account_name", F.round("_s", 4).alias("flagged_amount"))


def train_guards(feat: DataFrame, label_col: str = "fraud_risk_flag", min_positive: int = 5) -> DataFrame:
    """Status of the weak-label layer before training: counts and the guard outcome."""
    if label_col not in feat.columns:
        return feat.sparkSession.createDataFrame(
            [("skipped_no_label_column", None, None)],
            "status string, n_positive long, n_negative long")
    y = F.coalesce(F.col(label_col), F.lit(0))
    a = feat.agg(F.count_if(y == 1).alias("n_positive"), F.count_if(y == 0).alias("n_negative"))
    status = (F.when(F.col("n_positive") < min_positive, "skipped_insufficient_positives")
               .when(F.col("n_negative") == 0, "skipped_single_class")
               .otherwise("trained"))
    return a.select(status.alias("status"), "n_positive", "n_negative")


def escalation_counts(scored: DataFrame, training: dict | None = None,
                      label_col: str = "fraud_risk_flag", min_positive: int = 5) -> DataFrame:
    """Overrides, escalations and the weak-label layer's status and class counts (one pass).

    ``training`` is the status dict returned by the similarity layer; without it the
    status is derived from the label counts exactly as the training guards would."""
    y = F.coalesce(F.col(label_col), F.lit(0))
    a = scored.agg(
        F.coalesce(F.sum("is_qualitative_override"), F.lit(0)).cast("long").alias("n_qualitative_override"),
        F.coalesce(F.sum("is_supervised_escalation"), F.lit(0)).cast("long").alias("n_supervised_escalation"),
        F.count_if(y == 1).alias("n_positive"), F.count_if(y == 0).alias("n_negative"))
    if training is not None and training.get("status"):
        status = F.lit(training["status"])
    else:
        status = (F.when(F.col("n_positive") < min_positive, "skipped_insufficient_positives")
                   .when(F.col("n_negative") == 0, "skipped_single_class").otherwise("trained"))
    return a.select("n_qualitative_override", "n_supervised_escalation", status.alias("status"),
                    "n_positive", "n_negative")


def top_drivers(queue: DataFrame, n: int = TOP_DRIVERS_N) -> DataFrame:
    """Most frequent flags over the queue (fixed flag order breaks count ties)."""
    order = [UNUSUAL_AMOUNT_TEXT] + [t for _, t in FLAG_TEXTS]
    flags = queue.select(F.explode(F.split(F.col("active_flags"), ";")).alias("f")) \
        .select(F.trim(F.col("f")).alias("flag")) \
        .filter((F.col("flag") != "") & (F.col("flag") != NO_FLAGS_TEXT))
    counts = flags.groupBy("flag").agg(F.count(F.lit(1)).alias("n"))
    pos = F.array_position(F.array(*[F.lit(t) for t in order]), F.col("flag"))
    top = counts.orderBy(F.col("n").desc(), F.when(pos == 0, 99).otherwise(pos), "flag").limit(n)
    return top.select("flag", "n")


def _plural(n, word):
    return F.concat(n.cast("string"), F.lit(f" {word}"), F.when(n == 1, F.lit("")).otherwise(F.lit("s")))


def suggested_action(queue: DataFrame) -> DataFrame:
    a = queue.agg(F.count_if(F.col("final_tier") == "High").alias("n_high"),
                  F.count_if(F.col("final_tier") == "Medium").alias("n_medium"))
    h, m = F.col("n_high"), F.col("n_medium")
    hi, me = _plural(h, HIGH_ITEMS), _plural(m, MEDIUM_ITEMS)
    text = (F.when((h > 0) & (m > 0), fill(ACTION_BOTH, high=hi, medium=me))
             .when(h > 0, fill(ACTION_ONE, items=hi))
             .when(m > 0, fill(ACTION_ONE, items=me))
             .otherwise(F.lit(ACTION_NONE)))
    return a.select("n_high", "n_medium", text.alias("suggested_action"))


def _us_date(iso: str) -> str:
    d = dt.date.fromisoformat(iso)
    return f"{d.month:02d}/{d.day:02d}/{d.year}"


def packet_header(summary: DataFrame, counts: DataFrame, period_start: str, period_end: str) -> DataFrame:
    """One row: period, population, queue size, data-quality counts and their texts."""
    # two small inputs folded as (key, value) rows by one aggregate - no join needed; the summary
    # is read once, as it may be a pass over the ledger
    parts = F.array(*[F.struct(F.lit(k).alias("k"), F.col(k).cast("long").alias("v")) for k in ("total", "flagged")])
    kv = (summary.select(F.explode(parts).alias("p")).select("p.k", "p.v")
          .unionByName(counts.select(F.lower(F.col("status")).alias("k"), F.col("n").cast("long").alias("v"))))

    def val(k):
        return F.coalesce(F.sum(F.when(F.col("k") == k, F.col("v"))), F.lit(0)).cast("long")

    row = kv.agg(val("total").alias("population"), val("flagged").alias("queue_size"),
                 val("pass").alias("n_pass"), val("warning").alias("n_warning"), val("fail").alias("n_fail"))
    p, w, f = F.col("n_pass"), F.col("n_warning"), F.col("n_fail")
    return row.select(
        F.lit(period_start).alias("period_start"), F.lit(period_end).alias("period_end"),
        F.lit(f"{_us_date(period_start)} – {_us_date(period_end)}").alias("review_period"),
        "population", "queue_size", p, w, f,
        fill(POPULATION_TEXT, n=F.format_number(F.col("population"), 0)).alias("population_text"),
        fill(QUEUE_TEXT, n=F.format_number(F.col("queue_size"), 0)).alias("queue_text"),
        fill(QUALITY_TEXT, passed=_plural(p, "check"), warnings=_plural(w, "warning"),
             failures=_plural(f, "failure")).alias("quality_text"))
