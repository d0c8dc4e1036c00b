"""Audit rules on top of the model scores: materiality, co-occurrence override,
similarity escalation, labels. One ``select`` chain per stage — row-local, no shuffle.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import (ANNOTATION_BELOW_PERF, ANNOTATION_BELOW_TXN, ANNOTATION_EXCEEDS,
                         FLAG_SEPARATOR, FLAG_TEXTS, FLAGGED_TIERS, FS_PCT_OTHER,
                         FS_PCT_PUBLIC, NO_FLAGS_TEXT, PERFORMANCE_SHARE, SIMILARITY_THRESHOLD,
                         TRANSACTION_SHARE, UNUSUAL_AMOUNT_TEXT, UNUSUAL_Z)
from ..constants import (ESCALATION_NOTE, LABEL_MONITOR, OVERRIDE_NOTE, REVIEW_LABELS,
                         TIER_ORDER)
from ..functions.text import fill
from .exact import bin_of, bin_value, limb_sums, scaled, total
from ..functions.tiers import downgrade_tier, raw_tier, tier_at, tier_rank, two_decimals


def fs_pct_for_entity(entity_type: str) -> float:
    return FS_PCT_PUBLIC if entity_type == "Public company" else FS_PCT_OTHER


def materiality(entity_type: str, benchmark_figure: float) -> dict:
    """FS, performance and transaction materiality for an engagement (any entity type is
    accepted; only "Public company" uses 5 %, every other type 4 %)."""
    fs_pct = fs_pct_for_entity(entity_type)
    fs = benchmark_figure * fs_pct
    return {"fs_pct": fs_pct, "fs": fs, "performance": fs * PERFORMANCE_SHARE,
            "transaction": fs * TRANSACTION_SHARE}


def materiality_population(clean: DataFrame, m: dict) -> DataFrame:
    """threshold, amount, n_over and sum_over: the postings at or over each materiality threshold (one pass)."""
    names = ("fs", "performance", "transaction")
    x = F.col("abs_amount")
    rows = clean.select(x, bin_of(x).alias("bin"))
    rows = rows.select("bin", *[F.when(x >= F.lit(float(m[name])), scaled(x, F.col("bin"))).alias(name) for name in names])
    binned = rows.groupBy("bin").agg(*[F.count(name).alias(f"n_{name}") for name in names],
                                     *[limb for name in names for limb in limb_sums(F.col(name), name)])
    row = binned.agg(*[F.coalesce(F.sum(f"n_{name}"), F.lit(0)).alias(f"n_{name}") for name in names],
                     *[F.collect_list(F.struct("bin", bin_value(name).alias("v"))).alias(f"v_{name}") for name in names])
    row = row.select("*", *[total(f"v_{name}").alias(f"sum_{name}") for name in names])
    return row.select(F.explode(F.array(*[
        F.struct(F.lit(name).alias("threshold"), F.lit(float(m[name])).alias("amount"), F.col(f"n_{name}").alias("n_over"),
                 F.col(f"sum_{name}").alias("sum_over")) for name in names])).alias("t")).select("t.*")


def materiality_filter(raw: Column, abs_amount: Column, perf: float, txn: float) -> Column:
    """>= transaction keeps the raw tier; >= performance one tier down; else Monitor."""
    return (F.when(abs_amount >= F.lit(float(txn)), raw)
             .when(abs_amount >= F.lit(float(perf)), downgrade_tier(raw))
             .otherwise(F.lit("Monitor")))


def materiality_annotation(abs_amount: Column, perf: float, txn: float) -> Column:
    a = F.coalesce(abs_amount, F.lit(0.0))
    return (F.when(a >= F.lit(float(txn)), F.lit(ANNOTATION_EXCEEDS))
             .when(a >= F.lit(float(perf)), F.lit(ANNOTATION_BELOW_TXN))
             .otherwise(F.lit(ANNOTATION_BELOW_PERF)))


def active_flags(df_cols: list[str] | None = None) -> Column:
    """``|z| >= 2`` first, then the five flags in fixed order, joined by ``"; "``."""
    parts = [F.when(F.abs(F.col("amount_zscore_by_account")) >= UNUSUAL_Z, F.lit(UNUSUAL_AMOUNT_TEXT))]
    for col, text in FLAG_TEXTS:
        if df_cols is None or col in df_cols:
            parts.append(F.when(F.coalesce(F.col(col), F.lit(0)) == 1, F.lit(text)))
    joined = F.concat_ws(FLAG_SEPARATOR, F.array_compact(F.array(*parts)))
    return F.when(joined == "", F.lit(NO_FLAGS_TEXT)).otherwise(joined)


def flagged_status(tier: Column) -> Column:
    return F.when(tier.isin(*FLAGGED_TIERS), F.lit("Flagged")).otherwise(F.lit("Monitor"))


def _override_note(escalated: Column, count: Column, raw: Column, current: Column) -> Column:
    return fill(OVERRIDE_NOTE, escalated=escalated, count=count, raw=raw, current=current)


def _escalation_note(escalated: Column, score: Column, threshold: float) -> Column:
    return fill(ESCALATION_NOTE, escalated=escalated, score=two_decimals(score),
                threshold=F.lit(f"{threshold:.2f}"))


def apply_scoring(df: DataFrame, performance_materiality: float, transaction_materiality: float,
                  threshold: float = SIMILARITY_THRESHOLD, flagged_only: bool = False) -> DataFrame:
    """Adds final_tier, pcaob_label, materiality_annotation, active_flags, flagged_status,
    is_qualitative_override(+note), is_supervised_escalation(+note). Order is fixed:
    materiality filter, co-occurrence override, similarity escalation, derived columns.

    Tiers are carried as integer ranks (Monitor 0 .. High 3); each stage is one projection
    over the previous stage's small named columns, so no expression tree is copied. Texts are
    built last. ``flagged_only`` returns the flagged rows alone: every row is ranked (and counted by
    an observed metric, which keeps the filter behind the ranks), texts are built for flagged ones."""
    perf, txn = float(performance_materiality), float(transaction_materiality)
    top = len(TIER_ORDER) - 1
    a = F.col("abs_amount")
    cols = df.columns
    has_fp = "fraud_probability" in cols

    # 1. materiality filter; an unknown raw tier (rank NULL) keeps its text only at >= txn
    r_raw = tier_rank(F.col("raw_tier"))
    df = df.select("*", r_raw.alias("_r_raw"))
    df = df.select("*", F.when(a >= txn, F.col("_r_raw"))
                   .when(a >= perf, F.greatest(F.coalesce(F.col("_r_raw"), F.lit(1)) - 1, F.lit(0)))
                   .otherwise(F.lit(0)).alias("_r_mat"))
    # 2. co-occurrence override: one above the RAW tier, only if strictly above current
    up_raw = F.least(F.col("_r_raw") + 1, F.lit(top))
    ov = (F.coalesce(F.col("fraud_risk_flag"), F.lit(0)) == 1) & F.coalesce(up_raw > F.col("_r_mat"), F.lit(False))
    df = df.select("*", ov.alias("_ov"))
    df = df.select("*", F.when(F.col("_ov"), up_raw).otherwise(F.col("_r_mat")).alias("_r_ov"))
    # 3. similarity escalation: one above current, never on top of an override
    up = F.least(F.col("_r_ov") + 1, F.lit(top))
    fp = F.coalesce(F.col("fraud_probability"), F.lit(0.0)) if has_fp else F.lit(0.0)
    es = (fp >= F.lit(threshold)) & ~F.col("_ov") & F.coalesce(up > F.col("_r_ov"), F.lit(False)) if has_fp else F.lit(False)
    df = df.select("*", es.alias("_es"))
    df = df.select("*", F.when(F.col("_es"), up).otherwise(F.col("_r_ov")).alias("_r_fin"))
    # 4. derived columns on the final tier
    r_fin = F.col("_r_fin")
    flagged = F.coalesce(r_fin >= 2, F.lit(False))
    if flagged_only:
        df = df.observe("scored", F.count(F.lit(1)).alias("rows")).filter(flagged)
    unknown = F.when(F.col("_r_mat").isNull(), F.col("raw_tier"))
    t_mat = F.when(F.col("_r_mat").isNull(), F.col("raw_tier")).otherwise(tier_at(F.col("_r_mat")))
    final = F.coalesce(tier_at(r_fin), unknown)
    labels = F.array(*[F.lit(REVIEW_LABELS[t]) for t in TIER_ORDER])
    out = [F.col(f"`{c}`") for c in cols] + [
        final.alias("final_tier"),
        F.col("_ov").cast("int").alias("is_qualitative_override"),
        F.when(F.col("_ov"), _override_note(tier_at(up_raw), F.coalesce(F.col("fraud_flag_count"), F.lit(0)),
                                            F.col("raw_tier"), t_mat)).otherwise(F.lit("")).alias("qualitative_override_note"),
        F.col("_es").cast("int").alias("is_supervised_escalation"),
        F.when(F.col("_es"), _escalation_note(tier_at(r_fin), fp, threshold)).otherwise(F.lit("")).alias("supervised_escalation_note"),
        F.coalesce(F.element_at(labels, r_fin + 1), F.lit(LABEL_MONITOR)).alias("pcaob_label"),
        materiality_annotation(a, perf, txn).alias("materiality_annotation"),
        active_flags(cols).alias("active_flags"),
        F.when(flagged, F.lit("Flagged")).otherwise(F.lit("Monitor")).alias("flagged_status"),
    ]
    return df.select(*out)


def given_scores(feat: DataFrame) -> DataFrame:
    """Test scaffolding: a deterministic stand-in for the two model scores,
    used alike by a query and its SQL oracle to check the rules. Never the product's score."""
    z = F.abs(F.coalesce(F.col("amount_zscore_by_account"), F.lit(0.0)))
    ffc = F.col("fraud_flag_count").cast("double")
    score = F.round(F.lit(0.05) - F.lit(0.08) * ffc - F.lit(0.03) * z, 6)
    return feat.select("*", score.alias("anomaly_score"),
                       F.round(F.least(F.lit(1.0), F.lit(0.2) * ffc + F.lit(0.15) * z), 6)
                        .alias("fraud_probability")) \
               .withColumn("raw_tier", raw_tier(F.col("anomaly_score")))
