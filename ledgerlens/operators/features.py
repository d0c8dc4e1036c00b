"""Tier-1 and tier-2 risk-indicator features as column expressions.

All per-key statistics come from :class:`LedgerStats` (one grouping-sets pass) and are
attached with size-checked broadcast joins, so the ledger itself is never shuffled and
a hot account or vendor never lands on one task (no ``Window.partitionBy(account)``
over ledger rows). Every feature is then a plain expression in one ``select``.
"""
from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import (APPROVAL_THRESHOLDS, CO_OCCURRENCE_MIN_FLAGS, FRAUD_FLAG_COLUMNS,
                         NEAR_THRESHOLD_BAND, NEW_VENDOR_MIN_TXNS, NON_STANDARD_PATTERN,
                         UNKNOWN_VENDOR, YEAR_END_WINDOW_DAYS)
from ..functions.text import stripped
from .stats import LedgerStats, compute_stats


def _flag(cond: Column) -> Column:
    return F.coalesce(cond.cast("int"), F.lit(0))


def round_number(abs_amount: Column) -> Column:
    return _flag(abs_amount % 100 == 0)


def weekend_posting(date: Column) -> Column:
    return _flag(F.weekday(date).isin(5, 6))


def missing_description(desc: Column) -> Column:
    trimmed = stripped(desc)
    return _flag(desc.isNull() | (trimmed == "") | (F.lower(trimmed) == "nan"))


def near_threshold(abs_amount: Column) -> Column:
    cond = F.lit(False)
    for t in APPROVAL_THRESHOLDS:
        cond = cond | ((abs_amount >= float(t * NEAR_THRESHOLD_BAND)) & (abs_amount < float(t)))
    return _flag(cond)


def zscore() -> Column:
    """z within account from attached stats; degenerate accounts give 0 for every row."""
    degenerate = (F.col("acc_n") == 0) | (F.col("acc_min") == F.col("acc_max")) | (F.col("acc_sd") == 0)
    return (F.when(F.col("account_name").isNull(), F.lit(None).cast("double"))
             .when(degenerate, F.lit(0.0))
             .otherwise((F.col("abs_amount") - F.col("acc_mean")) / F.col("acc_sd")))


def _date_bound(value, dtype: T.DataType) -> Column:
    if isinstance(value, str):
        value = dt.date.fromisoformat(value)
    if isinstance(dtype, T.DateType):
        d = value.date() if isinstance(value, dt.datetime) else value
        return F.expr(f"DATE '{d.isoformat()}'")
    if not isinstance(value, dt.datetime):
        value = dt.datetime.combine(value, dt.time())
    return F.expr(f"TIMESTAMP_NTZ '{value.isoformat(sep=' ')}'")


def year_end_window(df: DataFrame, period_end, window_days: int = YEAR_END_WINDOW_DAYS) -> Column:
    """1 when end - (window-1) days <= date <= end; ``period_end`` None uses max(date)."""
    if period_end is None:
        return F.lit(0)
    dtype = df.schema["date"].dataType
    if isinstance(period_end, str):
        period_end = dt.date.fromisoformat(period_end)
    end = _date_bound(period_end, dtype)
    if isinstance(period_end, dt.datetime) or not isinstance(dtype, T.DateType):
        start_val = (period_end if isinstance(period_end, dt.datetime)
                     else dt.datetime.combine(period_end, dt.time())) - dt.timedelta(days=window_days - 1)
    else:
        start_val = period_end - dt.timedelta(days=window_days - 1)
    start = _date_bound(start_val, dtype)
    return _flag((F.col("date") >= start) & (F.col("date") <= end))


def non_standard_pattern(df: DataFrame) -> Column:
    if "dr_cr_pattern" not in df.columns:
        return F.lit(0)
    return _flag(F.lower(F.col("dr_cr_pattern")) == NON_STANDARD_PATTERN)


def attach_stats(clean: DataFrame, stats: LedgerStats) -> DataFrame:
    """Join (broadcast when size-checked small) the three dimensions onto the ledger."""
    df = clean.withColumn("_vendor_key", F.coalesce(F.col("vendor"), F.lit(UNKNOWN_VENDOR))) \
              .withColumn("_month", F.trunc(F.col("date"), "month"))
    df = df.join(stats.dim("account"), "account_name", "left")
    vd = stats.dim("vendor").withColumnRenamed("vendor_key", "_vendor_key")
    df = df.join(vd, "_vendor_key", "left")
    m = stats.dim("month").select(F.col("account_name").alias("_m_account"),
                                  F.col("month").alias("_month_key"), "period_over_period_pct")
    df = df.join(m, (df["account_name"] == m["_m_account"]) & (df["_month"] == m["_month_key"]), "left")
    return df


def engineer_features(clean: DataFrame, stats: LedgerStats | None = None,
                      period_end=None, use_period_end: bool = True) -> DataFrame:
    """Tier 1 then tier 2 features. ``period_end=None`` takes max(date) of the ledger."""
    if stats is None:
        stats = compute_stats(clean)
    if period_end is None and use_period_end:
        period_end = stats.globals.get("max_date")
    base_cols = clean.columns
    df = attach_stats(clean, stats)

    total = stats.globals.get("sum_basis")
    total = float(total) if total is not None else 0.0
    if total <= 0:
        vconc = F.lit(0.0)
    else:
        # a NULL vendor holds no share (its key UNKNOWN carries only real "UNKNOWN" rows)
        vconc = F.when(F.col("vendor").isNull(), F.lit(0.0)).otherwise(
            F.coalesce(F.col("vendor_disb").cast("double") / F.lit(total) * 100.0, F.lit(0.0)))

    a = F.col("abs_amount")
    t1 = {
        "amount_zscore_by_account": zscore(),
        "is_round_number": round_number(a),
        "is_weekend_posting": weekend_posting(F.col("date")),
        "missing_description": missing_description(F.col("description")),
        "vendor_txn_count": F.col("vendor_txn_count"),
        "is_new_vendor": _flag(F.col("vendor_txn_count") < NEW_VENDOR_MIN_TXNS),
        "is_near_approval_threshold": near_threshold(a),
    }
    df = df.select(*[F.col(f"`{c}`") for c in base_cols],
                   *[v.alias(k) for k, v in t1.items()],
                   "period_over_period_pct", vconc.alias("vendor_concentration_pct"))
    ffc = sum((F.col(c) for c in FRAUD_FLAG_COLUMNS[1:]), F.col(FRAUD_FLAG_COLUMNS[0]))
    return df.select(
        "*",
        (F.col("missing_description") + F.col("is_weekend_posting")).alias("control_gap_score"),
        ffc.alias("fraud_flag_count"),
        (ffc >= CO_OCCURRENCE_MIN_FLAGS).cast("int").alias("fraud_risk_flag"),
        year_end_window(df, period_end).alias("is_year_end_concentration"),
        non_standard_pattern(df).alias("is_non_standard_pattern"),
    ).select(*base_cols, "amount_zscore_by_account", "is_round_number", "is_weekend_posting",
             "missing_description", "vendor_txn_count", "is_new_vendor",
             "is_near_approval_threshold", "control_gap_score", "fraud_flag_count",
             "fraud_risk_flag", "period_over_period_pct", "vendor_concentration_pct",
             "is_year_end_concentration", "is_non_standard_pattern")
