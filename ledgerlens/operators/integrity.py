"""Advisory integrity checks (never block the review).

Each check is a one-row frame computed from the single statistics pass
(:class:`LedgerStats`): exact sums and differences for the hash total and cross-footing, date
counts for the period check, the small (code, name) pair table for the mapping check.
The report is their ordered union.
"""
from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import (CHECK_NAMES, CROSS_FOOTING_SUMMARY, DATE_PERIOD_NULLS,
                         DATE_PERIOD_SUMMARY, HASH_TOTAL_SUMMARY, INTEGRITY_TOLERANCE,
                         MAPPING_CODES, MAPPING_NAMES, MAPPING_OK, SKIP_CROSS, SKIP_HASH,
                         SKIP_PERIOD, STATUSES)
from ..functions.text import fill
from ..functions.tiers import money_text, two_decimals
from .stats import LedgerStats

def _d(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(0.0))


def _finding(df: DataFrame, order: int, status: Column, summary: Column, detail: Column) -> DataFrame:
    return df.select(F.lit(order).alias("check_order"), F.lit(CHECK_NAMES[order - 1]).alias("name"),
                     status.alias("status"), summary.alias("summary"), detail.alias("detail"))


def _empty_detail() -> Column:
    return F.create_map().cast("map<string,string>")


def _as_double(c: Column) -> Column:
    return F.round(c, 4)


def hash_total(stats: LedgerStats, tol: float = INTEGRITY_TOLERANCE) -> DataFrame:
    g = stats.global_row
    if not stats.has_debit_credit:
        return _finding(g, 1, F.lit("Pass"), F.lit(SKIP_HASH), _empty_detail())
    sum_abs, sum_dc, diff = _d("sum_abs"), _d("sum_debit_credit"), F.abs(_d("abs_less_debit_credit"))
    summary = fill(HASH_TOTAL_SUMMARY, sum_abs=money_text(sum_abs), sum_dc=money_text(sum_dc),
                   diff=money_text(diff))
    detail = F.create_map(F.lit("sum_abs"), _as_double(sum_abs).cast("string"),
                          F.lit("sum_dc"), _as_double(sum_dc).cast("string"),
                          F.lit("diff"), _as_double(diff).cast("string"))
    return _finding(g, 1, F.when(diff <= tol, "Pass").otherwise("Warning"), summary, detail)


def cross_footing(stats: LedgerStats, tol: float = INTEGRITY_TOLERANCE) -> DataFrame:
    g = stats.global_row
    if not stats.has_debit_credit:
        return _finding(g, 2, F.lit("Pass"), F.lit(SKIP_CROSS), _empty_detail())
    sd, sc, diff = _d("sum_debit"), _d("sum_credit"), F.abs(_d("debit_less_credit"))
    pct = diff / F.greatest(sd, F.lit(1.0)) * 100.0
    summary = fill(CROSS_FOOTING_SUMMARY, sum_d=money_text(sd), sum_c=money_text(sc),
                   diff=money_text(diff), pct=two_decimals(pct))
    detail = F.create_map(F.lit("sum_d"), _as_double(sd).cast("string"),
                          F.lit("sum_c"), _as_double(sc).cast("string"),
                          F.lit("diff"), _as_double(diff).cast("string"),
                          F.lit("pct"), F.round(pct, 6).cast("string"))
    return _finding(g, 2, F.when(diff <= tol, "Pass").otherwise("Warning"), summary, detail)


def date_in_period(stats: LedgerStats) -> DataFrame:
    g = stats.global_row
    if stats.period is None:
        return _finding(g, 3, F.lit("Pass"), F.lit(SKIP_PERIOD), _empty_detail())
    ps, pe = (p if isinstance(p, str) else p.isoformat() for p in stats.period)
    ps, pe = dt.date.fromisoformat(ps).isoformat(), dt.date.fromisoformat(pe).isoformat()
    n_total, n_oob = F.col("n_dates"), F.coalesce(F.col("n_out_of_period"), F.lit(0))
    n_null = F.col("n_rows") - F.col("n_dates")
    summary = F.concat(fill(DATE_PERIOD_SUMMARY, n_oob=n_oob, n_total=n_total, start=F.lit(ps),
                            end=F.lit(pe)),
                       F.when(n_null > 0, fill(DATE_PERIOD_NULLS, n_null=n_null)).otherwise(F.lit("")),
                       F.lit("."))
    status = F.when((n_oob == 0) & (n_null == 0), "Pass").otherwise("Warning")
    detail = F.create_map(F.lit("n_total"), n_total.cast("string"),
                          F.lit("n_out_of_bounds"), n_oob.cast("string"),
                          F.lit("n_null"), n_null.cast("string"),
                          F.lit("period_start"), F.lit(ps), F.lit("period_end"), F.lit(pe))
    return _finding(g, 3, status, summary, detail)


def mapping_breaks(stats: LedgerStats) -> tuple[DataFrame, DataFrame]:
    """(codes with more than one name, names with more than one code); NULLs ignored."""
    codes = stats.pair.groupBy("account_code").agg(F.count(F.lit(1)).alias("n_names")) \
        .filter(F.col("n_names") > 1)
    names = stats.pair.groupBy("account_name").agg(F.count(F.lit(1)).alias("n_codes")) \
        .filter(F.col("n_codes") > 1)
    return codes, names


def _py_list(keys: Column) -> Column:
    """Python-style list text: ['a', 'b']."""
    return F.concat(F.lit("['"), F.array_join(keys, "', '"), F.lit("']"))


def account_mapping(stats: LedgerStats) -> DataFrame:
    codes, names = mapping_breaks(stats)
    # Long format: per side its count and its three smallest keys (distributed top-k),
    # folded by one global aggregate; at most 3 keys per side reach the final buffer.
    bad = codes.select(F.lit("code").alias("kind"), F.col("account_code").alias("key")) \
        .unionByName(names.select(F.lit("name").alias("kind"), F.col("account_name").alias("key")))
    counts = bad.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).select(
        "kind", "n", F.lit(None).cast("string").alias("key"))
    tops = [bad.filter(F.col("kind") == k).orderBy("key").limit(3)
               .select("kind", F.lit(None).cast("long").alias("n"), "key") for k in ("code", "name")]
    rows = counts.unionByName(tops[0]).unionByName(tops[1])

    def n_of(kind):
        return F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("n"))), F.lit(0)).alias(f"n_bad_{kind}s")

    def keys_of(kind):
        return F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.col("key")))).alias(f"{kind}s3")

    row = rows.agg(n_of("code"), n_of("name"), keys_of("code"), keys_of("name"))
    parts = F.array_compact(F.array(
        F.when(F.col("n_bad_codes") > 0,
               fill(MAPPING_CODES, n=F.col("n_bad_codes"), examples=_py_list(F.col("codes3")))),
        F.when(F.col("n_bad_names") > 0,
               fill(MAPPING_NAMES, n=F.col("n_bad_names"), examples=_py_list(F.col("names3"))))))
    ok = (F.col("n_bad_codes") == 0) & (F.col("n_bad_names") == 0)
    summary = F.when(ok, F.lit(MAPPING_OK)).otherwise(F.concat(F.array_join(parts, "; "), F.lit(".")))
    detail = F.create_map(F.lit("n_bad_codes"), F.col("n_bad_codes").cast("string"),
                          F.lit("n_bad_names"), F.col("n_bad_names").cast("string"))
    return _finding(row, 4, F.when(ok, "Pass").otherwise("Warning"), summary, detail)


def integrity_report(stats: LedgerStats) -> DataFrame:
    """The four findings in display order."""
    return (hash_total(stats).unionByName(cross_footing(stats))
            .unionByName(date_in_period(stats)).unionByName(account_mapping(stats)))


def integrity_counts(report: DataFrame) -> DataFrame:
    """Pass / Warning / Fail counts, zero-filled (no check emits Fail)."""
    spark = report.sparkSession
    labels = spark.createDataFrame([(i, s) for i, s in enumerate(STATUSES)], "status_order int, status string")
    counts = report.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    return (labels.join(F.broadcast(counts), "status", "left")
            .select("status_order", "status", F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("n")))


def quality_exceptions(report: DataFrame) -> DataFrame:
    return report.filter(F.col("status") != "Pass")
