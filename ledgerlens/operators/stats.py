"""LedgerStats: every per-key and global statistic the features and checks need, in ONE pass.

One ``GROUPING SETS`` aggregate over the cleaned ledger of two sets, so each row is expanded twice:
by (account, code, month) and by vendor, each split by the exponent bins of the summed
amounts (``exact``). Everything else is merged upwards from these small groups:
  * per account: mean / population sd / min / max / count of abs_amount (z-score), by the
    pairwise rule for means and sums of squares,
  * per vendor key: posting count (new vendor) and disbursement sum (concentration),
  * per account-month: sum of abs_amount (period over period),
  * per (code, name) pair: presence (account mapping check),
  * global: hash-total and cross-footing sums, date counts, max date, basis total.

The aggregate is partial (map-side), so a hot account or vendor holding a
third of the rows costs one hash-map entry per task, not one overloaded task. Results are
small (keys, not rows); they are written under the shared checkpoint folder
(lineage cut, survives executor loss) and each dimension's bytes are measured before it is
broadcast. Dimensions over the limit are joined with a shuffle instead.
"""
from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import DISBURSEMENT_CODE_PATTERN, UNKNOWN_VENDOR
from ..session import materialize as write_table
from .exact import bin_of, bin_value, limb_sums, scaled, sums, total

# A dimension is broadcast only when its measured bytes stay under this; larger ones are
# joined with a shuffle (and AQE's skew-join splitting) instead.
BROADCAST_MAX_BYTES = 256 * 1024 * 1024

MEASURES = ["abs", "basis", "credit"]
_KEYS = ["k_account", "k_code", "k_month", "b_abs", "b_basis", "b_credit", "k_vendor", "k_vendor_null"]
_SETS = {
    "ledger": ["k_account", "k_code", "k_month", "b_abs", "b_basis", "b_credit"],
    "vendor": ["k_vendor", "k_vendor_null", "b_basis"],
}


def _gid(members: list[str]) -> int:
    n = len(_KEYS)
    return sum(1 << (n - 1 - i) for i, k in enumerate(_KEYS) if k not in members)


def disbursement_basis(df: DataFrame) -> Column:
    """debit_amount when the ledger has it, else abs_amount on expense-like codes."""
    if "debit_amount" in df.columns:
        return F.col("debit_amount")
    is_disb = F.coalesce(F.col("account_code").rlike(DISBURSEMENT_CODE_PATTERN), F.lit(False))
    return F.when(is_disb, F.col("abs_amount")).otherwise(F.lit(0.0))


def _as_date_lit(value) -> Column:
    if isinstance(value, dt.datetime):
        return F.expr(f"TIMESTAMP_NTZ '{value.isoformat(sep=' ')}'")
    return F.expr(f"DATE '{value.isoformat()}'")


def period_bounds(period_start, period_end) -> tuple[Column, Column]:
    """Period bounds as literals (dates; a timestamp column compares at midnight)."""
    ps = dt.date.fromisoformat(period_start) if isinstance(period_start, str) else period_start
    pe = dt.date.fromisoformat(period_end) if isinstance(period_end, str) else period_end
    return _as_date_lit(ps), _as_date_lit(pe)


@dataclass
class LedgerStats:
    account: DataFrame          # account_name, acc_mean, acc_sd, acc_min, acc_max, acc_n
    vendor: DataFrame           # vendor_key, vendor_txn_count, vendor_disb
    month: DataFrame            # account_name, month, month_sum, period_over_period_pct
    pair: DataFrame             # account_code, account_name
    global_row: DataFrame | None = None   # the one-row global aggregate, lazily
    globals: dict = field(default_factory=dict)
    sizes: dict = field(default_factory=dict)
    has_debit_credit: bool = False
    period: tuple | None = None

    def dim(self, name: str, max_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
        """A dimension, to be broadcast where its measured bytes allow it."""
        df = getattr(self, name)
        return F.broadcast(df) if self.sizes.get(name, max_bytes + 1) <= max_bytes else df


def _measured(dims: dict[str, tuple[DataFrame, str]]) -> dict[str, int]:
    """Bytes of each dimension: its rows at the width of their numbers, and the bytes of its keys."""
    found = None
    for name, (df, key) in dims.items():
        one = df.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(key)).alias("bytes"))
        found = one if found is None else found.unionAll(one)
    return {r["name"]: r["n"] * (16 + 8 * len(dims[r["name"]][0].columns)) + (r["bytes"] or 0) for r in found.collect()}


def compute_stats(clean: DataFrame, period_start=None, period_end=None) -> LedgerStats:
    has_dc = {"debit_amount", "credit_amount"}.issubset(clean.columns)
    prep = clean.select(
        F.col("account_name").alias("k_account"),
        F.coalesce(F.col("vendor"), F.lit(UNKNOWN_VENDOR)).alias("k_vendor"),
        F.col("vendor").isNull().alias("k_vendor_null"),
        F.trunc(F.col("date"), "month").alias("k_month"),
        F.col("account_code").alias("k_code"),
        F.col("abs_amount").alias("x_abs"),
        disbursement_basis(clean).alias("x_basis"),     # the debit column where there is one
        (F.col("credit_amount") if has_dc else F.lit(None).cast("double")).alias("x_credit"),
        F.col("date"),
    )
    prep = prep.select("*", *[bin_of(F.col(f"x_{m}")).alias(f"b_{m}") for m in MEASURES])
    # before the rows are expanded, and because a bin is NULL outside its grouping sets
    prep = prep.select("*", *[scaled(F.col(f"x_{m}"), F.col(f"b_{m}")).alias(f"y_{m}") for m in MEASURES])
    if period_start is not None and period_end is not None:
        ps, pe = period_bounds(period_start, period_end)
        oob = F.count_if((F.col("date") < ps) | (F.col("date") > pe))
    else:
        oob = F.lit(None).cast("long")

    n = F.count("x_abs")
    agg = write_table(prep.groupingSets(list(_SETS.values()), *_KEYS).agg(
        F.grouping_id().alias("gid"),
        F.count(F.lit(1)).alias("n_rows"),
        n.alias("n"), F.avg("x_abs").alias("mean"), (F.var_pop("x_abs") * n).alias("m2"),
        F.min("x_abs").alias("low"), F.max("x_abs").alias("high"),
        *[limb for m in MEASURES for limb in limb_sums(F.col(f"y_{m}"), m)],
        F.count("date").alias("n_dates"),
        F.max("date").alias("max_date"),
        oob.alias("n_out_of_period"),
    ), "stats")
    ledger, vendors = (agg.filter(F.col("gid") == _gid(m)) for m in _SETS.values())

    # Accounts: groups are merged by the pairwise rule, the sum of squares about the merged mean.
    groups = ledger.filter(F.col("k_account").isNotNull()).withColumnRenamed("k_account", "account_name")
    means = sums(groups, ["account_name"], "b_abs", bin_value("abs"), "_sum", {"acc_n": "n"})
    means = means.withColumn("acc_mean", F.col("_sum") / F.nullif(F.col("acc_n"), F.lit(0)))
    means = write_table(means, "account-means")
    off = F.col("mean") - F.col("acc_mean")
    account = groups.join(means, "account_name").groupBy("account_name").agg(
        F.first("acc_mean").alias("acc_mean"), F.sqrt(F.sum(F.col("m2") + F.col("n") * off * off) / F.first("acc_n")).alias("acc_sd"),
        F.min("low").alias("acc_min"), F.max("high").alias("acc_max"), F.first("acc_n").alias("acc_n"))

    # One vendor dimension keyed like the posting count (NULL vendor shares UNKNOWN): the
    # count covers both, the disbursement sum only rows whose vendor is really the key.
    vendor = sums(vendors.withColumnRenamed("k_vendor", "vendor_key"), ["vendor_key"], "b_basis",
                  F.when(F.col("k_vendor_null"), F.lit(0)).otherwise(bin_value("basis")), "vendor_disb",
                  {"vendor_txn_count": "n_rows"})

    # Previous PRESENT month of the same account; the table is accounts x months, small.
    w = Window.partitionBy("account_name").orderBy("month")
    month = sums(groups.filter(F.col("k_month").isNotNull()).withColumnRenamed("k_month", "month"), ["account_name", "month"], "b_abs",
                 bin_value("abs"), "month_sum").withColumn("prev_sum", F.lag("month_sum").over(w))
    cur, prev = F.col("month_sum"), F.col("prev_sum")
    month = month.select(
        "account_name", "month", "month_sum",
        F.when(prev.isNull(), F.lit(0.0))
         .when((prev == 0) & (cur == 0), F.lit(0.0))
         .when(prev == 0, F.lit(None).cast("double"))       # +inf in the source; NULL at the sink
         .otherwise((cur / prev - 1.0) * 100.0).alias("period_over_period_pct"))
    pair = ledger.filter(F.col("k_code").isNotNull() & F.col("k_account").isNotNull()) \
        .select(F.col("k_code").alias("account_code"), F.col("k_account").alias("account_name")).distinct()

    account, vendor, month = write_table(account, "accounts"), write_table(vendor, "vendors"), write_table(month, "months")
    global_row = write_table(_global(ledger, has_dc), "totals")
    return LedgerStats(account=account, vendor=vendor, month=month, pair=pair, global_row=global_row,
                       globals=global_row.first().asDict(),       # one row
                       sizes=_measured({"account": (account, "account_name"), "vendor": (vendor, "vendor_key"),
                                        "month": (month, "account_name")}),
                       has_debit_credit=has_dc,
                       period=(period_start, period_end) if period_start and period_end else None)


def _global(ledger: DataFrame, has_dc: bool) -> DataFrame:
    """One row: counts and exact totals of the whole ledger; differences of totals are exact as well."""
    counts = ["n_rows", "n_dates", "n_out_of_period"]
    entries = ledger.select(*counts, "max_date", F.explode(F.array(*[
        F.struct(F.lit(m).alias("m"), F.col(f"b_{m}").alias("bin"), bin_value(m).alias("v")) for m in MEASURES])).alias("e"))
    entries = entries.groupBy("e.m", "e.bin").agg(F.sum("e.v").cast("decimal(38,0)").alias("v"), F.max("max_date").alias("max_date"),
                                                  *[F.sum(c).alias(c) for c in counts])
    once = F.when(F.col("m") == MEASURES[0], F.lit(1))      # a ledger row is in one entry of each measure
    bins = entries.agg(*[F.sum(once * F.col(c)).alias(c) for c in counts], F.max("max_date").alias("max_date"),
                       F.collect_list(F.struct("m", "bin", "v")).alias("bins"))     # a row per measure and bin

    def of(plus: list[str], minus: list[str] = []) -> Column:  # noqa: B006
        chosen = F.filter("bins", lambda e: e["m"].isin(plus + minus))
        return total(F.transform(chosen, lambda e: F.struct(e["bin"].alias("bin"), F.when(e["m"].isin(minus), -e["v"]).otherwise(e["v"]).alias("v"))))
    found = {"sum_abs": of(["abs"]), "sum_basis": of(["basis"])}
    if has_dc:
        found |= {"sum_debit": of(["basis"]), "sum_credit": of(["credit"]), "sum_debit_credit": of(["basis", "credit"]),
                  "abs_less_debit_credit": of(["abs"], ["basis", "credit"]), "debit_less_credit": of(["basis"], ["credit"])}
    return bins.select(*[F.coalesce(c, F.lit(0)).alias(c) for c in counts[:2]], "n_out_of_period", "max_date",
                       *[c.alias(k) for k, c in found.items()])
