"""Exact sums of doubles: integer limbs binned by exponent.

A double is dealt to a bin by its exponent (24 binary orders each) and cut into four integer limbs of
20 bits there, without a remainder. Limbs of one bin add up as plain long sums, in any order and with
partial aggregates; a bin holds 2^43 rows. The sums of all bins of a key are one integer times a power
of two, which is rounded once: the result is the correctly rounded exact sum (that of ``math.fsum``), for any
finite doubles. A sum beyond the doubles is infinite.
"""
from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

BIN_BITS = 24
LIMB_BITS = 20
UNIT_BITS = 56      # a limb of the lowest place counts 2^-56 of its bin's 2^(24 bin)
LIMBS = 4


def bin_of(x: Column) -> Column:
    """The exponent bin of a double; missing values and zeros go to bin 0."""
    return F.coalesce(F.when(x != 0, F.floor(F.log2(F.abs(x)) / BIN_BITS)), F.lit(0)).cast("int")


def scaled(x: Column, bin_: Column) -> Column:
    """A double over its bin's power of two: of size 1 to 2^24, about."""
    half = F.pow(F.lit(2.0), -(BIN_BITS // 2) * bin_)
    return x * half * half      # both steps are exact for any double


def limb_sums(y: Column, name: str) -> list[Column]:
    """Aggregates ``name_0`` (lowest) to ``name_3`` of ``scaled`` values of one bin."""
    out = []
    for k in range(LIMBS):
        limb = y * 2.0 ** (UNIT_BITS - LIMB_BITS * k)
        if k < LIMBS - 1:
            limb = limb % 2.0 ** LIMB_BITS
        out.append(F.sum(limb.cast("long")).alias(f"{name}_{k}"))
    return out


def bin_value(name: str) -> Column:
    """The limb sums of one bin as one integer."""
    return sum((F.coalesce(F.col(f"{name}_{k}"), F.lit(0)).cast("decimal(19,0)") * F.lit(str(1 << LIMB_BITS * k)).cast("decimal(19,0)")
                for k in range(1, LIMBS)), F.coalesce(F.col(f"{name}_0"), F.lit(0)).cast("decimal(38,0)")).cast("decimal(38,0)")


@F.pandas_udf(DoubleType())
def total(entries: pd.Series) -> pd.Series:
    """The correctly rounded sum of (``bin``, ``v``) entries, one list a row."""
    def one(parts) -> float:
        parts = [(int(p["bin"]), int(p["v"])) for p in parts if p["v"]]
        if not parts:
            return 0.0
        low = min(b for b, _ in parts)
        n, shift = sum(v << BIN_BITS * (b - low) for b, v in parts), BIN_BITS * low - UNIT_BITS
        try:
            return float(n << shift) if shift >= 0 else n / (1 << -shift)      # Python rounds both correctly
        except OverflowError:
            return float("inf") if n > 0 else float("-inf")
    return entries.map(one)


def sums(binned: DataFrame, keys: list[str], bin_: str, value: Column, out: str, counts: dict[str, str] | None = None) -> DataFrame:
    """keys, ``out`` (the exact sum of ``value``, integers of the bins ``bin_``) and plain sums of ``counts`` (name: column)."""
    counts = counts or {}
    by_bin = binned.groupBy(*keys, F.col(bin_).alias("bin")).agg(
        F.sum(value).cast("decimal(38,0)").alias("v"), *[F.sum(c).alias(name) for name, c in counts.items()])
    return by_bin.groupBy(*keys).agg(F.collect_list(F.struct("bin", "v")).alias("_bins"), *[F.sum(name).alias(name) for name in counts]) \
        .select(*keys, total("_bins").alias(out), *counts)


def sum_by(df: DataFrame, keys: list[str], x: str, out: str) -> DataFrame:
    """The exact sum of the double column ``x`` for each key."""
    binned = df.select(*keys, x, bin_of(F.col(x)).alias("_bin")).select(*keys, "_bin", scaled(F.col(x), F.col("_bin")).alias("_y"))
    binned = binned.groupBy(*keys, "_bin").agg(*limb_sums(F.col("_y"), "_l"))
    return sums(binned, keys, "_bin", bin_value("_l"), out)
