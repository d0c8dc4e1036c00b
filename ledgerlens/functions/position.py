"""Global row positions after a sort, without a single-partition window.

``orderBy`` range-partitions and sorts; each row then carries its partition index and
its index within the partition. Per-partition counts (one row per partition) give prefix
offsets; position = offset[partition] + index in partition. The sorted rows are written
once so counting and numbering see the same partitioning.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize


def with_position(df: DataFrame, order: list[Column | str], name: str = "position") -> DataFrame:
    s = df.orderBy(*order).select("*", F.spark_partition_id().alias("_pid"),
                                  F.monotonically_increasing_id().alias("_mid"))
    s = materialize(s, "sorted")
    counts = s.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)   # over partitions only
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    local = F.col("_mid") - F.shiftleft(F.col("_pid").cast("long"), 33)
    return (s.join(F.broadcast(offsets), "_pid")
            .withColumn(name, F.col("_off") + local)
            .drop("_pid", "_mid", "_off"))
