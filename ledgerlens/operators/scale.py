"""standard_scale: (x - mean) / population sd per column, NULL -> 0, constant column -> 0.

One global aggregate (partial per task) gives the moments; they come back as a single
row of literals, so scaling is a projection with no join. Spark ML's StandardScaler
uses the sample sd and does not centre by default, hence this operator.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def standard_scale(df: DataFrame, cols: list[str]) -> DataFrame:
    x = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in cols}
    moments = df.agg(*[F.avg(x[c]).alias(f"m{i}") for i, c in enumerate(cols)],
                     *[F.stddev_pop(x[c]).alias(f"s{i}") for i, c in enumerate(cols)],
                     *[F.min(x[c]).alias(f"lo{i}") for i, c in enumerate(cols)],
                     *[F.max(x[c]).alias(f"hi{i}") for i, c in enumerate(cols)]).collect()[0]
    out = []
    for i, c in enumerate(cols):
        m, s = moments[f"m{i}"], moments[f"s{i}"]
        if m is None or s is None or moments[f"lo{i}"] == moments[f"hi{i}"] or s == 0:
            out.append(F.lit(0.0).alias(c))
        else:
            out.append(((x[c] - F.lit(m)) / F.lit(s)).alias(c))
    keep = [F.col(f"`{c}`") for c in df.columns if c not in cols]
    return df.select(*keep, *out)
