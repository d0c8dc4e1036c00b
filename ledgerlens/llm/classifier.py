"""Quality classifier: regularised quadratic discriminant over document statistics.

``fit`` gathers, in one aggregate per class, the count, the sums and the cross products of
the transformed statistics of all labelled training rows, and forms class means and
covariances shrunk towards a scaled identity. Each covariance is factored once (Cholesky);
the model keeps the inverse factors, so a score needs a triangular product per class:
log-density difference = half the difference of the squared Mahalanobis lengths and log
determinants, plus the log prior ratio. Document statistics have heavier tails than a
normal density, so the difference is calibrated by a logistic line (slope and intercept,
fitted to its histogram over the training rows) before it becomes a score. Only numbers of
fixed size (classes x statistics^2, histogram bins) reach the driver; scoring is a column
expression.

Only the text is an input of a score. Defined cases: null texts score as empty ones; rows
of ``labels`` with a null label or id are not used; an id with several labels takes their
majority, ties to 1; with no labels every score is 0.5, with one class only it is 0 or 1;
an empty table gives an empty result; repeated rows are scored alike.
"""
from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.quality_rules import CLASSES, with_classes
from ledgerlens.llm.textstats import pinned, with_base, with_words
from ledgerlens.session import materialize

STATISTICS = ["length", "word_length", "symbols", "dup_lines", "repeats", "upper", "digits",
              "marks", "wide", "distinct", "line_length"]
#: Log-density differences are clipped to this for the calibration histogram (0.1 a bin).
LIMIT = 60.0


@dataclass(frozen=True)
class Model:
    means: dict[int, list[float]]       # per class
    factors: dict[int, list[list[float]]]   # inverse Cholesky factors, lower triangular
    offsets: dict[int, float]           # log prior minus half the log determinant
    slope: float = 1.0
    intercept: float = 0.0


def with_statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """Add ``_x``, the array of transformed statistics in the order of STATISTICS."""
    df = with_classes(with_base(with_words(df, text)))
    df = df.withColumn("_d", F.size(F.array_distinct("_w"))).withColumn(
        "_l", F.length("_t") - F.length(F.regexp_replace("_t", "\n", "")) + 1)
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    per_class = dict(zip(CLASSES, (F.col("_c")[i] for i in range(len(CLASSES))), strict=True))
    x = [F.log1p("n_words"), F.log1p(F.col("word_chars") / words),
         F.log1p(1000 * per_class["symbol"] / chars), F.log1p(100 * F.col("n_dup_lines") / F.col("_l")),
         F.log1p(100 * F.col("n_repeat_words") / words), F.log1p(100 * per_class["upper"] / chars),
         F.log1p(1000 * per_class["digit"] / chars), F.log1p(100 * per_class["punct"] / chars),
         F.log1p(100 * per_class["wide"] / chars), F.col("_d") / words,
         F.log1p(F.col("n_words") / F.col("_l"))]
    return df.withColumn("_x", F.array(*[c.cast("double") for c in x]))


def calibrate(bins: list[tuple[float, int, int]], steps: int = 50) -> tuple[float, float]:
    """Slope and intercept of the logistic line over (difference, label, count), by Newton
    steps with a small ridge towards (1, 0)."""
    x, y, n = (np.array(v, float) for v in zip(*bins, strict=True))
    a, b, ridge = 0.2, 0.0, 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = np.array([(n * (p - y) * x).sum() + ridge * (a - 1), (n * (p - y)).sum() + ridge * b])
        w = n * p * (1 - p)
        h = np.array([[(w * x * x).sum() + ridge, (w * x).sum()], [(w * x).sum(), w.sum() + ridge]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 0.5 / max(abs(step[0]), abs(step[1]) / 10, 1e-12))
        a, b = max(a - step[0], 1e-3), b - step[1]
    return float(a), float(b)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3 == 1


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", shrinkage: float = 0.05) -> Model:
    """Fit on every labelled row that is not held out. The statistics are computed before the
    join with the labels, so that the join moves numbers and no texts."""
    d = len(STATISTICS)
    truth = (labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
             .groupBy(F.col("doc_id").alias("_id"))
             .agg((F.avg(F.col(label)) >= 0.5).cast("int").alias("_y")))
    rows = docs.select(F.col("doc_id").alias("_id"), "text").where(~held_out(F.col("_id")))
    rows = with_statistics(rows).select("_id", "_x")
    rows = materialize(rows.join(truth, "_id").select("_x", "_y"), "labelled")
    pairs = [(i, j) for i in range(d) for j in range(i + 1)]
    sums = [F.sum(F.col("_x")[i]).alias(f"s{i}") for i in range(d)]
    squares = [F.sum(F.col("_x")[i] * F.col("_x")[j]).alias(f"q{i}_{j}") for i, j in pairs]
    found = rows.groupBy("_y").agg(F.count("*").alias("n"), *sums, *squares).collect()
    total = sum(r["n"] for r in found)
    means, factors, offsets = {}, {}, {}
    for r in found:
        mean = np.array([r[f"s{i}"] for i in range(d)]) / r["n"]
        cov = np.zeros((d, d))
        for i, j in pairs:
            cov[i, j] = cov[j, i] = r[f"q{i}_{j}"] / r["n"] - mean[i] * mean[j]
        scale = max(np.trace(cov) / d, 1e-6)
        cov = (1 - shrinkage) * cov + shrinkage * scale * np.eye(d)
        lower = np.linalg.cholesky(cov)
        means[r["_y"]] = mean.tolist()
        factors[r["_y"]] = np.linalg.inv(lower).tolist()
        offsets[r["_y"]] = float(np.log(r["n"] / total) - np.log(np.diag(lower)).sum())
    model = Model(means, factors, offsets)
    if len(means) < 2:
        return model
    width = F.round(F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), difference(model))), 1)
    bins = rows.groupBy(width.alias("x"), "_y").count().collect()
    return replace(model, **dict(zip(("slope", "intercept"), calibrate([tuple(r) for r in bins]), strict=True)))


def difference(model: Model) -> Column:
    """Log density of class 1 less that of class 0, each with its prior."""
    density = {}
    for y, mean in model.means.items():
        diff = [F.col("_x")[i] - mean[i] for i in range(len(mean))]
        rows = [sum((diff[j] * row[j] for j in range(1, i + 1)), diff[0] * row[0])
                for i, row in enumerate(model.factors[y])]
        density[y] = F.lit(model.offsets[y]) - sum((z * z for z in rows[1:]), rows[0] * rows[0]) / 2
    return density[1] - density[0]


def score_column(model: Model) -> Column:
    if not model.means:
        return F.lit(0.5)
    if len(model.means) == 1:
        return F.lit(float(next(iter(model.means))))
    return 1 / (1 + F.exp(-(model.slope * difference(model) + model.intercept)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Add ``score`` (0 to 1, higher: label 1 likelier) and ``predicted`` to every row;
    columns of those names are replaced, all others kept whatever their names."""
    docs = docs.drop("score", "predicted")
    df = with_statistics(docs.select(F.struct("*").alias("_row"), "text"))
    df = df.withColumn("score", pinned(score_column(model).cast("double")))
    return df.select("_row.*", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
