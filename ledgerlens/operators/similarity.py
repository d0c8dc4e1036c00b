"""Weak-label similarity layer: a random forest trained on the rule label
(``fraud_risk_flag``) over continuous/structural features that exclude the five flags.

The forest trains on every row, level by level on executors: Spark ML's ``RandomForestClassifier`` up to
``ROWWISE_MAX`` rows, above that the same forest on the counts of all rows (``count_forest``), whose passes cost
by distinct rows of bins. Class balance comes from a weight ``w_c = n / (2 n_c)``. The score is
``P(class 1)``; it is 0 for every row when training is skipped. Guards:
``skipped_no_label_column``, ``skipped_no_features``, ``skipped_insufficient_positives``
and (ours) ``skipped_single_class``.
"""
from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import (FOREST_MAX_DEPTH, FOREST_MIN_LEAF, FOREST_TREES, MIN_POSITIVE_EXAMPLES,
                         SUPERVISED_FEATURES)
from ..session import materialize
from .count_forest import MAX_CODE, CountForest, fit_count_forest
from .iforest import content_key, forest_mean_column, numbered_copies


@dataclass
class SimilarityModel:
    model: RandomForestClassificationModel | CountForest | None
    feature_cols: list[str]
    info: dict = field(default_factory=dict)


def _finite(c: str) -> Column:
    x = F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(0.0)).otherwise(x)


# Spark ML passes over every row for every tree and level; above this many rows the passes run
# over the counts of equal rows of bins. Every row counts either way.
ROWWISE_MAX = 1_000_000
TRAIN_PARTITIONS = 32


def training_rows(feat: DataFrame, available: list[str], y: Column, shares: tuple[float, float] | None,
                  seed: int) -> DataFrame:
    """``_content``, ``_copy``, ``_label`` and the features of the rows to train on: every row, or by
    class the given shares (positive, negative). A row is drawn by a seeded hash of its content and
    its number among exact copies, so copies are drawn like other rows, whatever the layout."""
    rows = numbered_copies(feat.select(content_key(feat).alias("_content"), y.alias("_label"),
                                       *[_finite(c).alias(c) for c in available]))
    if shares is None:
        return rows
    h = F.xxhash64(F.col("_content"), F.col("_copy"), F.lit(seed), F.lit("similarity"))

    def cut(share: float) -> int:       # the whole 64-bit hash, so the share holds at any size
        return min(int(share * 2.0 ** 64) - 2 ** 63, 2 ** 63 - 1)
    return rows.filter(F.when(F.col("_label") == 1, h <= F.lit(cut(shares[0]))).otherwise(h <= F.lit(cut(shares[1]))))


def laid_out(rows: DataFrame, available: list[str]) -> DataFrame:
    """Spark ML draws its bootstrap per partition: the same rows in the same partitions and order,
    whatever the input's layout, give the same forest. Copies of a row are spread over the partitions."""
    order = ["_content", "_copy", "_label", *available]
    return rows.repartition(TRAIN_PARTITIONS, *order).sortWithinPartitions(*order)


def train_similarity(feat: DataFrame, label_col: str = "fraud_risk_flag",
                     feature_cols: list[str] | None = None, seed: int = 42,
                     num_trees: int = FOREST_TREES, max_depth: int = FOREST_MAX_DEPTH,
                     min_leaf: int = FOREST_MIN_LEAF, max_bins: int = 32,
                     counts: tuple[int, int] | None = None,
                     train_row_limit: int | None = None) -> SimilarityModel:
    """Train on all rows. Only a caller that asks for it (``train_row_limit``) gets a forest trained on a
    class-stratified sample; the review does not."""
    feature_cols = list(feature_cols or SUPERVISED_FEATURES)
    info: dict = {"status": "trained", "feature_cols": feature_cols, "label_col": label_col}
    if label_col not in feat.columns:
        info.update(status="skipped_no_label_column", reason=f"{label_col!r} not in dataframe")
        return SimilarityModel(None, feature_cols, info)
    available = [c for c in feature_cols if c in feat.columns]
    if not available:
        info.update(status="skipped_no_features",
                    reason="none of the supervised feature columns are present")
        return SimilarityModel(None, feature_cols, info)
    info["feature_cols"] = available
    y = F.coalesce(F.col(label_col), F.lit(0)).cast("int")
    if counts is None:
        r = feat.agg(F.count_if(y == 1).alias("p"), F.count_if(y == 0).alias("n")).collect()[0]
        counts = (int(r["p"]), int(r["n"]))
    n_pos, n_neg = counts
    info["n_positive"], info["n_negative"] = n_pos, n_neg
    if n_pos < MIN_POSITIVE_EXAMPLES:
        info.update(status="skipped_insufficient_positives",
                    reason=f"only {n_pos} positive examples (need >= {MIN_POSITIVE_EXAMPLES})")
        return SimilarityModel(None, available, info)
    if n_neg == 0:
        info.update(status="skipped_single_class", reason="every row carries the label")
        return SimilarityModel(None, available, info)

    n = n_pos + n_neg
    if train_row_limit is None and n > ROWWISE_MAX and max_bins ** len(available) <= MAX_CODE // 2:
        rows = feat.select(*[_finite(c).alias(c) for c in available], y.alias("_label"))
        model = fit_count_forest(rows, available, counts, seed=seed, num_trees=num_trees, max_depth=max_depth,
                                 min_leaf=min_leaf, max_bins=max_bins)
        info["feature_importance"] = {f: float(v) for f, v in zip(available, model.importances)}
        return SimilarityModel(model, available, info)
    shares, drawn = None, counts
    if train_row_limit is not None and n > train_row_limit:
        # Bernoulli per class; the weights follow from the rows drawn, so each class keeps its
        # balanced share of total weight.
        half = train_row_limit / 2.0
        shares = min(1.0, half / n_pos), min(1.0, half / n_neg)
    rows = training_rows(feat, available, y, shares, seed)
    if shares is not None:
        rows = materialize(rows, "similarity-rows")
        drawn = rows.agg(F.count_if(F.col("_label") == 1), F.count_if(F.col("_label") != 1)).first()
        info["train_sample"] = {"p_positive": shares[0], "p_negative": shares[1],
                                "n_positive": drawn[0], "n_negative": drawn[1]}
    w_pos, w_neg = (n / (2.0 * max(k, 1)) for k in drawn)
    train = laid_out(rows, available).select(
        *available, F.col("_label").cast("double").alias("_label"),
        F.when(F.col("_label") == 1, F.lit(w_pos)).otherwise(F.lit(w_neg)).alias("_w"))
    vec = VectorAssembler(inputCols=available, outputCol="_features").transform(train)
    rf = RandomForestClassifier(
        featuresCol="_features", labelCol="_label", weightCol="_w", numTrees=num_trees,
        maxDepth=max_depth, minInstancesPerNode=min_leaf, maxBins=max_bins, seed=seed,
        featureSubsetStrategy=str(max(1, int(len(available) ** 0.5))), bootstrap=True,
        subsamplingRate=1.0, maxMemoryInMB=256, cacheNodeIds=True, checkpointInterval=10)
    model = rf.fit(vec)
    info["feature_importance"] = {f: float(v) for f, v in zip(available, model.featureImportances.toArray())}
    return SimilarityModel(model, available, info)


def similarity_score(df: DataFrame, sim: SimilarityModel, out: str = "fraud_probability") -> DataFrame:
    """Adds ``fraud_probability`` = P(class 1), or 0.0 for all rows when untrained."""
    if sim.model is None:
        return df.withColumn(out, F.lit(0.0))
    if isinstance(sim.model, CountForest):
        return df.withColumn(out, forest_mean_column(sim.model.nodes, [_finite(c) for c in sim.feature_cols], df.sparkSession))
    cols = df.columns
    tmp = [f"_sim_{c}" for c in sim.feature_cols]
    x = df.select("*", *[_finite(c).alias(t) for c, t in zip(sim.feature_cols, tmp)])
    vec = VectorAssembler(inputCols=tmp, outputCol="_features").transform(x)
    m = sim.model.copy()
    m.setFeaturesCol("_features").setProbabilityCol("_prob").setRawPredictionCol("_raw") \
     .setPredictionCol("_pred")
    scored = m.transform(vec)
    return scored.select(*[F.col(f"`{c}`") for c in cols],
                         vector_to_array(F.col("_prob"))[1].alias(out))


def feature_importance(sim: SimilarityModel, spark) -> DataFrame:
    rows = sorted((sim.info.get("feature_importance") or {}).items(), key=lambda kv: -kv[1])
    return spark.createDataFrame(rows, "feature string, importance double")
