"""The weak-label forest gives the same probabilities whatever the layout of its input."""
import numpy as np

from ledgerlens.operators.similarity import similarity_score, train_similarity


def test_forest_does_not_depend_on_the_layout(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 3))
    rows = [(i, f"j{i}", *map(float, v), int(v[0] + 0.3 * v[1] > 1)) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "row_id long, journal_ref string, a double, b double, c double, fraud_risk_flag int")
    found = []
    for layout in (df.repartition(3), df.repartition(7, "b"), df.coalesce(1).orderBy("c").selectExpr(
            "row_id + 1000 AS row_id", "journal_ref", "a", "b", "c", "fraud_risk_flag")):
        model = train_similarity(layout, feature_cols=["a", "b", "c"], num_trees=8, max_depth=4)
        assert model.info["status"] == "trained"
        scored = similarity_score(layout, model).select("journal_ref", "fraud_probability").collect()
        found.append({r[0]: r[1] for r in scored})
    assert found[0] == found[1] == found[2]


def test_copies_are_drawn_and_spread_like_other_rows(spark):
    from pyspark.sql import functions as F

    from ledgerlens.operators import similarity as S
    n, limit = 30_000, 6_000
    df = spark.range(n).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 'copy' ELSE concat('j', id) END AS journal_ref",
        "CASE WHEN id % 3 = 0 THEN -1D ELSE CAST(id AS double) END AS a",
        "CAST(id % 30 = 1 AS int) AS fraud_risk_flag")
    model = train_similarity(df, feature_cols=["a"], num_trees=2, max_depth=2, train_row_limit=limit)
    drawn = model.info["train_sample"]
    assert drawn["n_positive"] == 1_000 and abs(drawn["n_negative"] - limit / 2) < 250
    shares = drawn["p_positive"], drawn["p_negative"]
    found = []
    for layout in (df, df.repartition(5, "a")):
        rows = S.training_rows(layout, ["a"], F.col("fraud_risk_flag"), shares, 42)
        assert abs(rows.where("a < 0").count() / (10_000 * shares[1]) - 1) < 0.1
        parts = S.laid_out(rows, ["a"]).where("a < 0").groupBy(F.spark_partition_id().alias("p")).count().collect()
        assert len(parts) == S.TRAIN_PARTITIONS and max(r["count"] for r in parts) < 100
        found.append(sorted((r._content, r._copy) for r in rows.collect()))
    assert found[0] == found[1] and len(found[0]) == drawn["n_positive"] + drawn["n_negative"]
