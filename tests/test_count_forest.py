"""The weak-label forest on counts: every row counts, whatever the layout; it is the forest that Spark ML grows."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import count_forest as C
from ledgerlens.operators import similarity as S


@pytest.fixture
def labelled(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(4000, 3))
    rows = [(f"j{i}", float(v[0]), round(float(v[1]), 1), float(v[2] > 0), int(v[0] + 0.3 * v[1] + 0.3 * rng.normal() > 1))
            for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "journal_ref string, a double, b double, c double, fraud_risk_flag int")


COLS = ["a", "b", "c"]


def probabilities(df, model):
    return {r[0]: r[1] for r in S.similarity_score(df, model).select("journal_ref", "fraud_probability").collect()}


def test_a_large_ledger_trains_on_every_row(spark):
    """Above a million rows the forest was trained on a sample."""
    n = 1_100_000
    df = spark.range(n).selectExpr("concat('j', id) AS journal_ref", "CAST(id % 1000 AS double) AS a",
                                   "CAST(id % 1000 < 50 AS int) AS fraud_risk_flag")
    sim = S.train_similarity(df, feature_cols=["a"], num_trees=3, max_depth=2)
    assert sim.info["status"] == "trained" and "train_sample" not in sim.info
    rows = df.select("a", F.col("fraud_risk_flag").alias("_label"))
    blocks, cells = C.cell_blocks(rows, ["a"], C.bin_cuts(rows, ["a"], (10.0, 0.5), 32), 1)
    counted = [sum(np.frombuffer(r[c], np.int64).sum() for r in blocks.collect()) for c in ("pos", "neg")]
    assert counted == [55_000, 1_045_000] and cells <= 32
    scored = probabilities(df.where("journal_ref IN ('j3', 'j900')"), sim)
    assert scored["j3"] > 0.9 and scored["j900"] < 0.1


def test_it_is_spark_ml_s_forest_in_distribution(labelled, monkeypatch):
    whole = S.train_similarity(labelled, feature_cols=COLS, num_trees=200, max_depth=5)
    monkeypatch.setattr(S, "ROWWISE_MAX", 100)
    counted = S.train_similarity(labelled, feature_cols=COLS, num_trees=200, max_depth=5)
    assert isinstance(counted.model, C.CountForest) and not isinstance(whole.model, C.CountForest)
    p, q = probabilities(labelled, whole), probabilities(labelled, counted)
    gaps = [abs(p[k] - q[k]) for k in p]
    assert np.mean(gaps) < 0.025 and np.corrcoef([p[k] for k in p], [q[k] for k in p])[0, 1] > 0.98
    for f in COLS:
        assert abs(whole.info["feature_importance"][f] - counted.info["feature_importance"][f]) < 0.08


def test_layout_and_copies(labelled, monkeypatch):
    monkeypatch.setattr(S, "ROWWISE_MAX", 100)
    monkeypatch.setattr(C, "BLOCK_CELLS", 256)
    twice = labelled.unionAll(labelled)
    found = []
    for layout in (twice, twice.repartition(7, "b"), twice.coalesce(1).orderBy("c")):
        found.append(probabilities(layout, S.train_similarity(layout, feature_cols=COLS, num_trees=6, max_depth=4)))
    assert found[0] == found[1] == found[2] and len(set(found[0].values())) > 20


def test_bins_follow_from_all_rows(spark):
    """Few values get a bin each; many are cut by class weight, whatever their spread."""
    rng = np.random.default_rng(1)
    x = np.concatenate([1e6 + rng.random(20_000) * 1e-3, -rng.lognormal(0, 6, 20_000), [0.0, -0.0, 1e300]])
    rows = spark.createDataFrame([(float(v), float(i % 7), int(i % 10 == 0)) for i, v in enumerate(x)], "x double, few double, _label int")
    cuts, few = C.bin_cuts(rows, ["x", "few"], (5.0, 0.5), 32)
    assert list(few) == [0.5, 1.5, 2.5, 3.5, 4.5, 5.5]
    weight = np.where(np.arange(len(x)) % 10 == 0, 5.0, 0.5)
    per_bin = np.bincount(np.searchsorted(cuts, x, side="left"), weight, 32)
    assert len(cuts) == 31 and np.all(np.abs(per_bin / weight.sum() * 32 - 1) < 0.25)


def test_best_split_by_hand():
    counts = np.zeros((2, 2, 3, 2), int)
    counts[0, 0] = [[8, 0], [2, 5], [0, 15]]         # feature 0 tells the classes apart best after its first bin
    counts[0, 1] = [[5, 10], [5, 10], [0, 0]]
    counts[1, 0] = [[3, 0], [0, 4], [0, 0]]          # too few rows for two children of five
    counts[1, 1] = [[3, 4], [0, 0], [0, 0]]
    found = C.best_splits(counts, (1.0, 1.0), 5)
    gini = lambda a, b: 1 - (a * a + b * b) / (a + b) ** 2
    by_cut = [gini(10, 20) - (8 * gini(8, 0) + 22 * gini(2, 20)) / 30, gini(10, 20) - (15 * gini(10, 5) + 15 * gini(0, 15)) / 30]
    assert list(found["j"]) == [0, -1] and found["cut"][0] == int(np.argmax(by_cut)) and abs(found["gain"][0] - max(by_cut)) < 1e-12
    assert (found["pos"][0], found["neg"][0], found["left_pos"][0], found["left_neg"][0]) == (10, 20, 8, 0)


def test_a_cell_is_walked_once_and_keeps_the_walk_s_result(monkeypatch):
    from ledgerlens.operators import iforest as I
    rng = np.random.default_rng(2)
    feature = rng.integers(0, 4, (9, 15)).astype(np.int32)
    threshold = np.where(rng.random((9, 15)) < 0.2, np.inf, np.round(rng.normal(size=(9, 15)), 2))
    nodes = {"feature": feature, "threshold": threshold, "bottom": rng.random((9, 16)), "depth": 4}
    X = np.round(rng.normal(size=(3000, 4)), 2)         # many values lie on a threshold
    X[:, 1:] = np.sign(X[:, 1:])
    plain = I._path_lengths(nodes, None, 4, X)
    walked = []
    walk = I._path_lengths
    monkeypatch.setattr(I, "_path_lengths", lambda n, r, d, x: walked.append(len(x)) or walk(n, r, d, x))
    cells = I.ForestCells(nodes, 4)
    for part in (X[:1000], X, X[::-1]):
        whole = cells.means(part)
    assert np.array_equal(whole[::-1], plain) and 0 < sum(walked) < 1200
    n = sum(walked)
    cells.means(X)
    assert sum(walked) == n                             # nothing is walked again
    monkeypatch.setattr(I, "KEPT_CELLS", 10)            # more cells than are kept: the same result
    assert np.array_equal(I.ForestCells(nodes, 4).means(X), plain)
    far = nodes | {"threshold": np.linspace(-3, 3, 135).reshape(9, 15)}
    monkeypatch.setattr(I, "KEPT_CELLS", 1 << 21)
    wide = I.ForestCells(far, 4)
    wide.limits = [(f, np.unique(np.concatenate([t, np.linspace(4, 5, 1 << 17)]))) for f, t in wide.limits]     # codes of over 62 bits
    assert np.array_equal(wide.means(X), walk(far, None, 4, X)) and any(len(s.codes) for s in wide.stages)
