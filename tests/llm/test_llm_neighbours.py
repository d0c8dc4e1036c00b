import numpy as np
import pytest

import __spark_entry__ as E
from ledgerlens.llm import neighbours as N


def exact(ids, x, queries, k=5):
    n = np.sqrt((x * x).sum(axis=1))
    out = {}
    for q in queries:
        s = np.round(x @ x[q] / n / n[q], 12)
        out[ids[q]] = [ids[j] for j in np.lexsort((ids, -s)) if ids[j] != ids[q]][:k]
    return out


def test_recall(spark):
    sf = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], "f8")
    want = exact(ids, x, np.flatnonzero(ids % 50 == 0))
    got = {}
    place = {v: i for i, v in enumerate(ids)}
    for r in E.queries()["op2_neighbours"](spark, sf).collect():
        got.setdefault(r.query_id, {})[r.rank] = r.vec_id
        a, b = x[place[r.query_id]], x[place[r.vec_id]]
        assert abs(r.score - a @ b / np.linalg.norm(a) / np.linalg.norm(b)) < 1e-12
    assert got.keys() == want.keys() and all(sorted(v) == [1, 2, 3, 4, 5] for v in got.values())
    found = sum(len(set(got[q].values()) & set(v)) for q, v in want.items())
    assert found >= 0.9 * sum(map(len, want.values()))


def test_routing_recall_with_many_parts(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(40, 16))
    x = centres[rng.integers(0, 40, 2000)] + 0.3 * rng.normal(size=(2000, 16))
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    cfg = N.Settings(part_rows=60, block_rows=50, query_rows=7)
    got = {}
    for r in N.search(df, df["vec_id"] % 50 == 0, 5, cfg).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    want = exact(np.arange(2000), x, range(0, 2000, 50))
    assert sum(len(got[q] & set(v)) for q, v in want.items()) >= 0.9 * 5 * len(want)
    points = N.unit(x)
    graph = N.neighbour_graph(points, 10)
    parts = N.balanced_parts(points, graph, 16)
    assert set(np.bincount(parts)) == {125}
    inside = (parts[graph] == parts[:, None]).mean()
    assert inside > 0.5         # chance is 1/16
    router = N.fit(df.selectExpr("embedding AS v"), 2000, cfg)
    assert router.probes < 16


@pytest.mark.parametrize("size", [1e200, 1e-200, 5e-324])
def test_large_and_tiny_components(spark, size):
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(60, 4)) * 1000)
    df = spark.createDataFrame([(i, [float(c * size) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in sorted(N.search(df, df["vec_id"] % 20 == 0).collect()):
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == exact(np.arange(60), x, (0, 20, 40))


def test_odd_rows_ties_and_copies(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (50, [1.0, 1.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, [0.0, 0.0]),
            (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (9, [1.0, 2.0, 3.0]), (None, [1.0, 0.0]), (10, []), (3, [0.0, 1.0])]
    rows += [(100 + i, [1.0, 0.0]) for i in range(1, 40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "'mine' AS part", "'mine' AS v", "1 AS rank")
    got = {}
    for r in N.search(df, df["vec_id"] % 50 == 0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, round(r.score, 9)))
    assert sorted(got[0]) == [(1, 1, 1.0), (2, 2, 1.0), (3, 101, 1.0), (4, 102, 1.0), (5, 103, 1.0)]
    assert [v for _, v, _ in sorted(got[50])] == [0, 1, 2, 3, 101] and set(got) == {0, 50}
    few = df.where("vec_id in (0, 3)")
    assert [(r.query_id, r.rank, r.vec_id) for r in N.search(few, few["vec_id"] == 0).collect()] == [(0, 1, 3)]
    none = df.limit(0)
    assert N.search(none, none["vec_id"] == 0).count() == 0
