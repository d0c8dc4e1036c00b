import math

import numpy as np
import pytest
from helpers import same_as_oracle
from pyspark.sql import functions as F

from ledgerlens.llm import hard_negatives as H


def mined(rows, asks, n_positives=5, n_negatives=10, low=30, high=90):
    """Brute force in Python integers: rows of (id, label, vector)."""
    rows = sorted(set((i, l, tuple(v)) for i, l, v in rows if i is not None and l is not None and v is not None and None not in v))
    out = []
    for i, label, v in rows:
        if not asks(i):
            continue
        scored = [(-sum(a * b for a, b in zip(v, w, strict=True)), j, l) for j, l, w in rows if j != i]
        for s, p, _ in sorted(x for x in scored if x[2] == label)[:n_positives]:
            fit = sorted(x for x in scored if x[2] != label and low * -s <= 100 * -x[0] <= high * -s)
            out += [(i, p, k, n, -s, -t) for k, (t, n, _) in enumerate(fit[:n_negatives], 1)]
    return sorted(out)


@pytest.mark.parametrize("width,most", [(1, 1), (3, 2**27), (64, 300), (200, 5000), (70, 2**20)])
def test_products_are_exact(width, most):
    rng = np.random.default_rng(width)
    a, b = (rng.integers(-most, most, (20, width), endpoint=True) for _ in range(2))
    a[0], b[0], b[1] = most, most, -most
    moduli = H.primes(most * most * width)
    want = [[sum(x * y for x, y in zip(r, s, strict=True)) for s in b.tolist()] for r in a.tolist()]
    assert H.product(H.residues(a, moduli), H.residues(b, moduli), moduli).tolist() == want
    assert all(H.WIDTH * (p // 2) ** 2 < 2**24 for p in moduli) and math.prod(moduli) > 2 * most * most * width


def test_first_takes_ties_in_order():
    rng = np.random.default_rng(0)
    for n in (0, 1, 9, 200):
        s = rng.integers(0, 5, n)
        assert H.first(s, 10).tolist() == sorted(range(n), key=lambda i: (-s[i], i))[:10]


@pytest.mark.parametrize("block_rows", [50, 1 << 17])
def test_against_brute_force(spark, block_rows):
    rng = np.random.default_rng(1)
    rows = [(i, int(rng.integers(0, 4)), rng.integers(-9, 30, 7).tolist()) for i in range(400)]
    rows += [(1000 + i, 1, rows[0][2]) for i in range(200)]       # a third are one vector
    df = spark.createDataFrame(rows, "vec_id long, label int, v array<long>")
    got = H.mine(df, df["vec_id"] % 50 == 0, block_rows=block_rows)
    want = mined(rows, lambda i: i % 50 == 0)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 400


def test_odd_rows(spark):
    rows = [(0, 1, [3, 4]), (0, 1, [3, 4]), (0, 2, [1, 1]), (1, 1, [2, 2]), (2, 1, [2, 2]), (3, 2, [1, 2]), (4, 2, [1, 2]), (None, 2, [1, 2]),
            (5, None, [1, 2]), (6, 2, None), (7, 2, [None, 1]), (9, 1, [0, 0]), (10, 1, [-3, -4]), (11, 2, [0, 0])]
    df = spark.createDataFrame(rows + [(8, 2, [1, 2, 3]), (12, 2, [])], "vec_id long, label int, v array<long>").selectExpr(
        "*", "'mine' AS row", "'mine' AS score", "'mine' AS cell", "0 AS n")
    got = sorted(map(tuple, H.mine(df, df["vec_id"] == 0).collect()))
    assert got == mined(rows, lambda i: i == 0) and len(got) > 5
    assert H.mine(df.limit(0), df["vec_id"] == 0).count() == 0
    with pytest.raises(ValueError, match="2.56"):
        H.mine(spark.createDataFrame([(0, 1, [2**40])], "vec_id long, label int, v array<long>"), F.col("vec_id") == 0)


def test_query_equals_sql(spark):
    same_as_oracle(spark, "op11_hard_negatives", ("embeddings",), "/root/testdata/sf0.01")


def test_query_leaves_out_rows_that_are_not_finite(spark, tmp_path):
    import __spark_entry__ as E
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [0.5, 0.25]), (1, 1, [0.5, 0.5]), (2, 2, [1.5, 1.5]), (3, 2, [nan, 1.0]), (4, 2, [inf, 1.0]), (5, 2, [-inf, 0.1]),
            (6, 2, [None, 0.1]), (7, 0, [0.5, 0.2]), (8, 2, [0.3, 0.3])]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = sorted(map(tuple, E.queries()["op11_hard_negatives"](spark, str(tmp_path)).collect()))
    whole = [(i, (l + 1) % 10 if i % 7 == 0 else l, [math.floor(256 * float(np.float32(c))) for c in v])
             for i, l, v in rows if i not in (3, 4, 5, 6)]
    assert got == mined(whole, lambda i: i % 100 == 0) and got
