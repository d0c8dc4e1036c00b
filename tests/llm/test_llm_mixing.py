import warnings
from collections import defaultdict

import numpy as np
import pytest
from helpers import odd_docs, same_as_oracle
from pyspark.sql import functions as F

from ledgerlens.llm import mixing as M


def test_oracle(spark):
    same_as_oracle(spark, "op1_mixing")


def expected(rows, key):
    sums = defaultdict(float)
    for r in rows:
        sums[r[key]] += r.probability * r.n_tokens
    total = sum(sums.values())
    return {k: v / total for k, v in sums.items()}


def test_expected_tokens_meet_every_target(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    lang = spark.createDataFrame([("en", 0.5), ("de", 0.3), ("fr", 0.2), ("es", 0.0), ("xx", None)], "level string, share double")
    rows = M.sample(docs, {"lang": lang}).collect()
    got = expected(rows, "lang")
    assert abs(got["en"] - 0.5) < 1e-8 and abs(got["de"] - 0.3) < 1e-8 and got["es"] == 0
    tokens = defaultdict(int)
    for r in rows:
        tokens[r.source] += r.n_tokens
    aim = {k: v ** 0.8 for k, v in tokens.items()}
    for k, v in expected(rows, "source").items():
        assert abs(v - aim[k] / sum(aim.values())) < 1e-6
    assert max(r.probability for r in rows) <= 1 + 1e-12
    kept = sum(r.sampled for r in rows)
    assert abs(kept - sum(r.probability for r in rows)) < 4 * len(rows) ** 0.5


#: The odd table has far too few cells to meet every target.
FEW = M.Mix(max_sweeps=3)


def test_odd_rows(spark):
    docs = odd_docs(spark, "probability sampled")
    found = M.sample(docs, mix=FEW)
    rows = found.collect()
    assert len(rows) == docs.count() and rows[0]["_p"] == "mine" and rows[0]["kept"] == "mine"
    assert all((r.probability == 0) for r in rows if r.n_tokens == 0 and (r.source, r.lang) == ("b", None))
    assert {r.sampled for r in rows if r.doc_id == 5} in ({True}, {False})
    assert found.where("sampled").count() == sum(r.sampled for r in rows)
    again = {(r.doc_id, r.sampled) for r in M.sample(docs.repartition(5), mix=FEW).collect()}
    assert again == {(r.doc_id, r.sampled) for r in rows}
    assert M.sample(docs.limit(0), mix=FEW).count() == 0
    assert M.sample(docs.withColumn("text", F.lit(None).cast("string")), mix=FEW).where("sampled").count() == 0


def nested(spark):
    """Cells of 20 sources, each nearly in one language; one source holds a third of the tokens. The
    targets are the margins of the cells under known factors, so they can be reached."""
    rng = np.random.default_rng(5)
    keys, cells, sums = ["source", "lang", "topic"], [], [defaultdict(float) for _ in range(3)]
    f = [rng.uniform(0.3, 3, 20), rng.uniform(0.3, 3, 4), rng.uniform(0.3, 3, 4)]
    for s in range(20):
        for la in range(4):
            for t in range(4):
                n = int((2e8 if s == 0 else 2e7) * rng.uniform(0.5, 1.5) * (1 if la == s % 4 else 4e-4))
                cells.append((f"s{s}", f"l{la}", f"t{t}", n))
                for d, level in zip(sums, cells[-1], strict=False):
                    d[level] += n * f[0][s] * f[1][la] * f[2][t]
    total = sum(sums[0].values())
    goals = {k: spark.createDataFrame([(x, float(v / total)) for x, v in d.items()], "level string, share double")
             for k, d in zip(keys, sums, strict=True)}
    return spark.createDataFrame(cells, "source string, lang string, topic string, tokens long"), keys, goals


def off_target(cells, keys, goals, factors):
    f = {k: {r.level: r.factor for r in factors[k].collect()} for k in keys}
    aims = {k: {r.level: r.share for r in goals[k].collect()} for k in keys}
    sums = {k: defaultdict(float) for k in keys}
    for r in cells.collect():
        w = r.tokens * f["source"][r.source] * f["lang"][r.lang] * f["topic"][r.topic]
        for k in keys:
            sums[k][r[k]] += w
    return max(abs(v / sum(sums[k].values()) / aims[k][x] - 1) for k in keys for x, v in sums[k].items())


def test_nearly_nested_margins_are_swept_until_they_meet_their_targets(spark):
    cells, keys, goals = nested(spark)
    full = M.rake(cells, keys, goals)
    assert full.sweeps > 25 and full.error < 1e-7 and off_target(cells, keys, goals, full) < 1e-6
    cut = M.rake(cells, keys, goals, M.Mix(max_sweeps=25))
    assert off_target(cells, keys, goals, cut) > 1e-3 and cut.error > 1e-4


def test_contradictory_targets_end_and_are_reported(spark):
    docs = spark.createDataFrame([(i, "word " * 9, "en" if i % 2 else "de", "a" if i % 2 else "b") for i in range(40)],
                                 "doc_id long, text string, lang string, source string")
    goals = {"lang": spark.createDataFrame([("en", 0.8), ("de", 0.2)], "level string, share double"),
             "source": spark.createDataFrame([("a", 0.2), ("b", 0.8)], "level string, share double")}
    with pytest.warns(UserWarning, match="misses its target share by 0.6"):
        assert M.sample(docs, goals).where("sampled").count() > 0
    absent = {"lang": spark.createDataFrame([("en", 0.2), ("de", 0.2), ("xx", 0.6)], "level string, share double")}
    with warnings.catch_warnings():
        warnings.simplefilter("error", UserWarning)
        assert M.sample(docs, absent).count() == 40


def test_both_ways_of_sweeping_agree(spark, monkeypatch):
    cells, keys, goals = nested(spark)
    few = M.Mix(max_sweeps=3)
    a = M.rake(cells, keys, goals, few)
    monkeypatch.setattr(M, "LOCAL_CELLS", 0)
    b = M.rake(cells, keys, goals, few)
    assert a.sweeps == b.sweeps == 3 and abs(a.error - b.error) < 1e-9
    for k in keys:
        x, y = ({r.level: r.log_factor for r in f[k].collect()} for f in (a, b))
        assert x.keys() == y.keys() and max(abs(x[i] - y[i]) for i in x) < 1e-9
