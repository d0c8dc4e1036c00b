import re
import zlib

import numpy as np
from helpers import WORDS, base_counts, odd_docs
from pyspark.sql import functions as F

import __spark_entry__ as E
from ledgerlens.llm import classifier as C
from ledgerlens.llm.quality_rules import CLASS_RUNS


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    found = E.queries()["op5_classifier"](spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert found.count() == docs.count()
    rows = found.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in rows) >= 0.97 * len(rows)
    low = [r.score for r in rows if r.quality == 0]
    assert low and sum(a.score > b for a in rows if a.quality for b in low) >= 0.98 * len(low) * sum(r.quality for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


def test_held_out_rows_do_not_matter(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    turned = labels.withColumn("quality", F.when(C.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert C.fit(docs, labels) == C.fit(docs, turned)


def test_odd_rows_and_labels(spark):
    docs = odd_docs(spark, "predicted")
    none = spark.createDataFrame([], "doc_id long, quality int")
    scored = C.score(docs, C.fit(docs, none)).collect()
    assert len(scored) == docs.count() and {r.score for r in scored} == {0.5} and scored[0]["_x"] == "mine"
    one = spark.createDataFrame([(5, 1), (8, 1), (None, 0), (7, None)], "doc_id long, quality int")
    assert {r.score for r in C.score(docs, C.fit(docs, one)).collect()} == {1.0}
    both = spark.createDataFrame([(i, int(i < 9)) for i in range(1, 15)] + [(9, 1), (9, 1)], "doc_id long, quality int")
    model = C.fit(docs, both)
    scores = {}
    for r in C.score(docs, model).collect():
        assert 0 <= r.score <= 1
        scores.setdefault(r.text or "", set()).add(r.score)
    assert all(len(x) == 1 for x in scores.values())        # null as empty, repeats alike
    assert C.score(docs.limit(0), model).count() == 0


def test_score_is_the_density_ratio():
    rng = np.random.default_rng(0)
    bins = [(float(x), int(rng.random() < 1 / (1 + np.exp(-(0.5 * x - 1)))), 1) for x in rng.normal(0, 5, 4000)]
    a, b = C.calibrate(bins)
    assert abs(a - 0.5) < 0.1 and abs(b + 1) < 0.3


def statistics(text):
    text = text or ""
    words, (_, chars, _, dup_lines, repeats) = WORDS.findall(text), base_counts(text)
    n = {k: len(re.sub(runs, "", text)) for k, runs in CLASS_RUNS.items()}
    w, c, lines = max(len(words), 1), max(chars, 1), text.count("\n") + 1
    logs = [len(words), chars / w, 1000 * n["symbol"] / c, 100 * dup_lines / lines, 100 * repeats / w, 100 * n["upper"] / c,
            1000 * n["digit"] / c, 100 * n["punct"] / c, 100 * n["wide"] / c]
    return [*np.log1p(logs), len(set(words)) / w, np.log1p(len(words) / lines)]


def test_fit_and_scores_equal_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    truth = {r.doc_id: r.quality for r in labels.collect() if r.quality is not None}
    x = {k: np.array(statistics(t)) for k, t in texts.items()}
    learnt = [k for k in texts if k in truth and zlib.crc32(str(k).encode()) % 3 != 1]
    density = {k: [] for k in texts}
    for y in (0, 1):
        own = np.array([x[k] for k in learnt if truth[k] == y])
        cov = np.cov(own.T, bias=True)
        cov = 0.95 * cov + 0.05 * np.trace(cov) / len(cov) * np.eye(len(cov))
        for k in texts:
            away = x[k] - own.mean(axis=0)
            density[k].append(np.log(len(own) / len(learnt)) - np.linalg.slogdet(cov)[1] / 2 - away @ np.linalg.solve(cov, away) / 2)
    apart = {k: b - a for k, (a, b) in density.items()}
    model = C.fit(docs, labels)
    # slope and intercept are where the penalised likelihood of the rounded differences is flat
    d = np.array([round(min(60.0, max(-60.0, apart[k])), 1) for k in learnt])
    miss = 1 / (1 + np.exp(-np.clip(model.slope * d + model.intercept, -30, 30))) - np.array([truth[k] for k in learnt])
    assert abs((miss * d).sum() + 1e-3 * (model.slope - 1)) < 0.05 and abs(miss.sum() + 1e-3 * model.intercept) < 0.05
    for r in C.score(docs, model).collect():
        want = 1 / (1 + np.exp(-min(700, max(-700, model.slope * apart[r.doc_id] + model.intercept))))
        assert abs(r.score - want) < 1e-9 and r.predicted == (r.score >= 0.5)
