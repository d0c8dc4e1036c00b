import re

import numpy as np
import xxhash
from helpers import SF, odd_docs

import __spark_entry__ as E
from ledgerlens.llm import simhash as S
from ledgerlens.session import materialize


def fingerprint(text, shingle=3):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    parts = [" ".join(words[i:i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(fps: np.ndarray, radius=2):
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= radius
    label = np.arange(len(fps))
    while True:
        new = np.array([label[near[i]].min() for i in range(len(fps))])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def check(rows, found):
    fps = [fingerprint(t) for _, t in rows]
    label = components(np.array(fps, "u8"))
    low = {}
    for (i, _), c in zip(rows, label, strict=True):
        low[c] = i if low.get(c) is None else low[c] if i is None else min(low[c], i)
    want = sorted(((i, f"{f:016x}", low[c]) for (i, _), f, c in zip(rows, fps, label, strict=True)), key=str)
    assert sorted(map(tuple, found), key=str) == want


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    check([(r.doc_id, r.text) for r in docs.collect()], E.queries()["op3_simhash"](spark, SF).collect())


def test_odd_rows(spark):
    docs = odd_docs(spark, "component_id fingerprint")
    found = S.near_duplicates(docs).collect()
    check([(r.doc_id, r.text) for r in docs.collect()], found)
    kept = S.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len({r.component_id for r in found})
    assert {r.doc_id for r in kept.collect()} == {r.component_id for r in found}
    assert S.near_duplicates(docs.limit(0)).count() == 0 and S.keep_one(docs.limit(0)).count() == 0


def test_bk_tree_finds_every_neighbour():
    rng = np.random.default_rng(0)
    points = np.unique(rng.integers(0, 2**12, 700, dtype="u8") * np.uint64(0x10001))
    tree = S.bk_tree(points)
    for parent, edges in enumerate(tree):       # one child per distance, keyed by it
        assert len({d for d, _ in edges}) == len(edges)
        assert all(int(points[parent] ^ points[c]).bit_count() == d for d, c in edges)
    q, p = S.bk_search(points, tree, points, 2)
    near = np.bitwise_count(points[:, None] ^ points[None, :]) <= 2
    assert set(zip(q.tolist(), p.tolist(), strict=True)) == set(zip(*map(list, near.nonzero()), strict=True))


def test_crowded_shards_lose_no_link(spark):
    rng = np.random.default_rng(1)
    points = []
    for x in rng.integers(0, 2**63, 12, dtype="u8"):
        for _ in range(120):
            y = x
            for b in rng.integers(0, 64, rng.integers(0, 4)):
                y ^= np.uint64(1) << np.uint64(b)
            points.append(y)
    points = np.unique(np.array(points, "u8").view("i8"))
    fps = materialize(spark.createDataFrame([(int(x),) for x in points], "fp long"), "test-fps")
    label = components(points.view("u8"))
    for size in (5000, 10):
        root = {int(x): int(x) for x in points} | {r.u: r.v for r in S.components(S.links(fps, 2, size)).collect()}
        groups = {}
        for x, c in zip(points, label, strict=True):
            groups.setdefault(c, set()).add(root[int(x)])
        assert all(len(g) == 1 for g in groups.values()) and len({min(g) for g in groups.values()}) == len(groups)


def test_long_chain_of_links_is_one_component(spark):
    edges = materialize(spark.range(300).selectExpr("id AS u", "id + 1 AS v"), "chain")
    assert {(r.u, r.v) for r in S.components(edges).collect()} == {(i, 0) for i in range(1, 301)}
