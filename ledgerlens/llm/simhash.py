"""SimHash near-dedup: fingerprints linked through BK-trees, components by star contraction.

1. ``fingerprints``: one 64-bit SimHash per whole text (an Arrow UDF over the bytes).
2. Equal fingerprints meet in one row (partial aggregates), so exact copies cost nothing
   further, however many there are.
3. Shards: the 64 bits are cut into ``max_distance + 2`` blocks. Two fingerprints within the
   distance agree on two blocks at least, so each goes to one shard for every pair of blocks
   and no link can be lost. A shard over ``shard_rows`` is dealt anew by six of eight blocks
   (``max_distance`` 2; all but ``max_distance`` of finer blocks in general): 16 bits are then
   free, so no shard can hold over 65,536 fingerprints.
4. Each shard's task builds a BK-tree (children keyed by their integer Hamming distance to
   the parent) and searches it with all fingerprints of the shard at once, following only
   edges within ``max_distance`` of the query's distance to the node. The links of a shard
   leave it as one star per connected group, never as all pairs. The trees travel to their
   queries by the shard key and are not broadcast through the driver: together they hold
   every fingerprint of the corpus.
5. ``components``: alternating large-star and small-star steps join the stars; each step is a
   table in the checkpoint folder. Two numbers per step reach the driver.

Defined cases: null and empty texts and texts without words have fingerprint zero and are
linked like any other; texts of fewer words than a shingle hash the whole sequence; a null
id never becomes the component's id unless all its ids are null; ``keep_one`` keeps the
smallest id, of rows that share it an arbitrary one (nulls last); an empty table gives an
empty result; columns of any other names pass through.
"""
from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.session import materialize

SEED = 42
CHUNK = 1 << 16


def simhash(raw: bytes | None, shingle: int) -> int:
    """Fingerprint of one text as a signed 64-bit number."""
    import xxhash
    words = (raw or b"").lower().split()    # bytes: A-Z only, and the six ASCII white spaces
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return int(np.array([xxhash.xxh64_intdigest(joined, SEED)], "u8").view("i8")[0])
    size = np.fromiter(map(len, words), "i8", len(words))
    end = np.cumsum(size + 1) - 1
    start = (end - size)[:len(words) - shingle + 1].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(start, end[shingle - 1:].tolist(), strict=True)),
                         "u8", len(start))
    ones = np.zeros(64, "i8")
    for k in range(0, len(hashes), CHUNK):
        part = hashes[k:k + CHUNK].view("u1").reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype="i8")
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, out: str = "_fp") -> DataFrame:
    """Add the fingerprint of ``text`` as a signed long."""
    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([simhash(x, shingle) for x in texts], dtype="int64")
    return docs.withColumn(out, of(F.col("text").cast("binary")))


def hex_digits(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def shard_keys(fp: str, blocks: int, agree: int) -> Column:
    """One key for every choice of ``agree`` of ``blocks`` blocks; a key keeps the fingerprint's
    bits in the chosen blocks and the number of the choice."""
    edge = [round(64 * k / blocks) for k in range(blocks + 1)]
    keys = []
    for n, chosen in enumerate(combinations(range(blocks), agree)):
        mask = sum(((1 << edge[k + 1]) - (1 << edge[k])) for k in chosen)
        signed = mask - (1 << 64) if mask >= 1 << 63 else mask
        keys.append(F.struct(F.lit(n).alias("choice"), F.col(fp).bitwiseAND(F.lit(signed)).alias("bits")))
    return F.explode(F.array(*keys))


def bk_tree(points: np.ndarray) -> list[list[tuple[int, int]]]:
    """Children of every point as (distance to the parent, child): the tree that inserting
    the points in order gives; point 0 is the root."""
    children: list[list[tuple[int, int]]] = [[] for _ in points]
    todo = [np.arange(len(points))]
    while todo:
        own = todo.pop()
        node, rest = int(own[0]), own[1:]
        if len(rest):
            d = np.bitwise_count(points[rest] ^ points[node])
            for edge in np.unique(d):
                below = rest[d == edge]
                children[node].append((int(edge), int(below[0])))
                todo.append(below)
    return children


def bk_search(points: np.ndarray, children, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, point) index pairs within the radius; each node is met once with all queries
    that reach it."""
    found_q, found_p = [], []
    todo = [(0, np.arange(len(queries)))] if len(points) else []
    while todo:
        node, at = todo.pop()
        d = np.bitwise_count(queries[at] ^ points[node]).astype("i4")
        hit = at[d <= radius]
        found_q.append(hit)
        found_p.append(np.full(len(hit), node))
        for edge, child in children[node]:
            on = at[np.abs(d - edge) <= radius]
            if len(on):
                todo.append((child, on))
    empty = np.zeros(0, "i8")
    return np.concatenate([empty, *found_q]), np.concatenate([empty, *found_p])


def stars(points: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of one shard as (member, smallest member of its connected group)."""
    points = np.unique(points)
    bits = points.view("u8")
    q, p = bk_search(bits, bk_tree(bits), bits, radius)
    label = np.arange(len(points))
    while True:
        low = np.minimum(label[q], label[p])
        new = label.copy()
        np.minimum.at(new, q, low)
        np.minimum.at(new, p, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(points))
    return points[moved], points[label[moved]]


def shard_links(keyed: DataFrame, radius: int) -> DataFrame:
    """Star edges (u, v) of all shards of ``keyed`` (``k``, ``fp``); a task meets its shards in
    key order and holds one."""
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: tuple | None = None       # the shard that the last batch left open
        def out(found):
            u = np.concatenate([x for x, _ in found])
            v = np.concatenate([x for _, x in found])
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])
        for batch in batches:
            choice, bits, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            if kept is not None:
                choice, bits, fp = (np.concatenate(x) for x in zip(kept, (choice, bits, fp), strict=True))
            cut = np.flatnonzero((choice[1:] != choice[:-1]) | (bits[1:] != bits[:-1])) + 1
            begin = np.concatenate([[0], cut])
            size = np.diff(np.concatenate([begin, [len(fp)]]))
            kept = tuple(x[begin[-1]:].copy() for x in (choice, bits, fp)) if len(fp) else None
            found = [stars(fp[b:b + n], radius) for b, n in
                     zip(begin[:-1], size[:-1], strict=True) if n > 1]
            if found:
                yield out(found)
        if kept is not None and len(kept[2]) > 1:
            yield out([stars(kept[2], radius)])
    return (keyed.select("k.choice", "k.bits", "fp").repartition("choice", "bits").sortWithinPartitions("choice", "bits")
            .mapInArrow(search, "u long, v long"))


def links(fps: DataFrame, max_distance: int = 2, shard_rows: int = 1024) -> DataFrame:
    """Star edges (u, v) that connect exactly the fingerprints linked within ``max_distance``.
    ``fps`` has one row per distinct fingerprint (``fp``)."""
    blocks, fine_blocks = max_distance + 2, 4 * max_distance
    keyed = fps.select("fp", shard_keys("fp", blocks, 2).alias("k"))
    large = materialize(keyed.groupBy("k").agg(F.count("*").alias("n"))
                        .where(F.col("n") > shard_rows).select("k"), "large-shards")
    if large.isEmpty():
        return shard_links(keyed, max_distance).distinct()
    # Any two fingerprints that share a large shard are both dealt anew, so it can go whole.
    again = keyed.join(large, "k", "left_semi").select("fp").distinct()
    again = again.select("fp", shard_keys("fp", fine_blocks, fine_blocks - max_distance).alias("k"))
    rest = keyed.join(large, "k", "left_anti")
    return (shard_links(rest, max_distance).union(shard_links(again, max_distance)).distinct())


def _marks(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(u, v): every node of the links and the smallest node it can reach, itself left out."""
    def low(e, name):
        return materialize(e.groupBy("u").agg(F.min("v").alias("m")), name)
    edges = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), "links")
    was = None
    while (now := _marks(edges)) != was:
        was = now
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(low(both, "large-low"), "u").where(F.col("v") > F.col("u")).select(
            F.col("v").alias("u"), F.least("m", "u").alias("v"))
        large = materialize(large.distinct(), "large-star")
        least = low(large, "small-low")
        small = (large.join(least, "u").where(F.col("v") != F.col("m")).select(
            F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))))
        edges = materialize(small.distinct(), "small-star")
    return edges


def classes(rows: DataFrame, max_distance: int = 2) -> DataFrame:
    """Per distinct fingerprint of ``rows`` (``_fp``, ``_id``): ``fp``, ``root`` (its component)
    and ``component_id`` (the component's smallest id)."""
    fps = materialize(rows.groupBy(F.col("_fp").alias("fp")).agg(F.min("_id").alias("id")), "fingerprints")
    reach = components(links(fps.select("fp"), max_distance)).select(
        F.col("u").alias("fp"), F.col("v").alias("root"))
    rooted = materialize(fps.join(reach, "fp", "left").select(
        "fp", "id", F.coalesce("root", "fp").alias("root")), "rooted")
    ids = rooted.groupBy("root").agg(F.min("id").alias("component_id"))
    return materialize(rooted.join(ids, "root").select("fp", "root", "component_id"), "classes")


def near_duplicates(docs: DataFrame, shingle: int = 3, max_distance: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row of ``docs``."""
    rows = fingerprints(docs.select(F.col("doc_id").alias("_id"), "text"), shingle)
    rows = materialize(rows.select("_id", "_fp"), "simhash")
    found = classes(rows, max_distance)
    return rows.join(found, rows["_fp"] == found["fp"]).select(
        F.col("_id").alias("doc_id"), hex_digits(F.col("_fp")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = 3, max_distance: int = 2) -> DataFrame:
    """The rows of ``docs`` with the smallest id of each component, one row each. The texts are
    written once, with a row number that makes repeated ids distinct."""
    rows = fingerprints(docs.select(F.struct("*").alias("_doc"), "text", F.col("doc_id").alias("_id"),
                                    F.monotonically_increasing_id().alias("_n")), shingle)
    rows = materialize(rows.drop("text"), "simhash-rows")
    narrow = rows.select("_id", "_n", "_fp")
    found = classes(narrow, max_distance)
    first = F.min(F.struct(F.col("_id").isNull(), "_id", "_n"))
    # per fingerprint first: the copies of one text are then a single row before the join
    per_fp = materialize(narrow.groupBy(F.col("_fp").alias("fp")).agg(first.alias("w")), "first-rows")
    winners = (per_fp.join(found, "fp").groupBy("root").agg(F.min("w").alias("w"))
               .select(F.col("w")["_n"].alias("_n")))
    return rows.join(winners, "_n", "left_semi").select("_doc.*")
