"""Approximate nearest neighbours by learned partitions.

``fit`` takes a hash sample of up to about ``sample_rows`` distinct vectors, builds their
neighbour graph, cuts it into equal parts by recursive bisection (spectral order, then
exchanges that shorten the cut and keep the balance) and trains a small network that
predicts, for a vector, the parts of its neighbours. Only that sample reaches the driver.

How many parts a query is sent to is measured, not set: the fewest that reach the neighbours
of sample vectors held out of training ``target_recall`` of the time. Vectors without cluster
structure need most parts, well-clustered ones a few.

``search`` indexes every vector under its most probable part and sends each query to its
most probable parts, where it is compared with all their vectors: exact cosine in
double precision. The work is a grid of blocks: (part, block of its vectors, block of its
queries), so a part of any size is spread over tasks and no task grows. Equal vectors are one
candidate that keeps its smallest ids (the results plus one), which loses no result, because
ties go to smaller ids. The best rows of each block meet per query.

Defined cases: vectors of any finite size count alike (they are scaled by powers of two before any product);
vectors that are null, zero, of another length than most, or that hold null or
non-finite components take no part; a query never finds its own id; equal rows count once; rows
that share an id but differ are separate queries; a query whose most probable parts hold too few
candidates goes to further parts; an empty table gives an empty result; other columns are not
read.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.session import materialize


@dataclass(frozen=True)
class Settings:
    sample_rows: int = 8192         # vectors that reach the driver, about (hash sample)
    part_rows: int = 256            # sample vectors a part, at least
    max_parts: int = 32
    neighbours: int = 10
    hidden: int = 128
    epochs: int = 10
    target_recall: float = 0.95     # of held-out sample vectors' neighbours, sets the probes
    block_rows: int = 2048          # vectors a task compares
    query_rows: int = 2048          # queries a task compares


@dataclass(frozen=True)
class Router:
    """A network of one hidden layer: log probabilities of the parts."""
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    probes: int = 1

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(unit(x) @ self.w1 + self.b1, 0) @ self.w2 + self.b2


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times powers of two that bring their greatest component near one: cosines stay the same to the
    last bit, and neither squares nor products overflow or vanish."""
    x = x.astype("f8")
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def nearest(x: np.ndarray, rows: np.ndarray, k: int, step: int = 128) -> np.ndarray:
    """The k most similar of the unit vectors to each of ``rows`` (itself left out), a few rows at a time."""
    out = []
    for some in np.split(rows, range(step, len(rows), step)):
        s = -(x[some] @ x.T)
        s[np.arange(len(s)), some] = 2
        out.append(np.argpartition(s, k - 1, axis=1)[:, :k].astype("i4"))
    return np.concatenate(out)


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    return nearest(x, np.arange(len(x)), k)


def bisect(rows: np.ndarray, u: np.ndarray, v: np.ndarray, x: np.ndarray, steps: int = 60) -> np.ndarray:
    """Half of ``rows`` marked True, with few of the edges (u, v), given as places in rows, cut."""
    n = len(rows)
    degree = np.bincount(u, minlength=n) + np.bincount(v, minlength=n) + 1e-9
    centred = x[rows] - x[rows].mean(axis=0)
    order = centred @ np.linalg.svd(centred.T @ centred)[0][:, 0]
    for _ in range(steps):      # power steps towards the second eigenvector of the random walk
        order = order - np.average(order, weights=degree)
        spread = np.bincount(u, order[v], n) + np.bincount(v, order[u], n)
        order = 0.5 * order + 0.5 * spread / degree
        order /= np.abs(order).max() + 1e-300
    side = np.zeros(n, bool)
    side[np.argsort(order, kind="stable")[n // 2:]] = True
    for _ in range(8):          # exchange equally many rows that would gain most on the other side
        cross = (side[u] != side[v]).astype("f8") * 2 - 1
        gain = np.bincount(u, cross, n) + np.bincount(v, cross, n)
        a, b = (np.flatnonzero((side == s) & (gain > 0)) for s in (True, False))
        m = min(len(a), len(b)) // 2
        if not m:
            break
        a, b = (z[np.argsort(-gain[z], kind="stable")[:m]] for z in (a, b))
        side[a], side[b] = False, True
    return side


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int) -> np.ndarray:
    """Part number of each row; parts is a power of two and all parts are equally large."""
    label = np.zeros(len(x), "i8")
    u = np.repeat(np.arange(len(x)), graph.shape[1])
    v = graph.ravel()
    while parts > 1:
        new = label * 2
        for one in np.unique(label):
            rows = np.flatnonzero(label == one)
            place = np.full(len(x), -1)
            place[rows] = np.arange(len(rows))
            inside = (place[u] >= 0) & (place[v] >= 0)
            new[rows] += bisect(rows, place[u[inside]], place[v[inside]], x)
        label, parts = new, parts // 2
    return label


def train(x: np.ndarray, target: np.ndarray, hidden: int, epochs: int, seed: int = 0) -> Router:
    """Adam on the cross entropy to the target distribution over parts."""
    rng = np.random.default_rng(seed)
    w = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], hidden)) * 2, np.zeros(hidden),
         rng.normal(0, hidden ** -0.5, (hidden, target.shape[1])), np.zeros(target.shape[1])]
    m, s, t = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for a in range(0, len(x), 128):
            own, goal = x[order[a:a + 128]], target[order[a:a + 128]]
            pre = own @ w[0] + w[1]
            mid = np.maximum(pre, 0)
            out = mid @ w[2] + w[3]
            p = np.exp(out - out.max(axis=1, keepdims=True))
            d = (p / p.sum(axis=1, keepdims=True) - goal) / len(own)
            back = (d @ w[2].T) * (pre > 0)
            t += 1
            for i, g in enumerate((own.T @ back, back.sum(axis=0), mid.T @ d, d.sum(axis=0))):
                m[i] = 0.9 * m[i] + 0.1 * g
                s[i] = 0.999 * s[i] + 0.001 * g * g
                w[i] = w[i] - 0.003 * (m[i] / (1 - 0.9 ** t)) / (np.sqrt(s[i] / (1 - 0.999 ** t)) + 1e-8)
    return Router(*w)


def usable(v: Column) -> Column:
    """Not null, not empty, not zero, all components finite."""
    good = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return v.isNotNull() & F.coalesce(good, F.lit(False)) & F.exists(v, lambda c: c != 0)


def fit(distinct: DataFrame, count: int, cfg: Settings = Settings()) -> Router | None:
    """Router for the distinct vectors (``v``); None where one part holds all."""
    share = min(1.0, cfg.sample_rows / max(count, 1))
    limit = int(share * 2**63) - 1
    rows = distinct.where(F.abs(F.xxhash64("v")) <= F.lit(limit)).select("v").toPandas()["v"]
    parts = 1
    while parts * 2 <= min(cfg.max_parts, len(rows) // cfg.part_rows):
        parts *= 2
    if parts == 1:
        return None
    x = unit(np.stack(rows.sort_values(key=lambda s: s.map(lambda v: tuple(v))).to_numpy()))
    graph = neighbour_graph(x, cfg.neighbours)
    label = balanced_parts(x, graph, parts)
    target = np.zeros((len(x), parts))
    np.add.at(target, (np.repeat(np.arange(len(x)), graph.shape[1]), label[graph].ravel()), 1.0)
    target[np.arange(len(x)), label] += 1.0
    target /= target.sum(axis=1, keepdims=True)
    held = np.arange(len(x)) % 8 == 0
    router = train(x[~held], target[~held], cfg.hidden, cfg.epochs)
    found = router(x).argmax(axis=1)[nearest(x, np.flatnonzero(held), 5)]
    order = np.argsort(-router(x[held]), axis=1, kind="stable")
    reached = (order[:, None, :] == found[:, :, None]).mean(axis=(0, 1)).cumsum()
    return replace(router, probes=int((reached < cfg.target_recall).sum()) + 1)


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype("f8").reshape(len(column), -1)


def routed(rows: DataFrame, router: Router | None, most: int, sizes: list[int] | None = None, need: int = 0) -> DataFrame:
    """Add ``parts``: the ``most`` most probable parts of ``v``, and further ones until the parts
    hold ``need`` vectors by ``sizes``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(batch.schema.get_field_index("v")))
            order = np.argsort(-router(x), axis=1, kind="stable") if router else np.zeros((len(x), 1), "i8")
            n = np.full(len(x), min(most, order.shape[1]))
            if sizes is not None:
                held = np.cumsum(np.array(sizes)[order], axis=1)
                n = np.maximum(n, np.minimum((held < need).sum(axis=1) + 1, order.shape[1]))
            found = pa.array([o[:k].tolist() for o, k in zip(order, n, strict=True)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, found], [*batch.schema.names, "parts"])
    from pyspark.sql.types import ArrayType, IntegerType
    return rows.mapInArrow(run, rows.select("*").schema.add("parts", ArrayType(IntegerType())))


def per_part(rows: DataFrame) -> dict[int, int]:
    return {r[0]: r[1] for r in rows.groupBy("part").count().collect()}      # at most max_parts rows


def blocks(sizes: dict[int, int], rows: int) -> Column:
    """Number of blocks of ``rows`` rows of the part."""
    pairs = [F.lit(x) for k, n in sizes.items() for x in (k, -(-n // rows))]
    return F.coalesce(F.create_map(*pairs)[F.col("part")], F.lit(1)) if pairs else F.lit(1)


def compare(queries: pd.DataFrame, points: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best rows of one block for each query."""
    out = pd.DataFrame({"query_id": [], "query": [], "vec_id": [], "score": []}).astype(
        {"query_id": "i8", "query": "i8", "vec_id": "i8", "score": "f8"})
    if not len(queries) or not len(points):
        return out
    q, p = (scaled(np.stack(x["v"].to_numpy())) for x in (queries, points))
    qn, pn = (np.sqrt((x * x).sum(axis=1)) for x in (q, p))
    near = (q @ p.T) / qn[:, None] / pn
    width = min(k + 1, len(p))
    least = -np.partition(-near, width - 1, axis=1)[:, width - 1] - 1e-9
    found = []
    for i in range(len(q)):
        at = np.flatnonzero(near[i] >= least[i])
        score = (p[at] * q[i]).sum(axis=1) / (qn[i] * pn[at])       # summed alike for equal vectors
        rows = [(-s, vec) for s, j in zip(score, at, strict=True) for vec in points["ids"].iat[j]
                if vec != queries["query_id"].iat[i]]
        found += [(queries["query_id"].iat[i], queries["query"].iat[i], vec, -s) for s, vec in sorted(rows)[:k]]
    return pd.DataFrame(found, columns=out.columns).astype(out.dtypes) if found else out


def search(vectors: DataFrame, is_query: Column, k: int = 5, cfg: Settings = Settings()) -> DataFrame:
    """query_id, rank, vec_id and score: the k nearest found of every row that ``is_query`` marks,
    against all other rows of ``vectors`` (``vec_id``, ``embedding``)."""
    rows = vectors.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull())
    sized = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    rows = rows.where(F.size("embedding") == (sized["d"] if sized else 0))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v"),
                       is_query.alias("asks")).distinct()
    rows = materialize(rows, "vectors")
    # The smallest ids of equal vectors: Spark cuts each group before it is shuffled.
    same = Window.partitionBy("v").orderBy("vec_id")
    points = (rows.select("v", "vec_id").withColumn("n", F.row_number().over(same)).where(F.col("n") <= k + 1)
              .groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")))
    points = materialize(points, "points")
    router = fit(points, points.count(), cfg)
    index = materialize(routed(points, router, 1).select("v", "ids", F.col("parts")[0].alias("part")), "index")
    sizes = per_part(index)
    parts = len(router.b2) if router else 1
    asked = rows.where("asks").select(F.col("vec_id").alias("query_id"), F.xxhash64("v").alias("query"), "v")
    asked = routed(asked, router, router.probes if router else 1, [sizes.get(i, 0) for i in range(parts)], k + 2)
    asked = materialize(asked.select("query_id", "query", "v", F.explode("parts").alias("part")), "queries")
    asked_sizes = per_part(asked)
    chunk = F.pmod(F.xxhash64("query_id", "query"), blocks(asked_sizes, cfg.query_rows)).cast("int")
    block = F.pmod(F.xxhash64("v"), blocks(sizes, cfg.block_rows)).cast("int")
    left = asked.withColumn("chunk", chunk).withColumn("block", F.explode(F.sequence(
        F.lit(0), (blocks(sizes, cfg.block_rows) - 1).cast("int"))))
    right = index.withColumn("block", block).withColumn("chunk", F.explode(F.sequence(
        F.lit(0), (blocks(asked_sizes, cfg.query_rows) - 1).cast("int"))))
    keys = ["part", "block", "chunk"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(
        lambda q, p: compare(q, p, k), "query_id long, query long, vec_id long, score double")
    best = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
