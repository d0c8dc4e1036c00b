"""Hard-negative mining: exact integer inner products by residues, then windowed selection.

Vectors of integers are multiplied as component matrices modulo several small primes. The
residues are centred and columns are taken ``WIDTH`` at a time, so every partial sum is an integer
below 2^24 and float32 multiplication is exact. The mixed-radix form of Chinese remaindering
with centred digits gives the signed scores; as many primes are taken as the measured greatest
component calls for.

The work is blocks of rows against all anchors (``cells.meet``): a block's rows reach one task
once, the anchors pass through it in batches, and only the best rows of each block go on. A
first pass finds every anchor's positives, among the rows of its label; a second one, given
their scores, finds the negatives among the rows of other labels: the first ``n_negatives`` whose
score lies between ``low`` and ``high`` hundredths of the positive's, limits included. Rows are dealt to blocks by
a hash of the whole row, so no label, vector or id makes a block larger than the others.

Defined cases: rows whose id, label or vector is null, whose vector holds a null or is of
another length than most take no part; exact repeats count once; rows that share an id but differ
are rows of their own, and an anchor never takes a row of its own id; ties go to the smaller id;
an anchor without positives or without negatives in a window gives no rows; an empty table gives
an empty result; other columns are not read. Components over 2^31 or scores that could pass
2^56 raise an error before any score is formed.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.cells import field, meet, numbers
from ledgerlens.session import materialize

WIDTH = 64                          # columns multiplied before residues are taken again
HALF = int(np.sqrt(2**24 / WIDTH))  # greatest centred residue: WIDTH squares of it stay exact
TILE = 1 << 22                      # scores formed at a time
BLOCK_ROWS = 1 << 17


def primes(bound: int) -> list[int]:
    """The greatest odd primes with residues up to ``HALF`` whose product exceeds twice the bound."""
    out, product, p = [], 1, 2 * HALF + 1
    while product <= 2 * bound + 1:
        p -= 2
        if all(p % d for d in range(3, int(p**0.5) + 1, 2)):
            out.append(p)
            product *= p
    return out


def centred(x: np.ndarray, p: int) -> np.ndarray:
    """Residues between -(p-1)/2 and (p-1)/2."""
    x = x.astype("f8")
    return x - p * np.rint(x / p)


def residues(x: np.ndarray, moduli: list[int]) -> list[np.ndarray]:
    """One float32 matrix of centred residues for each modulus."""
    return [centred(x, p).astype("f4") for p in moduli]


def product(a: list[np.ndarray], b: list[np.ndarray], moduli: list[int]) -> np.ndarray:
    """The exact signed products of the rows of two matrices given by their residues."""
    digits: list[np.ndarray] = []
    out, weight = np.int64(0), 1
    for x, y, p in zip(a, b, moduli, strict=True):
        digit = np.float64(0)
        for k in range(0, max(x.shape[1], 1), WIDTH):
            digit = centred(digit + (x[:, k:k + WIDTH] @ y[:, k:k + WIDTH].T).astype("f8"), p)
        for q, d in zip(moduli, digits, strict=False):      # mixed radix: take off what is known, divide
            digit = centred(centred(digit - d, p) * pow(q, -1, p), p)
        digits.append(digit)
        out = out + digit.astype("i8") * np.int64(weight)
        weight *= p
    return out


def first(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k greatest scores, greatest first, ties by place."""
    at = np.arange(len(scores))
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        above = np.flatnonzero(scores > least)
        at = np.sort(np.concatenate([above, np.flatnonzero(scores == least)[:k - len(above)]]))
    return at[np.argsort(-scores[at], kind="stable")]


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


class Block:
    """The rows of one block, in the order of their labels and ids, with their residues."""

    def __init__(self, rows: pa.StructArray, moduli: list[int], by_label: bool):
        ids, label = numbers(rows, "vec_id"), numbers(rows, "label")
        order = np.lexsort((ids, label) if by_label else (ids,))
        self.ids, self.label = ids[order], label[order]
        self.x = residues(matrix(field(rows, "v"))[order], moduli)


def batch_of(columns: list[list], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, "i8"), *c]), pa.int64()) for c in columns], names)


def near_positives(moduli: list[int], k: int):
    names = ["anchor_id", "row", "positive_id", "score"]

    def search(block: Block, rows: pa.StructArray) -> pa.RecordBatch:
        ids, row, label = (numbers(rows, c) for c in ("anchor_id", "row", "label"))
        x, out = residues(matrix(field(rows, "v")), moduli), [[], [], [], []]
        for one in np.unique(label):
            a, b = np.searchsorted(block.label, [one, one + 1])
            own, own_ids = [y[a:b] for y in block.x], block.ids[a:b]
            asked, step = np.flatnonzero(label == one), max(1, TILE // max(1, b - a))
            for at in (asked[s:s + step] for s in range(0, len(asked) if b > a else 0, step)):
                for i, scores in zip(at, product([y[at] for y in x], own, moduli), strict=True):
                    other = np.flatnonzero(own_ids != ids[i])
                    best = other[first(scores[other], k)]
                    for c, v in zip(out, (np.full(len(best), ids[i]), np.full(len(best), row[i]), own_ids[best], scores[best]), strict=True):
                        c.append(v)
        return batch_of(out, names)
    return search


def negatives_in_windows(moduli: list[int], k: int, low: int, high: int):
    names = ["anchor_id", "row", "n", "positive_id", "positive_score", "negative_id", "score"]

    def search(block: Block, rows: pa.StructArray) -> pa.RecordBatch:
        ids, row, label = (numbers(rows, c) for c in ("anchor_id", "row", "label"))
        positives = field(rows, "positives").to_pylist()
        x, out, step = residues(matrix(field(rows, "v")), moduli), [[] for _ in names], max(1, TILE // len(block.ids))
        for s in range(0, len(ids), step):
            for i, scores in enumerate(product([y[s:s + step] for y in x], block.x, moduli), s):
                windows = [(p["n"], p["positive_id"], p["score"], -(-low * p["score"] // 100), high * p["score"] // 100) for p in positives[i]]
                least, most = min(w[3] for w in windows), max(w[4] for w in windows)
                at = np.flatnonzero((scores >= least) & (scores <= most) & (block.label != label[i]) & (block.ids != ids[i]))
                for place, positive, score, a, b in windows:
                    own = at[(scores[at] >= a) & (scores[at] <= b)]
                    best = own[first(scores[own], k)]
                    same = [np.full(len(best), v) for v in (ids[i], row[i], place, positive, score)]
                    for c, v in zip(out, (*same, block.ids[best], scores[best]), strict=True):
                        c.append(v)
        return batch_of(out, names)
    return search


def mine(vectors: DataFrame, is_anchor: Column, n_positives: int = 5, n_negatives: int = 10, low: int = 30, high: int = 90,
         block_rows: int = BLOCK_ROWS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score for the anchors of
    ``vectors`` (``vec_id``, ``label``, ``v``: whole numbers) that ``is_anchor`` marks, against all its rows."""
    whole = F.coalesce(F.forall("v", lambda c: c.isNotNull()), F.lit(False))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "v",
                          F.coalesce(is_anchor, F.lit(False)).alias("asks")).where(whole & F.col("vec_id").isNotNull() & F.col("label").isNotNull())
    sized = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.max(F.array_max(F.transform(
        "v", lambda c: F.abs(c)))).alias("most")).orderBy(F.desc("n"), "d").first()     # a row per length
    width, most = (sized["d"], int(sized["most"] or 0)) if sized else (0, 0)
    bound = most * most * width
    if most >= 2**31 or bound >= 2**56:
        raise ValueError(f"components up to {most} in {width} columns: scores could pass 2^56")
    moduli = primes(bound)
    rows = rows.where(F.size("v") == width).withColumn("v", F.col("v").cast("array<int>")).distinct()
    rows = materialize(rows.withColumn("row", F.xxhash64("vec_id", "label", "v")), "mining-rows")
    count = rows.count()
    tasks = 2 * rows.sparkSession.sparkContext.defaultParallelism
    blocks = max(-(-count // block_rows), min(-(-count // 4096), tasks), 1)
    points = rows.select(F.pmod("row", F.lit(blocks)).alias("cell"), "vec_id", "label", "v")
    each = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("cell")
    anchors = rows.where("asks").select(F.col("vec_id").alias("anchor_id"), "row", "label", "v")
    key = ["anchor_id", "row"]

    found = meet(points, anchors.select(each, "*"), lambda r: Block(r, moduli, True), near_positives(moduli, n_positives),
                 "anchor_id long, row long, positive_id long, score long")
    best = Window.partitionBy(*key).orderBy(F.desc("score"), "positive_id")
    positives = materialize(found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= n_positives)
                            .groupBy(*key).agg(F.collect_list(F.struct("n", "positive_id", "score")).alias("positives")), "positives")
    found = meet(points, anchors.join(positives, key).select(each, "*"), lambda r: Block(r, moduli, False),
                 negatives_in_windows(moduli, n_negatives, low, high),
                 "anchor_id long, row long, n long, positive_id long, positive_score long, negative_id long, score long")
    best = Window.partitionBy(*key, "n").orderBy(F.desc("score"), "negative_id")
    return (found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n_negatives)
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", F.col("score").alias("negative_score")))
