"""A random forest for two classes, trained on the counts of all rows, as Spark jobs.

The forest is that of Spark ML's ``RandomForestClassifier`` (bootstrap per tree, ``max_bins`` bins a feature, a
random subset of features per node, Gini impurity of the class-weighted counts, at least ``min_leaf`` drawn rows a
child, leaves of one decision merged), with another random stream. What differs is what a pass costs:

  * Rows that fall into the same bin of every feature (a cell) are the same to every tree, so each pass runs over
    cells with their counts by class. A row's Poisson(1) bootstrap weights add up over ``k`` rows of a cell to
    Poisson(k), so the draw per cell has the distribution of the draw per row. No row is left out; where
    every row is a cell of its own, the cost is that of a pass over the rows.
  * Bin limits follow from the counts of all rows (:func:`bin_cuts`), not from a sample.
  * Cells lie in blocks by their hash. A tree's draw in a block is seeded by seed, block and tree, and histograms
    are sums of integers, so the forest depends on the rows alone, not on their layout.
  * A level of all trees is one pass: histograms per task (bounded by trees x nodes x features of a node x bins),
    added up and searched per tree on executors; the driver receives one row per open node.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, ship_package

#: Rows (cells) that a task handles at once; cells of a block, on average.
CHUNK_ROWS = 1 << 18
BLOCK_CELLS = 1 << 14
#: Mantissa bits by which a bucket of values is divided in one pass, the first one counted from sign and exponent.
BUCKET_BITS = 10
FIRST_SHIFT = 52 - BUCKET_BITS
#: A bucket heavier than this share of a bin is divided further.
FINE = 1 / 16
#: Codes of cells are 64-bit integers.
MAX_CODE = 1 << 62
COUNTS_SCHEMA = "feature int, key long, pos long, neg long, low double, high double"


@dataclass
class CountForest:
    feature_cols: list[str]
    nodes: dict                     # complete binary trees, as of the isolation forest
    importances: np.ndarray
    n_cells: int


def _ordered(x: np.ndarray) -> np.ndarray:
    """Doubles as 64-bit integers of the same order."""
    bits = (x + 0.0).view(np.int64)         # -0.0 becomes 0.0
    return bits ^ ((bits >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))


def _chunks(batches: Iterator[pa.RecordBatch], n_cols: int) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """Columns and the positive label of about ``CHUNK_ROWS`` rows at a time."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= CHUNK_ROWS:
            yield _columns(held, n_cols)
            held, n = [], 0
    if n:
        yield _columns(held, n_cols)


def _columns(held: list[pa.RecordBatch], n_cols: int) -> tuple[list[np.ndarray], np.ndarray]:
    column = lambda i: np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in held])
    return [column(i) for i in range(n_cols)], column(n_cols) == 1


def _merged(parts: list[tuple]) -> tuple:
    """Buckets (key, pos, neg, low, high) of several lists as one, ordered by key."""
    key, pos, neg, low, high = (np.concatenate(x) for x in zip(*parts))
    if not key.size:
        return key, pos, neg, low, high
    order = np.argsort(key, kind="stable")
    key = key[order]
    at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return (key[at], np.add.reduceat(pos[order], at), np.add.reduceat(neg[order], at),
            np.minimum.reduceat(low[order], at), np.maximum.reduceat(high[order], at))


def _bucket_counter(n_cols: int, shift: int, before: int, wanted: list[np.ndarray] | None):
    """Counts by class, least and greatest value of each bucket; ``wanted`` are the buckets of the pass before to divide."""
    def count(batches):
        found: list = [None] * n_cols
        for columns, y in _chunks(batches, n_cols):
            for f, x in enumerate(columns):
                key = _ordered(x) >> shift
                label = y
                if wanted is not None:
                    keep = np.isin(key >> (before - shift), wanted[f])
                    key, x, label = key[keep], x[keep], y[keep]
                part = key, label.astype(np.int64), (~label).astype(np.int64), x, x
                found[f] = _merged([part] if found[f] is None else [found[f], part])
        for f, part in enumerate(found):
            if part is not None and part[0].size:
                names = ["feature", "key", "pos", "neg", "low", "high"]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(part[0].size, f, np.int32)), *map(pa.array, part)], names=names)
    return count


def bin_cuts(rows: DataFrame, cols: list[str], weights: tuple[float, float], max_bins: int) -> list[np.ndarray]:
    """Limits of at most ``max_bins`` bins per feature, of about the same class weight (``weights``: of a positive, of
    another row). ``rows`` hold ``cols`` and ``_label``. Values are counted in buckets of ``BUCKET_BITS`` bits of their
    mantissa over all rows; buckets of several values that weigh over ``FINE`` of a bin are divided by more bits, pass by
    pass. Bounded numbers of buckets reach the driver."""
    settled: list[list[pd.DataFrame]] = [[] for _ in cols]
    totals, wanted, shift, before = None, None, FIRST_SHIFT, FIRST_SHIFT
    while True:
        buckets = rows.select(*cols, "_label").mapInArrow(_bucket_counter(len(cols), shift, before, wanted), COUNTS_SCHEMA)
        buckets = buckets.groupBy("feature", "key").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"),
                                                        F.min("low").alias("low"), F.max("high").alias("high")).toPandas()
        buckets["weight"] = weights[0] * buckets.pos + weights[1] * buckets.neg
        each = [buckets[buckets.feature == f] for f in range(len(cols))]
        totals = totals or [b.weight.sum() for b in each]
        wanted = []
        for f, b in enumerate(each):
            divide = (b.weight > FINE * totals[f] / max_bins) & (b.low < b.high) & (shift > 0)
            settled[f].append(b[~divide])
            wanted.append(b.key[divide].to_numpy(np.int64))
        if not any(w.size for w in wanted):
            return [_cuts(pd.concat(s).sort_values("low"), max_bins) for s in settled]
        before, shift = shift, max(0, shift - BUCKET_BITS)


def _cuts(entries: pd.DataFrame, max_bins: int) -> np.ndarray:
    """Limits between neighbouring buckets, where the weight so far comes nearest to a multiple of a bin's."""
    low, high, weight = (entries[c].to_numpy(float) for c in ("low", "high", "weight"))
    between = high[:-1] / 2 + low[1:] / 2
    between = np.where((between >= high[:-1]) & (between < low[1:]), between, high[:-1])
    if len(between) < max_bins:
        return between
    so_far, stride, chosen = np.cumsum(weight), weight.sum() / max_bins, []
    target = stride
    for i in range(1, len(weight)):
        if abs(so_far[i - 1] - target) < abs(so_far[i] - target):
            chosen.append(i - 1)
            target += stride
    return between[chosen[:max_bins - 1]]


def _cell_counter(cuts: list[np.ndarray]):
    """Counts by class of the cells of a task's rows."""
    def count(batches):
        held = None
        for columns, y in _chunks(batches, len(cuts)):
            code = np.zeros(len(y), np.int64)
            for x, limits in zip(columns, cuts):
                code = code * (len(limits) + 1) + np.searchsorted(limits, x, side="left")
            keys, n = np.unique(code * 2 + y, return_counts=True)
            if held is not None:
                keys, at = np.unique(np.concatenate([held[0], keys]), return_inverse=True)
                n = np.bincount(at, np.concatenate([held[1], n])).astype(np.int64)
            held = keys, n
            if keys.size > 4 * CHUNK_ROWS:
                yield batch(*held)
                held = None
        if held is not None:
            yield batch(*held)

    def batch(keys, n):
        y = keys % 2 == 1
        return pa.RecordBatch.from_arrays([pa.array(keys // 2), pa.array(np.where(y, n, 0)), pa.array(np.where(y, 0, n))],
                                          names=["cell", "pos", "neg"])
    return count


def _pack(cells: pd.DataFrame) -> pd.DataFrame:
    cells = cells.sort_values("cell")
    return pd.DataFrame({"block": [int(cells["block"].iloc[0])],
                         **{c: [cells[c].to_numpy(np.int64).tobytes()] for c in ("cell", "pos", "neg")}})


def cell_blocks(rows: DataFrame, cols: list[str], cuts: list[np.ndarray], seed: int) -> tuple[DataFrame, int]:
    """The cells of all rows with their counts, packed into blocks by their hash, and their number."""
    cells = rows.select(*cols, "_label").mapInArrow(_cell_counter(cuts), "cell long, pos long, neg long")
    cells = materialize(cells.groupBy("cell").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")), "forest-cells")
    n = cells.count()
    blocks = max(1, -(-n // BLOCK_CELLS))
    own = F.pmod(F.xxhash64("cell", F.lit(seed)), F.lit(blocks)).cast("int")
    packed = cells.withColumn("block", own).groupBy("block").applyInPandas(_pack, "block int, cell binary, pos binary, neg binary")
    spread = min(blocks, 4 * rows.sparkSession.sparkContext.defaultParallelism)
    return materialize(packed.repartition(spread), "forest-blocks"), n


def _drawn(rng: np.random.Generator, counts: np.ndarray) -> np.ndarray:
    """Bootstrap weights of cells: the sum of a Poisson(1) weight for each of their rows."""
    out = np.zeros(len(counts), np.int64)
    some = np.flatnonzero(counts)
    out[some] = rng.poisson(counts[some])
    return out


def _histogrammer(shared, sizes: list[int], seed: int):
    """Of every open node of a level: counts of drawn rows by feature of the node, bin and class."""
    def count(batches):
        state = shared.value
        level, split, cut, slot, subset = (state[k] for k in ("level", "split", "cut", "slot", "subset"))
        bins = max(sizes)
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, *packed in zip(*(batch.column(i).to_pylist() for i in range(4))):
                cell, pos, neg = (np.frombuffer(b, np.int64) for b in packed)
                k, rest, columns = len(cell), cell, np.empty((len(sizes), len(cell)), np.int64)
                for f in reversed(range(len(sizes))):
                    rest, columns[f] = np.divmod(rest, sizes[f])
                flat, rows = columns.ravel(), np.arange(k)
                for t in range(len(split)):
                    n_open, m = subset[t].shape
                    if not n_open:
                        continue
                    rng = np.random.default_rng([seed, block, t])
                    p, q = _drawn(rng, pos), _drawn(rng, neg)
                    node = np.zeros(k, np.int64)
                    for _ in range(level):
                        node = 2 * node + 1 + (flat[split[t][node] * k + rows] > cut[t][node])
                    at = slot[t][node]
                    hist = found.setdefault(t, np.zeros((n_open * m * bins, 2), np.int64))
                    for c, w in enumerate((p, q)):
                        here = np.flatnonzero((at >= 0) & (w > 0))
                        s, w = at[here], w[here]
                        for j in range(m):
                            key = (s * m + j) * bins + flat[subset[t][s, j] * k + here]
                            hist[:, c] += np.bincount(key, w, n_open * m * bins).astype(np.int64)     # exact below 2^53
        if found:
            trees = sorted(found)
            yield pa.RecordBatch.from_arrays([pa.array(trees, pa.int32()), pa.array([found[t].tobytes() for t in trees], pa.binary())],
                                             names=["tree", "counts"])
    return count


def _gini(pos, neg):
    total = pos + neg
    return 1 - (pos ** 2 + neg ** 2) / np.where(total > 0, total, 1) ** 2


def best_splits(counts: np.ndarray, weights: tuple[float, float], min_leaf: int) -> dict[str, np.ndarray]:
    """The split of greatest gain of each node from its ``counts`` (node, feature, bin, class); ``j`` is -1 where
    none leaves ``min_leaf`` drawn rows on both sides and gains anything."""
    total = counts[:, :1].sum(axis=2, keepdims=True)
    left = counts.cumsum(axis=2)[:, :, :-1]
    right = total - left
    wl, wr, w = (x * np.asarray(weights) for x in (left, right, total))
    nl, nr, n = wl.sum(-1), wr.sum(-1), w.sum(-1)
    parent = _gini(w[..., 0], w[..., 1])
    gain = parent - (nl * _gini(wl[..., 0], wl[..., 1]) + nr * _gini(wr[..., 0], wr[..., 1])) / np.where(n > 0, n, 1)
    gain = np.where((left.sum(-1) >= min_leaf) & (right.sum(-1) >= min_leaf), gain, -1.0)
    gain = gain.reshape(len(counts), -1)
    best = gain.argmax(axis=1) if gain.shape[1] else np.zeros(len(counts), int)
    each = np.arange(len(counts))
    top = gain[each, best] if gain.shape[1] else np.full(len(counts), -1.0)
    j, cut = np.divmod(best, max(counts.shape[2] - 1, 1))
    out = {"j": np.where(top > 0, j, -1), "cut": cut, "gain": top, "pos": total[:, 0, 0, 0], "neg": total[:, 0, 0, 1]}
    for c, name in enumerate(("pos", "neg")):
        out[f"left_{name}"] = left.reshape(len(counts), -1, 2)[each, best, c] if gain.shape[1] else np.zeros(len(counts), int)
    return out


SPLITS = ["j", "cut", "gain", "pos", "neg", "left_pos", "left_neg"]


def _splitter(bins: int, m: int, weights: tuple[float, float], min_leaf: int):
    def split(parts: pd.DataFrame) -> pd.DataFrame:
        counts = sum(np.frombuffer(b, np.int64) for b in parts["counts"]).reshape(-1, m, bins, 2)
        found = best_splits(counts, weights, min_leaf)
        return pd.DataFrame({"tree": np.int32(parts["tree"].iloc[0]), "slot": np.arange(len(counts), dtype=np.int32),
                             **{c: found[c] for c in SPLITS}})
    return split


def fit_count_forest(rows: DataFrame, cols: list[str], counts: tuple[int, int], seed: int = 42, num_trees: int = 200,
                     max_depth: int = 8, min_leaf: int = 10, max_bins: int = 32) -> CountForest:
    """Train on every row of ``rows`` (``cols`` as finite doubles, ``_label`` 0 or 1; ``counts``: rows with 1, with 0).
    Both classes have the same total weight."""
    spark = rows.sparkSession
    ship_package(spark)
    if max_bins ** len(cols) > MAX_CODE // 2:
        raise ValueError("too many features: a cell's code has 63 bits")
    weights = tuple(sum(counts) / (2.0 * n) for n in counts)
    cuts = bin_cuts(rows, cols, weights, max_bins)
    sizes = [len(c) + 1 for c in cuts]
    blocks, n_cells = cell_blocks(rows, cols, cuts, seed)
    d, m, slots = len(cols), max(1, int(len(cols) ** 0.5)), 2 ** (max_depth + 1) - 1
    split, cut = np.full((num_trees, slots), -1), np.zeros((num_trees, slots), np.int64)
    gain, stats = np.zeros((num_trees, slots)), np.zeros((num_trees, slots, 2))
    open_nodes = [np.array([0]) for _ in range(num_trees)]
    for level in range(max_depth):
        subset = [np.array([np.random.default_rng([seed, t, int(node), 1]).permutation(d)[:m] for node in nodes], int).reshape(-1, m)
                  for t, nodes in enumerate(open_nodes)]
        slot = np.full((num_trees, slots), -1)
        for t, nodes in enumerate(open_nodes):
            slot[t, nodes] = np.arange(len(nodes))
        # a closed node's rows go on by feature 0; none of the nodes below it is open
        shared = spark.sparkContext.broadcast({"level": level, "split": np.maximum(split, 0), "cut": cut, "slot": slot, "subset": subset})
        found = blocks.mapInArrow(_histogrammer(shared, sizes, seed), "tree int, counts binary")
        found = found.groupBy("tree").applyInPandas(
            _splitter(max(sizes), m, weights, min_leaf),
            "tree int, slot int, j int, cut int, gain double, pos long, neg long, left_pos long, left_neg long").toPandas()
        shared.unpersist()
        new: list[list[int]] = [[] for _ in range(num_trees)]
        for r in found.itertuples(index=False):
            t, node = r.tree, int(open_nodes[r.tree][r.slot])
            stats[t, node] = r.pos * weights[0], r.neg * weights[1]
            if r.j < 0:
                continue
            split[t, node], cut[t, node], gain[t, node] = subset[t][r.slot, r.j], r.cut, r.gain
            sides = (r.left_pos, r.left_neg), (r.pos - r.left_pos, r.neg - r.left_neg)
            for child, side in zip((2 * node + 1, 2 * node + 2), sides):
                stats[t, child] = side[0] * weights[0], side[1] * weights[1]
                if min(side):                   # rows of both classes
                    new[t].append(child)
        open_nodes = [np.array(sorted(nodes), int) for nodes in new]
        if not any(len(nodes) for nodes in open_nodes):
            break
    return _model(cols, cuts, split, cut, gain, stats, max_depth, n_cells)


def _model(cols, cuts, split, cut, gain, stats, depth: int, n_cells: int) -> CountForest:
    """Leaves of one decision are merged; the trees are laid out as complete ones (a leaf's value goes down to the bottom)."""
    inner = (1 << depth) - 1
    decision = stats[..., 0] > stats[..., 1]
    leaf = split < 0
    for node in reversed(range(inner)):
        a, b = 2 * node + 1, 2 * node + 2
        leaf[:, node] |= leaf[:, a] & leaf[:, b] & (decision[:, a] == decision[:, b])
    total = stats.sum(-1)
    value = stats[..., 0] / np.where(total > 0, total, 1)
    importances = np.zeros(len(cols))
    feature, threshold = np.zeros((len(split), inner), np.int32), np.full((len(split), inner), np.inf)
    for t in range(len(split)):
        own, reached = np.zeros(len(cols)), {0}
        for node in range(inner):
            if node in reached and not leaf[t, node]:
                feature[t, node], threshold[t, node] = split[t, node], cuts[split[t, node]][cut[t, node]]
                own[split[t, node]] += gain[t, node] * total[t, node]
                reached |= {2 * node + 1, 2 * node + 2}
            else:                               # all rows go left, with the leaf's value
                leaf[t, 2 * node + 1] = True
                value[t, 2 * node + 1] = value[t, node]
        importances += own / own.sum() if own.sum() > 0 else 0
    importances = importances / importances.sum() if importances.sum() > 0 else importances
    return CountForest(list(cols), {"feature": feature, "threshold": threshold, "bottom": value[:, inner:].copy(), "depth": depth},
                       importances, n_cells)
