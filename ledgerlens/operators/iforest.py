"""Isolation forest (Liu, Ting & Zhou, ICDM 2008) as Spark jobs.

fit
  * Training input is bounded by ``n_trees x max_samples`` rows whatever the ledger size.
    Rows are chosen by a seeded hash of their content and their number among its exact copies
    (the choice does not depend on partitioning, and a block of copies is drawn from like other
    rows); see ``training_sample``.
  * Trees are grown in parallel: ``groupBy(tree_id).applyInPandas`` — one group of
    ``psi`` rows per tree, random state from ``(seed, tree_id)``. Each split picks a
    feature uniformly among those not constant in the node and a threshold uniformly in
    ``[min, max)``; depth is capped at ``ceil(log2 psi)``.
  * The node table (at most ``n_trees x (2 psi - 1)`` rows, independent of data size)
    is the model; it is re-laid as complete binary trees and shipped as a broadcast.

score
  * An Arrow ``pandas_udf`` walks all trees for a batch of rows at once with NumPy
    gathers. ``s = 2 ** (-E[h] / c(psi))``; ``decision = -s - offset`` where the offset
    is the exact ``contamination`` percentile of ``-s`` at every size (``exact_quantile``);
    label -1 when ``decision < 0``.

Scaling the features first would not change the split distribution (thresholds are
uniform in the node's range), so the raw features are used.
"""
from __future__ import annotations

import math
import uuid
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..session import ship_package

EULER_GAMMA = 0.5772156649015329
RINGS = 16
PERCENTILE_BUCKETS = 1 << 16
FETCH_ROWS = 10_000
NODE_SCHEMA = ("tree_id int, node_id int, feature int, threshold double, left int, right int, "
               "n_node int, value double")


def c_factor(n) -> np.ndarray:
    """Average path length of an unsuccessful BST search: c(1)=0, c(2)=1."""
    n = np.asarray(n, dtype=float)
    out = np.zeros_like(n)
    big = n > 2
    out[big] = 2.0 * (np.log(n[big] - 1.0) + EULER_GAMMA) - 2.0 * (n[big] - 1.0) / n[big]
    out[n == 2] = 1.0
    return out


def _grow(X: np.ndarray, rng: np.random.Generator, max_depth: int):
    """Grow one isolation tree; returns node arrays (feature -1 marks a leaf)."""
    feats, thrs, lefts, rights, sizes, values = [], [], [], [], [], []

    def new_node():
        for lst, v in ((feats, -1), (thrs, 0.0), (lefts, -1), (rights, -1), (sizes, 0), (values, 0.0)):
            lst.append(v)
        return len(feats) - 1

    stack = [(new_node(), np.arange(X.shape[0]), 0)]
    while stack:
        node, idx, depth = stack.pop()
        sizes[node] = len(idx)
        if depth >= max_depth or len(idx) <= 1:
            values[node] = depth + float(c_factor([len(idx)])[0])
            continue
        sub = X[idx]
        lo, hi = sub.min(axis=0), sub.max(axis=0)
        candidates = np.flatnonzero(hi > lo)
        if candidates.size == 0:           # all remaining points identical
            values[node] = depth + float(c_factor([len(idx)])[0])
            continue
        f = int(rng.choice(candidates))
        t = float(rng.uniform(lo[f], hi[f]))
        if t >= hi[f]:
            t = float(lo[f])
        go_left = sub[:, f] <= t
        li, ri = new_node(), new_node()
        feats[node], thrs[node], lefts[node], rights[node] = f, t, li, ri
        stack.append((ri, idx[~go_left], depth + 1))
        stack.append((li, idx[go_left], depth + 1))
    return feats, thrs, lefts, rights, sizes, values


def _tree_builder(feature_cols: list[str], seed: int, max_depth: int):
    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        tree_id = int(pdf["tree_id"].iloc[0])
        pdf = pdf.sort_values(["_key", *feature_cols], kind="stable")     # order-independent input
        X = pdf[feature_cols].to_numpy(dtype=float)
        rng = np.random.default_rng([seed, tree_id])
        f, t, left, right, n, v = _grow(X, rng, max_depth)
        return pd.DataFrame({"tree_id": tree_id, "node_id": np.arange(len(f), dtype=np.int32),
                             "feature": np.asarray(f, dtype=np.int32), "threshold": t,
                             "left": np.asarray(left, dtype=np.int32),
                             "right": np.asarray(right, dtype=np.int32),
                             "n_node": np.asarray(n, dtype=np.int32), "value": v})
    return build


@dataclass
class IsolationForestModel:
    feature_cols: list[str]
    n_trees: int
    psi: int
    max_depth: int
    nodes: dict            # flattened arrays over all trees
    roots: np.ndarray      # global index of each tree's root
    contamination: float
    offset: float | None = None
    node_table: pd.DataFrame | None = None   # the grown trees, for reporting

    @property
    def c_psi(self) -> float:
        return float(c_factor([self.psi])[0])


#: Ledger columns that identify a posting whatever file or partition it comes from.
CONTENT = ["journal_ref", "date", "amount", "account_code", "account_name", "vendor", "description"]


def content_key(feat: DataFrame) -> Column:
    """Hash of a posting's content; where a frame has none of these columns, of its row id or else
    of all columns."""
    own = [c for c in CONTENT if c in feat.columns] or [c for c in ["row_id"] if c in feat.columns]
    return F.xxhash64(*[F.col(f"`{c}`") for c in own or feat.columns])


#: Copies of one row that are numbered in one go.
COPY_CHUNK = 4096


def numbered_copies(rows: DataFrame) -> DataFrame:
    """``rows`` with ``_copy``, a number from 0 among the exact copies of a row, the same in every
    layout. Copies meet as partial counts; the numbers of a row with many are made in chunks that
    are spread over the cluster."""
    cols = [F.col(f"`{c}`") for c in rows.columns]
    counted = rows.groupBy(*cols).agg(F.count("*").alias("_n"))
    few = counted.where(F.col("_n") <= COPY_CHUNK).select(
        *cols, F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)).alias("_copy"))
    last = F.floor((F.col("_n") - 1) / COPY_CHUNK)
    chunks = counted.where(F.col("_n") > COPY_CHUNK).select(
        *cols, "_n", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("_chunk"))
    chunks = chunks.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *cols, "_chunk")
    first = F.col("_chunk") * COPY_CHUNK
    many = chunks.select(*cols, F.explode(F.sequence(first, F.least(first + COPY_CHUNK, F.col("_n")) - 1)).alias("_copy"))
    return few.unionByName(many)


def training_sample(feat: DataFrame, feature_cols: list[str], n_rows: int, n_trees: int,
                    psi: int, seed: int) -> DataFrame:
    """(tree_id, _key, features...) with psi rows per tree, by one rule at every size.

    Trees stand evenly spaced on ``RINGS`` rings. A seeded hash of its content and its number among
    exact copies places each row on every ring, and a tree takes the ``psi`` rows that follow it. Only
    rows within a window that holds 1.5 psi + 64 rows on average (the whole ring, when there are fewer)
    are candidates: the trees of a row follow from its place by arithmetic, so beside the counts of
    copies (content hash and features) nothing but the candidates is shuffled, and each tree's group
    is bounded."""
    x = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in feature_cols]
    x = [F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(0.0)).otherwise(c).alias(n)
         for c, n in zip(x, feature_cols)]
    width = min(1.0, (1.5 * psi + 64) / max(n_rows, 1))
    rows = numbered_copies(feat.select(content_key(feat).alias("_content"), *x))
    rings = min(RINGS, n_trees)

    def bounds(r: int) -> tuple[int, Column, Column, Column]:
        m = len(range(r, n_trees, rings))       # trees on this ring
        u = F.xxhash64(F.col("_content"), F.col("_copy"), F.lit(r), F.lit(seed)).cast("double") / 2.0 ** 64 + 0.5
        return m, u, F.floor((u - width) * m) + 1, F.floor(u * m)

    def trees_near(r: int) -> Column:
        m, u, low, high = bounds(r)
        return F.when(low <= high, F.transform(F.sequence(low, high), lambda k: F.struct(
            (r + rings * F.pmod(k, F.lit(m))).cast("int").alias("tree_id"), (u - k / m).alias("_key"))))
    # most rows of a large ledger are near no tree: they go before any list of trees is made
    rows = rows.where(reduce(Column.__or__, [low <= high for _, _, low, high in map(bounds, range(rings))]))
    found = [trees_near(r) for r in range(rings)]
    near = F.flatten(F.array_compact(F.array(*found)))
    rows = rows.select("_content", "_copy", *feature_cols, F.explode(near).alias("_t")).select(
        "_t.tree_id", "_t._key", "_content", "_copy", *feature_cols)
    w = Window.partitionBy("tree_id").orderBy("_key", "_content", "_copy", *feature_cols)
    return (rows.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= psi)
            .select("tree_id", "_key", *feature_cols))


def _full_layout(nodes: pd.DataFrame, n_trees: int, depth: int) -> dict:
    """Re-lay every tree as a complete binary tree of ``depth`` levels (children of slot i
    at 2i+1 / 2i+2). A leaf above the bottom becomes a pass-through (threshold +inf, always
    left) down to the bottom level, which holds the path length. Scoring is then
    ``depth`` steps of pure index arithmetic, no child-pointer lookups."""
    inner = (1 << depth) - 1
    feat = np.zeros((n_trees, max(inner, 1)), np.int32)
    thr = np.full((n_trees, max(inner, 1)), np.inf)
    bottom = np.zeros((n_trees, 1 << depth))
    for t, tree in nodes.groupby("tree_id"):
        tree = tree.sort_values("node_id")
        f_, t_ = tree["feature"].to_numpy(), tree["threshold"].to_numpy()
        l_, r_, v_ = tree["left"].to_numpy(), tree["right"].to_numpy(), tree["value"].to_numpy()
        stack = [(0, 0, 0)]
        while stack:
            node, slot, d = stack.pop()
            if f_[node] < 0:                            # leaf
                if d == depth:
                    bottom[t, slot - inner] = v_[node]
                else:
                    stack.append((node, 2 * slot + 1, d + 1))
            else:
                feat[t, slot], thr[t, slot] = int(f_[node]), float(t_[node])
                stack.append((int(l_[node]), 2 * slot + 1, d + 1))
                stack.append((int(r_[node]), 2 * slot + 2, d + 1))
    return {"feature": feat, "threshold": thr, "bottom": bottom, "depth": depth}


def fit_isolation_forest(feat: DataFrame, feature_cols: list[str], n_rows: int | None = None,
                         n_trees: int = 200, max_samples: int = 256, contamination: float = 0.05,
                         seed: int = 42) -> IsolationForestModel:
    ship_package(feat.sparkSession)
    if n_rows is None:
        n_rows = feat.count()
    psi = max(1, min(max_samples, n_rows))
    max_depth = int(math.ceil(math.log2(max(psi, 2))))
    sample = training_sample(feat, feature_cols, n_rows, n_trees, psi, seed)
    nodes = (sample.groupBy("tree_id")
             .applyInPandas(_tree_builder(feature_cols, seed, max_depth), NODE_SCHEMA)
             .toPandas())                     # bounded: n_trees * (2 psi - 1) rows
    if nodes.empty:
        return IsolationForestModel(feature_cols, 0, psi, max_depth,
                                    _full_layout(nodes, 0, max_depth), np.zeros(0, np.int64),
                                    contamination, node_table=nodes)
    nodes = nodes.sort_values(["tree_id", "node_id"]).reset_index(drop=True)
    # renumber tree ids densely (a tree id never drawn would leave a hole)
    nodes["tree_id"] = nodes["tree_id"].rank(method="dense").astype(int) - 1
    n_built = int(nodes["tree_id"].nunique())
    flat = _full_layout(nodes, n_built, max_depth)
    return IsolationForestModel(feature_cols, n_built, psi, max_depth, flat,
                                np.arange(n_built, dtype=np.int64), contamination,
                                node_table=nodes)


def _path_lengths(model_arrays: dict, roots: np.ndarray, max_depth: int, X: np.ndarray,
                  chunk: int = 4096) -> np.ndarray:
    """Mean path length over the trees for each row of X (complete-tree layout).

    A chunk of rows goes down one tree at a time: the tree, the chunk's columns and the few work
    arrays, used again and again, stay in cache."""
    feat, thr, bottom = model_arrays["feature"], model_arrays["threshold"], model_arrays["bottom"]
    n_trees, inner = feat.shape[0], (1 << max_depth) - 1
    m = X.shape[0]
    out = np.empty(m)
    for s in range(0, m, chunk):
        columns = np.ascontiguousarray(X[s:s + chunk].T)
        k = columns.shape[1]
        flat, rows = columns.ravel(), np.arange(k)
        at, node, right = np.empty(k, np.int64), np.empty(k, np.int64), np.empty(k, bool)
        x, cut, lengths = np.empty(k), np.empty(k), np.empty((n_trees, k))
        for t in range(n_trees):
            column, threshold = feat[t].astype(np.int64) * k, thr[t]
            node[:] = 0
            for _ in range(max_depth):
                np.take(column, node, out=at, mode="clip")      # the mode spares a copy; all are in range
                at += rows
                np.take(flat, at, out=x, mode="clip")
                np.take(threshold, node, out=cut, mode="clip")
                np.greater(x, cut, out=right)
                node *= 2
                node += 1
                node += right
            node -= inner
            np.take(bottom[t], node, out=lengths[t], mode="clip")
        out[s:s + k] = np.ascontiguousarray(lengths.T).mean(axis=1)
    return out


#: Cells whose path lengths a Python worker keeps (16 bytes each).
KEPT_CELLS = 1 << 21
_CELLS: dict = {}


class _Seen:
    """Sorted codes, each with a number."""
    def __init__(self, dtype):
        self.codes, self.values = np.zeros(0, np.int64), np.zeros(0, dtype)

    def find(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of sorted distinct ``codes``, and which of them are there."""
        at = np.searchsorted(self.codes, codes)
        there = at < len(self.codes)
        there[there] = self.codes[at[there]] == codes[there]
        return at, there

    def add(self, at: np.ndarray, codes: np.ndarray, values: np.ndarray) -> None:
        self.codes, self.values = np.insert(self.codes, at, codes), np.insert(self.values, at, values)


class ForestCells:
    """Mean path lengths (or leaf values) of a forest, walked once for each cell: rows between the same
    thresholds of every feature reach the same leaves of all trees. A worker keeps the cells that it met, up to
    ``KEPT_CELLS``; rows of cells beyond are walked batch by batch. The result is that of ``_path_lengths``, bit by bit."""
    def __init__(self, nodes: dict, depth: int):
        self.nodes, self.depth = nodes, depth
        feat, thr = nodes["feature"], nodes["threshold"]
        cut = np.isfinite(thr)                              # the others send every row left
        limits = {f: np.unique(thr[cut & (feat == f)]) for f in np.unique(feat[cut])}
        self.limits = sorted(limits.items(), key=lambda kv: len(kv[1]))
        self.stages = [_Seen(np.int64) for _ in self.limits]
        self.cells = _Seen(np.float64)

    def codes(self, X: np.ndarray) -> np.ndarray | None:
        """A number for each row, the same for rows of one cell; None when there are too many to be numbered."""
        code, radix = np.zeros(len(X), np.int64), 1
        for seen, (f, limits) in zip(self.stages, self.limits):
            size = len(limits) + 1
            if radix > (1 << 62) // size:       # the combinations met so far are numbered anew
                keys, each = np.unique(code, return_inverse=True)
                at, there = seen.find(keys)
                if not there.all():
                    n = len(seen.codes)
                    seen.add(at[~there], keys[~there], np.arange(n, n + (~there).sum()))
                    at = np.searchsorted(seen.codes, keys)
                if len(seen.codes) > KEPT_CELLS:
                    return None
                code, radix = seen.values[at][each], KEPT_CELLS + 1
            code, radix = code * size + np.searchsorted(limits, X[:, f], side="left"), radix * size
        return code

    def means(self, X: np.ndarray) -> np.ndarray:
        code = self.codes(X)
        if code is None:
            self.stages = [_Seen(np.int64) for _ in self.limits]       # numbers change: the kept cells go
            self.cells = _Seen(np.float64)
            return _path_lengths(self.nodes, None, self.depth, X)
        keys, first, each = np.unique(code, return_index=True, return_inverse=True)
        at, there = self.cells.find(keys)
        out = np.empty(len(keys))
        out[there] = self.cells.values[at[there]]
        if not there.all():
            out[~there] = _path_lengths(self.nodes, None, self.depth, X[first[~there]])
            if len(self.cells.codes) + (~there).sum() <= KEPT_CELLS:
                self.cells.add(at[~there], keys[~there], out[~there])
        return out[each]


def forest_cells(key: str, nodes: dict, depth: int) -> ForestCells:
    """This worker's cells of a forest; those of the last few forests are kept."""
    if key not in _CELLS:
        while len(_CELLS) >= 4:
            _CELLS.pop(next(iter(_CELLS)))
        _CELLS[key] = ForestCells(nodes, depth)
    return _CELLS[key]


def forest_mean_column(nodes: dict, columns: list[Column], spark) -> Column:
    """The mean over a forest's trees (complete layout) of the leaf values that a row reaches."""
    ship_package(spark)
    bc, key = spark.sparkContext.broadcast(nodes), uuid.uuid4().hex

    @pandas_udf("double")
    def mean(*cols: pd.Series) -> pd.Series:
        X = np.column_stack([c.to_numpy(dtype=float, na_value=0.0) for c in cols])
        return pd.Series(forest_cells(key, bc.value, bc.value["depth"]).means(np.where(np.isfinite(X), X, 0.0)))

    return mean(*columns)


def raw_score_column(model: IsolationForestModel, spark) -> Column:
    """-s per row (sklearn's ``score_samples``; lower = more anomalous)."""
    if model.n_trees == 0:                  # empty ledger: nothing was grown
        return F.lit(None).cast("double")
    ship_package(spark)
    bc, key = spark.sparkContext.broadcast({"nodes": model.nodes, "depth": model.max_depth, "c": model.c_psi}), uuid.uuid4().hex

    @pandas_udf("double")
    def score(*cols: pd.Series) -> pd.Series:
        m = bc.value
        X = np.column_stack([c.to_numpy(dtype=float, na_value=0.0) for c in cols])
        X = np.where(np.isfinite(X), X, 0.0)
        eh = forest_cells(key, m["nodes"], m["depth"]).means(X)
        return pd.Series(-np.power(2.0, -eh / m["c"]))

    return score(*[F.col(c) for c in model.feature_cols])


def exact_quantile(df: DataFrame, col: str, p: float, bounds: tuple[float, float] | None = None) -> float | None:
    """The linearly interpolated quantile, exact at every size. Counts of buckets over the range narrow it to
    the buckets of the two order statistics, both in one pass, until at most ``FETCH_ROWS`` values lie there; these
    are fetched. Two passes do for 10^8 distinct values and more. ``bounds`` hold all values; without them a pass
    finds them. Bucket counts and the last few values reach the driver."""
    values = df.select(F.col(col).alias("_v")).filter(F.col("_v").isNotNull())
    low, high = bounds or values.agg(F.min("_v"), F.max("_v")).first()
    rank, below, share = None, 0, 0.0
    while low is not None:
        step = (high - low) / PERCENTILE_BUCKETS
        place = F.least(F.floor((F.col("_v") - low) / step), F.lit(PERCENTILE_BUCKETS - 1)) if low + step > low else F.col("_v")
        found = (values.filter((F.col("_v") >= low) & (F.col("_v") <= high)).groupBy(place.alias("b"))
                 .agg(F.count("*").alias("n"), F.min("_v").alias("a"), F.max("_v").alias("z")).collect())
        found.sort(key=lambda r: r["a"])
        if rank is None:
            n = sum(r["n"] for r in found)
            if not n:
                return None
            rank = int(p * (n - 1))
            share = p * (n - 1) - rank
        wanted, own = (rank, rank + 1 if share else rank), []
        for r in found:             # the buckets that hold the two statistics, and all between
            if below + r["n"] > wanted[0] and below <= wanted[1]:
                own.append((below, r))
            below += r["n"]
        below = own[0][0]
        if all(r["a"] == r["z"] for _, r in own):
            first, second = (next(r["a"] for at, r in own if at <= k < at + r["n"]) for k in wanted)
            return first + share * (second - first)
        low, high = own[0][1]["a"], own[-1][1]["z"]
        if sum(r["n"] for _, r in own) <= FETCH_ROWS:
            last = sorted(r["_v"] for r in values.filter((F.col("_v") >= low) & (F.col("_v") <= high)).collect())
            first, second = (last[k - below] for k in wanted)
            return first + share * (second - first)
        if len(own) > 1:            # the statistics lie in two buckets: the end of one, the beginning of the next
            return own[0][1]["z"] + share * (own[-1][1]["a"] - own[0][1]["z"])
    return None


def fit_offset(scored: DataFrame, model: IsolationForestModel, n_rows: int | None = None,
               col: str = "_if_raw") -> float:
    """Contamination percentile of the raw scores (linear interpolation)."""
    value = exact_quantile(scored, col, float(model.contamination), (-1.0, 0.0))     # -s is in it
    model.offset = float(value) if value is not None else 0.0     # empty ledger
    return model.offset


def decision_column(raw: Column, model: IsolationForestModel) -> Column:
    return raw - F.lit(float(model.offset))
