"""Spelling variants: words at one edit, found by k-d trees over letter-count vectors.

1. ``words``: the runs of letters of whole texts, lower-cased (A-Z), counted with partial sums.
2. A replaced letter moves two counts by one and an inserted one moves one, so words of one
   length can only be near at L1 distance two, words of lengths one apart at distance one.
   Words are dealt by length and, within a length, by a k-d tree over the counts whose splits
   come from a hash sample of about ``sample_rows`` words. The leaves cover all of space: a
   word is a point of the one leaf it lies in and a query of every leaf whose box is within
   reach of it, for its own length and the next. So no pair is lost and each is met once.
3. The task of a leaf builds a k-d tree of its points with tight boxes and takes the queries
   through it together, leaving out the subtrees whose box is out of reach; words that have
   the right distance are compared letter by letter. Only the number of near words and the best
   one leave a task for each word and batch, never the pairs.
4. Forms are followed to their last by pointer doubling; the words of one form are spread over
   salted keys.

A form has at least ``ratio`` times its word's occurrences, so chains end. Defined cases: null and
empty texts have no words; a null id counts as an empty one; rows that share an id count each; runs of
any length are whole words (a word's counts are exact at any length); ties go to the smaller word in
code-point order; an empty table gives an empty result; other columns are not read.
"""
from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.cells import field, meet, numbers
from ledgerlens.llm.chunks import slices
from ledgerlens.session import materialize

RUN = re.compile("[a-zÀ-ÿ]+")       # of texts whose A-Z are lower-cased
LETTERS = 26 + 64
LEAF = 32
SALTS = 16


def slip(doc_id: str, run: str, every: int) -> str:
    """The run, or the run without one code point where a checksum of document and run says so."""
    h = zlib.crc32(f"{doc_id}:{run}".encode())
    if h % every:
        return run
    k = h % len(run)
    return run[:k] + run[k + 1:]


def words(docs: DataFrame, min_length: int, min_count: int, slips_every: int | None) -> DataFrame:
    """word and n: the words of ``docs`` (``doc_id``, ``text``) that are long and frequent enough."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                total: Counter = Counter()
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    found = Counter(RUN.findall((text or b"").lower().decode("utf-8", "replace")))
                    if slips_every:
                        for x, n in found.items():
                            total[slip(doc or "", x, slips_every)] += n
                    else:
                        total.update(found)
                kept = [(x, n) for x, n in total.items() if len(x) >= min_length]
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in kept], pa.string()),
                                                  pa.array([n for _, n in kept], pa.int64())], ["word", "n"])
    rows = docs.select(F.col("doc_id").cast("string"), F.col("text").cast("binary")).mapInArrow(run, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def codes(some: list[str]) -> np.ndarray:
    """The letters of words of one length, a row each."""
    return np.frombuffer("".join(some).encode("latin-1"), "u1").reshape(len(some), -1)


def letter_counts(letters: np.ndarray) -> np.ndarray:
    dim = letters.astype("i8")
    dim = np.where(dim >= 0xC0, dim - 0xC0 + 26, dim - ord("a"))
    flat = np.bincount((np.arange(len(dim))[:, None] * LETTERS + dim).ravel(), minlength=len(dim) * LETTERS)
    return flat.reshape(-1, LETTERS).astype("i1" if letters.shape[1] < 60 else "i4")


def split(x: np.ndarray) -> tuple[int, int] | None:
    """Letter and count of the split (up to the count, over it) that halves the vectors best."""
    low, high = x.min(axis=0), x.max(axis=0)
    if (low == high).all():
        return None
    over = np.stack([(x > t).sum(axis=0) for t in range(4)])
    t, letter = np.unravel_index(np.abs(over - len(x) / 2).argmin(), over.shape)
    if 0 < over[t, letter] < len(x):
        return int(letter), int(t)
    letter = int((high.astype("i8") - low).argmax())
    return letter, (int(low[letter]) + int(high[letter])) // 2


def box_distance(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return (np.maximum(low - q, 0) + np.maximum(q - high, 0)).sum(axis=1, dtype="i4")


class Leaves:
    """The k-d trees that deal words, one per length of the sample; their boxes cover all of space."""

    def __init__(self, sample: list[str], per_leaf: float):
        self.roots: dict[int, int] = {}
        self.nodes: list[tuple] = []        # low, high, two nodes (none for a leaf: its place is its cell)
        for length in sorted(set(map(len, sample))):
            self.roots[length] = len(self.nodes)
            x = letter_counts(codes(sorted(w for w in sample if len(w) == length)))
            todo: list[tuple] = [(x, np.zeros(LETTERS, "i4"), np.full(LETTERS, 1 << 30, "i4"), [])]
            while todo:
                own, low, high, children = todo.pop()
                children.append(len(self.nodes))
                cut = split(own) if len(own) > per_leaf else None
                self.nodes.append((low, high, [] if cut else None))
                if cut:
                    letter, t = cut
                    left, right = high.copy(), low.copy()
                    left[letter], right[letter] = t, t + 1
                    over = own[:, letter] > t
                    todo += [(own[~over], low, left, self.nodes[-1][2]), (own[over], right, high, self.nodes[-1][2])]

    def within(self, counts: np.ndarray, length: int, reach: int) -> Iterator[tuple[np.ndarray, int]]:
        """The words that have a leaf of a length within reach, and the leaf's cell. A length that the
        sample lacks is one leaf."""
        if length not in self.roots:
            yield np.arange(len(counts)), -length
            return
        counts, todo = counts.astype("i4"), [(self.roots[length], np.arange(len(counts)))]
        while todo:
            node, at = todo.pop()
            low, high, children = self.nodes[node]
            at = at[box_distance(counts[at], low, high) <= reach]
            if children is None:
                yield at, node
            elif len(at):
                todo += [(child, at) for child in children]


def dealt(rows: DataFrame, leaves: Leaves) -> DataFrame:
    """Add ``own`` (the leaf of the word) and ``reached`` (the leaves that it queries)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = batch.column(0).to_pylist()
            size = np.fromiter(map(len, some), "i8", len(some))
            own, reached = np.zeros(len(some), "i8"), [[] for _ in some]
            for length in np.unique(size).tolist():
                at = np.flatnonzero(size == length)
                counts = letter_counts(codes([some[i] for i in at]))
                for word, cell in leaves.within(counts, length, 0):
                    own[at[word]] = cell
                for step in (0, 1):
                    for word, cell in leaves.within(counts, length + step, 2 - step):
                        for i in at[word]:
                            reached[i].append(cell)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own), pa.array(reached, pa.list_(pa.int64()))],
                                             ["word", "n", "own", "reached"])
    return rows.select("word", "n").mapInArrow(run, "word string, n long, own long, reached array<long>")


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of a and b differ by one replaced letter or, where b is a letter longer, by one
    inserted letter."""
    if a.shape[1] == b.shape[1]:
        return (a != b).sum(axis=1) == 1
    yes = np.ones((len(a), 1), bool)
    head = np.concatenate([yes, np.logical_and.accumulate(a == b[:, :-1], axis=1)], axis=1)
    tail = np.concatenate([np.logical_and.accumulate((a == b[:, 1:])[:, ::-1], axis=1)[:, ::-1], yes], axis=1)
    return (head & tail).any(axis=1)


class Tree:
    """A k-d tree with tight boxes over the letter counts of words of one length."""

    def __init__(self, some: list[str]):
        self.letters = codes(some)
        self.counts = letter_counts(self.letters)
        self.nodes: list[tuple] = []        # low, high, and two nodes or the points of a leaf
        self.root = self._node(np.arange(len(some)))

    def _node(self, at: np.ndarray) -> int:
        me, todo = len(self.nodes), [(at, None, 0)]
        while todo:
            own, parent, side = todo.pop()
            x = self.counts[own]
            if parent is not None:
                self.nodes[parent][2][side] = len(self.nodes)
            cut = split(x) if len(own) > LEAF else None
            self.nodes.append((x.min(axis=0), x.max(axis=0), [0, 0] if cut else None, own))
            if cut:
                over = x[:, cut[0]] > cut[1]
                todo += [(own[~over], len(self.nodes) - 1, 0), (own[over], len(self.nodes) - 1, 1)]
        return me

    def near(self, letters: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, point) places of words at one edit, each once."""
        counts = letter_counts(letters)
        reach = 2 if letters.shape[1] == self.letters.shape[1] else 1
        todo = [(self.root, np.arange(len(letters)))]
        while todo:
            node, at = todo.pop()
            low, high, children, own = self.nodes[node]
            far = box_distance(counts[at], low, high)
            if children:
                at = at[far <= reach]
                if len(at):
                    todo += [(child, at) for child in children]
                continue
            equal = bool((low == high).all())       # then the box is the vector of every point
            at = at[far == reach] if equal else at[far <= reach]
            step = max(1, (1 << 22) // (len(own) * max(LETTERS, letters.shape[1])))
            for s in range(0, len(at), step):
                some = at[s:s + step]
                if equal:
                    q, p = np.repeat(some, len(own)), np.tile(own, len(some))
                else:
                    apart = np.abs(counts[some][:, None, :] - self.counts[own][None, :, :]).sum(axis=2, dtype="i4")
                    q, p = np.nonzero(apart == reach)
                    q, p = some[q], own[p]
                width = max(1, (1 << 24) // letters.shape[1])
                for k in range(0, len(q), width):
                    hit = one_edit(letters[q[k:k + width]], self.letters[p[k:k + width]])
                    if hit.any():
                        yield q[k:k + width][hit], p[k:k + width][hit]


def ranked(rows: pa.StructArray) -> tuple[list[str], np.ndarray]:
    """Words and their numbers, the most frequent first (ties by word)."""
    some, n = field(rows, "word").to_pylist(), numbers(rows, "n")
    order = sorted(range(len(some)), key=lambda i: (-n[i], some[i]))
    return [some[i] for i in order], n[order]


def leaf(rows: pa.StructArray) -> tuple[list[str], np.ndarray, Tree]:
    some, n = ranked(rows)
    return some, n, Tree(some)


def best_of(at: np.ndarray, other: np.ndarray, words_: list[str], others: list[str], n: np.ndarray) -> pa.RecordBatch:
    """word, n_near, near_n and near: per word at ``at`` the number of hits and the first of ``others``."""
    count, best = np.bincount(at, minlength=len(words_)), np.full(len(words_), len(others))
    np.minimum.at(best, at, other)
    hit = np.flatnonzero(count)
    return pa.RecordBatch.from_arrays(
        [pa.array([words_[i] for i in hit], pa.string()), pa.array(count[hit], pa.int64()), pa.array(n[best[hit]], pa.int64()),
         pa.array([others[i] for i in best[hit]], pa.string())], ["word", "n_near", "near_n", "near"])


def search(points: tuple[list[str], np.ndarray, Tree], rows: pa.StructArray) -> pa.RecordBatch | None:
    (own, own_n, tree), (asked, asked_n), out = points, ranked(rows), []
    size = np.fromiter(map(len, asked), "i8", len(asked))
    for length in np.unique(size).tolist():
        at = np.flatnonzero(size == length)
        found = list(tree.near(codes([asked[i] for i in at])))
        if not found:
            continue
        q, p = (np.concatenate(z) for z in zip(*found, strict=True))
        out.append(best_of(at[q], p, asked, own, own_n))
        if length < tree.letters.shape[1]:      # the longer word never asks for the shorter one
            out.append(best_of(p, at[q], own, asked, asked_n))
    return pa.Table.from_batches(out).combine_chunks().to_batches()[0] if out else None


def roots(forms: DataFrame) -> DataFrame:
    """word and root of ``forms`` (``word``, ``form``): the last form of each chain."""
    at = materialize(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        # Only the forms that have a form themselves move anything; they are few and met salted.
        last = materialize(at.join(at.select(F.col("root").alias("word")).distinct(), "word", "left_semi"), "inner-forms")
        if last.isEmpty():
            return at
        last = last.select(F.col("word").alias("root"), F.col("root").alias("next"),
                           F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        salted = at.withColumn("salt", F.pmod(F.xxhash64("word"), F.lit(SALTS)).cast("int"))
        at = materialize(salted.join(last, ["root", "salt"], "left").select("word", F.coalesce("next", "root").alias("root")), "forms")


def group(docs: DataFrame, min_length: int = 6, min_count: int = 5, ratio: int = 5, slips_every: int | None = None,
          sample_rows: int = 1 << 16, leaf_rows: int = 1 << 15) -> DataFrame:
    """word, form, root, n, n_near and form_n of the words of ``docs`` (``doc_id``, ``text``)."""
    vocabulary = materialize(words(docs, min_length, min_count, slips_every), "words")
    count = vocabulary.count()
    share = min(1.0, sample_rows / max(count, 1))
    sample = vocabulary.where(F.abs(F.xxhash64("word")) <= F.lit(int(share * 2**63) - 1)).select("word").toPandas()["word"]
    routed = materialize(dealt(vocabulary, Leaves(sample.tolist(), leaf_rows * share)), "dealt-words")
    points = routed.select(F.col("own").alias("cell"), "word", "n")
    queries = routed.select(F.explode("reached").alias("cell"), "word", "n")
    near = meet(points, queries, leaf, search, "word string, n_near long, near_n long, near string")
    near = near.groupBy("word").agg(F.sum("n_near").alias("n_near"),
                                    F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("word"))).alias("best"))
    enough = -F.col("best")["n"] >= ratio * F.col("n")
    found = materialize(vocabulary.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(enough, F.col("best")["word"]).alias("form"),
        F.when(enough, -F.col("best")["n"]).alias("form_n")), "near-words")
    ends = roots(found.where(F.col("form").isNotNull()))
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
