"""Best-fit packing of documents into sequences of at most ``capacity`` tokens.

``write`` encodes every document where it stands, ends it with ``end_id``, cuts those longer than
the capacity and stores the pieces as rows of a Parquet table (whole tasks are committed, so a
lost executor leaves no half file; texts and tokens are never shuffled). A piece keeps the number of
its task and its place among the task's pieces of equal length.

``best_fit`` is best-fit decreasing: pieces are placed from the longest to the shortest, each in the
open sequence it fits most tightly, which a segment tree over the remaining capacities finds
in logarithmic time. Pieces of one length and sequences of one remaining capacity are
interchangeable, so runs of both are placed together: the input is the number of pieces per length, the
output a list of runs (rows of ``RUN``), and the result is that of placing the pieces one by
one. There are at most ``capacity`` lengths, every length adds at most three runs of
sequences and a sequence holds at most sqrt(2 capacity) different lengths: some 400,000 runs
for 2,048, whatever the number of documents. That bounds what the driver and a broadcast hold.

``assign`` numbers the pieces of each length (numbers of earlier tasks plus the place in the
task; narrow rows only) and reads sequence and offset off the runs. ``sequences`` puts the tokens
together where whole sequences are wanted.

Defined cases: null and empty texts are the end id alone; repeated rows, null and repeated ids are
documents of their own; texts of any length are encoded whole and cut afterwards; an empty table gives no
pieces and an empty result; other columns are not written.

Words are encoded once each where the tokenizer drops white space and cuts at it (``cuts_at_blanks``
reads that off its file); any other tokenizer gets whole texts.
"""
from __future__ import annotations

import functools
import json
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlens.llm.chunks import Gather, Memory, flat_ids, ranges, slices, words_of

RUN = "length int, first long, n long, each long, sequence long, begin int"
# Fixed value: the split pattern of the public word-level tokenizer; no alternative matches white space.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
MARK = ".,;:!?"
MARKS = list(MARK)
LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")


class Remaining:
    """Open sequences by remaining capacity, under a segment tree that finds the tightest."""

    def __init__(self, capacity: int):
        self.base = 1 << capacity.bit_length()
        self.open = np.zeros(2 * self.base, "i8")       # runs below each node
        self.runs: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def _add(self, left: int, by: int) -> None:
        node = self.base + left
        while node:
            self.open[node] += by
            node //= 2

    def push(self, left: int, run: tuple[int, int]) -> None:
        self.runs[left].append(run)
        self._add(left, 1)

    def pop(self, left: int) -> tuple[int, int]:
        self._add(left, -1)
        return self.runs[left].pop()

    def tightest(self, need: int) -> int | None:
        """The smallest remaining capacity of ``need`` or more that an open sequence has."""
        node = self.base + need
        if not self.open[node]:
            while node > 1 and (node % 2 or not self.open[node + 1]):
                node //= 2
            if node == 1:
                return None
            node += 1
            while node < self.base:
                node = 2 * node if self.open[2 * node] else 2 * node + 1
        return node - self.base


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first piece, pieces, pieces per sequence, first sequence, offset in it) of the best-fit
    decreasing packing of ``counts`` pieces per length."""
    open_, out, used = Remaining(capacity), [], 0
    for length in sorted(counts, reverse=True):
        placed, n = 0, counts[length]
        while placed < n:
            left = open_.tightest(length)
            if left is None:
                left = capacity
                run = (used, -(-(n - placed) // (capacity // length)))
                used += run[1]
            else:
                run = open_.pop(left)
            # A sequence stays the tightest until it takes no more pieces of this length.
            first, size = run
            each = left // length
            full = min(size, (n - placed) // each)
            if full:
                out.append((length, placed, full * each, each, first, capacity - left))
                placed += full * each
                open_.push(left - each * length, (first, full))
            if full < size and placed < n:
                rest = n - placed
                out.append((length, placed, rest, each, first + full, capacity - left))
                placed += rest
                open_.push(left - rest * length, (first + full, 1))
                full += 1
            if full < size:
                open_.push(left, (first + full, size - full))
    return out


def cuts_at_blanks(path: str) -> bool:
    """Whether a text cut at blanks and line feeds encodes piece by piece as it does whole."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    def parts(x: dict | None, name: str) -> list[dict]:
        return [] if x is None else x[name] if x["type"] == "Sequence" else [x]
    normal, cut = parts(model["normalizer"], "normalizers"), parts(model["pre_tokenizer"], "pretokenizers")
    blanks = [x for x in normal if x["type"] == "Replace"]
    return (bool(cut) and cut[0]["type"] == "Split" and cut[0]["behavior"] == "Removed" and cut[0]["invert"]
            and cut[0]["pattern"] == {"Regex": WORD_PATTERN}
            and all(x["type"] in ("NFC", "Lowercase", "Replace") for x in normal)
            and all(x["pattern"] == {"Regex": r"\s+"} and x["content"] == " " for x in blanks)
            and model["model"]["end_of_word_suffix"] == "</w>" and any(x["type"] == "Lowercase" for x in normal)
            and all(not (x["lstrip"] or x["rstrip"] or x["single_word"] or any(c.isspace() for c in x["content"]))
                    for x in model["added_tokens"]))


class WordEncoder:
    """Ids of texts from those of their distinct words.

    A word of plain letters is one token sequence that ends with the first token that closes a word, so
    many are encoded in one text; a mark after it is a word of its own to the pattern, and case is dropped.
    Other words are encoded one by one."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.words = Memory(12_000_000) if cuts_at_blanks(path) else None
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for x, i in vocabulary.items() if x.endswith("</w>")]] = True

    def whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return flat_ids([e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)])

    def _learn(self, new: list[str]) -> None:
        plain = [x for x in new if LETTERS.fullmatch(x)]
        self.words.learn(plain, self._letters)
        self.words.learn([x for x in new if x not in self.words.known], self.whole)

    @functools.cached_property
    def marks(self) -> list[bytes]:
        return [self.whole([x])[0].tobytes() for x in ("", *MARKS)]

    def _letters(self, some: list[str], together: int = 32) -> tuple[np.ndarray, np.ndarray]:
        flat, _ = self.whole([" ".join(some[a:a + together]) for a in range(0, len(some), together)])
        ends = np.flatnonzero(self.closes[flat])
        if len(ends) != len(some):
            raise ValueError("a word of letters is not closed by one token")
        return flat, np.diff(ends, prepend=-1)

    def encode(self, texts: pa.Array, together: int = 1 << 20) -> Iterator[np.ndarray]:
        """The ids of every text."""
        if self.words is None:
            flat, sizes = self.whole([x or "" for x in texts.to_pylist()])
            yield from np.split(flat, np.cumsum(sizes)[:-1])
            return
        self.words.trim()
        at, words, edge = words_of(pc.replace_substring(texts, "\n", " "))
        plain = pc.match_substring_regex(words, f"\\A{LETTERS.pattern}[{MARK}]?\\z")
        stems = pc.if_else(plain, pc.utf8_rtrim(pc.utf8_lower(words), MARK), words).dictionary_encode()
        mark = pc.if_else(plain, pc.index_in(pc.utf8_slice_codeunits(words, -1), pa.array(MARKS)), None)
        distinct = stems.dictionary.to_numpy(zero_copy_only=False).tolist()        # many times faster than to_pylist
        self._learn([x for x in distinct if x not in self.words.known])
        gather = Gather([self.words.known[x] for x in distinct] + self.marks)
        # Each word is its stem and its mark, which may be none.
        mark = pc.add(pc.fill_null(mark, -1), len(distinct) + 1).to_numpy()
        pairs = np.stack([stems.indices.to_numpy(), mark], axis=1).astype("i4")
        for i, j in ranges(edge, together):
            flat, ends = gather(pairs[at[edge[i]:edge[j]]].ravel())
            ends = np.concatenate([[0], ends])[2 * (edge[i:j + 1] - edge[i])]
            for a, b in zip(ends[:-1], ends[1:], strict=True):
                yield flat[a:b]


@functools.cache
def word_encoder(path: str) -> WordEncoder:
    import os
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")     # one core a task
    return WordEncoder(path)


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int, capacity: int = 2048) -> None:
    """Write the pieces of ``docs`` (``doc_id``, ``text``) as a Parquet table at ``path``."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import BinaryType, IntegerType, LongType, StructType
    schema = (StructType().add("part", IntegerType()).add("place", LongType()).add("doc_id", docs.schema["doc_id"].dataType)
              .add("piece", IntegerType()).add("start", LongType()).add("length", IntegerType()).add("payload", BinaryType()))
    names = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, seen = word_encoder(tokenizer).encode, TaskContext.get().partitionId(), Counter()
        end = np.array([end_id], "<u4")
        for batch in (x for b in batches for x in slices(b, 1)):
            rows: list[tuple] = []
            for doc, ids in enumerate(encode(batch.column(1))):
                ids = np.concatenate([ids, end]).astype("<u4")
                for piece, a in enumerate(range(0, len(ids), capacity)):
                    own = ids[a:a + capacity]
                    rows.append((seen[len(own)], doc, piece, a, len(own), own.tobytes()))
                    seen[len(own)] += 1
            place, doc, piece, start, length, payload = zip(*rows, strict=True) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * len(rows), pa.int32()), pa.array(place, pa.int64()), batch.column(0).take(pa.array(doc, pa.int64())),
                 pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int32()), pa.array(payload, pa.binary())], schema=names)

    docs.select("doc_id", "text").mapInArrow(run, schema).write.option("compression", "zstd").parquet(path)


def assign(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """``pieces`` (``part``, ``place`` and ``length``, any other columns) with ``sequence_id`` and ``offset``."""
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    total = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}    # at most capacity rows
    runs = pieces.sparkSession.createDataFrame(best_fit(total, capacity), RUN)
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)     # a row per task
    base = counts.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    ranked = pieces.join(base, ["part", "length"]).withColumn("_rank", F.col("base") + F.col("place")).drop("base")
    ranked, runs = ranked.alias("p"), runs.alias("r")
    nth = F.col("_rank") - F.col("r.first")
    return (ranked.join(F.broadcast(runs), (F.col("p.length") == F.col("r.length")) & (nth >= 0) & (nth < F.col("r.n")))
            .select("p.*", (F.col("r.sequence") + F.floor(nth / F.col("r.each"))).alias("sequence_id"),
                    (F.col("r.begin") + (nth % F.col("r.each")) * F.col("p.length")).alias("offset")).drop("_rank"))


def sequences(spark: SparkSession, path: str, capacity: int = 2048) -> DataFrame:
    """sequence_id, n_tokens, payload (all ids as little-endian 32-bit integers) and spans (offset, doc_id,
    piece, start, length) of every sequence of the pieces at ``path``. Each holds ``capacity`` tokens at most."""
    names = ("offset", "doc_id", "piece", "start", "length")
    rows = assign(spark.read.parquet(path), capacity).groupBy("sequence_id").agg(
        F.sort_array(F.collect_list(F.struct(*names, "payload"))).alias("rows"))
    payload = F.aggregate("rows", F.lit(b""), lambda done, x: F.concat(done, x["payload"]))
    return rows.select("sequence_id", F.aggregate("rows", F.lit(0), lambda n, x: n + x["length"]).alias("n_tokens"), payload.alias("payload"),
                       F.transform("rows", lambda x: F.struct(*[x[c].alias(c) for c in names])).alias("spans"))
