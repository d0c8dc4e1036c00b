"""Token-id output in patched frame-of-reference blocks.

Documents are range-partitioned and sorted by id once (the only shuffle of texts); each task
encodes its range and writes segments of whole documents. A segment is one binary value:

    magic "PFB1", tokens, block length, blocks            (4 x 4 bytes, little-endian)
    start of every block in the segment                   (4 bytes each)
    blocks: minimum (4), width (1), exceptions (2), packed differences to the minimum at that
            width, exception positions (2 each) and full differences (4 each)

The width of a block is that of the ``percentile`` of its differences, so rare large ones
become exceptions instead of widening the block. Segments are stored as rows of a Parquet
table, which commits whole tasks only: a lost executor leaves no half-written file. Offsets
of the ranges come from the stored counts (one row per range).

Encoding asks the tokenizers library for distinct chunks only and reuses the answers. Chunks
end where a blank stands between two printable characters: the tokenizer's own pattern
always starts a new token there, so chunks encode as they do inside the text (``starts_at_blanks``
reads that off its file; any other tokenizer gets whole texts).

Defined cases: null and empty texts hold the end id only; rows that share an id are ordered by
their text's hash and keep a range each; a null id sorts first; an empty table gives no
segments and an empty result; other columns are not written.
"""
from __future__ import annotations

import functools
import json
import re
import zlib
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlens.llm.chunks import Gather, Memory, flat_ids, ranges, words_of

MAGIC = 0x31424650
BLOCK = 1024
PERCENTILE = 0.9
SEGMENT = 1 << 18
PRINTED = "!-~¡-ɏ"
BREAK = re.compile(f"(?<=[{PRINTED}])(?= [{PRINTED}])")
BLANK = "Ġ"        # the blank in a byte-level vocabulary
PLAIN = f"(?s)\\A[{PRINTED}](.*[{PRINTED}])?\\z"       # in the syntax of Arrow


def places(w: int) -> Iterator[tuple[int, int, int]]:
    """Eight numbers of ``w`` bits fill ``w`` bytes: each number, each byte it touches, and the shift to
    the left that brings the one to the other."""
    return ((k, b, 8 * (b + 1) - w * (k + 1)) for k in range(8) for b in range(w * k // 8, (w * (k + 1) + 7) // 8))


def shifted(x: np.ndarray, by: int) -> np.ndarray:
    return x << np.uint32(by) if by >= 0 else x >> np.uint32(-by)


def narrow(rows: np.ndarray, w: int) -> np.ndarray:
    """The lowest ``w`` bits of every number, highest first, without gaps: a row of bytes per row."""
    numbers = (rows & np.uint32((1 << w) - 1)).reshape(-1, 8).T.copy()
    out = np.zeros((w, numbers.shape[1]), "u1")
    for k, b, by in places(w):
        out[b] |= shifted(numbers[k], by).astype("u1")
    return out.T.copy().reshape(len(rows), -1)


def widen(rows: np.ndarray, w: int) -> np.ndarray:
    """The numbers of ``w`` bits in rows of bytes."""
    data = rows.reshape(-1, w).T.astype("u4", order="C")
    out = np.zeros((8, data.shape[1]), "u4")
    for k, b, by in places(w):
        out[k] |= shifted(data[b], -by)
    return (out & np.uint32((1 << w) - 1)).T.copy().reshape(len(rows), -1)


def pack(ids: np.ndarray, block: int = BLOCK, percentile: float = PERCENTILE) -> bytes:
    """One segment."""
    n = len(ids)
    blocks = -(-n // block)
    rows = np.zeros(blocks * block, "u4")
    rows[:n] = ids
    rows[n:] = ids[-1] if n else 0
    rows = rows.reshape(blocks, block)
    low = rows.min(axis=1) if blocks else np.zeros(0, "u4")
    diff = rows - low[:, None]
    at = min(block - 1, max(0, int(np.ceil(percentile * block)) - 1))
    chosen = np.partition(diff, at, axis=1)[:, at] if blocks else low
    width = np.ceil(np.log2(chosen.astype("f8") + 1)).astype("u1")
    packed: list = [b""] * blocks
    for w in np.unique(width[width > 0]):
        own = np.flatnonzero(width == w)
        for k, data in zip(own, narrow(diff[own], int(w)), strict=True):
            packed[k] = data.tobytes()
    over = diff > ((np.uint64(1) << width.astype("u8")) - np.uint64(1)).astype("u4")[:, None]
    out, starts, size = [], [], 16 + 4 * blocks
    for k in range(blocks):
        where = np.flatnonzero(over[k])
        data = b"".join((low[k].astype("<u4").tobytes(), bytes([width[k]]), len(where).to_bytes(2, "little"),
                         packed[k], where.astype("<u2").tobytes(), diff[k, where].astype("<u4").tobytes()))
        starts.append(size)
        size += len(data)
        out.append(data)
    head = np.array([MAGIC, n, block, blocks, *starts], "<u4").tobytes()
    return head + b"".join(out)


def unpack(segment: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """Ids of blocks ``first`` to ``last`` (exclusive) of a segment; all by default."""
    magic, n, block, blocks = np.frombuffer(segment, "<u4", 4).tolist()
    if magic != MAGIC:
        raise ValueError("not a segment")
    raw = np.frombuffer(segment, "u1")
    last = blocks if last is None else min(last, blocks)
    starts = np.frombuffer(segment, "<u4", blocks, 16)[first:last].astype("i8")
    if not len(starts):
        return np.zeros(0, "u4")
    head = raw[starts[:, None] + np.arange(7)]
    low = head[:, :4].copy().view("<u4")[:, 0]
    width = head[:, 4].astype("i8")
    patched = head[:, 5:7].copy().view("<u2")[:, 0].astype("i8")
    out = np.zeros((len(starts), block), "u4")
    for w in np.unique(width[width > 0]):
        own = np.flatnonzero(width == w)
        out[own] = widen(np.stack([raw[a:a + block * w // 8] for a in (starts[own] + 7).tolist()]), int(w))
    for k in np.flatnonzero(patched):
        a = int(starts[k] + 7 + block * width[k] // 8)
        m = int(patched[k])
        out[k, np.frombuffer(segment, "<u2", m, a)] = np.frombuffer(segment, "<u4", m, a + 2 * m)
    return (out + low[:, None]).reshape(-1)[:n - first * block]


def starts_at_blanks(path: str) -> bool:
    """Whether the tokenizer starts a token at every blank between two printable characters, and
    writes that blank as ``BLANK``."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    cut = model["pre_tokenizer"] or {}
    return (model["normalizer"] is None and cut.get("type") == "ByteLevel" and cut.get("use_regex", True)
            and not cut.get("add_prefix_space")
            and all(not (x["lstrip"] or x["rstrip"] or x["single_word"] or " " in x["content"] or BLANK in x["content"])
                    for x in model["added_tokens"]))


class Tails(Gather):
    """Ids of words that follow a blank, learnt once and kept up to ``most`` characters in all.
    Words have numbers; 0 is any word without ids."""

    def __init__(self, most: int = 12_000_000):
        self.most, self.held = most, 0
        self.known: dict[str, int] = {}
        self.size = self.begin = np.zeros(1, "i8")
        self.flat = np.zeros(0, "<u4")

    def trim(self) -> None:
        if self.held > self.most:
            self.__init__(self.most)

    def numbers(self, words: pa.Array, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Number of each of the distinct ``words``; ``encode`` is given those not yet known."""
        distinct = words.to_numpy(zero_copy_only=False)        # far cheaper than to_pylist
        out = np.fromiter(map(self.known.get, distinct.tolist(), repeat(0)), "i8", len(distinct))
        new = np.flatnonzero(out == 0)
        new = new[pc.match_substring_regex(words.take(pa.array(new)), PLAIN).to_numpy(zero_copy_only=False)]
        if len(new):
            chunks = distinct[new].tolist()
            flat, size = encode(chunks)
            out[new] = len(self.size) + np.arange(len(new))
            self.known.update(zip(chunks, out[new].tolist(), strict=True))
            self.begin = np.concatenate([self.begin, len(self.flat) + np.cumsum(size) - size])
            self.size = np.concatenate([self.size, size])
            self.flat = np.concatenate([self.flat, flat])
            self.held += len("".join(chunks))
        return out


class ChunkEncoder:
    """Ids of texts from those of their distinct chunks."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        self.blank = np.zeros(max(vocab.values()) + 1, bool)
        self.blank[[i for x, i in vocab.items() if x.startswith(BLANK)]] = True
        self.cuts = starts_at_blanks(path)
        self.heads = Memory()      # chunks as they stand
        self.tails = Tails()       # chunks without their leading blank

    def whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return flat_ids([e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)])

    def joined(self, chunks: list[str], together: int = 64, texts: int = 128) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks of printable edges and without blanks, each with a blank before it, many in
        one text: a token that begins with the blank begins a chunk."""
        joined = [" " + " ".join(chunks[a:a + together]) for a in range(0, len(chunks), together)]
        flat = np.concatenate([self.whole(joined[a:a + texts])[0] for a in range(0, len(joined), texts)])
        begins = np.flatnonzero(self.blank[flat])
        if len(begins) != len(chunks):
            raise ValueError("a token does not start at a blank")
        return flat, np.diff(begins, append=len(flat))

    def encode(self, texts: pa.Array, together: int = 1 << 20) -> Iterator[bytes]:
        """Ids of every text as little-endian 32-bit bytes; up to ``together`` words are put together
        at a time."""
        if not self.cuts:
            for x in texts:
                yield self.whole([x.as_py() or ""])[0].tobytes()
            return
        self.heads.trim()
        self.tails.trim()
        at, words, edge = words_of(texts)
        firsts = words.take(pa.array(at[edge[:-1]])).to_pylist()
        at = self.tails.numbers(words, self.joined)[at]
        # A text whose blanks do not all stand between printable characters is cut by the pattern.
        plain = np.logical_and.reduceat(at > 0, edge[:-1]) if len(at) else np.zeros(0, bool)
        heads = [[first] if ok else BREAK.split(x.as_py() or "") for first, ok, x in zip(firsts, plain, texts, strict=True)]
        self.heads.learn(list({x for h in heads for x in h} - self.heads.known.keys()), self.whole)
        head = self.heads.known.__getitem__
        for i, j in ranges(edge, together):
            own = edge[i:j + 1] - edge[i]
            rest, ends = self.tails(at[edge[i]:edge[j]], own[:-1])      # first words stand in heads
            rest, ends = rest.tobytes(), (4 * np.concatenate([[0], ends]))[own]
            for h, a, b, ok in zip(heads[i:j], ends[:-1], ends[1:], plain[i:j], strict=True):
                yield b"".join(map(head, h)) + (rest[a:b] if ok else b"")


@functools.cache
def chunk_encoder(path: str) -> ChunkEncoder:
    import os
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")     # one core a task
    return ChunkEncoder(path)


def in_order(docs: DataFrame) -> DataFrame:
    """Range-partitioned and sorted by id, ties by the text's hash."""
    order = ["doc_id", F.xxhash64("text")]
    return docs.select("doc_id", "text").repartitionByRange(*order).sortWithinPartitions(*order)


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int, segment: int = SEGMENT) -> None:
    """Write the segments of ``docs`` (``doc_id``, ``text``) as a Parquet table at ``path``."""
    kind = docs.schema["doc_id"].dataType
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = chunk_encoder(tokenizer).encode
        part, seg, first, ids, data, held = TaskContext.get().partitionId(), 0, 0, [], [], 0

        def cut():
            sizes = [len(x) // 4 for x in data]
            tokens = np.frombuffer(b"".join(data), "<u4")
            return pa.RecordBatch.from_pydict({
                "part": [part], "segment": [seg], "first": [first], "n_tokens": [len(tokens)],
                "doc_ids": pa.array([ids]), "sizes": [sizes], "payload": [pack(tokens)]}, names)

        for batch in batches:
            for i, x in zip(batch.column(0).to_pylist(), encode(batch.column(1)), strict=True):
                ids.append(i)
                data.append(x + end)
                held += len(x) // 4 + 1
                if held >= segment:
                    yield cut()
                    seg, first, ids, data, held = seg + 1, first + held, [], [], 0
        if ids:
            yield cut()

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructType
    schema = (StructType().add("part", IntegerType()).add("segment", IntegerType()).add("first", LongType())
              .add("n_tokens", LongType()).add("doc_ids", ArrayType(kind)).add("sizes", ArrayType(IntegerType()))
              .add("payload", BinaryType()))
    names = to_arrow_schema(schema)
    in_order(docs).mapInArrow(run, schema).write.option("compression", "zstd").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 (of the ids as
    little-endian 32-bit integers) of every document, from the segments alone."""
    segments = spark.read.parquet(path)
    kind = segments.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, first, ids, sizes, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                tokens = unpack(payload).astype("<u4")
                edge = np.concatenate([[0], np.cumsum(sizes)])
                crc = [zlib.crc32(tokens[a:b]) for a, b in zip(edge[:-1], edge[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(ids), pa.int32()), pa.array(ids, batch.column(2).type.value_type),
                     pa.array(first + edge[:-1], pa.int64()), pa.array(sizes, pa.int64()), pa.array(crc, pa.int64())],
                    ["part", "doc_id", "local", "n_tokens", "ids_crc32"])

    rows = segments.select("part", "first", "doc_ids", "sizes", "payload").mapInArrow(
        run, f"part int, doc_id {kind}, local long, n_tokens long, ids_crc32 long")
    counts = segments.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)     # a row per range
    counts = counts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return rows.join(counts, "part").select(
        "doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")
