"""Token counts of documents in flat, unindexed token files by a separator scan.

A flat file is nothing but token ids with an end-of-document id after each document. It is
read in blocks of any size that know only their file and number; documents may begin, end
and span blocks anywhere.

1. ``scan``: each block is searched for the separator at once (one vector comparison); the
   positions found are written as a narrow table.
2. ``boundaries``: an exclusive prefix scan over the blocks (tokens, separators, last
   separator), first within each file and then over the files' totals, gives every block the
   position it starts at, the ordinal of its first document and where that document began.
   One row per block, then one per file, takes part; no token is read again.
3. ``counts``: each separator closes a document: its length is the distance to the previous
   separator, which for the first one of a block comes from the prefix scan.

Defined cases: a document of no tokens counts its separator only; tokens after the last
separator of all files are one open document (``closed`` false); blocks without separator
only carry on; an empty block or table gives nothing. Where the writer is used: null and
empty texts are documents of a separator, rows that share an id (or have none) are documents
of their own, other columns are not written.
"""
from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from ledgerlens.llm.chunks import slices
from ledgerlens.llm.tokenfile import in_order
from ledgerlens.session import materialize

BLOCK = 1 << 20


@functools.cache
def tiktoken_encoder(path: str, pattern: str):
    import base64

    import tiktoken
    with open(path, "rb") as ranks:
        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks)}
    return tiktoken.Encoding("flat", pat_str=pattern, mergeable_ranks=merges, special_tokens={})


def write_flat(docs: DataFrame, path: str, ranks: str, pattern: str, end_id: int, block: int = BLOCK,
               ordered: bool = False) -> None:
    """Write the documents, as they are read (no shuffle) or ``ordered`` by id, as flat files of
    16-bit ids, cut into blocks of ``block`` tokens wherever they fall: a table of (file, block, payload, doc_ids). ``doc_ids`` names the
    documents that end in the block, in order, and tells nothing of their lengths."""
    kind = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tiktoken_encoder(ranks, pattern).encode_ordinary
        part, number, left, waiting = TaskContext.get().partitionId(), 0, np.zeros(0, "<u2"), []
        # documents whose separator is still to come out, as (id, tokens from here to its end)

        def cut(size):
            nonlocal number, left, waiting
            ends = np.cumsum([n for _, n in waiting]) if waiting else np.zeros(0)
            done = int((ends <= size).sum())
            out = pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([number], pa.int32()),
                 pa.array([left[:size].tobytes()], pa.binary()),
                 pa.array([[i for i, _ in waiting[:done]]], names.field("doc_ids").type)], schema=names)
            if done < len(waiting):
                i, n = waiting[done]
                waiting = [(i, int(ends[done] - size)), *waiting[done + 1:]]
            else:
                waiting = []
            number, left = number + 1, left[size:]
            return out

        for batch in batches:
            for piece in slices(batch, 1):
                ids = [[*encode(t or ""), end_id] for t in piece.column(1).to_pylist()]
                waiting += [(i, len(x)) for i, x in zip(piece.column(0).to_pylist(), ids, strict=True)]
                left = np.concatenate([left, *[np.array(x, "<u2") for x in ids]])
                while len(left) >= block:
                    yield cut(block)
        if len(left):
            yield cut(len(left))

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import BinaryType, StructType
    schema = (StructType().add("file", IntegerType()).add("block", IntegerType())
              .add("payload", BinaryType()).add("doc_ids", ArrayType(kind)))
    names = to_arrow_schema(schema)
    docs = in_order(docs) if ordered else docs.select("doc_id", "text")
    docs.mapInArrow(run, schema).write.option("compression", "zstd").parquet(path)


def read_files(spark: SparkSession, path: str, block: int = BLOCK, width: int = 2) -> DataFrame:
    """Blocks of plain binary files of token ids (each under 2 GB), in name order."""
    files = spark.read.format("binaryFile").load(path).select(
        F.col("path").alias("file"), F.col("content").alias("c"), F.col("length"))
    last = F.greatest(F.ceil(F.col("length") / (block * width)).cast("int") - 1, F.lit(0))
    files = files.select("file", "c", F.explode(F.sequence(F.lit(0), last)).alias("block"))
    return files.select("file", "block", F.substring(
        "c", F.col("block") * (block * width) + 1, F.lit(block * width)).alias("payload"))


def scan(blocks: DataFrame, end_id: int, dtype: str = "<u2") -> DataFrame:
    """(file, block, n, ends): tokens of each block and the positions of its separators; other
    columns of ``blocks`` are kept."""
    kept = [c for c in blocks.columns if c != "payload"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(x.as_py() or b"", dtype) for x in batch.column(len(kept))]
            ends = [np.flatnonzero(x == end_id) for x in ids]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in ends])]).astype("i4")
            found = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, "i4"), *ends]).astype("i4")))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([len(x) for x in ids], pa.int64()), found],
                                             [*kept, "n", "ends"])

    schema = blocks.select(*kept).schema.add("n", "long").add("ends", ArrayType(IntegerType()))
    return blocks.select(*kept, "payload").mapInArrow(run, schema)


def boundaries(found: DataFrame) -> DataFrame:
    """For every block: ``base`` (tokens before it), ``ordinal`` (documents closed before it) and
    ``open`` (position at which its first document begins)."""
    rows = found.select("file", "block", "n", F.size("ends").cast("long").alias("k"),
                        F.try_element_at("ends", F.lit(-1)).alias("last"))
    own = Window.partitionBy("file").orderBy("block")
    before = own.rowsBetween(Window.unboundedPreceding, -1)

    def total(c, w):
        return F.coalesce(F.sum(c).over(w), F.lit(0))
    rows = rows.select("file", "block", "n", "k", total("n", before).alias("b"), total("k", before).alias("o"), "last")
    rows = rows.withColumn("e", F.max(F.col("b") + F.col("last") + 1).over(before))
    files = rows.groupBy("file").agg(F.sum("n").alias("n"), F.sum("k").alias("k"),
                                     F.max(F.col("b") + F.col("last") + 1).alias("e"))
    earlier = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)     # one row per file
    files = files.select("file", total("n", earlier).alias("fb"), total("k", earlier).alias("fo"), "e")
    files = files.select("file", "fb", "fo", F.coalesce(
        F.max(F.col("fb") + F.col("e")).over(earlier), F.lit(0)).alias("fe"))
    return rows.join(files, "file").select(
        "file", "block", (F.col("fb") + F.col("b")).alias("base"), (F.col("fo") + F.col("o")).alias("ordinal"),
        F.coalesce(F.col("fb") + F.col("e"), F.col("fe")).alias("open"))


def counts(blocks: DataFrame, end_id: int, dtype: str = "<u2", tail: bool = True) -> DataFrame:
    """ordinal, start, n_tokens (with the separator) and closed of every document; ``doc_id`` too
    where the blocks have ``doc_ids``."""
    found = materialize(scan(blocks, end_id, dtype), "separators")
    at = materialize(boundaries(found), "boundaries")
    named = "doc_ids" in found.columns
    rows = found.join(at, ["file", "block"]).select(
        "base", "ordinal", "open", "ends", *(["doc_ids"] if named else []), F.posexplode("ends").alias("k", "end"))
    start = F.when(F.col("k") == 0, F.col("open")).otherwise(
        F.col("base") + F.get("ends", F.col("k") - 1) + 1)
    docs = rows.select(*([F.get("doc_ids", F.col("k")).alias("doc_id")] if named else []),
                       (F.col("ordinal") + F.col("k")).alias("ordinal"), start.alias("start"),
                       (F.col("base") + F.col("end") + 1 - start).alias("n_tokens"), F.lit(True).alias("closed"))
    if not tail:
        return docs
    rest = found.join(at, ["file", "block"]).agg(
        F.sum("n").alias("n"), F.sum(F.size("ends")).alias("ordinal"), F.max(F.coalesce(
            F.col("base") + F.try_element_at("ends", F.lit(-1)) + 1, F.col("open"))).alias("start"))
    rest = rest.where(F.col("n") > F.col("start")).select(
        *([F.lit(None).cast(docs.schema["doc_id"].dataType).alias("doc_id")] if named else []),
        "ordinal", "start", (F.col("n") - F.col("start")).alias("n_tokens"), F.lit(False).alias("closed"))
    return docs.unionByName(rest)
