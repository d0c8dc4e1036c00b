"""Sharding by extendible hashing (native).

Every row has a hash; a bucket of depth d holds the rows whose hashes begin with the same d
bits. Starting from one bucket, only buckets over the byte limit split on one more bit. The
directory maps each prefix of the current depth to its bucket, so several neighbouring
entries point to a bucket that did not have to split as deep.

A level reads (prefix of ``STEP`` more bits -> bytes) of the rows still undecided, one
partial aggregate, and resolves all splits of those bits on that table: totals of every
prefix length, the shortest prefix that fits, and its directory entries. Rows look their
prefix up in the directory (a join on evenly spread hash bits). What still exceeds the limit
goes to the next level; with shards of 1 MiB the second level starts at about 60 GB.

The hash is 44 bits of the MD5 of the id and then 16 bits of the row's number in the written
table of sizes, so copies of one id split like any other rows after 44 bits. Buckets that are still
over the limit after these 60 bits split on, by the same levels, on 60 bits of a second hash of the
row's number, so their shards are up to 120 bits deep.

Defined cases: null ids hash as one id; null and empty texts weigh 0 bytes; a single row over
the limit is a shard of its own, and so are rows that share all bits there are (``oversized`` is true
for these two, the only shards over the limit);
an empty table gives an empty result; repeated rows may go to different shards; extra columns
pass through, columns named like a result are replaced.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.session import materialize

ID_BITS, ROW_BITS, STEP = 44, 16, 12
BITS = ID_BITS + ROW_BITS
ADDED = ["shard", "depth", "bytes", "oversized"]
LIMIT = 1 << 20


def row_hash(doc_id: Column, row: Column) -> Column:
    """60 bits: 44 of the id's MD5, 16 of the row number's."""
    def bits(value, n):
        return F.conv(F.substring(F.md5(value), 1, n // 4), 16, 10).cast("long")
    return F.shiftleft(bits(F.coalesce(doc_id.cast("string"), F.lit("")), ID_BITS), ROW_BITS).bitwiseOR(
        bits(row.cast("string"), ROW_BITS))


def deeper_hash(row: Column) -> Column:
    """60 more bits of the row number."""
    return F.shiftrightunsigned(F.xxhash64(row), 64 - BITS)


def directory(sizes: DataFrame, low: int, high: int, limit: int, h: str = "h", stem: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """For rows (hash ``h``, ``bytes``), apart by ``stem``, whose buckets of depth ``low`` are undecided: the directory
    (``prefix`` of ``high`` bits, ``depth``, ``bucket``, ``total``) of what fits at a depth up to
    ``high``, and the prefixes of ``high`` bits that do not."""
    leaf = materialize(sizes.groupBy(*stem, F.shiftright(h, BITS - high).alias("prefix"))
                       .agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n")), "prefix-bytes")
    at = leaf.select(*stem, "bytes", "n", "prefix", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("depth"))
    totals = materialize(at.groupBy(*stem, "depth", F.expr(f"shiftright(prefix, {high} - depth)").alias("bucket"))
                         .agg(F.sum("bytes").alias("total"), F.sum("n").alias("n")), "bucket-bytes")
    fits = (F.col("total") <= limit) | (F.col("n") == 1)     # one row cannot be split
    fit, over = totals.where(fits).drop("n"), totals.where(~fits)
    parents = over.select(*stem, (F.col("depth") + 1).alias("depth"), F.col("bucket").alias("parent"))
    first = fit.withColumn("parent", F.shiftright("bucket", 1))
    first = (first.where(F.col("depth") > low).join(parents, [*stem, "depth", "parent"])
             .select(*stem, "depth", "parent", "bucket", "total")
             .unionByName(first.where(F.col("depth") == low).select(*stem, "depth", "parent", "bucket", "total")))
    entries = first.select(*stem, "depth", "bucket", "total", F.explode(F.expr(
        f"sequence(shiftleft(bucket, {high} - depth), shiftleft(bucket + 1, {high} - depth) - 1)")).alias("prefix"))
    return entries, over.where(F.col("depth") == high).select(*stem, F.col("bucket").alias("prefix"))


def levels(sizes: DataFrame, limit: int, h: str = "h", stem: tuple[str, ...] = ()) -> list[DataFrame]:
    """Rows with ``shard``, ``depth`` and ``total``, in parts, by the bits of ``h`` below those of ``stem``."""
    done, todo, low, keys = [], sizes, 0, [*stem, "prefix"]
    above = [F.expr(f"lpad(bin({x}), {BITS}, '0')") for x in stem]
    name = F.concat(*above, F.when(F.col("depth") == 0, "").otherwise(F.expr("lpad(bin(bucket), depth, '0')")))
    while True:
        high = min(low + STEP, BITS)
        entries, over = directory(todo, low, high, limit, h, stem)
        over = materialize(over, "oversized")
        more = not over.isEmpty()
        deeper = more and high == BITS and h == "h" and "h2" in sizes.columns
        if high == BITS and more and not deeper:
            last = over.select(*keys, F.lit(BITS).alias("depth"), F.col("prefix").alias("bucket"),
                               F.lit(limit + 1).cast("long").alias("total"))
            entries = entries.unionByName(last)
        keyed = todo.withColumn("prefix", F.shiftright(h, BITS - high))
        found = keyed.join(materialize(entries, "directory"), keys).drop("prefix").withColumn("shard", name)
        done.append(found.withColumn("depth", F.col("depth") + BITS * len(stem)).drop("bucket"))
        if not more or high == BITS and not deeper:
            return done
        todo = materialize(keyed.join(over, keys, "left_semi").drop("prefix"), "undecided")
        if deeper:
            return done + levels(todo, limit, "h2", ("h",))
        low = high


def assign(sizes: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Add ``shard`` (its hash prefix in binary; empty: one shard for all), ``depth`` and
    ``oversized`` to rows of (``h``, ``bytes``), which may have the bits of a second hash in ``h2``."""
    rows, *others = levels(sizes, limit)
    for other in others:
        rows = rows.unionByName(other)
    return rows.withColumn("oversized", F.col("total") > limit).drop("total")


def shards(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """doc_id, shard, depth, bytes and oversized of every row of ``docs`` (``doc_id``, ``text``)."""
    sizes = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"),
                        F.monotonically_increasing_id().alias("_n"))
    sizes = materialize(sizes.select("doc_id", "bytes", row_hash(F.col("doc_id"), F.col("_n")).alias("h"),
                                     deeper_hash(F.col("_n")).alias("h2")), "sizes")
    return assign(sizes, limit).select("doc_id", *ADDED)


def write_shards(docs: DataFrame, path: str, limit: int = LIMIT) -> None:
    """Write ``docs`` as one folder per shard below ``path`` (partition column ``shard``); texts are
    shuffled once, to the task of their shard."""
    docs = docs.drop(*ADDED).withColumn("_n", F.monotonically_increasing_id())
    rows = materialize(docs.select(F.struct(*[c for c in docs.columns if c != "_n"]).alias("_row"), "_n", F.coalesce(
        F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"),
        row_hash(F.col("doc_id"), F.col("_n")).alias("h"), deeper_hash(F.col("_n")).alias("h2")), "shard-rows")
    found = assign(rows.select("_n", "bytes", "h", "h2"), limit)
    both = rows.select("_row", "_n").join(found, "_n").select("_row.*", "shard")
    both.repartition("shard").write.partitionBy("shard").parquet(path)
