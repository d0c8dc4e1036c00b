import hashlib
from collections import defaultdict

from helpers import odd_docs, same_as_oracle
from pyspark.sql import functions as F

from ledgerlens.llm import sharding as S
from ledgerlens.session import materialize


def test_oracle(spark):
    same_as_oracle(spark, "op9_sharding")


def split(rows, limit, depth=0):
    """Extendible hashing of (hash, bytes) by hand: name -> rows."""
    if sum(b for _, b in rows) <= limit or len(rows) == 1 or depth == S.BITS:
        return {f"{rows[0][0] >> (S.BITS - depth):0{depth}b}" if depth else "": rows} if rows else {}
    one = [r for r in rows if r[0] >> (S.BITS - depth - 1) & 1]
    two = [r for r in rows if not r[0] >> (S.BITS - depth - 1) & 1]
    return split(one, limit, depth + 1) | split(two, limit, depth + 1)


def test_shards_equal_brute_force(spark):
    rows = [(int(hashlib.md5(str(i).encode()).hexdigest()[:15], 16), 1 + i * 37 % 90) for i in range(3000)]
    rows += [(rows[0][0], 40)] * 5 + [(12345, 500)]
    sizes = materialize(spark.createDataFrame(rows, "h long, bytes long"), "test-sizes")
    for limit in (100, 3000, 10**9):
        got = defaultdict(list)
        for r in S.assign(sizes, limit).collect():
            got[r.shard].append((r.h, r.bytes))
            assert r.depth == len(r.shard)
        assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in split(rows, limit).items()}


def test_hot_id_splits(spark):
    docs = spark.range(2000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("x" * 100).alias("text")).union(
        spark.range(100).select("id", F.lit("y" * 100).alias("text")))
    rows = S.shards(docs, 10_000).collect()
    total = defaultdict(int)
    for r in rows:
        total[r.shard] += r.bytes
    assert len(rows) == 2100 and max(total.values()) <= 10_000 and not any(r.oversized for r in rows)


def test_odd_rows(spark, tmp_path):
    docs = odd_docs(spark, "bytes depth oversized")
    rows = S.shards(docs, 500).collect()
    assert len(rows) == docs.count()
    assert all(r.bytes <= 500 or r.oversized for r in rows) and [r.doc_id for r in rows if r.oversized] == [10]
    assert S.shards(docs.limit(0)).count() == 0
    S.write_shards(docs, str(tmp_path / "out"), 500)
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(rows)


def test_rows_of_one_id_split_beyond_the_first_hash(spark):
    """20,000 rows of one id and limits of one row: 16 bits of the row number do not tell all apart."""
    docs = spark.range(20_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("x").alias("text"))
    rows = S.shards(docs, 1).collect()
    assert len(rows) == len({r.shard for r in rows}) == 20_000 and not any(r.oversized for r in rows)
    assert all(r.depth == len(r.shard) for r in rows) and max(r.depth for r in rows) > S.BITS
    names = sorted(r.shard for r in rows)
    assert not any(b.startswith(a) for a, b in zip(names, names[1:], strict=False))
