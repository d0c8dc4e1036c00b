"""Scale helpers: spreading an under-partitioned input, input size, written tables."""
import os

import pytest

from ledgerlens.session import ensure_parallelism, input_bytes, materialize


def test_ensure_parallelism_only_spreads_small_partition_counts(spark):
    one = spark.range(1000).coalesce(1)
    spread = ensure_parallelism(one, min_partitions=4)
    assert spread.rdd.getNumPartitions() == 4 and spread.count() == 1000
    many = spark.range(1000).repartition(16)
    assert ensure_parallelism(many, min_partitions=4) is many


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.001"), reason="test tables absent")
def test_input_bytes_counts_scanned_files(spark):
    from ledgerlens.sources.fixture import gl_fixture
    b = input_bytes(gl_fixture(spark, "/root/testdata/sf0.001"))
    files = sum(os.path.getsize(f"/root/testdata/sf0.001/{t}.parquet") for t in ("lineitem", "part", "supplier"))
    assert b is not None and 0 < b <= 4 * files


def test_materialize_round_trip(spark):
    df = spark.range(100).withColumnRenamed("id", "x")
    back = materialize(df, "roundtrip")
    assert sorted(r.x for r in back.collect()) == list(range(100))
