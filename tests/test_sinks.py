"""Sinks: non-finite values become NULL; the export adds memo columns only when memos exist."""
import pytest
from pyspark.sql import functions as F

from ledgerlens.sources.sinks import (EXPORT_BASE_COLUMNS, EXPORT_MEMO_COLUMNS, export_csv, export_frame, nonfinite_to_null, read_packet,
                                      write_packet)


def test_nonfinite_to_null(spark):
    df = spark.createDataFrame([(1, float("nan"), float("inf"), 2.5), (2, -float("inf"), 1.0, None)],
                               "k int, a double, b double, c double")
    rows = {r["k"]: r for r in nonfinite_to_null(df).collect()}
    assert (rows[1]["a"], rows[1]["b"], rows[1]["c"]) == (None, None, 2.5)
    assert (rows[2]["a"], rows[2]["b"], rows[2]["c"]) == (None, 1.0, None)


def test_export_columns_with_and_without_memos(spark):
    q = spark.createDataFrame([("2024-01-02", "A", "V", 12345678.5, None, ["x", "y", "z"])],
                              "date string, account_name string, vendor string, amount double, "
                              "narrative_status string, recommended_follow_up array<string>")
    q = q.withColumn("date", F.col("date").cast("date"))
    plain = export_frame(q.drop("narrative_status", "recommended_follow_up"))
    assert plain.columns == [c for c in EXPORT_BASE_COLUMNS if c in q.columns]
    assert plain.first()["amount"] == "12345678.5"
    for c in EXPORT_MEMO_COLUMNS:
        if c not in q.columns:
            q = q.withColumn(c, F.lit(None).cast("string"))
    row = export_frame(q).first()
    assert row["narrative_status"] == "Not generated" and row["recommended_follow_up"] == "x; y; z"
    assert row["risk_summary"] == "" and row["date"] == "2024-01-02"


def test_export_keeps_every_digit(spark):
    values = [1e-11, 0.12345678901234567, 1e30, 12345678.9, 100.0, -0.05, 0.0, 123456789012.5, 1e7]
    q = spark.createDataFrame([(v,) for v in values], "amount double")
    texts = [r["amount"] for r in export_frame(q).collect()]
    assert [float(t) for t in texts] == values
    assert texts[3:] == ["12345678.9", "100", "-0.05", "0", "123456789012.5", "10000000"]


def test_parts_of_the_export_are_the_queue_in_order(spark, tmp_path):
    q = spark.range(5000).selectExpr("pmod(id * 7919, 5000) AS queue_position", "concat('a', pmod(id * 7919, 5000)) AS account_name")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        export_csv(q.repartition(9), str(tmp_path / "e"))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    parts = sorted(p for p in (tmp_path / "e").iterdir() if p.name.startswith("part-"))
    rows = [x for p in parts for x in p.read_text().split()[1:]]
    assert len(parts) > 3 and rows == [f"a{k}" for k in range(5000)]


def test_a_packet_is_whole_or_absent(spark, tmp_path):
    one = spark.createDataFrame([(1, 0.5, {"k": "v"})], "a int, b double, m map<string,string>")
    broken = spark.range(3).selectExpr("raise_error('lost') AS x")
    path = str(tmp_path / "packet")
    with pytest.raises(Exception, match="lost"):
        write_packet({"one": one, "two": broken}, path)
    with pytest.raises(Exception):
        read_packet(spark, path)
    for fmt in ("parquet", "json"):
        write_packet({"one": one, "two": spark.range(3).toDF("x")}, path, fmt)
        with pytest.raises(Exception, match="lost"):        # ends before its manifest: the last packet stays
            write_packet({"one": one.union(one), "two": broken}, path, fmt)
        got = read_packet(spark, path)
        assert sorted(got) == ["one", "two"] and [tuple(r) for r in got["one"].collect()] == [(1, 0.5, {"k": "v"})] and got["two"].count() == 3
    spark.range(9).toDF("x").write.mode("overwrite").json(got["two"].inputFiles()[0].rsplit("/", 1)[0])
    with pytest.raises(ValueError, match="two"):
        read_packet(spark, path)


def test_closing_a_review_deletes_its_scratch(spark, tmp_path):
    from ledgerlens.session import SCRATCH, delete_paths, materialize
    begun = len(SCRATCH)
    kept = materialize(spark.range(3), "close-test")
    assert kept.count() == 3
    delete_paths(spark, SCRATCH[begun:])
    with pytest.raises(Exception):
        spark.read.parquet(SCRATCH[begun]).count()
