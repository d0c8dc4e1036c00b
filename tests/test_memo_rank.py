"""Memo ranking keys on literal rows, and queue positions on the real review."""
import os

import pytest


def _queue(spark, rows):
    return spark.createDataFrame(rows, "row_id long, journal_ref string, final_tier string, "
                                 "is_qualitative_override int, fraud_risk_flag int, anomaly_score double, "
                                 "amount double, date string, account_name string, vendor string")


def test_rank_keys_in_order(spark):
    from ledgerlens.operators.memos import memo_rank
    rows = [
        (1, "a", "Medium", 1, 1, -0.5, 10.0, None, None, None),
        (2, "b", "High", 0, 0, 0.2, 5.0, None, None, None),          # High beats everything
        (3, "c", "High", 1, 0, 0.3, 5.0, None, None, None),          # override first within High
        (4, "d", "Medium", 1, 1, -0.5, 20.0, None, None, None),      # larger signed amount first
        (5, "e", "Medium", 1, 0, -0.9, 99.0, None, None, None),      # co-occurrence before it
        (6, "f", "Medium", 1, 1, None, -5.0, None, None, None),      # NULL score as 0
        (7, "g", "Odd", 1, 1, -1.0, 1.0, None, None, None),          # unknown tier last
        (8, "h", "Monitor", 0, 0, -1.0, None, None, None, None),
    ]
    got = [r["journal_ref"] for r in memo_rank(_queue(spark, rows), 50).orderBy("position").collect()]
    assert got == ["c", "b", "d", "a", "f", "e", "h", "g"]


def test_any_top_n_or_the_whole_queue(spark):
    from ledgerlens.operators.memos import memo_rank
    rows = [(i, f"j{i:03d}", "Medium", 0, 0, -i / 100.0, 1.0, None, None, None) for i in range(30)]
    q = _queue(spark, rows)
    assert memo_rank(q).count() == memo_rank(q, 99).count() == 30 and memo_rank(q, 25).count() == 25
    assert [r["position"] for r in memo_rank(q, 5).orderBy("position").collect()] == list(range(5))
    with pytest.raises(ValueError):
        memo_rank(q, 0)


def test_one_memo_per_position_and_row(spark):
    from pyspark.sql import functions as F

    from ledgerlens.operators.memos import attach_memos, full_memo, memo_rank, memo_table
    rows = [(i, f"j{i}", "High", 0, 0, -0.1, 1.0, None, None, None) for i in range(3)]
    q = _queue(spark, rows).selectExpr("*", "'Weekend posting' AS active_flags", "'x' AS materiality_annotation")
    c = memo_rank(q).select("position", F.to_json(full_memo()).alias("memo_json"))
    bad = c.select("position", F.lit("not json").alias("memo_json"))
    m = memo_table(q, None, c.unionAll(c).unionAll(bad))
    assert m.count() == 3 and {r.narrative_status for r in m.collect()} == {"GPT"}
    assert attach_memos(q, m.unionAll(m)).count() == 3
    assert attach_memos(q, m.unionAll(m), by="keys").count() == 3


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.001"), reason="test tables absent")
def test_queue_positions_follow_anomaly_order(spark):
    from ledgerlens.plans.review import review_fixture
    q = review_fixture(spark, "/root/testdata/sf0.001", forest_trees=10).flagged
    rows = sorted(q.select("queue_position", "anomaly_score").collect(), key=lambda r: r[0])
    assert [r[0] for r in rows] == list(range(len(rows)))
    scores = [r[1] for r in rows]
    assert scores == sorted(scores)
