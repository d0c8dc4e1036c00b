"""Distributed positions and key-join memo attachment on literal rows."""
import random

from pyspark.sql import functions as F


def test_positions_match_python_sort(spark):
    from ledgerlens.functions.position import with_position
    rnd = random.Random(5)
    rows = [(i, rnd.choice([0.1, 0.2, 0.3, rnd.random()]), f"j{rnd.randrange(1000):04d}") for i in range(5000)]
    df = spark.createDataFrame(rows, "row_id long, score double, ref string").repartition(13)
    got = {r["row_id"]: r["pos"] for r in with_position(df, ["score", "ref", "row_id"], "pos").collect()}
    want = {rid: i for i, (rid, _, _) in enumerate(sorted(rows, key=lambda r: (r[1], r[2], r[0])))}
    assert got == want


def test_attach_by_keys_last_position_wins(spark):
    from ledgerlens.operators.memos import attach_memos
    queue = spark.createDataFrame(
        [(1, "2024-01-01", "A", "V", 10.0), (2, "2024-01-01", "A", "V", 10.0), (3, "2024-01-02", "B", None, 5.0),
         (4, "2024-01-03", "C", "W", 7.0)],
        "row_id long, date string, account_name string, vendor string, amount double")
    fields = ["risk_summary", "assertion_consideration", "magnitude_assessment", "likelihood_assessment",
              "control_or_coso_consideration", "disclaimer"]
    memos = spark.createDataFrame(
        [(0, 1, "2024-01-01", "A", "V", 10.0, "Fallback", "first", ["a", "b", "c"]),
         (1, 2, "2024-01-01", "A", "V", 10.0, "Fallback", "second", ["a", "b", "c"]),
         (2, 3, "2024-01-02", "B", None, 5.0, "GPT", "third", ["a", "b", "c"])],
        "position int, row_id long, date string, account_name string, vendor string, amount double, "
        "narrative_status string, risk_summary string, recommended_follow_up array<string>")
    for f in fields[1:]:
        memos = memos.withColumn(f, F.lit("x"))
    by_keys = {r["row_id"]: (r["narrative_status"], r["risk_summary"])
               for r in attach_memos(queue, memos, by="keys").collect()}
    assert by_keys == {1: ("Fallback", "second"), 2: ("Fallback", "second"), 3: ("GPT", "third"),
                       4: ("Not generated", None)}
    by_id = {r["row_id"]: r["risk_summary"] for r in attach_memos(queue, memos).collect()}
    assert by_id == {1: "first", 2: "second", 3: "third", 4: None}
