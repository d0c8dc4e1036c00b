"""The CSV path (text dates -> naive timestamps, text amounts) gives the same features,
findings and rule outcomes as the typed fixture ledger."""
import os

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators.clean import clean_gl
from ledgerlens.operators.features import engineer_features
from ledgerlens.operators.integrity import integrity_report
from ledgerlens.operators.scoring import apply_scoring, given_scores
from ledgerlens.operators.stats import compute_stats
from ledgerlens.session import scratch_path
from ledgerlens.sources.csv_gl import read_csv_ledger, read_gl_csv
from ledgerlens.sources.fixture import FIXTURE_PARAMS, gl_fixture

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="test tables absent")
COLS = ["amount_zscore_by_account", "is_round_number", "is_weekend_posting", "missing_description",
        "vendor_txn_count", "is_new_vendor", "is_near_approval_threshold", "control_gap_score",
        "fraud_flag_count", "fraud_risk_flag", "period_over_period_pct", "vendor_concentration_pct",
        "is_year_end_concentration", "is_non_standard_pattern", "final_tier", "active_flags"]


def _run(gl):
    p = FIXTURE_PARAMS
    c = clean_gl(gl)
    st = compute_stats(c, p["period_start"], p["period_end"])
    f = engineer_features(c, st, period_end=p["period_end"])
    s = apply_scoring(given_scores(f), 40000.0, 64000.0)
    rows = {}
    key = [F.col("journal_ref"), F.col("date").cast("date").alias("d"), F.col("amount"), F.col("vendor")]
    for r in s.select(*key, *COLS).collect():
        d = r.asDict()
        for k in ("amount_zscore_by_account", "period_over_period_pct", "vendor_concentration_pct"):
            d[k] = None if d[k] is None else round(d[k], 9)
        rows[(d.pop("journal_ref"), d.pop("d"), d.pop("amount"), d.pop("vendor"))] = d
    report = [tuple(r) for r in integrity_report(st).drop("detail").orderBy("check_order").collect()]
    return rows, report


def test_csv_round_trip_same_review(spark):
    gl = gl_fixture(spark, SF, with_row_id=False)
    path = scratch_path(spark, "gl-csv-review")
    gl.select(*[F.col(c).cast("string").alias(c) for c in gl.columns]) \
      .write.option("header", True).option("escape", '"').csv(path)
    typed = gl
    text = read_gl_csv(spark, path, with_row_id=False)
    a_rows, a_rep = _run(typed)
    b_rows, b_rep = _run(text)
    assert a_rep == b_rep
    # empty descriptions become NULL through the CSV (a missing word); both count as missing
    assert a_rows.keys() == b_rows.keys()
    assert a_rows == b_rows


def test_files_with_other_headers_fail_and_line_breaks_are_read(spark, tmp_path):
    import pytest

    from ledgerlens.sources.csv_gl import read_gl_csv
    head = "date,amount,account_code,account_name,vendor,description,journal_ref\n"
    one, two = tmp_path / "two_orders", tmp_path / "line_break"
    one.mkdir()
    two.mkdir()
    (one / "a.csv").write_text(head + "2024-01-01,5,1,Cash,V,x,j1\n")
    (one / "b.csv").write_text("amount,date,account_code,account_name,vendor,description,journal_ref\n5,2024-01-01,1,Cash,V,x,j2\n")
    with pytest.raises(Exception):
        read_gl_csv(spark, str(one)).collect()
    (two / "a.csv").write_text(head + '2024-01-01,5,1,Cash,V,"two\nlines",j1\n2024-01-02,6,1,Cash,V,y,j2\n')
    for multi_line in (None, True):
        rows = read_gl_csv(spark, str(two), multi_line).collect()
        assert sorted((r.amount, r.description) for r in rows) == [("5", "two\nlines"), ("6", "y")]


def test_damaged_rows_are_padded_or_named(spark, tmp_path):
    head = "date,amount,account_code,account_name,vendor,description,journal_ref\n"
    (tmp_path / "a.csv").write_text(head + '2024-01-01,5,1,Cash,V,"a, ""b""",j1\n2024-01-02,6\n2024-01-03,7,1,Cash,V,x,j3,extra\n')
    (tmp_path / "b.csv").write_text(head + '2024-01-04,8,1,Cash,"V, W",x,j4,\n\n2024-01-05,9,1,Cash,V,x\n2024-01-06,10,1,Cash,V,x,j6\n')
    ledger = read_csv_ledger(spark, str(tmp_path))
    rows = {r.amount: r for r in ledger.rows.collect()}
    assert set(rows) == {"5", "6", "9", "10"} and rows["5"].description == 'a, "b"'
    assert rows["6"].account_code is None and rows["6"].journal_ref is None and rows["9"].description == "x" and rows["9"].journal_ref is None
    assert ledger.observed.get == {"n_short": 2, "n_long": 2}
    found = sorted((r.n_fields, r.n_expected, r.record.split(",")[1], r.file[-5:]) for r in ledger.damaged.collect())
    assert found == [(2, 7, "6", "a.csv"), (6, 7, "9", "b.csv"), (8, 7, "7", "a.csv"), (8, 7, "8", "b.csv")]
    assert len({r.row_id for r in rows.values()}) == 4


def test_review_names_damaged_rows_and_the_date_format(spark, tmp_path):
    from ledgerlens.plans.review import review
    gl = gl_fixture(spark, SF, with_row_id=False).withColumn("date", F.date_format("date", "MM/dd/yyyy"))
    gl.select(*[F.col(c).cast("string").alias(c) for c in gl.columns]).coalesce(1).write.option("header", True).option("escape", '"').csv(str(tmp_path / "gl"))
    (tmp_path / "gl" / "more.csv").write_text(",".join(gl.columns) + "\nj-short,01/31/1998,12\n" + "j-long" + "," * 20 + "\n")
    packet = review(read_csv_ledger(spark, str(tmp_path / "gl")), **FIXTURE_PARAMS, n_trees=5, forest_trees=5, forest_depth=3)
    assert packet.request["n_short"] == packet.request["n_long"] == 1 and packet.request["row_count"] == gl.count() + 1
    assert (packet.request["date_format"], packet.request["date_ambiguous"], packet.request["date_failed_share"]) == ("month/day/yyyy", False, 0.0)
    assert packet.tables["damaged_rows"].count() == 2 and packet.tables["date_votes"].count() > 10
    assert packet.scored.where("journal_ref = 'j-short' AND date = '1998-01-31'").count() == 1
