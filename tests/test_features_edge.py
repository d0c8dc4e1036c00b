"""Literal-row edge cases (FIXTURES.md section 4)."""
from pyspark.sql import functions as F

from ledgerlens.operators.clean import clean_gl
from ledgerlens.operators.features import engineer_features
from ledgerlens.operators.stats import compute_stats
from ledgerlens.sources.sinks import nonfinite_to_null


def feats(df, period_end=None, period=(None, None)):
    c = clean_gl(df)
    st = compute_stats(c, *period)
    return engineer_features(c, st, period_end=period_end)


def by_ref(df, col):
    return {r["journal_ref"]: r[col] for r in df.select("journal_ref", col).collect()}


def test_constant_account_gives_zero_z(ledger):
    rows = [("2024-01-0%d" % i, "0.10", "5000", "Const", "V", "d", f"j{i}") for i in (1, 2, 3)]
    z = by_ref(feats(ledger(rows)), "amount_zscore_by_account")
    assert set(z.values()) == {0.0}


def test_unparseable_amount_in_normal_account(ledger):
    rows = [("2024-01-02", a, "5000", "A", "V", "d", f"j{i}") for i, a in
            enumerate(["100", "250", "330", "abc"])]
    f = feats(ledger(rows))
    r = {x["journal_ref"]: x for x in f.collect()}
    assert r["j3"]["amount"] is None and r["j3"]["amount_zscore_by_account"] is None
    assert r["j3"]["is_round_number"] == 0 and r["j3"]["is_near_approval_threshold"] == 0
    assert r["j0"]["amount_zscore_by_account"] is not None


def test_nan_text_amount_is_null(ledger):
    f = feats(ledger([("2024-01-02", "NaN", "5000", "A", "V", "d", "j0")]))
    row = f.first()
    assert row["amount"] is None and row["is_near_approval_threshold"] == 0


def test_month_gap_compares_with_previous_present_month(ledger):
    rows = [("2024-01-10", "100", "5000", "A", "V", "d", "jan"),
            ("2024-03-10", "150", "5000", "A", "V", "d", "mar"),
            ("2024-04-10", "300", "5000", "A", "V", "d", "apr")]
    pop = by_ref(feats(ledger(rows)), "period_over_period_pct")
    assert pop["jan"] == 0.0
    assert abs(pop["mar"] - 50.0) < 1e-9
    assert abs(pop["apr"] - 100.0) < 1e-9


def test_zero_month_then_nonzero_is_null_at_sink(ledger):
    rows = [("2024-01-10", "0", "5000", "A", "V", "d", "jan"),
            ("2024-02-10", "0", "5000", "A", "V", "d", "feb"),
            ("2024-03-10", "10", "5000", "A", "V", "d", "mar")]
    pop = by_ref(nonfinite_to_null(feats(ledger(rows))), "period_over_period_pct")
    assert pop["jan"] == 0.0 and pop["feb"] == 0.0 and pop["mar"] is None


def test_null_vendor_shares_group_with_unknown(ledger):
    rows = [("2024-01-02", "10", "5000", "A", None, "d", "a"),
            ("2024-01-02", "10", "5000", "A", "NA", "d", "b"),   # NA word -> NULL via CSV only
            ("2024-01-02", "10", "5000", "A", "UNKNOWN", "d", "c")]
    df = ledger(rows).withColumn("vendor", F.when(F.col("vendor") == "NA", None).otherwise(F.col("vendor")))
    f = feats(df)
    assert set(by_ref(f, "vendor_txn_count").values()) == {3}
    assert set(by_ref(f, "is_new_vendor").values()) == {0}
    # NULL vendor holds no concentration share
    assert by_ref(f, "vendor_concentration_pct")["a"] == 0.0


def test_null_account_or_date_gives_null_change(ledger):
    rows = [("2024-01-02", "10", "5000", None, "V", "d", "noacct"),
            (None, "10", "5000", "A", "V", "d", "nodate"),
            ("2024-01-02", "10", "5000", "A", "V", "d", "ok")]
    f = feats(ledger(rows))
    pop = by_ref(f, "period_over_period_pct")
    assert pop["noacct"] is None and pop["nodate"] is None and pop["ok"] == 0.0
    assert by_ref(f, "amount_zscore_by_account")["noacct"] is None


def test_zero_amount_is_round(ledger):
    f = feats(ledger([("2024-01-02", "0", "5000", "A", "V", "d", "z")]))
    assert f.first()["is_round_number"] == 1


def test_near_threshold_edges(ledger):
    amts = ["4749.99", "4750", "4999.99", "5000"]
    rows = [("2024-01-02", a, "5000", "A", "V", "d", a) for a in amts]
    near = by_ref(feats(ledger(rows)), "is_near_approval_threshold")
    assert [near[a] for a in amts] == [0, 1, 1, 0]


def test_last_day_timestamp_outside_window_and_period(ledger):
    from ledgerlens.operators.integrity import date_in_period
    rows = [("2024-12-31 09:00:00", "10", "5000", "A", "V", "d", "late"),
            ("2024-12-31", "10", "5000", "A", "V", "d", "midnight"),
            ("2024-12-22", "10", "5000", "A", "V", "d", "start")]
    c = clean_gl(ledger(rows))
    st = compute_stats(c, "2024-01-01", "2024-12-31")
    ye = by_ref(engineer_features(c, st, period_end="2024-12-31"), "is_year_end_concentration")
    assert ye == {"late": 0, "midnight": 1, "start": 1}
    d = date_in_period(st).first()
    assert d["status"] == "Warning" and d["summary"].startswith("1 of 3 rows fall outside")


def test_weekend_and_missing_description(ledger):
    rows = [("2024-01-06", "10", "5000", "A", "V", "  ", "sat"),
            ("2024-01-07", "10", "5000", "A", "V", " NaN ", "sun"),
            ("2024-01-08", "10", "5000", "A", "V", "rent", "mon")]
    f = feats(ledger(rows))
    assert by_ref(f, "is_weekend_posting") == {"sat": 1, "sun": 1, "mon": 0}
    assert by_ref(f, "missing_description") == {"sat": 1, "sun": 1, "mon": 0}


def test_infinite_and_tiny_amounts(spark):
    from ledgerlens.operators.clean import clean_gl
    from ledgerlens.operators.exact import sum_by
    df = spark.createDataFrame([("A", v) for v in (101.0, 102.0, 103.0, float("inf"), -float("inf"))],
                               "account_name string, amount double")
    assert [r.amount for r in clean_gl(df).collect()] == [101.0, 102.0, 103.0, None, None]
    tiny = spark.createDataFrame([("A", 0.00004)] * 10, "account_name string, amount double")
    assert sum_by(tiny, ["account_name"], "amount", "s").first().s == 0.0004
