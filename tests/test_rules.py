"""Scoring rules and model-layer guards on literal rows."""
from pyspark.sql import functions as F

from ledgerlens.functions.tiers import raw_tier
from ledgerlens.operators.scoring import apply_scoring


def test_tier_edges(spark):
    df = spark.createDataFrame([(-0.15,), (-0.1499,), (-0.05,), (-0.0499,)], "s double")
    got = [r[0] for r in df.select(raw_tier(F.col("s"))).collect()]
    assert got == ["High", "Medium", "Medium", "Low"]


def _rows(spark, rows):
    schema = ("raw_tier string, abs_amount double, fraud_risk_flag int, fraud_flag_count int, "
              "fraud_probability double, amount_zscore_by_account double, is_round_number int, "
              "is_weekend_posting int, missing_description int, is_new_vendor int, "
              "is_near_approval_threshold int")
    return spark.createDataFrame(rows, schema)


def test_materiality_override_and_escalation(spark):
    rows = [
        ("High", 70000.0, 0, 0, 0.1, 0.0, 0, 0, 0, 0, 0),    # >= txn keeps High
        ("High", 50000.0, 0, 0, 0.1, 0.0, 0, 0, 0, 0, 0),    # >= perf one down -> Medium
        ("High", 100.0, 0, 0, 0.1, 0.0, 0, 0, 0, 0, 0),      # below perf -> Monitor
        ("Low", 100.0, 1, 2, 0.9, 0.0, 1, 1, 0, 0, 0),       # override: one above raw -> Medium
        ("Low", 100.0, 0, 1, 0.9, 2.5, 1, 0, 0, 0, 0),       # escalation: Monitor -> Low
        ("Medium", None, 0, 0, 0.0, None, 0, 0, 0, 0, 0),    # NULL amount -> Monitor
    ]
    out = apply_scoring(_rows(spark, rows), 40000.0, 64000.0).collect()
    assert [r["final_tier"] for r in out] == ["High", "Medium", "Monitor", "Medium", "Low", "Monitor"]
    assert out[3]["is_qualitative_override"] == 1
    assert out[3]["qualitative_override_note"].startswith("Escalated to Medium: 2 fraud indicators co-occur")
    assert out[4]["is_supervised_escalation"] == 1 and "similarity=0.90 >= 0.50" in out[4]["supervised_escalation_note"]
    assert out[3]["is_supervised_escalation"] == 0          # never on top of an override
    assert out[4]["active_flags"] == "Unusual amount for account; Round number amount"
    assert out[0]["active_flags"] == "Statistical anomaly only"
    assert out[5]["materiality_annotation"] == "Below Performance Materiality"
    assert [r["flagged_status"] for r in out] == ["Flagged", "Flagged", "Monitor", "Flagged", "Monitor", "Monitor"]
    for r in out:                                          # override implies note
        assert (r["is_qualitative_override"] == 1) == (r["qualitative_override_note"] != "")


def test_escalation_never_lowers(spark):
    from ledgerlens.functions.tiers import tier_rank
    rows = [(t, a, f, 2, p, 0.0, 1, 1, 0, 0, 0) for t in ("High", "Medium", "Low")
            for a in (100.0, 50000.0, 70000.0) for f in (0, 1) for p in (0.2, 0.8)]
    out = apply_scoring(_rows(spark, rows), 40000.0, 64000.0)
    bad = out.filter(F.col("is_supervised_escalation") == 1).filter(
        tier_rank(F.col("final_tier")) < 1).count()
    assert bad == 0


def test_train_guards(spark):
    from ledgerlens.operators.similarity import train_similarity
    base = [(float(i), 0.0, 0.0, 0.0, 0, 0, 5) for i in range(40)]

    def df(n_pos, n_total=40):
        rows = [r + (1 if i < n_pos else 0,) for i, r in enumerate(base[:n_total])]
        return spark.createDataFrame(rows, "abs_amount double, amount_zscore_by_account double, "
                                     "period_over_period_pct double, vendor_concentration_pct double, "
                                     "is_year_end_concentration int, is_non_standard_pattern int, "
                                     "vendor_txn_count int, fraud_risk_flag int")
    assert train_similarity(df(4), num_trees=5).info["status"] == "skipped_insufficient_positives"
    sim = train_similarity(df(5), num_trees=5, max_depth=3)
    assert sim.info["status"] == "trained" and sim.model is not None
    assert train_similarity(df(40), num_trees=5).info["status"] == "skipped_single_class"
    assert train_similarity(df(5).drop("fraud_risk_flag")).info["status"] == "skipped_no_label_column"


def test_materiality_any_entity_type():
    from ledgerlens.operators.scoring import materiality
    assert materiality("Public company", 100000.0)["fs"] == 5000.0
    m = materiality("Something else", 150000.0)
    assert (m["fs"], m["performance"], m["transaction"]) == (6000.0, 3000.0, 4800.0)


def test_review_rejects_bad_parameters(spark):
    import pytest
    from ledgerlens.plans.review import review
    df = spark.createDataFrame([("2024-01-01", "1", "5000", "A", "V", "d", "j")],
                               "date string, amount string, account_code string, account_name string, "
                               "vendor string, description string, journal_ref string")
    with pytest.raises(ValueError, match="Unknown detection_sensitivity"):
        review(df, "Fund", 1.0, "Extreme", "2024-01-01", "2024-12-31")
    with pytest.raises(ValueError, match="Invalid period_end"):
        review(df, "Fund", 1.0, "Balanced (0.05)", "2024-01-01", "2024/12/31")
    with pytest.raises(ValueError, match="on or after"):
        review(df, "Fund", 1.0, "Balanced (0.05)", "2024-12-31", "2024-01-01")


def test_integrity_skips_and_mapping_break(spark):
    from ledgerlens.constants import MAPPING_OK, SKIP_CROSS, SKIP_HASH, SKIP_PERIOD
    from ledgerlens.operators.clean import clean_gl
    from ledgerlens.operators.integrity import integrity_counts, integrity_report
    from ledgerlens.operators.stats import compute_stats
    rows = [("2024-01-02", "10", "5000", "Rent", "V", "d", "j1"),
            ("2024-01-03", "20", "5000", "Rent", "V", "d", "j2"),
            ("2024-01-04", "30", "6000", "Rent", "V", "d", "j3"),     # name with two codes
            ("2024-01-05", "40", None, "Travel", "V", "d", "j4")]     # NULL code ignored
    df = spark.createDataFrame(rows, "date string, amount string, account_code string, account_name string, "
                               "vendor string, description string, journal_ref string")
    rep = {r["name"]: r for r in integrity_report(compute_stats(clean_gl(df))).collect()}
    assert (rep["Hash total"]["status"], rep["Hash total"]["summary"]) == ("Pass", SKIP_HASH)
    assert rep["Cross-footing"]["summary"] == SKIP_CROSS
    assert rep["Date in period"]["summary"] == SKIP_PERIOD
    assert rep["Account mapping"]["status"] == "Warning"
    assert rep["Account mapping"]["summary"] == "1 account_name(s) map to multiple codes (e.g. ['Rent'])."
    ok = spark.createDataFrame(rows[:2], df.schema)
    rep_ok = {r["name"]: r for r in integrity_report(compute_stats(clean_gl(ok))).collect()}
    assert rep_ok["Account mapping"]["summary"] == MAPPING_OK
    counts = {r["status"]: r["n"] for r in integrity_counts(integrity_report(compute_stats(clean_gl(df)))).collect()}
    assert counts == {"Pass": 3, "Warning": 1, "Fail": 0}
