"""Flagship review on sf0.001: contract, table shapes and cross-table invariants."""
import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="test tables absent")


@pytest.fixture(scope="module")
def packet(spark):
    from ledgerlens.plans.review import review_fixture
    return review_fixture(spark, SF)


def test_entry_contract(spark):
    df = E.entry(spark)
    assert "final_tier" in df.columns and "anomaly_score" in df.columns
    assert df.count() >= 0


def test_packet_invariants(packet):
    s = packet.scored
    n = s.count()
    assert n == 6000 == packet.request["row_count"]
    # anomaly labels: contamination share within ties
    neg = s.filter(F.col("anomaly_label") == -1).count()
    assert abs(neg - 0.05 * n) <= 0.01 * n
    # escalation never lowers; override implies its note; score in [0, 1]
    bad = s.filter((F.col("fraud_probability") < 0) | (F.col("fraud_probability") > 1)).count()
    assert bad == 0
    assert s.filter((F.col("is_qualitative_override") == 1) & (F.col("qualitative_override_note") == "")).count() == 0
    assert s.filter((F.col("is_qualitative_override") == 1) & (F.col("is_supervised_escalation") == 1)).count() == 0
    summary = packet.tables["review_summary"].first()
    assert summary["flagged"] == packet.flagged.count()
    dist = {r["label"]: r["count"] for r in packet.tables["tier_distribution"].collect()}
    assert sum(dist.values()) == n
    assert packet.tables["integrity_counts"].agg(F.sum("n")).first()[0] == 4
    assert len(packet.tables["top_accounts"].collect()) <= 10
    assert packet.similarity.info["status"] == "trained"


def test_memo_table_on_real_queue(packet):
    from ledgerlens.operators.memos import memo_table, validate_memos
    m = memo_table(packet.flagged, top_n=20)
    rows = m.collect()
    assert len(rows) == min(20, packet.flagged.count())
    assert [r["position"] for r in rows] == sorted(r["position"] for r in rows)
    js = m.select("position", F.to_json(F.struct(
        "risk_summary", "assertion_consideration", "magnitude_assessment", "likelihood_assessment",
        "control_or_coso_consideration", "recommended_follow_up", "disclaimer")).alias("memo_json"))
    assert validate_memos(js).filter(~F.col("is_valid")).count() == 0


def test_empty_ledger_reviews_to_empty_queue(spark, tmp_path):
    from ledgerlens.plans.review import review
    from ledgerlens.sources.csv_gl import read_gl_csv
    p = tmp_path / "empty.csv"
    p.write_text("date,amount,account_code,account_name,vendor,description,journal_ref\n")
    pk = review(read_gl_csv(spark, str(p)), "Private for-profit", 150000.0, "Balanced (0.05)",
                "2024-01-01", "2024-12-31", forest_trees=5)
    s = pk.tables["review_summary"].first()
    assert (s["total"], s["flagged"], s["flagged_pct"], s["risk_rating"]) == (0, 0, 0.0, "Low")
    assert pk.flagged.count() == 0
    assert pk.similarity.info["status"] == "skipped_insufficient_positives"
    assert pk.tables["integrity_report"].count() == 4
