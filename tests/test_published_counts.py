import os

import pytest
from pyspark.sql import functions as F

from ledgerlens.plans.ledger import FixtureLedger

FEATURE_COUNTS = {
    # sf: rows, round, weekend, missing desc, new vendor, near, |z|>=2, co-occurrence,
    #     year-end, non-standard, NULL date, out of period, NULL vendor
    "0.001": (6000, 201, 1657, 115, 22, 119, 22, 129, 28, 590, 21, 840, 54),
    "0.01": (60000, 1797, 17082, 1330, 186, 1185, 144, 1291, 228, 5967, 158, 8908, 530),
}


@pytest.mark.parametrize("sf", sorted(FEATURE_COUNTS))
def test_fixture_feature_counts(spark, sf):
    d = f"/root/testdata/sf{sf}"
    if not os.path.exists(d):
        pytest.skip("tables absent")
    led = FixtureLedger.get(spark, d)
    f = led.feat
    got = f.agg(F.count(F.lit(1)), F.sum("is_round_number"), F.sum("is_weekend_posting"),
                F.sum("missing_description"), F.sum("is_new_vendor"),
                F.sum("is_near_approval_threshold"),
                F.count_if(F.abs("amount_zscore_by_account") >= 2), F.sum("fraud_risk_flag"),
                F.sum("is_year_end_concentration"), F.sum("is_non_standard_pattern"),
                F.count_if(F.col("date").isNull())).first()
    oob = led.stats.globals["n_out_of_period"]
    null_vendor = f.filter(F.col("vendor").isNull()).count()
    assert tuple(int(x) for x in got) + (oob, null_vendor) == FEATURE_COUNTS[sf]


def test_rule_layer_counts_on_scaffold_scores(spark):
    d = "/root/testdata/sf0.01"
    if not os.path.exists(d):
        pytest.skip("tables absent")
    s = FixtureLedger.get(spark, d).scored_given
    raw = {r[0]: r[1] for r in s.groupBy("raw_tier").count().collect()}
    fin = {r[0]: r[1] for r in s.groupBy("final_tier").count().collect()}
    ov, es = s.agg(F.sum("is_qualitative_override"), F.sum("is_supervised_escalation")).first()
    assert raw == {"High": 353, "Medium": 12366, "Low": 47281}
    assert (ov, es) == (1215, 43)
    assert fin == {"High": 1421, "Medium": 5331, "Low": 18105, "Monitor": 35143}
