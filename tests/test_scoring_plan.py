"""The rules over a ledger: a query computes what it selects; texts are built for the rows that keep them."""
import os

from pyspark.sql import functions as F

from ledgerlens.operators.scoring import apply_scoring
from ledgerlens.operators.summary import packet_header, review_summary

COLUMNS = ("row_id long, abs_amount double, raw_tier string, fraud_risk_flag int, fraud_flag_count int, fraud_probability double, "
           "amount_zscore_by_account double")


def _rows(spark):
    tiers = ["High", "Medium", "Low", "Monitor", "odd", None]
    amounts = [None, 10.0, 50_000.0, 90_000.0]
    rows = [(t, a, f, p) for t in tiers for a in amounts for f in (None, 0, 1) for p in (None, 0.2, 0.95)]
    return spark.createDataFrame([(i, a, t, f, f, p, 2.5 if i % 2 else None) for i, (t, a, f, p) in enumerate(rows)] * 2, COLUMNS)


def test_flagged_only_is_the_filter(spark):
    df = _rows(spark)
    whole = apply_scoring(df, 40_000.0, 80_000.0)
    found = apply_scoring(df, 40_000.0, 80_000.0, flagged_only=True)
    assert found.columns == whole.columns and whole.count() == df.count()
    wanted = sorted(map(str, whole.filter("flagged_status = 'Flagged'").collect()))
    assert wanted and sorted(map(str, found.collect())) == wanted
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("CollectMetrics"):]
    assert "_r_fin" in below and "concat" not in below      # ranked below the filter, texts above


def test_a_tier_needs_no_texts_and_no_write(spark):
    from ledgerlens import session
    d = "/root/testdata/sf0.001"
    if not os.path.exists(d):
        return
    from ledgerlens.plans.catalog import QUERIES
    QUERIES["feature_firing"](spark, d)         # the statistics, which are written
    before = len(session.SCRATCH)
    plan = QUERIES["raw_tier"](spark, d)._jdf.queryExecution().optimizedPlan().toString()
    assert len(session.SCRATCH) == before and "raw_tier" in plan
    assert "_note" not in plan and "active_flags" not in plan


def test_packet_header_reads_the_summary_once(spark):
    counts = spark.createDataFrame([("PASS", 2), ("FAIL", 1)], "status string, n long")
    scored = apply_scoring(_rows(spark), 40_000.0, 80_000.0)
    header = packet_header(review_summary(scored), counts, "2024-01-01", "2024-12-31")
    plan = header._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") == 2
    row = header.first()
    assert (row["population"], row["queue_size"]) == (scored.count(), scored.filter(F.col("flagged_status") == "Flagged").count())


def test_the_queue_is_written_by_compiled_methods(spark, tmp_path, monkeypatch):
    """A stage with a generated method over 8000 bytes runs row by row instead. On a large ledger the scan, the joins, the
    features, the scores and the ranks followed each other without a shuffle, in one method of about that length."""
    from ledgerlens.plans import ledger
    from ledgerlens.sources import fixture
    d = str(tmp_path)
    spark.range(400).selectExpr(
        "id AS l_orderkey", "id % 6 AS l_partkey", "id % 5 AS l_suppkey", "int(id % 7 + 1) AS l_linenumber",
        "double(id % 50 + 1) AS l_quantity", "double(if(id % 4 = 0, 90000 + id * 700, id * 70 + 5)) AS l_extendedprice",
        "id % 3 / 20D AS l_discount", "id % 9 / 100D AS l_tax", "if(id % 3 = 0, 'R', 'N') AS l_returnflag",
        "timestamp_ntz'1997-01-01' + make_dt_interval(int(id)) AS l_shipdate").write.parquet(f"{d}/lineitem.parquet")
    spark.range(6).selectExpr("id AS p_partkey", "concat('part ', id) AS p_name", "concat('Brand#', id) AS p_brand",
                              "element_at(array('ECONOMY', 'LARGE', 'MEDIUM', 'PROMO', 'SMALL', 'STANDARD'), int(id + 1)) AS p_type"
                              ).write.parquet(f"{d}/part.parquet")
    spark.range(5).selectExpr("id AS s_suppkey", "concat('supplier ', id) AS s_name").write.parquet(f"{d}/supplier.parquet")
    monkeypatch.setattr(fixture, "ensure_parallelism", lambda df: df)      # as where the scan has enough splits
    written = []
    monkeypatch.setattr(ledger, "materialize", lambda df, name: written.append(df) or df)
    led = ledger.FixtureLedger(spark, d)
    found = led.flagged_given
    whole = led.scored_given.filter("flagged_status = 'Flagged'").select(*found.columns)
    assert found.count() > 0 and sorted(map(str, found.collect())) == sorted(map(str, whole.collect()))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = written[0].select("*")._jdf.queryExecution().executedPlan()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    debug = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
    stages = debug.codegenStringSeq(plan)
    lengths = [stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.size())]
    assert len(lengths) > 3 and max(lengths) < 7500, lengths
