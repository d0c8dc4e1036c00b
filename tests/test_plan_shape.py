"""Plan-shape guards for the scale properties the design relies on."""
import os

import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="test tables absent")


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_features_pass_never_shuffles_the_ledger(spark):
    from ledgerlens.operators.clean import clean_gl
    from ledgerlens.operators.features import engineer_features
    from ledgerlens.operators.stats import compute_stats
    from ledgerlens.sources.csv_gl import read_gl_parquet
    from ledgerlens.sources.fixture import gl_fixture
    from ledgerlens.session import scratch_path
    path = scratch_path(spark, "gl-parquet")
    gl_fixture(spark, SF, with_row_id=False).write.parquet(path)
    clean = clean_gl(read_gl_parquet(spark, path))
    feat = engineer_features(clean, compute_stats(clean, "1996-01-01", "2001-10-31"))
    plan = _plan(feat)
    for bad in ("SortMergeJoin", "CartesianProduct", "BroadcastNestedLoopJoin", "ShuffledHashJoin"):
        assert bad not in plan, bad
    assert plan.count("BroadcastHashJoin") == 3
    assert feat.count() == 6000


def test_review_tables_have_no_cartesian_products(spark):
    from ledgerlens.plans.review import review_fixture
    pk = review_fixture(spark, SF, forest_trees=20)
    for name, df in pk.tables.items():
        plan = _plan(df)
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
