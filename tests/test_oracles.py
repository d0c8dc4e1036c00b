"""Every registered query with an oracle equals DuckDB on the sf0.001 tables."""
import math
import os
from collections import Counter

import duckdb
import pytest

from ledgerlens.plans.catalog import QUERIES
from ledgerlens.plans.oracle import ORACLE

SF = "/root/testdata/sf0.001"
SKIP_HEAVY = {"iforest_fit", "iforest_score", "order_by_anomaly", "weak_label_train",
              "feature_importance", "similarity_score", "hybrid_pipeline", "review_queue"}


def _norm(v):
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else repr(round(v, 9) + 0.0)
    return repr(v)


def _bag(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return Counter(tuple(_norm(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("lineitem", "part", "supplier"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.skipif(not os.path.exists(SF), reason="test tables absent")
@pytest.mark.parametrize("name", sorted(set(ORACLE) - SKIP_HEAVY))
def test_query_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF)
    res = con.execute(ORACLE[name])
    dcols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(dcols)
    assert _bag(df.columns, [tuple(r) for r in df.collect()]) == _bag(dcols, res.fetchall())


def test_every_query_registered_has_oracle_or_is_model():
    missing = set(QUERIES) - set(ORACLE)
    assert missing <= SKIP_HEAVY, missing
