import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from ledgerlens.session import get_session
    s = get_session(master="local[*]", shuffle_partitions=8, extra={"spark.driver.memory": "8g"})
    yield s


GL_COLS = ["date", "amount", "account_code", "account_name", "vendor", "description", "journal_ref"]


@pytest.fixture
def ledger(spark):
    """Build a ledger from literal string rows (as the CSV source delivers them)."""
    from pyspark.sql import functions as F

    def make(rows, cols=GL_COLS):
        schema = ", ".join(f"`{c}` string" for c in cols)
        df = spark.createDataFrame(rows, schema)
        return df.withColumn("row_id", F.xxhash64(*[F.col(c) for c in cols], F.monotonically_increasing_id()))
    return make
