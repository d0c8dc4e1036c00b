"""A fixture ledger with its lazily built stages, shared by the registered queries."""
from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.clean import clean_gl
from ..operators.features import engineer_features
from ..operators.scoring import apply_scoring, given_scores, materiality
from ..operators.stats import LedgerStats, compute_stats
from ..operators.summary import QUEUE_COLUMNS
from ..session import apart, materialize
from ..sources.fixture import FIXTURE_PARAMS, gl_fixture

_CACHE: dict = {}


def r6(c: str | Column) -> Column:
    """Round a double to 6 places and fold -0.0 into 0.0 (stable value hashes)."""
    col = F.col(c) if isinstance(c, str) else c
    return F.round(col, 6) + F.lit(0.0)


class FixtureLedger:
    def __init__(self, spark: SparkSession, sf_dir: str, with_debit: bool = True,
                 default_period_end: bool = False):
        self.spark, self.sf_dir = spark, sf_dir
        self.with_debit = with_debit
        self.default_period_end = default_period_end
        self.params = dict(FIXTURE_PARAMS)
        m = materiality(self.params["entity_type"], self.params["benchmark_figure"])
        self.perf, self.txn = m["performance"], m["transaction"]

    @classmethod
    def get(cls, spark: SparkSession, sf_dir: str, with_debit: bool = True,
            default_period_end: bool = False) -> "FixtureLedger":
        key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"), with_debit, default_period_end)
        if key not in _CACHE:
            _CACHE[key] = cls(spark, sf_dir, with_debit, default_period_end)
        return _CACHE[key]

    @cached_property
    def gl(self) -> DataFrame:
        return gl_fixture(self.spark, self.sf_dir, with_debit=self.with_debit)

    @cached_property
    def clean(self) -> DataFrame:
        return clean_gl(self.gl)

    @cached_property
    def stats(self) -> LedgerStats:
        return compute_stats(self.clean, self.params["period_start"], self.params["period_end"])

    @cached_property
    def feat(self) -> DataFrame:
        pe = None if self.default_period_end else self.params["period_end"]
        return engineer_features(self.clean, self.stats, period_end=pe)

    @cached_property
    def scored_given(self) -> DataFrame:
        """Rules applied on the deterministic stand-in scores (checks only). Not written: a query
        computes the columns that it selects."""
        return apply_scoring(given_scores(self.feat), self.perf, self.txn)

    @cached_property
    def flagged_given(self) -> DataFrame:
        """The flagged rows of ``scored_given`` with the columns of the queue, written once. The features of all
        rows and their scores and ranks are two generated methods: one would be too long to be compiled."""
        rows = apply_scoring(given_scores(apart(self.feat)), self.perf, self.txn, flagged_only=True)
        return materialize(rows.select(*QUEUE_COLUMNS, "abs_amount", "flagged_status"), "flagged-given")
