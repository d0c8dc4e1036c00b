"""review(): the whole ledger review as a small, fixed sequence of Spark passes.

  pass 1  scan -> clean -> GROUPING SETS statistics (partial aggregation; small result,
          written once under the checkpoint folder, sizes checked before broadcast).
          A small input (<= 2 GB of scanned files) stays persisted for pass 2.
  pass 2  clean ledger -> broadcast joins of the statistics -> features, written once
          (lineage cut; later passes prune columns)
  pass 3  hash-chosen bounded sample -> isolation trees per tree_id (applyInPandas)
  pass 4  features -> Arrow UDF raw scores, that column written -> contamination percentile
  pass 5  weak-label forest (Spark ML, level-wise on executors), trained from a second
          thread while passes 3-4 run
  pass 6  scores + audit rules -> scored table written once; the flagged queue gets its
          positions from a distributed sort (per-partition offsets)
  then    every review table is an aggregate, filter or distributed top-k over the
          scored table; writing them (sinks.write_packet) runs a few jobs at a time.

No pass shuffles ledger rows by a business key, so a hot account, vendor or a block of
copied rows never concentrates on one task; the only shuffles carry partial aggregates,
the bounded forest sample, the one-off spread of an under-partitioned input, or the
range-partitioned sort of flagged rows.
"""
from __future__ import annotations

import datetime as dt
import time
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import SENSITIVITY, TIER1_FEATURES
from ..functions.tiers import raw_tier
from ..operators import integrity as I
from ..operators import summary as S
from ..operators.clean import clean_gl
from ..operators.dates import choose_date_format, date_votes
from ..operators.features import engineer_features
from ..operators.iforest import (IsolationForestModel, decision_column, fit_isolation_forest,
                                 fit_offset, raw_score_column)
from ..operators.scoring import apply_scoring, materiality, materiality_population
from ..operators.similarity import SimilarityModel, similarity_score, train_similarity
from ..operators.stats import LedgerStats, compute_stats
from ..session import SCRATCH, delete_paths, input_bytes, materialize
from ..sources.csv_gl import CsvLedger
from ..sources.fixture import FIXTURE_PARAMS, gl_fixture


# Inputs up to this many bytes on disk are persisted between passes 1 and 2.
CACHE_INPUT_MAX_BYTES = 2 * 1024 ** 3


@dataclass
class ReviewPacket:
    request: dict
    materiality: dict
    stats: LedgerStats
    features: DataFrame
    forest: IsolationForestModel
    similarity: SimilarityModel
    scored: DataFrame
    tables: dict = field(default_factory=dict)
    timings: dict = field(default_factory=dict)
    scratch: list = field(default_factory=list)     # paths of the tables written on the way

    def close(self) -> None:
        """Delete the review's scratch tables; its frames can no longer be read, a written packet can."""
        delete_paths(self.features.sparkSession, self.scratch)

    @property
    def flagged(self) -> DataFrame:
        return self.tables["flagged_queue"]


def hybrid_scores(feat: DataFrame, n_rows: int, contamination: float, seed: int = 42,
                  n_trees: int = 200, max_samples: int = 256, forest_trees: int = 200,
                  forest_depth: int = 8, counts: tuple[int, int] | None = None):
    """Both tracks on the same rows: isolation forest (anomaly_score, anomaly_label,
    raw_tier) and weak-label forest (fraud_probability). Returns (lazy scored, forest, sim)."""
    spark = feat.sparkSession
    forest = fit_isolation_forest(feat, TIER1_FEATURES, n_rows=n_rows, n_trees=n_trees,
                                  max_samples=max_samples, contamination=contamination, seed=seed)
    fit_offset(raw_scores(feat, forest), forest, n_rows)
    sim = train_similarity(feat, seed=seed, num_trees=forest_trees, max_depth=forest_depth,
                           counts=counts)
    return model_scores(feat, forest, sim), forest, sim


def raw_scores(feat: DataFrame, forest: IsolationForestModel) -> DataFrame:
    """The forest's raw score ``_if_raw`` alone, written once for the passes of the offset. The scoring pass finds
    the scores again: looking up a row's cell costs less than writing and reading all features once more."""
    return materialize(feat.select(raw_score_column(forest, feat.sparkSession).alias("_if_raw")), "iforest-raw")


def model_scores(feat: DataFrame, forest: IsolationForestModel, sim: SimilarityModel) -> DataFrame:
    """anomaly_score (decision function), anomaly_label, raw_tier, fraud_probability."""
    scored = feat.withColumn("anomaly_score", decision_column(raw_score_column(forest, feat.sparkSession), forest))
    scored = scored.select("*", F.when(F.col("anomaly_score") < 0, F.lit(-1)).otherwise(F.lit(1))
                           .alias("anomaly_label"), raw_tier(F.col("anomaly_score")).alias("raw_tier"))
    return similarity_score(scored, sim)


def finish_scoring(feat: DataFrame, forest: IsolationForestModel, sim: SimilarityModel,
                   mat: dict) -> DataFrame:
    """Model scores + audit rules over every row, written once (the scored table)."""
    scored = apply_scoring(model_scores(feat, forest, sim), mat["performance"], mat["transaction"])
    return materialize(scored, "scored")


def review(gl: DataFrame | CsvLedger, entity_type: str, benchmark_figure: float, detection_sensitivity: str,
           period_start: str, period_end: str, seed: int = 42, date_format: str | None = None,
           n_trees: int = 200, forest_trees: int = 200, forest_depth: int = 8) -> ReviewPacket:
    """The whole review of a ledger: a frame, or a ``CsvLedger``, whose damaged rows are then reported too."""
    source, gl = (gl, gl.rows) if isinstance(gl, CsvLedger) else (None, gl)
    if detection_sensitivity not in SENSITIVITY:
        raise ValueError(f"Unknown detection_sensitivity {detection_sensitivity!r}. "
                         f"Expected one of {list(SENSITIVITY)}.")
    bounds = []
    for label, value in (("period_start", period_start), ("period_end", period_end)):
        try:
            bounds.append(value if isinstance(value, dt.date) else dt.date.fromisoformat(str(value)))
        except ValueError:
            raise ValueError(f"Invalid {label}: expected YYYY-MM-DD, got {value!r}") from None
    if bounds[1] < bounds[0]:
        raise ValueError("period_end must be on or after period_start.")
    period_start, period_end = bounds[0].isoformat(), bounds[1].isoformat()
    m = materiality(entity_type, benchmark_figure)
    timings: dict = {}
    begun = len(SCRATCH)

    def timed(name, fn):
        t0 = time.time()
        out = fn()
        timings[name] = round(time.time() - t0, 3)
        return out

    if "row_id" not in gl.columns:
        # the sources attach a position-based id; any other frame gets one here
        gl = gl.withColumn("row_id", F.xxhash64(*[F.col(f"`{c}`") for c in gl.columns],
                                                F.monotonically_increasing_id()))
    dates = choose_date_format(gl) if date_format is None else None
    clean = clean_gl(gl, date_format=dates.pattern if dates else date_format)
    # A small input is kept in memory (spilling to disk) between the statistics and the
    # features pass; a large one is simply scanned twice - never cached whole.
    small = (input_bytes(clean) or CACHE_INPUT_MAX_BYTES + 1) <= CACHE_INPUT_MAX_BYTES
    if small:
        clean = clean.persist(StorageLevel.MEMORY_AND_DISK)
    stats = timed("stats_pass", lambda: compute_stats(clean, period_start, period_end))      # 1
    n_rows = int(stats.globals["n_rows"])
    feat = timed("features_pass", lambda: materialize(
        engineer_features(clean, stats, period_end=period_end), "features"))               # 2
    if small:
        clean.unpersist()
    contamination = SENSITIVITY[detection_sensitivity]
    # The weak-label forest does not depend on the isolation forest: train it from a
    # second thread so its many small level-wise jobs share the cluster with passes 3-4.
    with ThreadPoolExecutor(max_workers=1) as pool:
        t_sim = time.time()
        sim_future = pool.submit(train_similarity, feat, seed=seed, num_trees=forest_trees,
                                 max_depth=forest_depth)                                    # 5
        forest = timed("iforest_fit", lambda: fit_isolation_forest(
            feat, TIER1_FEATURES, n_rows=n_rows, n_trees=n_trees, contamination=contamination,
            seed=seed))                                                                     # 3
        raw = timed("iforest_score_pass", lambda: raw_scores(feat, forest))                # 4
        timed("iforest_offset", lambda: fit_offset(raw, forest, n_rows))
        sim = sim_future.result()
        timings["similarity_fit_concurrent"] = round(time.time() - t_sim, 3)
    scored = timed("scoring_pass", lambda: finish_scoring(feat, forest, sim, m))           # 6

    report = I.integrity_report(stats)
    counts_df = I.integrity_counts(report)
    queue = S.flagged_queue(scored, positions=True)
    summary = S.review_summary(scored)
    firing = S.feature_firing(feat)
    broken_codes, broken_names = I.mapping_breaks(stats)
    tables = {
        "integrity_report": report,
        "mapping_broken_codes": broken_codes,
        "mapping_broken_names": broken_names,
        "materiality": materiality_population(scored, m),
        "integrity_counts": counts_df,
        "feature_firing": firing,
        "firing_summary": S.firing_summary(firing),
        "review_summary": summary,
        "tier_distribution": S.tier_distribution(scored),
        "top_accounts": S.top_accounts(scored),
        "escalation_counts": S.escalation_counts(scored, sim.info),
        "flagged_queue": queue,
        "top_drivers": S.top_drivers(queue),
        "suggested_action": S.suggested_action(queue),
        "packet_header": S.packet_header(summary, counts_df, str(period_start), str(period_end)),
    }
    request = {"entity_type": entity_type, "benchmark_figure": benchmark_figure,
               "detection_sensitivity": detection_sensitivity, "period_start": str(period_start),
               "period_end": str(period_end), "row_count": n_rows}
    if dates:
        request |= {"date_format": dates.name, "date_failed_share": round(dates.failed_share, 6), "date_ambiguous": dates.ambiguous}
        if dates.values:
            tables["date_votes"] = date_votes(gl)
    if source:
        request |= source.observed.get
        tables["damaged_rows"] = source.damaged
    status = {"forest": {"trees": forest.n_trees, "psi": forest.psi, "offset": forest.offset},
              "similarity": {k: v for k, v in sim.info.items() if k != "feature_importance"}}
    facts = [(part, k, None if v is None else str(v)) for part, found in ({"request": request} | status).items() for k, v in found.items()]
    tables["request_and_models"] = gl.sparkSession.createDataFrame(facts, "part string, name string, value string")
    return ReviewPacket(request, m, stats, feat, forest, sim, scored, tables, timings, SCRATCH[begun:])


def review_fixture(spark: SparkSession, sf_dir: str, **kw) -> ReviewPacket:
    """The full review of the fixture ledger with its engagement parameters."""
    p = dict(FIXTURE_PARAMS)
    p.update(kw)
    return review(gl_fixture(spark, sf_dir), **p)
