"""Sinks: non-finite normalisation, CSV export of the review queue, packet writer."""
from __future__ import annotations

import datetime as dt
import json
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import MEMO_FIELDS, QUEUE_ORDER, STATUS_NONE

EXPORT_BASE_COLUMNS = ["date", "account_name", "vendor", "amount", "anomaly_score", "raw_tier",
                       "final_tier", "pcaob_label", "materiality_annotation", "active_flags",
                       "control_gap_score", "fraud_risk_flag", "period_over_period_pct",
                       "vendor_concentration_pct", "is_year_end_concentration",
                       "is_non_standard_pattern"]
EXPORT_MEMO_COLUMNS = ["narrative_status"] + MEMO_FIELDS


def nonfinite_to_null(df: DataFrame) -> DataFrame:
    """NaN and +/-infinity in floating columns become NULL (what a JSON sink can carry)."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(None).cast(f.dataType)) \
                 .otherwise(c)
        cols.append(c.alias(f.name))
    return df.select(*cols)


def export_frame(queue: DataFrame, with_memos: bool | None = None) -> DataFrame:
    """The exported table: 16 queue columns, plus 8 memo columns when memos exist.

    ``with_memos=None`` decides from the presence of a ``narrative_status`` column.
    Follow-ups are joined by ``"; "`` into one cell; dates are ISO text.
    """
    base = [c for c in EXPORT_BASE_COLUMNS if c in queue.columns]
    if with_memos is None:
        with_memos = "narrative_status" in queue.columns
    cols = []
    for c in base:
        if c == "date":
            cols.append(F.date_format(F.col("date"), "yyyy-MM-dd").alias("date"))
        else:
            cols.append(F.col(c))
    if with_memos:
        for c in EXPORT_MEMO_COLUMNS:
            if c == "recommended_follow_up":
                cols.append(F.coalesce(F.array_join(F.col(c), "; "), F.lit("")).alias(c))
            elif c == "narrative_status":
                cols.append(F.coalesce(F.col(c), F.lit(STATUS_NONE)).alias(c))
            else:
                cols.append(F.coalesce(F.col(c), F.lit("")).alias(c))
    out = nonfinite_to_null(queue.select(*cols))
    # plain decimal text with every digit of the number; only magnitudes under 0.001 or over 1e27
    # keep an exponent
    plain = []
    for f in out.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            text = c.cast("string")
            large = text.contains("E") & ~text.contains("E-")
            text = F.when(large, F.coalesce(text.try_cast("decimal(38,10)").cast("string"), text)).otherwise(text)
            c = F.when(text.contains("E"), text).otherwise(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"))
            c = F.regexp_replace(c, r"\.$", "")
        plain.append(c.alias(f.name))
    return out.select(*plain)


def export_csv(queue: DataFrame, path: str, with_memos: bool | None = None) -> str:
    """Write the export table as CSV (header, quotes only where needed, "" escaping). The parts are ranges of
    the queue in its order: read by name, one after the other, they are the queue."""
    order = ["queue_position"] if "queue_position" in queue.columns else QUEUE_ORDER
    queue = queue.orderBy(*[c for c in order if c in queue.columns])
    (export_frame(queue, with_memos).write.mode("overwrite")
     .option("header", True).option("quote", '"').option("escape", '"')
     .option("emptyValue", "").csv(path))
    return path


def content_hash(df: DataFrame) -> DataFrame:
    """n_rows and content (an order-free hash of all rows) of a table."""
    cols = [F.to_json(F.col(f"`{f.name}`")) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in df.schema.fields]
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(F.xxhash64(*cols).cast("decimal(38,0)")), F.lit(0)).cast("string").alias("content"))


MANIFEST = "run string, committed timestamp, table string, path string, format string, n_rows long, content string, schema string"


def write_packet(packet: dict[str, DataFrame], path: str, fmt: str = "parquet",
                 parallelism: int = 4) -> dict[str, str]:
    """Write every part of a review packet as its own table and, last, the packet's manifest.

    The tables go under a fresh prefix of ``path``. The manifest (run, table, path, format, rows and content hash of
    what was written) is one file, added to ``path``/manifest when all of them are whole: that file is the
    commit. Whoever reads with ``read_packet`` sees a whole packet, the new or the last one, or none.

    The parts are independent jobs over the same small scored/statistics tables, so they
    are submitted from a few threads at once and overlap their per-job overhead."""
    root, run = path.rstrip("/"), f"run-{uuid.uuid4().hex}"

    def write(item):
        name, df = item
        target, df = f"{root}/{run}/{name}", nonfinite_to_null(df)
        df.write.format(fmt).save(target)
        found = content_hash(df.sparkSession.read.schema(df.schema).format(fmt).load(target)).first()     # one row
        return run, dt.datetime.now(dt.timezone.utc), name, target, fmt, found["n_rows"], found["content"], df.schema.json()

    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        written = list(pool.map(write, packet.items()))
    if written:
        spark = next(iter(packet.values())).sparkSession
        spark.createDataFrame(written, MANIFEST).coalesce(1).write.mode("append").parquet(f"{root}/manifest")
    return {row[2]: row[3] for row in written}


def read_packet(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of the packet committed last at ``path``; an error where a table is not what its manifest says."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{path.rstrip('/')}/manifest")
    last = manifest.groupBy("run").agg(F.max("committed").alias("at")).orderBy(F.desc("at"), "run").limit(1)
    tables = {}
    for r in manifest.join(last, "run", "left_semi").collect():     # a row per table
        df = spark.read.schema(T.StructType.fromJson(json.loads(r["schema"]))).format(r["format"]).load(r["path"])
        if tuple(content_hash(df).first()) != (r["n_rows"], r["content"]):
            raise ValueError(f"packet table {r['table']!r} differs from its manifest")
        tables[r["table"]] = df
    return tables
