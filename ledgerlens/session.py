"""Session and scratch-space helpers.

The engine never picks its own scratch folder on a cluster: intermediate tables go
under the shared folder named by ``spark.checkpoint.dir``, which a cluster must set. Only
in local mode (unit tests, a laptop) is a private folder chosen where it is absent.
"""
from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.driver.memory": "12g",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str = "local[8]", shuffle_partitions: int = 8,
                app_name: str = "ledgerlens", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.master(master).appName(app_name)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder.

    Where none is set, a private folder is chosen only if driver and executors are one local
    process (tests, a laptop); on a cluster that is an error, because executors would write
    to disks that no other machine can read."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not configured and not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not configured:
        configured = tempfile.mkdtemp(prefix="ledgerlens-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the checkpoint folder for a written intermediate table."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/ledgerlens-{name}-{uuid.uuid4().hex}"
    SCRATCH.append(path)
    return path


#: Scratch paths given out by this process, in order.
SCRATCH: list[str] = []


def delete_paths(spark: SparkSession, paths: list[str]) -> None:
    """Delete scratch tables where the session's file systems hold them."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(conf).delete(place, True)


METHOD_LIMIT = "spark.sql.codegen.hugeMethodLimit"
_WRITES: dict = {"open": 0, "before": None}
_WRITES_LOCK = threading.Lock()


@contextmanager
def compiled_methods(spark: SparkSession) -> Iterator[None]:
    """While a table is written, no generated method of over 8000 bytes of code: the JVM only interprets
    larger ones, which makes wide projections several times slower. The session's own limit comes back
    with the last of the writes that overlap."""
    with _WRITES_LOCK:
        if not _WRITES["open"]:
            _WRITES["before"] = spark.conf.get(METHOD_LIMIT)
            spark.conf.set(METHOD_LIMIT, "8000")
        _WRITES["open"] += 1
    try:
        yield
    finally:
        with _WRITES_LOCK:
            _WRITES["open"] -= 1
            if not _WRITES["open"]:
                spark.conf.set(METHOD_LIMIT, _WRITES["before"])


def apart(df):
    """``df`` with its row count observed, which ends the generated method of the steps below: a write whose steps
    together pass the limit of ``compiled_methods`` runs one operator at a time, row by row."""
    return df.observe(f"apart-{uuid.uuid4().hex}", F.count(F.lit(1)).alias("rows"))


def materialize(df, name: str):
    """Write ``df`` as parquet under the checkpoint folder and return a reader of it.

    Used at stage boundaries that later passes read several times: it cuts lineage (a
    lost executor does not trigger a recompute from the raw scan), gives later passes
    column pruning and pushdown on the written table, and stops filters from being
    re-derived through the rule projections above it.
    """
    path = scratch_path(df.sparkSession, name)
    with compiled_methods(df.sparkSession):
        df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def ensure_parallelism(df, min_partitions: int | None = None):
    """Spread an under-partitioned input over the cluster.

    A ledger that arrives as a few large unsplittable units (one parquet row group, one
    gzip CSV) would otherwise run every later pass on a handful of tasks. When the scan
    has fewer partitions than the session's default parallelism, rows are dealt
    round-robin (a one-off shuffle of the input); a normal large input, which already
    has many more splits than cores, is left untouched.
    """
    want = min_partitions or df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < want:
        return df.repartition(want)
    return df


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable on executors (``addPyFile``, once per application).

    Python UDFs (the isolation-forest builder and scorer) are unpickled in executor
    Python workers, which import ``ledgerlens`` by module name; on a cluster the driver's
    code tree is not there unless it is shipped, as ``--py-files`` would do."""
    import os
    import zipfile

    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    # Driver-side staging of the package's .py files only (no data): addPyFile copies the
    # zip into the application's file server, from which every executor fetches it.
    fd, path = tempfile.mkstemp(prefix="ledgerlens-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for dirpath, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(path)
    _SHIPPED.add(key)


def input_bytes(df) -> int | None:
    """Sum of the leaf relations' sizes in the optimized plan (the bytes the job reads),
    or None when a leaf has no size estimate."""
    try:
        leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
        total = 0
        for i in range(leaves.size()):
            total += int(str(leaves.apply(i).stats().sizeInBytes()))
        return total
    except Exception:  # noqa: BLE001 - planner internals differ across versions
        return None
