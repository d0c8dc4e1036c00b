"""CSV source for general-ledger exports.

Reads every column as a string (no type inference: an account code with one missing
value must stay ``"4000"``, not become ``4000.0``), turns the missing-value words
of the original tool's reader into NULL, and checks the required columns on the
schema before any job runs. Typing is left to :func:`ledgerlens.operators.clean.clean_gl`.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..constants import NA_WORDS, REQUIRED_COLUMNS
from ..session import ensure_parallelism


DAMAGED = "_damaged_record"


class MissingColumnsError(ValueError):
    def __init__(self, missing: list[str]):
        self.missing = missing
        super().__init__(f"ledger is missing required columns: {missing}")


def validate_required_columns(df: DataFrame) -> tuple[bool, list[str]]:
    """(ok, missing) — a pure schema test, no Spark job."""
    missing = [c for c in REQUIRED_COLUMNS if c not in df.columns]
    return (not missing, missing)


def has_line_breaks(spark: SparkSession, path: str) -> bool:
    """Whether a quoted field may span lines: some line has an odd number of quotes."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return not spark.read.text(path).where(quotes % 2 == 1).isEmpty()


@dataclass
class CsvLedger:
    """A ledger read from CSV and what its files held besides whole rows."""
    rows: DataFrame             # the ledger
    damaged: DataFrame          # file, n_fields, n_expected and record of every short or over-long row
    observed: Observation       # n_short and n_long, once an action has run over ``rows``


def read_csv_ledger(spark: SparkSession, path: str, multi_line: bool | None = None, with_row_id: bool = True) -> CsvLedger:
    """Read ledger CSV file(s) as all-string columns with missing words as NULL.

    A row with fewer fields than its header is padded with missing values. A row with more cannot be told apart
    column by column: it is left out of the ledger, counted, and listed in ``damaged`` with all the others, so
    one read names them all. A file whose header differs from that of the others (names or their order)
    fails the read.

    Line breaks inside quoted fields are read as such. Files with them are read whole by one task each;
    ``multi_line=None`` looks for them first (one scan of the lines), so files without them stay splittable.
    """
    if multi_line is None:
        multi_line = has_line_breaks(spark, path)
    reader = (spark.read.option("header", True).option("inferSchema", False)
              .option("escape", '"').option("multiLine", multi_line))
    header = reader.csv(path).schema
    # Without column pruning: the fields of a pruned row are not counted.
    raw = reader.option("mode", "PERMISSIVE").option("enforceSchema", False).option("columnNameOfCorruptRecord", DAMAGED) \
        .option("columnPruning", False) \
        .schema(StructType([*header.fields]).add(DAMAGED, "string")).csv(path)
    ok, missing = validate_required_columns(raw)
    if not ok:
        raise MissingColumnsError(missing)
    # Quoted fields are taken out before commas are counted.
    fields = F.size(F.split(F.regexp_replace(DAMAGED, r'"([^"]|"")*"', ""), ","))
    # Spark reads the damaged record only beside a data column: the first one adds nothing here.
    beside = F.xxhash64(F.col(f"`{header.names[0]}`")).bitwiseAND(F.lit(0)).cast("int")
    raw = raw.withColumn("_fields", F.coalesce(fields, F.lit(len(header))) + beside)
    over, short = F.col("_fields") > len(header), F.col("_fields") < len(header)
    damaged = raw.where(F.col(DAMAGED).isNotNull() & (over | short)).select(
        F.col("_metadata.file_path").alias("file"), F.col("_fields").alias("n_fields"), F.lit(len(header)).alias("n_expected"),
        F.col(DAMAGED).alias("record"))
    observed = Observation()
    cols = [F.when(F.col(f"`{c}`").isin(NA_WORDS), F.lit(None).cast("string"))
             .otherwise(F.col(f"`{c}`")).alias(c) for c in header.names]
    if with_row_id:
        # Position within the scan split; evaluated directly above the scan, so a
        # recomputed partition re-reads the same split and gets the same ids.
        cols.append(F.xxhash64(F.col("_metadata.file_path"),
                               F.monotonically_increasing_id()).alias("row_id"))
    rows = raw.select(*cols, "_fields").observe(observed, F.count_if(short).alias("n_short"), F.count_if(over).alias("n_long")) \
        .where(~over).drop("_fields")
    return CsvLedger(ensure_parallelism(rows), damaged, observed)


def read_gl_csv(spark: SparkSession, path: str, multi_line: bool | None = None,
                with_row_id: bool = True) -> DataFrame:
    """The ledger of :func:`read_csv_ledger`."""
    return read_csv_ledger(spark, path, multi_line, with_row_id).rows


def read_gl_parquet(spark: SparkSession, path: str, with_row_id: bool = True) -> DataFrame:
    """Read a typed parquet ledger; same contract check, row identity from the file
    position (``_metadata.file_path``, ``_metadata.row_index``), stable under any
    repartitioning."""
    raw = spark.read.parquet(path)
    ok, missing = validate_required_columns(raw)
    if not ok:
        raise MissingColumnsError(missing)
    cols = [F.col(f"`{c}`") for c in raw.columns]
    if with_row_id:
        cols.append(F.xxhash64(F.col("_metadata.file_path"), F.col("_metadata.row_index")).alias("row_id"))
    return ensure_parallelism(raw.select(*cols))
