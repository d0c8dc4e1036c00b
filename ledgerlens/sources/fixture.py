"""Ledger over the driver's TPC-H-like tables.

The test tables hold no general ledger, so every query starts from one projection of
``lineitem`` joined to ``part`` and ``supplier`` (FIXTURES.md section 3). It plants
round amounts, missing dates and descriptions, a NULL and a one-off vendor per part,
a mapping break on code 6999 and a debit/credit layout.

Row identity comes from the scan position of the lineitem row
(``_metadata.file_path``, ``_metadata.row_index``): stable under any repartitioning,
no shuffle, unique even where the ledger content repeats.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_parallelism

# Analysis parameters that go with this ledger.
FIXTURE_PARAMS = {
    "entity_type": "Private for-profit",
    "benchmark_figure": 2_000_000.0,
    "detection_sensitivity": "Balanced (0.05)",
    "period_start": "1996-01-01",
    "period_end": "2001-10-31",
}

LEDGER_COLUMNS = ["journal_ref", "date", "amount", "account_code", "account_name",
                  "vendor", "description", "debit_amount", "credit_amount", "dr_cr_pattern"]


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def gl_fixture(spark: SparkSession, sf_dir: str, with_debit: bool = True,
               with_row_id: bool = True) -> DataFrame:
    """The fixture ledger: 10 ledger columns (+ ``row_id``)."""
    li = _read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
        "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_shipdate",
        F.xxhash64(F.col("_metadata.file_path"), F.col("_metadata.row_index")).alias("row_id"))
    li = ensure_parallelism(li)
    ptype = F.col("p_type")
    prefix = (F.when(ptype == "ECONOMY", "50").when(ptype == "LARGE", "61")
               .when(ptype == "MEDIUM", "64").when(ptype == "PROMO", "66")
               .when(ptype == "SMALL", "40").otherwise("20"))
    brand_no = F.lpad(F.regexp_replace(F.col("p_brand"), "Brand#", ""), 2, "0")
    # what follows from the part alone is made once a part, not once a posting
    part = _read(spark, sf_dir, "part").select(
        "p_partkey", "p_name", F.concat(prefix, brand_no).alias("code"),
        F.concat(ptype, F.lit(" / "), F.col("p_brand")).alias("account_name"), (ptype == "PROMO").alias("promo"),
        ptype.isin("SMALL", "STANDARD").alias("credit"))
    sup = _read(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    j = (li.join(part, li.l_partkey == part.p_partkey)
           .join(sup, li.l_suppkey == sup.s_suppkey))

    ln, qty = F.col("l_linenumber"), F.col("l_quantity")
    price = F.col("l_extendedprice")
    planted_code = (ln == 2) & (qty == 50) & F.col("promo")

    sign = F.when(F.col("l_returnflag") == "R", F.lit(-1.0)).otherwise(F.lit(1.0))
    base = (F.when((ln == 7) & (qty >= 40), F.floor(price / 100).cast("double") * 100)
             .when((ln == 5) & (qty == 45), price * 5)
             .otherwise(price))
    amount = (sign * base).alias("amount")

    out = j.select(
        F.concat(F.col("l_orderkey").cast("string"), F.lit("-"),
                 F.col("l_linenumber").cast("string"), F.lit("-"),
                 F.col("l_partkey").cast("string"), F.lit("-"),
                 F.col("l_suppkey").cast("string")).alias("journal_ref"),
        F.when((qty == 1) & (ln == 7), F.lit(None).cast("date"))
         .otherwise(F.col("l_shipdate").cast("date")).alias("date"),
        amount,
        F.when(planted_code, F.lit("6999")).otherwise(F.col("code")).alias("account_code"),
        "account_name",
        F.when((F.col("l_tax") == 0.08) & (ln == 6), F.lit(None).cast("string"))
         .when((qty == 50) & (ln == 1),
               F.concat(F.col("s_name"), F.lit(" #"), F.col("l_partkey").cast("string")))
         .otherwise(F.col("s_name")).alias("vendor"),
        F.when((F.col("l_discount") == 0.10) & (ln <= 2), F.lit(""))
         .when((F.col("l_discount") == 0.10) & (ln == 3), F.lit(None).cast("string"))
         .otherwise(F.col("p_name")).alias("description"),
        F.when(F.col("credit"), F.lit("C")).otherwise(F.lit("D")).alias("side"),
        F.when(qty > 45, F.lit("Non_Standard")).otherwise(F.lit("standard")).alias("dr_cr_pattern"),
        "row_id",
    )
    out = out.select(
        "journal_ref", "date", "amount", "account_code", "account_name", "vendor", "description",
        F.when(F.col("side") == "D", F.abs("amount")).otherwise(F.lit(0.0)).alias("debit_amount"),
        F.when(F.col("side") == "C", F.abs("amount")).otherwise(F.lit(0.0)).alias("credit_amount"),
        "dr_cr_pattern", "row_id")
    if not with_debit:
        out = out.drop("debit_amount", "credit_amount")
    if not with_row_id:
        out = out.drop("row_id")
    return out
