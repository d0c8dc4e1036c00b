"""The registered operator queries: each applies one operator to its whole table."""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import (classifier, hard_negatives, mixing, neighbours, packing, pieces, quality_rules, separators,
                            sharding, simhash, tokenfile, variants, warc)
from ledgerlens.llm.oracle import ORACLE
from ledgerlens.session import scratch_path, ship_package


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    return mixing.sample(docs).drop("text").withColumn("probability", F.round("probability", 6))


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return quality_rules.apply_rules(docs).drop("text", "lang")


def op5_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = classifier.fit(docs, table(spark, sf_dir, "labels"))
    scored = classifier.score(docs, model)
    return scored.select("doc_id", classifier.held_out(scored["doc_id"]).alias("held_out"),
                         "score", "predicted")


def digests(encoded: DataFrame) -> DataFrame:
    """n_tokens and the SHA-256 digests of ids and decoded text beside the columns of ``encoded``."""
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return (encoded.withColumn("n_tokens", F.size("ids").cast("long")).withColumn("ids_sha256", F.sha2(ids, 256))
            .withColumn("decoded_sha256", F.sha2("decoded", 256)))


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", size.alias("n_bytes"))
    encoded = pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"), decoded=True)
    spanned = (F.get("begins", F.lit(0)) == 0) & (F.element_at("ends", -1) == F.col("n_bytes"))
    return digests(encoded).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_bytes",
                                   F.xxhash64("begins", "ends").alias("spans_hash"),
                                   F.when(F.size("ids") == 0, F.col("n_bytes") == 0).otherwise(spanned).alias("spans_whole"))


def op7_tokenfile(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    path = scratch_path(spark, "tokens")
    tokenfile.write(docs, path, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return tokenfile.read(spark, path)


def op8_separators(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, end_id = scratch_path(spark, "flat"), 50256
    separators.write_flat(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.tiktoken"),
                          public_tokenizers.PATTERN, end_id)
    return separators.counts(spark.read.parquet(path), end_id).select("doc_id", "n_tokens", "closed")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    arc, path = scratch_path(spark, "arc"), scratch_path(spark, "warc")
    warc.write_arc(table(spark, sf_dir, "pages"), arc)
    warc.convert(spark.read.parquet(arc), path)
    return warc.read_warc(spark.read.parquet(path)).drop("url")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    whole = F.transform(F.col("embedding").cast("array<double>"), lambda c: F.when(
        ~F.isnan(c) & (F.abs(c) < float("inf")), F.floor(256 * c)))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = rows.select("vec_id", label.alias("label"), whole.alias("v"))
    return hard_negatives.mine(rows, F.col("vec_id") % 100 == 0, n_positives=5, n_negatives=10, low=30, high=90)


def op12_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return variants.group(docs, min_length=6, min_count=5, ratio=5, slips_every=199)


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "pieces")
    packing.write(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=0)
    stored = spark.read.parquet(path).withColumn("ids_crc32", F.crc32("payload"))
    return packing.assign(stored.drop("payload")).select(
        "doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset")


QUERIES = {f.__name__: f for f in (op1_mixing, op2_neighbours, op3_simhash, op4_quality_rules, op5_classifier, op6_pieces, op7_tokenfile,
                                 op8_separators, op9_sharding, op10_warc, op11_hard_negatives, op12_variants,
                                 op13_packing)}

__all__ = ["ORACLE", "QUERIES"]
