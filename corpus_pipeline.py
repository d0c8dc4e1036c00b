"""A corpus pipeline of five operator stages over ``documents``.

Quality rules, quality classifier, SimHash near-dedup, mixing to target weights, SentencePiece
encoding. Each stage works on all that the one before kept; the first four return the columns
of ``documents``, the last the token ids and digests of every document left.
"""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import classifier, mixing, pieces, quality_rules, simhash
from ledgerlens.llm.queries import digests
from ledgerlens.session import scratch_path, ship_package

#: Mild tempering: the rarest levels are kept whole, the others by more than half.
MIX = mixing.Mix(temper=0.97)


def rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base counts or diverge from their language's references go."""
    ship_package(spark)
    return quality_rules.apply_rules(docs).where(F.col("kept")).select(*docs.columns)


def classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for label 0 go. It is fitted on all labelled documents
    of the corpus, rejected ones included: they are its examples of label 0."""
    model = classifier.fit(spark.read.parquet(f"{sf_dir}/documents.parquet"),
                           spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return classifier.score(docs, model).where(F.col("predicted") == 1).select(*docs.columns)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each near-duplicate group stays."""
    ship_package(spark)
    return simhash.keep_one(docs, shingle=3, max_distance=2)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn with the raked probabilities stay."""
    return mixing.sample(docs, mix=MIX).where(F.col("sampled")).select(*docs.columns)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, their number and the digests of ids and decoded text."""
    ship_package(spark)
    model = public_tokenizers.path("piece_bpe_32k.model")
    encoded = pieces.encode(docs.select("doc_id", "text"), model, decoded=True)
    return digests(encoded).select("doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [("quality rules", rules_stage), ("quality classifier", classifier_stage),
          ("SimHash near-dedup", dedup_stage), ("mixing", mixing_stage), ("SentencePiece", encoding_stage)]

#: The classifier's fit, the fingerprints' links and the encoding are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents, each written and reread as the next one's input."""
    ship_package(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        path = scratch_path(spark, f"stage{i}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
