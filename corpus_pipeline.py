"""The training-data pipeline: five stages over the documents table, each written as Parquet and read by the next."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rastermill.llm import decontaminate, minhash, packing, pii, quality
from rastermill.llm.common import cut, shared_dir, table, text_key


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the adaptive quality rules keep."""
    return quality.quality_filter(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: that with the smallest doc_id. Texts without words and other texts with
    the same doc_id stay."""
    return minhash.near_dedup(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Rows are told apart by id and text: a null id may leak, and other texts with the
    same doc_id stay."""
    own = F.struct("doc_id", text_key(F.col("text")).alias("key"))
    leaks = decontaminate.find_leaks(docs.select(own.alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    leaks = cut(leaks.select(F.col("doc_id.doc_id").alias("leaked"), F.col("doc_id.key").alias("leaked_key")).distinct(), "leaks")
    return docs.join(leaks, F.col("doc_id").eqNullSafe(F.col("leaked")) & (text_key(F.col("text")) == F.col("leaked_key")), "left_anti")


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with pseudonyms in their texts and n_chars of the new text."""
    out = pii.pseudonymise(docs, pii.secret_key(spark))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality rules", quality_rules), ("near-duplicates", near_dedup), ("decontamination", decontamination), ("pseudonyms", pseudonyms), ("packing", packed)]
#: Feistel digests, sketches and tokenizers are beyond SQL; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    at = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{k}")
        docs = spark.read.parquet(f"{at}/{k}")
    return docs
