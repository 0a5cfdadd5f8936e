"""Corpus pipeline: toxicity, near-duplicates, personal data, source mix, tokens.

Each stage is ``fn(spark, docs, sf_dir)``; ``run`` writes what a stage returns as Parquet to the shared folder
and reads it again as the next stage's documents. All but the last return the columns of ``documents``.

Stages that hand whole texts to Python bound the Arrow batches of the session by bytes (``session.small_batches``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from labelflow.llm import bpe, mixing, pii, simhash, toxicity
from labelflow.session import materialize, small_batches

# No SQL expresses the stages; tests/llm compares them with brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below the cutoff."""
    small_batches(spark)
    return toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest doc_id."""
    small_batches(spark)
    return simhash.keep_first(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind."""
    return pii.mask(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.draw(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document with the digests of the ids and of the decoded bytes."""
    small_batches(spark)
    return bpe.encode_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("pii", mask_personal_data),
    ("source_mix", mix_sources),
    ("bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
