"""From raw documents to token ids: STAGES in order, each written as Parquet and read again as the next one's documents.

Every stage but the last returns rows with the columns of ``documents``. Quality drops what the classifier rejects;
exact dedup keeps the smallest doc_id of equal texts; near dedup keeps one document of each group of documents that
share 0.8 of their five-word shingles; mixing passes over each source once at least and over small ones more often, up
to ``MAX_REPEATS`` times, so it drops nothing and some doc_ids come several times; BPE gives a row of ids for each row.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from edgeloom import scratch
from edgeloom.llm import bpe, exact_dedup, mixing, near_dedup, quality

MAX_REPEATS = 1.5


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.without_rejected(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.one_of_each(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.without_near_copies(docs, words=5, num=80, den=100)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs, whole=True, max_repeats=MAX_REPEATS)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), tokens=True)


STAGES = [("quality classifier", quality_filter), ("exact dedup", exact_copies), ("near dedup", near_copies), ("mixing", mixed_sources), ("bpe", token_ids)]
#: SQL cannot express the classifier's fitting.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES applied to the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs, _ = scratch.save(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
