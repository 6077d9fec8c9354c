"""A corpus pipeline: quality rules, one document of each group of near copies, secrets masked,
sources mixed to target weights, and the mixed texts encoded.

Each stage reads all that the one before kept. All but the last return the columns of
``documents``; mixing returns a document as often as the mix takes it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from flowloom.llm.bpe import encode_documents
from flowloom.llm.jaccard import BATCH_BYTES, Likeness, keep_one
from flowloom.llm.mixing import mix
from flowloom.llm.quality import keep_clean
from flowloom.llm.secret_scan import mask_secrets
from flowloom.plans.staging import new_path

#: Bytes of text that a worker encodes at once, fewer than alone: its executor also holds what earlier stages took.
ENCODED_BYTES = 1 << 20


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of few MiB from now on: 10,000 texts at once are held by the JVM and Python, several times."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return keep_clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8."""
    small_batches(spark)
    return keep_one(docs, Likeness(width=5, percent=80))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets masked."""
    small_batches(spark)
    return mask_secrets(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mix(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and what they decode to."""
    small_batches(spark)
    return encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"), piece_bytes=ENCODED_BYTES)


STAGES = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard_join", near_duplicates),
    ("secret_scans", secret_scans),
    ("source_mixing", source_mixing),
    ("bpe_encoding", encoding),
]
#: Secret scans and encoding cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is stored and read again by the next stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        path = new_path(spark)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
