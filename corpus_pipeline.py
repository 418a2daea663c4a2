"""Corpus pipeline: quality rules, near-duplicate removal, secret redaction, source mixing, tokenization.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and returns the columns of docs;
the last returns one row of token and decoding digests for each row of the mix.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from kindred.llm import bpe, mixing, quality, secrets, simhash
from kindred.operators.storage import durable, release

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.passing(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    return simhash.keep_one(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark."""
    return secrets.redact(docs, vocabulary=VOCABULARY)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed(docs)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token and decoding digests of every row."""
    return bpe.digests(docs, VOCABULARY, public_tokenizers.PATTERN)


STAGES = [
    ("quality_rules", quality_stage),
    ("simhash_near_dedup", near_dedup_stage),
    ("secret_scans", secrets_stage),
    ("mix_sources", mixing_stage),
    ("byte_bpe", tokens_stage),
]

#: SQL has no SimHash, redaction or BPE; a test compares run() with brute force over a small corpus, all stages and columns.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over sf_dir's documents. What a stage returns is a table in the shared folder for the next
    one, as stages read their input several times.

    Null texts are rejected by the quality rules, as all of under ten words are. Columns beside those of documents are
    kept up to the last stage; rows repeated as a whole are one after near-duplicates. No documents give no rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, durable(stage(spark, docs, sf_dir), name)
        release(before)  # nothing reads an earlier stage's table again
    return STAGES[-1][1](spark, docs, sf_dir)
