"""The corpus pipeline: quality rules, near-duplicates, secrets, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and works on all rows of docs. Stages but
the last return the columns that they get; the last returns one row per row
with its tokens. A stage's result is written before the next one reads it.

Edge cases are those of the operators: rows with null or empty texts fail the
quality rules and go in the first stage, an empty table passes through every
stage as an empty table, and repeated rows of one id end in the second.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textloom.llm import mixing, neardup, pieces, quality, scratch, secrets


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule and the suffix-array rule keep."""
    return quality.filter_quality(docs)


def keep_first_of_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of smallest id, of each class of near-duplicates."""
    return neardup.drop_near_duplicates(docs)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret replaced by a mark and n_chars renewed."""
    return secrets.redact_secrets(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in the order of training."""
    return mixing.apply_mix(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the token ids, their number, and digests of ids, decoded text and byte bounds."""
    return pieces.encode_texts(docs, pieces.public_model(), with_ids=True)


STAGES = [
    ("quality_rules", keep_quality),
    ("near_dedup", keep_first_of_class),
    ("secret_scan", hide_secrets),
    ("mixing", mix_sources),
    ("tokens", tokenize),
]
#: Suffix arrays, sketches, a random field and a tokenizer are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.write(docs)
    return docs
