"""The corpus pipeline: quality rules, line dedup, near-dedup, decontamination, piece encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.decontaminate import drop_leaks
from tessera.llm.line_dedup import dedup_lines
from tessera.llm.near_copies import keep_first_near
from tessera.llm.pieces import encode_and_check
from tessera.llm.quality import filter_quality
from tessera.session import materialize


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the learned decision list nor their own repetition rejects; short ones are judged alike."""
    return filter_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the blocks of lines that an earlier one has; those left empty go."""
    return dedup_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each class of near copies: five-word shingles, Jaccard 0.8 or more."""
    return keep_first_near(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no copy of a benchmark item."""
    return drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def piece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled piece ids of each document, with a check that they decode to its text."""
    return encode_and_check(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("piece_encoding", piece_encoding),
]

#: Fitted rules, alignment, fingerprints and sampling have no SQL form; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
