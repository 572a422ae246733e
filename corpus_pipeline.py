"""The corpus pipeline: quality, near duplicates, repeated strings, benchmark passages, packing.

Each stage calls one operator on all that its predecessor kept; run() stores what a stage keeps and reads it back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from snapscope.llm import decontaminate, neardup, packing, quality, suffix_dedup
from snapscope.llm.common import stored, table
from snapscope.llm.queries import vocabulary


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or lie too far from their language and source go."""
    return quality.kept(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, similarity 0.8) stays."""
    return neardup.deduplicated(docs, width=5, percent=80)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 200 bytes that start at two places or more go from every text."""
    return suffix_dedup.without_repeats(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of the benchmark go, and documents that are hardly anything else."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document with their sequence and offset."""
    return packing.pack_documents(docs, vocabulary())


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_strings", repeated_strings),
    ("benchmark_passages", benchmark_passages),
    ("best_fit_packing", best_fit_packing),
]
# SQL can't express the outlier estimate of the first stage or the tokens of the last; tests/llm checks each stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
