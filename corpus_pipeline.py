"""The corpus pipeline: five stages from raw documents to packed sequences.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor
kept. All but the last return the columns of documents; the last returns the
pieces of packed sequences. Between stages the rows are written as Parquet to the
shared checkpoint folder and read again, so a lost executor costs its own tasks
and no earlier stage.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evalspark.llm import decontam, packing, simhash, suffixes, toxicity
from evalspark.llm.common import stored, table, tune


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go."""
    return toxicity.clean(spark, docs, sf_dir)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of SimHash near-duplicates one document stays."""
    return simhash.keep_one(spark, docs, sf_dir)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 250 bytes (50 words of four letters) that occur again are cut out of the texts."""
    return suffixes.without_repeats(spark, docs, sf_dir)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontam.clean(spark, docs, sf_dir)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All remaining documents as pieces of sequences of 2048 tokens."""
    tune(spark)
    return packing.pieces(packing.pack(docs))


STAGES = [
    ("toxicity", toxicity_filter),
    ("simhash", near_duplicates),
    ("suffixes", repeated_strings),
    ("decontamination", benchmark_leaks),
    ("packing", packed),
]

#: No stage but decontamination can be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
