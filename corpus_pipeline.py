"""The corpus pipeline: each stage calls one operator, is written as Parquet, and is the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import mixing, neardup, packing, pii, quality
from lodestone.llm.common import passing, settle, table


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.filter_good(docs, table(spark, sf_dir, "labels"))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8) stays, the one of least id."""
    return neardup.dedup(docs, k=5, percent=80)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; n_chars follows the text."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the mix takes them: whole copies are rows of their own, a last one in part ends with its last word
    taken; documents taken no word of go."""
    return mixing.take(docs).withColumn("n_chars", F.length("text").cast("long"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences; see packing.SCHEMA."""
    return packing.pack(docs)


STAGES = [("quality", classify), ("near_duplicates", deduplicate), ("personal_data", redact), ("mixing", mix), ("packing", pack)]
#: The trained classifier is not SQL; tests/llm/test_pipeline.py holds every stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    with passing(spark) as last:  # a stage's input goes when the pipeline has been laid out, what is within a stage at its end
        for _, stage in STAGES[:-1]:
            with passing(spark) as keep:
                docs = keep(settle(stage(spark, docs, sf_dir)))
        return STAGES[-1][1](spark, last(docs), sf_dir)
