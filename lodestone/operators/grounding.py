"""Grounded-answer checks: support of claims by evidence, retrieval status, conflicts, confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import WORD, collapse

NUMBER = r"[0-9]+(?:\.[0-9]+)?"


def words(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)))


def support(claim: Column, evidence: Column) -> Column:
    """1 where the evidence contains the claim, else 0.7 x share of its words + 0.3 x share of its numbers."""
    share = lambda a, b: F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))
    numbers = lambda t: F.array_distinct(F.regexp_extract_all(t, F.lit(NUMBER), F.lit(0)))
    inside = F.contains(F.lower(collapse(evidence)), F.lower(collapse(claim)))
    return F.when(inside, F.lit(1.0)).otherwise(0.7 * share(words(claim), words(evidence)) + 0.3 * share(numbers(claim), numbers(evidence)))


def verdict(score: Column) -> Column:
    return F.when(score >= 0.35, "verified").when(score > 0, "partial").otherwise("unsupported")


def retrieval_status(hits: DataFrame, queries: DataFrame, least: int = 1, floor: float = 0.2) -> DataFrame:
    """query_id, n, best and status: no_results, insufficient (few, or best score under the floor), sufficient."""
    got = hits.groupBy("query_id").agg(F.count("*").alias("n"), F.max("score").alias("best"))
    out = queries.select("query_id").join(got, "query_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    status = F.when(F.col("n") == 0, "no_results").when((F.col("n") < least) | (F.col("best") < floor), "insufficient").otherwise("sufficient")
    return out.withColumn("status", status)


def context_budget(rows: DataFrame, order: list, limit: int) -> DataFrame:
    """Contexts of a query in order, cut to the characters that remain of `limit`, those without any dropped."""
    from pyspark.sql import Window

    w = Window.partitionBy("query_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    used = F.coalesce(F.sum(F.length("text")).over(w), F.lit(0))
    return rows.withColumn("_used", used).where(F.col("_used") < limit).withColumn("text", F.left("text", (F.lit(limit) - F.col("_used")).cast("int"))).drop("_used")
