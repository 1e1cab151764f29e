"""Ranking metrics and report aggregates over ranked lists (query_id, doc_id, rank) and relevant pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ir_metrics(ranks: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """query_id, recall, precision, mrr, ndcg, hit at k, for queries with a relevant document. A list is cut to k and
    then freed of repeats; precision divides by k; gains are binary."""
    cut = ranks.where(F.col("rank") <= k).groupBy("query_id", "doc_id").agg(F.min("rank").alias("rank"))
    need = relevant.groupBy("query_id").agg(F.count_distinct("doc_id").alias("r"))
    hits = cut.join(relevant.select("query_id", "doc_id").distinct(), ["query_id", "doc_id"])
    got = hits.groupBy("query_id").agg(F.count("*").alias("h"), F.min("rank").alias("first"), F.sum(1 / F.log2(F.col("rank") + 1.0)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("r"), F.lit(k)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1.0))
    h = F.coalesce("h", F.lit(0))
    return need.join(got, "query_id", "left").select(
        "query_id",
        F.round(h / F.col("r"), 6).alias("recall"),
        F.round(h / F.lit(k), 6).alias("precision"),
        F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("mrr"),
        F.round(F.coalesce("dcg", F.lit(0.0)) / ideal, 6).alias("ndcg"),
        (h > 0).cast("int").alias("hit"),
    )


def latency(rows: DataFrame, by: str, value: str) -> DataFrame:
    """Exact linear-interpolated p50, p95 and p99, mean and count by group."""
    p = F.percentile(value, F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    out = rows.groupBy(by).agg(p.alias("p"), F.avg(value).alias("mean"), F.count(value).alias("n"))
    return out.select(by, *[F.round(F.col("p")[i], 6).alias(f"p{q}") for i, q in enumerate((50, 95, 99))], F.round("mean", 6).alias("mean"), "n")
