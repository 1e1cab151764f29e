"""Operational records: versions, idempotent ingestion, first-of-id, allocation, trace rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, key: str, *order) -> DataFrame:
    """The first row of each key in the order given."""
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_rn = 1").drop("_rn")


def unseen(batch: DataFrame, done: DataFrame, key: str = "content_hash") -> DataFrame:
    """Rows of a batch whose content was not processed before, the first of each content."""
    return latest(batch.join(done.select(key), key, "left_anti"), key, "doc_id")


def upsert(store: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """The last write of a key wins."""
    return store.join(rows.select(key), key, "left_anti").unionByName(rows)


def largest_remainder(counts: DataFrame, group: str, n: str, total: int) -> DataFrame:
    """total seats over groups in proportion to n: floors, then the largest fractions, ties by group."""
    whole = Window.partitionBy()
    df = counts.withColumn("_q", F.col(n) * F.lit(total) / F.sum(n).over(whole)).withColumn("_f", F.floor("_q"))
    df = df.withColumn("_left", F.lit(total) - F.sum("_f").over(whole))
    order = Window.orderBy(F.desc(F.round(F.col("_q") - F.col("_f"), 9)), group)
    seats = F.col("_f") + (F.row_number().over(order) <= F.col("_left")).cast("long")
    return df.withColumn("seats", seats.cast("long")).drop("_q", "_f", "_left")
