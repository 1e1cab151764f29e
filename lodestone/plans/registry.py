"""Where queries and their DuckDB SQL are registered."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.sources.spread import spread

QUERIES, SQL = {}, {}
TOK = r"list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+(?:[.-][\p{L}\p{N}_]+)*'), lambda x: length(x) >= 2)"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df, "doc_id", "text") if name == "documents" else df
