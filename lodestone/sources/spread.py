"""Small tables over many cores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SMALL = 16_000_000


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """A table of less than SMALL bytes a core, dealt over the cores by keys: it may be one row group, which one core
    would read and work on alone. Larger tables are left as they are, so no large shuffle is added."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores, F.xxhash64(*keys)) if size < SMALL * cores else df
