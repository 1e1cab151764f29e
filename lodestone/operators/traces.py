"""Traces and audit: stage rows, timings, sampling, retention, hashed actors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STAGES = "array<struct<stage string, elapsed_ms double, document_id string, chunks array<struct<document_id string, chunk_id string, preview string>>>>"


def trace_rows(traces: DataFrame) -> DataFrame:
    """traces (trace_id, status, elapsed_ms, document_id, stages) as rows by trace, stage and chunk; what a chunk or a
    stage lacks comes from what holds it, and a trace without stages is one row."""
    s = traces.select("trace_id", "status", "elapsed_ms", "document_id", F.posexplode_outer("stages").alias("stage_no", "s"))
    c = s.select("*", F.explode_outer("s.chunks").alias("c"))
    return c.select(
        "trace_id",
        "status",
        F.coalesce("stage_no", F.lit(0)).alias("stage_no"),
        F.coalesce("s.stage", F.lit("")).alias("stage"),
        F.coalesce("s.elapsed_ms", "elapsed_ms").alias("duration"),
        F.coalesce("c.document_id", "s.document_id", "document_id", F.lit("")).alias("document_id"),
        F.coalesce("c.chunk_id", F.lit("")).alias("chunk_id"),
        F.coalesce("c.preview", F.lit("")).alias("preview"),
    )


def sampled(trace_id: Column, rate: float) -> Column:
    """Whether a trace is kept: its hash's first 12 hex digits, as a share of 16^12, lie under the rate."""
    return F.conv(F.left(F.sha2(trace_id, 256), F.lit(12)), 16, 10).cast("double") / 16.0**12 < rate


def retained(rows: DataFrame, at: str, now: Column, days: int = 30) -> DataFrame:
    return rows.where(F.col(at) >= now - F.expr(f"interval {days} days"))


def without(rows: DataFrame, gone: Column) -> DataFrame:
    """rows but for the traces that gone holds for."""
    return rows.where(~F.coalesce(gone, F.lit(False)))


def audit(actor: Column, query: Column, preview: int = 80) -> list[Column]:
    """actor_hash, query_hash and a preview: who asked what, without either in full."""
    return [F.left(F.sha2(actor, 256), F.lit(16)).alias("actor_hash"), F.sha2(query, 256).alias("query_hash"), F.left(query, F.lit(preview)).alias("preview")]
