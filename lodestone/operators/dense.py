"""Exact cosine search of a stated query set against all vectors, in blocks, and vectors from texts by a model slot.

Queries and vectors are packed into blocks of rows, each one binary of float64. Every pair of a query block and a vector
block is one row: a matrix product that keeps the k best of each query; the partial lists meet in one window per query.
Query blocks are broadcast up to BROADCAST_BYTES by count, beyond that Spark deals the pairs itself; nothing passes
through the driver, the vectors are read once, and memory is a pair of blocks. Vectors with a null element or of another
length than the first query's are skipped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import tokens

BLOCK, DIMS = 2048, 64
BROADCAST_BYTES = 64_000_000
DIGITS = 6
SCHEMA = "query_id long, doc_id long, score double"
PACKED = "ids binary, rows binary"


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column as float64; all of one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def unit(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = np.sqrt((m * m).sum(1))
    return m / np.where(n > 0, n, 1)[:, None], n > 0


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the k greatest scores, ties by the smaller id."""
    order = np.argsort(ids, axis=1, kind="stable")
    ids, scores = np.take_along_axis(ids, order, 1), np.take_along_axis(scores, order, 1)
    order = np.argsort(-scores, axis=1, kind="stable")[:, :k]
    return np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)


def packer(size: int):
    """Blocks of at most size rows: ids, and unit vectors of those that are not all zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def block() -> pa.RecordBatch:
            ids, rows = (np.concatenate(x) for x in zip(*held))
            return pa.RecordBatch.from_arrays([pa.array([ids.tobytes()], pa.binary()), pa.array([rows.tobytes()], pa.binary())], names=["ids", "rows"])

        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                v, ok = unit(matrix(part.column(1)))
                if n + int(ok.sum()) > size:
                    yield block()
                    held, n = [], 0
                if ok.any():
                    held.append((part.column(0).to_numpy(zero_copy_only=False)[ok].astype(np.int64), v[ok]))
                    n += int(ok.sum())
        if n:
            yield block()

    return run


def multiplier(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for q_ids, q, v_ids, v in zip(*(c.to_pylist() for c in batch.columns)):
                q_ids, v_ids = np.frombuffer(q_ids, np.int64), np.frombuffer(v_ids, np.int64)
                scores = np.frombuffer(q).reshape(len(q_ids), -1) @ np.frombuffer(v).reshape(len(v_ids), -1).T
                s, ids = best(np.round(np.maximum(0, (1 + scores) / 2), DIGITS), np.broadcast_to(v_ids, scores.shape), k)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q_ids, s.shape[1])), pa.array(ids.ravel()), pa.array(s.ravel())], names=["query_id", "doc_id", "score"])

    return run


def search(vectors: DataFrame, queries: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """query_id, doc_id, score = (1 + cosine) / 2: the k best of each block for each query, of (id, embedding)."""
    first = queries.where("size(embedding) > 0").select(F.size("embedding").alias("n")).first()
    if first is None:
        return vectors.sparkSession.createDataFrame([], SCHEMA)
    whole = (F.size("embedding") == first["n"]) & ~F.exists("embedding", lambda x: x.isNull()) & F.col("id").isNotNull()
    q, v = (x.where(whole).select(F.col("id").cast("long").alias("id"), "embedding") for x in (queries, vectors))
    small = q.count() * first["n"] * 8 <= BROADCAST_BYTES
    q = q.coalesce(1) if small else q
    q, v = q.mapInArrow(packer(block), PACKED).toDF("q_ids", "q"), v.mapInArrow(packer(block), PACKED)
    return (v.crossJoin(F.broadcast(q)) if small else v.crossJoin(q)).select("q_ids", "q", "ids", "rows").mapInArrow(multiplier(k), SCHEMA)


def feature_hash(tokens_of: list[list[str]], dims: int = DIMS) -> np.ndarray:
    """The stand-in for a model: each token adds 1 or -1 at a place that its MD5 names."""
    out, known = np.zeros((len(tokens_of), dims)), {}
    for row, ts in enumerate(tokens_of):
        for t in ts:
            if t not in known:
                h = hashlib.md5(t.encode()).hexdigest()
                known[t] = (int(h[:4], 16) % dims, 1.0 if h[4] < "8" else -1.0)
            at, sign = known[t]
            out[row, at] += sign
    return out


def embedded(text: Column, model: Callable[[list[list[str]]], np.ndarray] = feature_hash, batch: int = 256, most: int = 1024) -> Column:
    """array<double> of a text's tokens by a model that takes lists of tokens, at most min(batch, most) at a time; a model
    that returns another number of rows, or of columns from batch to batch, fails."""

    @F.pandas_udf("array<double>")
    def encode(rows: pd.Series) -> pd.Series:
        size, out = min(batch, most), []
        for at in range(0, len(rows), size):
            part = [list(x) for x in rows.iloc[at : at + size]]
            got = np.asarray(model(part), float)
            if got.ndim != 2 or len(got) != len(part) or (out and got.shape[1] != len(out[-1])):
                raise ValueError("the model returned other rows or dimensions")
            out.extend(got.tolist())
        return pd.Series(out)

    return encode(tokens(text, 2))
