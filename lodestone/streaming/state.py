"""State machines over keyed event logs: rate limits, circuit breakers, task leases.

A log is dealt by key, sorted in time within its partition and streamed past one key's small state at a time, so memory
is the limit's size and never a key's history. `rate_limited_stream` keeps the same state in a streaming query.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import BooleanType, StringType, StructField, StructType


def folded(log: DataFrame, name: str, start: Callable[[], object], step: Callable, kind: str) -> DataFrame:
    """log (key, at, id, ...) with a column `name`: step(state, row) of each row in the order (at, id) of its key."""
    log = log.repartition("key").sortWithinPartitions("key", "at", "id")
    arrow, kind_type = {"boolean": (pa.bool_(), BooleanType()), "string": (pa.string(), StringType())}[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = object(), None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["key"] != key:
                    key, state = row["key"], start()
                out.append(step(state, row))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, arrow)], names=[*batch.schema.names, name])

    return log.mapInArrow(run, StructType([*log.schema.fields, StructField(name, kind_type)]))


def admit(taken: deque, at: float, limit: int, seconds: float) -> bool:
    """Only admitted events count; one exactly `seconds` old no longer does."""
    while taken and taken[0] <= at - seconds:
        taken.popleft()
    ok = len(taken) < limit
    if ok:
        taken.append(at)
    return ok


def rate_limited(log: DataFrame, limit: int, seconds: float) -> DataFrame:
    """log (key, at double seconds, id) with allowed: at most `limit` admitted in (at - seconds, at] of a key."""
    return folded(log, "allowed", deque, lambda s, r: admit(s, r["at"], limit, seconds), "boolean")


def rate_limited_stream(log: DataFrame, limit: int, seconds: float) -> DataFrame:
    def run(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        taken = deque(state.get[0]) if state.exists else deque()
        got = pd.concat(list(frames)).sort_values(["at", "id"])
        got["allowed"] = [admit(taken, at, limit, seconds) for at in got["at"]]
        state.update((list(taken),))
        yield got[["key", "at", "id", "allowed"]]

    rows = log.select("key", "at", "id")
    return rows.groupBy("key").applyInPandasWithState(run, StructType([*rows.schema.fields, StructField("allowed", BooleanType())]), "taken array<double>", "append", GroupStateTimeout.NoTimeout)


def circuit(log: DataFrame, failures: int = 3, seconds: float = 60) -> DataFrame:
    """log (key, at, id, ok) with circuit: open while `seconds` have not passed since the last of `failures` in a row."""

    def step(s: dict, r: dict) -> str:
        if r["at"] < s["until"]:
            return "open"
        s["run"] = 0 if r["ok"] else s["run"] + 1
        if s["run"] >= failures:
            s["until"], s["run"] = r["at"] + seconds, 0
        return "closed"

    return folded(log, "circuit", lambda: {"run": 0, "until": float("-inf")}, step, "string")


def task_status(log: DataFrame, retries: int = 3, lease: float = 300) -> DataFrame:
    """log (key, at, id, event: submit, claim, done, retryable, fatal, recover) with the task's status after each event.
    A lease that ran out puts a running task back into the queue when recovery comes by."""

    def step(s: dict, r: dict) -> str:
        event, now = r["event"], s["status"]
        if event == "submit" and now == "":
            s["status"] = "queued"
        elif event == "claim" and now in ("queued", "retrying"):
            s["status"], s["until"] = "running", r["at"] + lease
        elif event == "recover" and now == "running" and r["at"] >= s["until"]:
            s["status"] = "queued"
        elif event == "done" and now == "running":
            s["status"] = "succeeded"
        elif event == "fatal" and now == "running":
            s["status"] = "failed"
        elif event == "retryable" and now == "running":
            s["status"] = "retrying" if s["count"] < retries else "dead_letter"
            s["count"] += 1
        return s["status"]

    return folded(log, "status", lambda: {"status": "", "until": 0.0, "count": 0}, step, "string")


def ingest(stream: DataFrame, store: str, checkpoint: str, key: str = "content_hash"):
    """A started query that appends each micro-batch's rows of unseen content to the Parquet table at `store`."""

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        batch = batch.dropDuplicates([key])
        try:
            batch = batch.join(spark.read.parquet(store).select(key), key, "left_anti")
        except Exception as e:  # the table does not exist before its first batch
            if "PATH_NOT_FOUND" not in str(e):
                raise
        batch.write.mode("append").parquet(store)

    return stream.withColumn(key, F.sha2("text", 256)).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
