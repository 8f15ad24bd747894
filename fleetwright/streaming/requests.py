"""Latest state of upgrade requests as a stream."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from fleetwright.functions.blocks import micros
from fleetwright.operators.runs import CLOSING
from fleetwright.session import STATE_STORE, STATE_STORE_CONF

# How long a closed request is remembered by the stream, in seconds.
CLOSED_SECONDS = 86_400
# Micro-batches between two snapshots.
SNAPSHOT_EVERY = 16

_ROW = "t bigint, tie bigint, state string"
_COLUMNS = ["request_id", "state", "since", "terminal", "event_id"]


class RequestProcessor(StatefulProcessor):
    """Per request the latest row, or the first closing one.

    Frames are folded one by one, so that a request with very many rows needs no more memory
    than one frame. A closed request is held in a value that expires; from then on it takes no
    room, and only rows later than that would be taken for a new request.
    """

    def __init__(self, closed_ms: int):
        self.closed_ms = closed_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getValueState("open", _ROW)
        self.closed = handle.getValueState("closed", _ROW, ttlDurationMs=self.closed_ms)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        for t, tie, state in zip(*[initialState[c].tolist() for c in ("t", "tie", "state")], strict=True):
            (self.closed if state in CLOSING else self.open).update((t, tie, state))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        before, latest = self.closed.get(), self.open.get()
        ended = before = before and tuple(before)
        latest = latest and tuple(latest)
        for frame in rows:
            for row in zip(frame["t"].tolist(), frame["tie"].tolist(), frame["state"].tolist(), strict=True):
                latest = row if latest is None else max(latest, row)
                if row[2] in CLOSING:
                    ended = row if ended is None else min(ended, row)
        if ended:
            self.open.clear()
            if ended != before:
                self.closed.update(ended)
        else:
            self.open.update(latest)
        t, tie, state = ended or latest
        yield pd.DataFrame({"request": [key[0]], "state": [state], "t": [t], "tie": [tie]})

    def close(self) -> None:
        pass


@contextmanager
def no_idle_batches(spark: SparkSession) -> Iterator[None]:
    """Queries started inside run no micro-batches without data. State that expires by the clock would
    keep a run with `availableNow` busy for ever; expired values go with the next data."""
    key = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def request_state_stream(
    events: DataFrame, initial: DataFrame | None = None, closed_seconds: float = CLOSED_SECONDS
) -> DataFrame:
    """The requests that each micro-batch touches: request_id, state, since, terminal, event_id.

    `events` has request_id, ts, event_id and state. `initial` may give the states of an earlier
    stream (the same columns as the result), with which this one goes on. Start it inside
    `no_idle_batches` if it is to end by itself.
    """
    spark = events.sparkSession
    if "RocksDB" not in spark.conf.get(STATE_STORE_CONF):
        spark.conf.set(STATE_STORE_CONF, STATE_STORE)
    _ = spark.streams

    def rows(df: DataFrame, ts: str):
        return df.select("request_id", micros(ts).alias("t"), F.col("event_id").cast("bigint").alias("tie"), "state").groupBy("request_id")

    kind = events.schema["request_id"].dataType.simpleString()
    found = rows(events, "ts").transformWithStateInPandas(
        RequestProcessor(int(closed_seconds * 1000)),
        outputStructType=f"request {kind}, state string, t bigint, tie bigint",
        outputMode="Update",
        timeMode="ProcessingTime",
        initialState=None if initial is None else rows(initial, "since"),
    )
    return found.select(
        F.col("request").alias("request_id"),
        "state",
        F.timestamp_micros("t").cast(events.schema["ts"].dataType).alias("since"),
        F.col("state").isin(*CLOSING).alias("terminal"),
        F.col("tie").alias("event_id"),
    )


def _current(parts: DataFrame) -> DataFrame:
    """One row per request: the first closing row, or the latest one."""
    row = F.struct("since", "event_id", "state")
    ended = F.min(F.when(F.col("terminal"), row))
    last = parts.groupBy("request_id").agg(F.coalesce(ended, F.max(row)).alias("last"))
    return last.select("request_id", "last.*").withColumn("terminal", F.col("state").isin(*CLOSING))


def start_request_state(
    events: DataFrame,
    path: str,
    checkpoint: str,
    initial: DataFrame | None = None,
    closed_seconds: float = CLOSED_SECONDS,
    snapshot_every: int = SNAPSHOT_EVERY,
) -> StreamingQuery:
    """Keep the latest state per request below `path`; resumes from `checkpoint`.

    Without a checkpoint a stopped stream resumes from the table it left (`initial`, as
    `read_request_state` returns it). Each micro-batch writes the requests it touched into a
    folder of its own; every so many add a snapshot of all requests. Running a batch again
    replaces its folders.
    """

    def keep(changed: DataFrame, batch_id: int) -> None:
        changed.write.mode("overwrite").parquet(f"{path}/kind=changes/batch={batch_id}")
        if batch_id % snapshot_every == snapshot_every - 1:
            current = _stored(changed.sparkSession, path, batch_id)
            current.write.mode("overwrite").parquet(f"{path}/kind=snapshot/batch={batch_id}")

    if initial is not None:
        initial.select(*_COLUMNS).write.mode("overwrite").parquet(f"{path}/kind=snapshot/batch=-1")
    states = request_state_stream(events, initial, closed_seconds)
    with no_idle_batches(events.sparkSession):
        return (
            states.writeStream.outputMode("update")
            .foreachBatch(keep)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )


def _stored(spark: SparkSession, path: str, upto: int | None = None) -> DataFrame:
    """State after micro-batch `upto`: the snapshot before it and the changes since; no other folder is read."""
    parts = spark.read.parquet(path)
    batch = F.col("batch")
    if upto is not None:
        parts = parts.where((batch < upto) | ((batch == upto) & (F.col("kind") == "changes")))
    since = parts.where("kind = 'snapshot'").agg(F.max("batch")).first()[0]
    if since is not None:
        parts = parts.where((batch > since) & (F.col("kind") == "changes") | (batch == since) & (F.col("kind") == "snapshot"))
    return _current(parts.select(*_COLUMNS))


def read_request_state(spark: SparkSession, path: str) -> DataFrame:
    """request_id, state, since, terminal, event_id: the current state of all requests."""
    return _stored(spark, path)
