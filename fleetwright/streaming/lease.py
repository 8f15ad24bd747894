"""Leases with expiry: who got the lock, and until when.

Acquire works only while there is no live lease; a lease ends after its lifetime; release removes
any lease, whoever holds it. Operations are (event_id, lock_name, ts, op) and are taken per lock
in the order (ts, event_id).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from fleetwright.functions.blocks import BLOCK_ROWS, carry, micros, range_blocks
from fleetwright.functions.lookup import look_up
from fleetwright.session import STATE_STORE, STATE_STORE_CONF, cut_lineage

# Fixed value: lifetime of a lease in seconds.
LEASE_SECONDS = 3_600
# How far an operation may lie behind the newest one of an earlier micro-batch.
LATE_SECONDS = 86_400
# Operations of a lock that a stream sorts at once, and the slots it puts more of them into.
MOST_ROWS = 200_000
SLOT_SECONDS = 60

_OUT = "lock_name string, event_id bigint, op string, t bigint, granted boolean, expires bigint"


def _with_times(df: DataFrame, ts_type) -> DataFrame:
    return df.select(
        "lock_name",
        "event_id",
        "op",
        F.timestamp_micros("t").cast(ts_type).alias("ts"),
        "granted",
        F.timestamp_micros("expires").cast(ts_type).alias("expires_at"),
    )


def _nameless(ops: DataFrame) -> DataFrame:
    """Operations without a lock name: they come back, and are never granted."""
    return ops.where(F.col("lock_name").isNull()).select(
        "lock_name",
        "event_id",
        "op",
        "ts",
        F.lit(False).alias("granted"),
        F.lit(None).cast(ops.schema["ts"].dataType).alias("expires_at"),
    )


def _frees(before: str, t: Column, ttl: int) -> Column:
    """Is the lock surely free at `t`, given the operation before?"""
    return (F.col(f"{before}.op") == "release") | (t - F.col(f"{before}.t") >= ttl)


def _walk(t: np.ndarray, acquire: np.ndarray, exp: int | None, ttl: int):
    """Grants and the expiry after each operation of one lock, in order.

    Jumps from grant to grant by binary search; steps through refused operations never happen.
    """
    n = len(t)
    granted = np.zeros(n, dtype=bool)
    expires = np.full(n, -1, dtype=np.int64)
    frees = np.flatnonzero(~acquire)
    tries = np.flatnonzero(acquire)
    i, f, live = 0, 0, exp
    while i < n:
        while f < len(frees) and frees[f] < i:
            f += 1
        stop = int(frees[f]) if f < len(frees) else n
        if live is not None:
            late = i + int(np.searchsorted(t[i:stop], live, side="left"))
            expires[i:late] = live
            i = late
        at = int(np.searchsorted(tries, i))
        if i < stop and at < len(tries) and tries[at] < stop:
            i = int(tries[at])
            live = int(t[i]) + ttl
            granted[i] = True
            expires[i] = live
            i += 1
        elif stop < n:
            live, i = None, stop + 1
        else:
            break
    return granted, expires, live


def lease_state(
    ops: DataFrame, ttl_seconds: int = LEASE_SECONDS, ranges: int | None = None, slot_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Batch form: every operation with `granted` and the expiry of the lease live after it.

    A lock is surely free after a release and after a gap of one lifetime, so its operations
    fall into stretches that do not depend on each other. Their starts are found in blocks of
    about equal size: inside a block by comparing neighbours, across blocks from one row per block. Within
    a stretch the first acquire is granted and everything in its lifetime is refused; what
    comes later is left to `_late_operations`.
    """
    ttl = ttl_seconds * 1_000_000
    rows = ops.where(F.col("lock_name").isNotNull()).select(
        "lock_name",
        "event_id",
        "op",
        micros("ts").alias("t"),
    )
    rows = range_blocks(rows, ["lock_name"], ["t", "event_id"], ranges)
    row = F.struct("t", "event_id", "op")
    inside = Window.partitionBy("lock_name", "_block").orderBy("t", "event_id")
    marked = rows.withColumn("_before", F.lag(row).over(inside)).withColumn(
        "_inner", F.when(F.col("_before").isNotNull() & _frees("_before", F.col("t"), ttl), row)
    )
    # Everything about the borders between blocks is settled on the small side.
    earlier = (
        Window.partitionBy("lock_name").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    )
    borders = (
        marked.groupBy("lock_name", "_block")
        .agg(F.min(row).alias("_first"), F.max(row).alias("_last"), F.max("_inner").alias("_inner"))
        .withColumn("_before", F.last("_last").over(earlier))
        .withColumn(
            "_opens", F.col("_before").isNull() | _frees("_before", F.col("_first.t"), ttl)
        )
        .withColumn("_latest", F.coalesce("_inner", F.when(F.col("_opens"), F.col("_first"))))
        .withColumn("_held", F.last("_latest", ignorenulls=True).over(earlier))
        .select(
            "lock_name",
            "_block",
            F.when(F.col("_opens"), F.col("_first")).otherwise(F.col("_held")).alias("_held"),
        )
    )
    running = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (
        marked.withColumn("_start", F.last("_inner", ignorenulls=True).over(running))
        .join(borders, ["lock_name", "_block"])
        .withColumn("_start", F.coalesce("_start", "_held"))
    )
    first = F.col("_start.event_id") == F.col("event_id")
    due = F.col("_start.t") + F.lit(ttl)
    is_release = F.col("op") == "release"
    settled = placed.where((F.col("t") < due) | is_release).select(
        "lock_name",
        "event_id",
        "op",
        "t",
        (first & ~is_release).alias("granted"),
        F.when(~is_release, due).alias("expires"),
    )
    late = cut_lineage(
        placed.where((F.col("t") >= due) & ~is_release).select(
            "lock_name",
            F.col("_start.t").alias("t0"),
            F.col("_start.event_id").alias("e0"),
            "event_id",
            "op",
            "t",
            (F.floor((F.col("t") - F.col("_start.t")) / F.lit(ttl)) - 1).cast("bigint").alias("slot"),
        )
    )
    result = settled
    if not late.isEmpty():
        result = settled.unionByName(_late_operations(late, ttl, slot_rows))
    return _with_times(result, ops.schema["ts"].dataType).unionByName(_nameless(ops))


_STRETCH = ["lock_name", "t0", "e0"]

# Levels handed down in one job.
_GATHER = 5


def _nearest(rows: DataFrame, group: list[str], dense: bool) -> DataFrame:
    """Add `_hit`: for rows with `_side` 0 the closest `_target` at or after their `_at`.

    `dense` groups are cut into blocks.
    """
    if dense:
        order = ["_at", "_side", "_row"]
        blocks = range_blocks(rows.withColumn("_row", F.coalesce("t", "_at")), group, order)
        found = carry(blocks, group, "_block", order, F.col("_target"), "_hit", backward=True)
        return found.drop("_block", "_row")
    nearest = (
        Window.partitionBy(*group)
        .orderBy(F.col("_at").desc(), F.col("_side").desc())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return rows.withColumn("_hit", F.last("_target", ignorenulls=True).over(nearest))


def _merge_chunks(jumps: DataFrame, level: int, ttl: int, dense: bool) -> DataFrame:
    """Jumps through twice as long chunks: leave the left chunk, go on in the right one.

    A jump says: if the lease is granted at (t, ev), the last grant inside the chunk is at
    `exit`. Kept are the jumps that can be the first in the longer chunk: those of the left one
    and, behind a single slot, the first of the right one.
    """
    group = [*_STRETCH, "_pair"]
    side = (F.col("chunk") % 2).cast("int")
    rows = jumps.withColumns(
        {
            "_pair": F.floor(F.col("chunk") / 2).cast("bigint"),
            "_side": side,
            "_at": F.when(side == 0, F.col("exit") + F.lit(ttl)).otherwise(F.col("t")),
            "_target": F.when(side == 1, F.struct("exit")),
        }
    )
    keep = F.col("_side") == 0
    if level == 0:
        firsts = rows.where(~keep).groupBy(*group).agg(F.min("t").alias("_right"))
        rows = look_up(rows, cut_lineage(firsts), group, ["t"], "left")
        keep = keep | (F.col("t") == F.col("_right"))
    rows = _nearest(rows, group, dense)
    far = F.when(F.col("_side") == 0, F.col("_hit.exit"))
    return rows.where(keep).select(
        *_STRETCH, F.col("_pair").alias("chunk"), "t", "ev", F.coalesce(far, "exit").alias("exit")
    )


def _look_up(entries: DataFrame, jumps: DataFrame, dense: bool) -> DataFrame:
    """Add `_hit` to each entry (stretch, chunk, e): the first jump of its chunk at or after e."""
    targets = jumps.select(
        *_STRETCH,
        "chunk",
        "t",
        F.col("t").alias("_at"),
        F.lit(1).alias("_side"),
        F.struct("t", "ev", "exit").alias("_target"),
    )
    asked = entries.withColumn("_at", F.col("e")).withColumn("_side", F.lit(0))
    rows = asked.unionByName(targets, allowMissingColumns=True)
    found = _nearest(rows, [*_STRETCH, "chunk"], dense).where(F.col("_side") == 0)
    return found.select(*_STRETCH, "chunk", "e", "last", "_hit")


def _late_operations(late: DataFrame, ttl: int, slot_rows: int) -> DataFrame:
    """Operations later than one lifetime into their stretch, each with its outcome.

    Time is cut into slots of one lifetime; a slot holds one grant at most. Which one depends
    on the slot before, so the slots are joined to chunks of 2, 4, 8, ... slots on the way up,
    each level half as large as the one before, and the expiry at the begin of every chunk is
    handed down again. A lock that is asked for without end is thereby spread over as many
    tasks as it has slots, and where a slot has more than `slot_rows` moments, it is cut further.
    """
    levels = [
        late.groupBy(*_STRETCH, F.col("slot").alias("chunk"), "t")
        .agg(F.min("event_id").alias("ev"))
        .withColumn("exit", F.col("t"))
    ]
    ends = late.groupBy(*_STRETCH).agg(F.max("slot").alias("last"))
    slots = ends.agg(F.max("last")).first()[0] + 1
    dense = levels[0].groupBy(*_STRETCH, "chunk").count().agg(F.max("count")).first()[0] > slot_rows
    while 2 ** (len(levels) - 1) < slots:
        levels.append(cut_lineage(_merge_chunks(levels[-1], len(levels) - 1, ttl, dense)))
    first = (F.col("t0") + F.lit(ttl)).alias("e")
    entries = ends.select(*_STRETCH, F.lit(0).cast("bigint").alias("chunk"), first, "last")
    for level in range(len(levels) - 2, -1, -1):
        asked = _look_up(
            entries.withColumn("chunk", F.col("chunk") * 2),
            levels[level].where(F.col("chunk") % 2 == 0),
            dense,
        )
        left = F.struct("chunk", "e")
        passed = F.coalesce(F.col("_hit.exit") + F.lit(ttl), F.col("e"))
        right = F.struct((F.col("chunk") + 1).alias("chunk"), passed.alias("e"))
        exists = (F.col("chunk") + 1) * F.lit(2**level) <= F.col("last")
        halves = F.when(exists, F.array(left, right)).otherwise(F.array(left))
        entries = asked.select(*_STRETCH, F.inline(halves), "last")
        if level and level % _GATHER == 0:
            entries = cut_lineage(entries)
    grants = _look_up(entries, levels[0], dense).withColumnRenamed("chunk", "slot")
    here = F.struct(F.col("t"), F.col("event_id").alias("ev"))
    grant = F.struct(F.col("_hit.t").alias("t"), F.col("_hit.ev").alias("ev"))
    waits = F.col("_hit").isNull() | (here < grant)
    return look_up(late, cut_lineage(grants), [*_STRETCH, "slot"], ["t"]).select(
        "lock_name",
        "event_id",
        "op",
        "t",
        (F.col("_hit").isNotNull() & (here == grant)).alias("granted"),
        F.when(waits, F.col("e")).otherwise(F.col("_hit.t") + F.lit(ttl)).alias("expires"),
    )


# Marks the lease that was live before a micro-batch among its operations.
_HELD = -(2**63)


def start_lease_state(
    ops: DataFrame,
    path: str,
    checkpoint: str,
    ttl_seconds: int = LEASE_SECONDS,
    late_seconds: int = LATE_SECONDS,
) -> StreamingQuery:
    """Stream by whole micro-batches: each is resolved by `lease_state`, so one lock may fill it.

    Below `path` every micro-batch has a folder with its operations and one with the leases it
    leaves behind; these go first in the next one. Running a micro-batch again replaces both.
    Later micro-batches must not bring earlier operations of the same lock. A lease that ended
    `late_seconds` before the newest operation of a micro-batch is not carried on, so the rows
    carried are those of live and lately ended leases, however many locks were ever seen.
    """

    def resolve(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.select("lock_name", "event_id", "op", "ts")
        if batch_id:
            held = spark.read.parquet(f"{path}/live/batch={batch_id - 1}")
            granted_at = F.col("expires_at") - F.make_dt_interval(secs=F.lit(ttl_seconds))
            rows = rows.unionByName(
                held.select(
                    "lock_name",
                    F.lit(_HELD).alias("event_id"),
                    F.lit("acquire").alias("op"),
                    granted_at.alias("ts"),
                )
            )
        done = f"{path}/operations/batch={batch_id}"
        lease_state(cut_lineage(rows), ttl_seconds).write.mode("overwrite").parquet(done)
        last = F.max_by("expires_at", F.struct("ts", "event_id")).alias("expires_at")
        resolved = spark.read.parquet(done)
        newest = resolved.agg(F.max("ts").alias("newest"))
        kept = F.col("expires_at") + F.make_dt_interval(secs=F.lit(late_seconds)) >= F.lit(newest.first()[0])
        resolved.groupBy("lock_name").agg(last).where(F.col("lock_name").isNotNull() & kept).write.mode("overwrite").parquet(
            f"{path}/live/batch={batch_id}"
        )

    return (
        ops.writeStream.foreachBatch(resolve)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_lease_state(spark: SparkSession, path: str) -> DataFrame:
    """The operations stored by `start_lease_state`."""
    stored = spark.read.parquet(f"{path}/operations").where(F.col("event_id") != _HELD)
    return stored.drop("batch")


class LeaseProcessor(StatefulProcessor):
    """State per lock: the expiry of the live lease in microseconds.

    Up to `most_rows` operations of a lock and micro-batch are sorted in memory. More of them are
    put away in the state store by slots of time and taken up again slot by slot, so that a lock
    with any share of the rows needs the memory of one frame and one slot. A timer removes a lease
    that is over. Later micro-batches must not bring earlier operations of the same lock.
    """

    def __init__(self, ttl_seconds: int = LEASE_SECONDS, timers: bool = True, most_rows: int = MOST_ROWS, slot_seconds: int = SLOT_SECONDS):
        self.ttl = ttl_seconds * 1_000_000
        self.timers = timers
        self.most = most_rows
        self.slot = slot_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.lease = handle.getValueState("lease", "expires bigint")
        self.waiting = handle.getMapState(
            "waiting", "slot bigint", "t array<bigint>, event_id array<bigint>, op array<string>"
        )

    def _put_away(self, frame: pd.DataFrame) -> set[int]:
        slots = frame["t"] // self.slot
        for slot, part in frame.groupby(slots):
            key = (int(slot),)
            old = self.waiting.getValue(key) if self.waiting.containsKey(key) else ([], [], [])
            self.waiting.updateValue(key, tuple(list(o) + part[c].tolist() for o, c in zip(old, ("t", "event_id", "op"), strict=True)))
        return {int(slot) for slot in slots.unique()}

    def _walked(self, name: str, frame: pd.DataFrame, live: int | None) -> tuple[pd.DataFrame, int | None]:
        frame = frame.sort_values(["t", "event_id"], ignore_index=True)
        acquire = (frame["op"] != "release").to_numpy()
        granted, expires, live = _walk(frame["t"].to_numpy(dtype=np.int64), acquire, live, self.ttl)
        out = frame[["event_id", "op", "t"]].copy()
        out.insert(0, "lock_name", name)
        out["granted"] = granted
        out["expires"] = pd.Series(expires, dtype="Int64").where(expires >= 0)
        return out, live

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = self.lease.get()
        before = live = None if held is None else held[0]
        frames, count, slots = [], 0, set()
        for frame in rows:
            frames.append(frame)
            count += len(frame)
            if count > self.most:
                slots |= self._put_away(pd.concat(frames))
                frames, count = [], 0
        if slots and frames:
            slots |= self._put_away(pd.concat(frames))
        if slots:
            for slot in sorted(slots):
                t, event_id, op = self.waiting.getValue((slot,))
                self.waiting.removeKey((slot,))
                out, live = self._walked(key[0], pd.DataFrame({"event_id": event_id, "op": op, "t": t}), live)
                yield out
        else:
            out, live = self._walked(key[0], pd.concat(frames), live)
            yield out
        if live is None:
            self.lease.clear()
        else:
            self.lease.update((live,))
        if self.timers and live != before:
            if before is not None:
                self.handle.deleteTimer(_millis(before))
            if live is not None:
                self.handle.registerTimer(_millis(live))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self.lease.get()
        if held is not None and _millis(held[0]) <= expiredTimerInfo.getExpiryTimeInMs():
            self.lease.clear()
        return iter(())

    def close(self) -> None:
        pass


def _millis(micros_: int) -> int:
    return -(-micros_ // 1000)


def lease_state_stream(
    ops: DataFrame,
    ttl_seconds: int = LEASE_SECONDS,
    late_seconds: int = LATE_SECONDS,
    most_rows: int = MOST_ROWS,
    slot_seconds: int = SLOT_SECONDS,
) -> DataFrame:
    """Streaming form of `lease_state` with state per lock, for low delay.

    A lease leaves the state once operations are `late_seconds` behind its end; operations that
    lie that far behind the newest one of an earlier micro-batch are not expected.
    """
    # State of this kind needs the RocksDB store. Asking for the query manager brings the state
    # store up also where no stream ran before.
    spark = ops.sparkSession
    if "RocksDB" not in spark.conf.get(STATE_STORE_CONF):
        spark.conf.set(STATE_STORE_CONF, STATE_STORE)
    _ = spark.streams
    rows = ops.where(F.col("lock_name").isNotNull()).select(
        "lock_name", "event_id", "op", micros("ts").alias("t")
    )
    if ops.isStreaming:
        rows = rows.withColumn("at", F.timestamp_micros("t")).withWatermark("at", f"{late_seconds} seconds")
    walked = rows.groupBy("lock_name").transformWithStateInPandas(
        LeaseProcessor(ttl_seconds, ops.isStreaming, most_rows, slot_seconds),
        outputStructType=_OUT,
        outputMode="Append",
        timeMode="EventTime" if ops.isStreaming else "None",
    )
    return _with_times(walked, ops.schema["ts"].dataType).unionByName(_nameless(ops))
