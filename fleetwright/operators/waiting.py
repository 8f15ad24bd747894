"""Waiting with a fixed pause until a target is up."""

from __future__ import annotations

from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetwright.functions.blocks import carry, micros, range_blocks
from fleetwright.functions.lookup import look_up
from fleetwright.functions.stabbing import first_cells
from fleetwright.session import cut_lineage

BUCKET_ROWS = 65_536
_FAR = (1 << 63) - 1


def _stretches(states: DataFrame, looked: DataFrame, width: int, ranges: int | None) -> DataFrame:
    """(target, period, a, b): being up, cut at the begin of every period somebody looks at.

    The begin of such a period counts as one more observation, of the state before it.
    """
    seen = states.select("target", "up", F.col("t").alias("a"), F.lit(1).alias("kind"))
    begins = looked.select("target", F.lit(None).cast("boolean").alias("up"), (F.col("period") * F.lit(width)).alias("a"), F.lit(0).alias("kind"))
    rows = range_blocks(seen.union(begins), ["target"], ["a", "kind"], ranges)
    args = (["target"], "_block", ["a", "kind"])
    before = carry(rows, *args, F.when(F.col("kind") == 1, F.struct("up")), "_before", inclusive=False)
    down = F.when((F.col("kind") == 1) & ~F.col("up"), F.col("a"))
    both = carry(before, *args, down, "b", inclusive=False, backward=True, edges=rows)
    was_up = F.coalesce(F.col("_before.up"), F.lit(False))
    starts = F.when(F.col("kind") == 1, F.col("up") & ~was_up).otherwise(was_up)
    period = F.floor(F.col("a") / F.lit(width)).cast("bigint")
    stop = F.least(F.coalesce("b", F.lit(_FAR)), (F.col("period") + 1) * F.lit(width))
    cut = both.where(starts).select("target", period.alias("period"), "a", "b").withColumn("b", stop)
    return cut.where("b > a")


def _search(rows: pd.DataFrame, step: int, max_checks: int) -> pd.DataFrame:
    """First check of each waiter of a task inside a stretch of its group."""
    group = pd.factorize(pd.MultiIndex.from_frame(rows[["target", "period", "bucket"]]))[0]
    begin = rows["period"].to_numpy(np.int64) * max_checks
    a, b = rows["a"].to_numpy(np.int64), rows["b"].to_numpy(np.int64)
    asks = rows["asks"].to_numpy(bool)
    first = np.maximum(a[asks] // step - begin[asks], 0)
    base = begin[~asks] * step
    cell = first_cells(
        group[~asks], a[~asks] - base, b[~asks] - base, group[asks], first, a[asks] % step, step, max_checks
    )
    hit = rows.loc[asks, ["target", "a"]].assign(k=begin[asks] + cell - a[asks] // step)
    return hit[(cell >= 0) & (hit["k"] < max_checks)]


def wait_until_ready(
    waiters: DataFrame,
    states: DataFrame,
    sleep_seconds: int,
    max_checks: int,
    waiter: str = "waiter_id",
    target: str = "target",
    ts: str = "ts",
    bucket_rows: int = BUCKET_ROWS,
    ranges: int | None = None,
) -> DataFrame:
    """For each waiter the check at which its target is up, or a timeout.

    Check k (from 0) happens at the start plus k times the pause. A state holds until the next
    observation; one observation per target and time. `attempts` counts checks from 1. A waiter
    without target or start times out.

    Time is cut into periods of as many pauses as there are checks, so that a waiter looks at two
    periods at most. Within a period all waits are found in one sweep (`functions/stabbing.py`),
    whatever the number of ups and downs. A period of a target with very many rows is divided by
    the residue of the start modulo the pause: a waiter keeps its residue at every check, and a
    stretch goes to the residues it covers. Equal starts are looked up once.
    """
    step = sleep_seconds * 1_000_000
    width = step * max_checks
    starts = waiters.select(waiter, F.col(target).alias("target"), micros(ts).alias("a"))
    known = states.where(F.col(target).isNotNull()).select(F.col(target).alias("target"), "up", micros(ts).alias("t"))
    period = F.floor(F.col("a") / F.lit(width)).cast("bigint")
    asked = starts.where("target is not null and a is not null").select("target", "a").distinct()
    asked = cut_lineage(asked.select("target", F.explode(F.array(period, period + 1)).alias("period"), "a"))
    up = _stretches(known, asked.select("target", "period").distinct(), width, ranges)
    none = F.lit(None).cast("bigint")
    rows = up.withColumn("asks", F.lit(False)).unionByName(asked.withColumns({"b": none, "asks": F.lit(True)}))
    rows = cut_lineage(rows)
    sizes = rows.groupBy("target", "period").agg(F.ceil(F.count("*") / F.lit(bucket_rows)).alias("parts"))
    hot = cut_lineage(sizes.where("parts > 1"))
    parted = look_up(rows, hot, ["target", "period"], ["a"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)).cast("bigint"))
    residue = F.pmod("a", F.lit(step))
    low = F.floor(residue * F.col("parts") / F.lit(step)).cast("bigint")
    high = F.floor((residue + F.col("b") - F.col("a") - 1) * F.col("parts") / F.lit(step)).cast("bigint")
    every = low + F.col("parts") - 1
    high = F.when(F.col("asks"), low).when(F.col("b") - F.col("a") >= step, every).otherwise(F.least(high, every))
    dealt = parted.select("*", F.explode(F.sequence(low, high)).alias("bucket"))
    dealt = dealt.withColumn("bucket", F.pmod("bucket", F.col("parts"))).drop("parts")
    tasks = max(1, -(-rows.count() // bucket_rows))
    name = F.pmod(F.xxhash64("target", "period", "bucket"), F.lit(tasks)).alias("task")
    kind = waiters.schema[target].dataType.simpleString()
    found = (
        dealt.groupBy(name)
        .applyInPandas(partial(_search, step=step, max_checks=max_checks), f"target {kind}, a bigint, k bigint")
        .groupBy("target", "a")
        .agg(F.min("k").alias("k"))
    )
    # As many rows as distinct starts, in a small file: Spark would send every copy of them to all tasks.
    met = look_up(starts, cut_lineage(found).hint("merge"), ["target", "a"], [waiter], "left")
    ready = F.col("k").isNotNull()
    moment = F.timestamp_micros(F.col("a") + F.col("k") * F.lit(step))
    return met.select(
        waiter,
        F.when(ready, F.col("k") + 1).otherwise(F.lit(max_checks)).cast("bigint").alias("attempts"),
        F.when(ready, moment).cast(waiters.schema[ts].dataType).alias("ready_ts"),
        F.when(ready, "ready").otherwise("timeout").alias("outcome"),
    )
