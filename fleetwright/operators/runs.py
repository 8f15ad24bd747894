"""Judging runs: refresh gates, retries, verdicts, readiness waits, state changes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetwright.functions.blocks import carry, range_blocks
from fleetwright.operators.catalog import ordered_list_agg
from fleetwright.session import cut_lineage

# Rounds of module upgrades.
MAX_ROUNDS = 3

# Request states, their allowed followers and the closing states.
TRANSITIONS = [
    ("init", "new"),
    ("new", "pending"),
    ("pending", "progress"),
    ("progress", "done"),
    ("progress", "failed"),
    ("progress", "cancelled"),
]
STATES = ["init", "new", "pending", "progress", "done", "failed", "cancelled"]
CLOSING = ["done", "failed", "cancelled"]


def _digits(c: Column) -> Column:
    return F.coalesce(c.rlike(r"\A[0-9]+\z"), F.lit(False))


def _number(c: Column) -> Column:
    """Digit texts of any length in numeric order: without leading zeros, by length, by text."""
    short = F.regexp_replace(c, "^0+", "")
    return F.struct(F.length(short), short)


def refresh_gate(
    df: DataFrame, build: str = "build_stamp", recorded: str = "recorded_stamp"
) -> DataFrame:
    """Add needed and reason: does the recorded stamp call for a refresh to the build stamp?

    A null record means that nothing was recorded; a blank one is an invalid record. Line ends
    after a stamp do not count.
    """
    b, r = (F.regexp_replace(F.col(c), r"\n+\z", "") for c in (build, recorded))
    reason = (
        F.when(F.coalesce(b, F.lit("")) == "", "build_missing")
        .when(~_digits(b), "build_invalid")
        .when(r.isNull(), "record_missing")
        .when(~_digits(r), "record_invalid")
        .when(_number(r) < _number(b), "record_older")
        .otherwise("up_to_date")
    )
    needed = F.col("reason").isin("record_missing", "record_invalid", "record_older")
    return df.withColumn("reason", reason).withColumn("needed", needed)


def retry_outcome(
    attempts: DataFrame, run: str = "run_id", module: str = "module", rounds: int = MAX_ROUNDS
) -> DataFrame:
    """Per run and module: did one of the first rounds succeed, and how many were used?"""
    first_ok = F.min(F.when(F.col("ok"), F.col("attempt")))
    return (
        attempts.where(F.col("attempt") <= rounds)
        .groupBy(run, module)
        .agg(
            F.coalesce(F.bool_or("ok"), F.lit(False)).alias("ok"),
            F.coalesce(first_ok, F.max("attempt")).alias("attempts_used"),
        )
    )


def run_verdict(
    outcomes: DataFrame, run: str = "run_id", module: str = "module", chunk: int = 10_000
) -> DataFrame:
    """Per run: success, fatal (all failed) or partial, the failed modules and whether the
    stamp is written (unless fatal).

    The failed modules come sorted, as comma lists of `chunk` names each; a run with more
    has further rows with chunk_no 1, 2, ... and the same verdict. `outcomes` is read three
    times and should be stored if it is costly.
    """
    verdicts = (
        outcomes.groupBy(run)
        .agg(
            F.count_if(~F.col("ok")).alias("failed_count"),
            F.count(F.lit(1)).alias("_all"),
        )
        .withColumn(
            "verdict",
            F.when(F.col("failed_count") == 0, "success")
            .when(F.col("failed_count") == F.col("_all"), "fatal")
            .otherwise("partial"),
        )
        .withColumn("stamp", F.col("verdict") != "fatal")
        .drop("_all")
    )
    failed = failed_modules(outcomes, run, module, chunk)
    return verdicts.join(failed, run, "left").withColumns(
        {
            "chunk_no": F.coalesce("chunk_no", F.lit(0)).cast("bigint"),
            "failed": F.coalesce("failed", F.lit("")),
        }
    )


def failed_modules(
    outcomes: DataFrame, run: str = "run_id", module: str = "module", chunk: int = 10_000
) -> DataFrame:
    """The failed modules of each run as sorted comma lists of at most `chunk` names."""
    bad = outcomes.where(~F.col("ok")).select(run, module)
    if bad.schema[module].dataType.typeName() == "string":
        # Blocks are ranges of names found by sampling: many names with one prefix are split.
        part = F.spark_partition_id().cast("bigint")
        bad = cut_lineage(bad.repartitionByRange(run, module).withColumn("_range", part))
        block = F.col("_range")
    else:
        block = F.floor(F.col(module) / F.lit(65_536)).cast("bigint")
    return ordered_list_agg(bad, module, [module], block, by=[run], chunk=chunk, out="failed")


def lifecycle_audit(
    events: DataFrame,
    request: str = "request_id",
    order: Sequence[str] = ("ts", "event_id"),
    ranges: int | None = None,
) -> DataFrame:
    """Each state change with the state before it and whether it is allowed.

    The first state of a request may be any known one, since requests can be resumed. The
    previous state is looked up in blocks of about equal size, so a request with very many
    events, even within one hour, is spread over tasks. The allowed pairs are a short fixed list
    and become a plain filter expression.
    """
    seen = carry(
        range_blocks(events.select(request, *order, "state"), [request], list(order), ranges),
        [request],
        "_block",
        list(order),
        F.struct("state"),
        "_before",
        inclusive=False,
    )
    change = F.concat_ws(">", "from_state", "to_state")
    allowed = [f"{a}>{b}" for a, b in TRANSITIONS]
    return seen.select(
        request,
        *order,
        F.col("_before.state").alias("from_state"),
        F.col("state").alias("to_state"),
    ).withColumn(
        "valid",
        F.when(F.col("from_state").isNull(), F.col("to_state").isin(*STATES)).otherwise(
            change.isin(*allowed)
        ),
    )


def request_state(
    events: DataFrame,
    request: str = "request_id",
    ts: str = "ts",
    tie: str = "event_id",
) -> DataFrame:
    """State per request, since when, and whether it closes the request.

    The first closing state is the end: later rows do not reopen a request. Before one, the
    latest state counts.
    """
    row = F.struct(ts, tie, "state")
    ended = F.min(F.when(F.col("state").isin(*CLOSING), row))
    return (
        events.groupBy(request)
        .agg(F.coalesce(ended, F.max(row)).alias("_last"))
        .select(
            request,
            F.col("_last.state").alias("state"),
            F.col(f"_last.{ts}").alias("since"),
            F.col("_last.state").isin(*CLOSING).alias("terminal"),
        )
    )
