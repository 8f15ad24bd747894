import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from fleetwright.streaming.lease import (
    lease_state,
    lease_state_stream,
    read_lease_state,
    start_lease_state,
)

EPOCH = datetime(2024, 1, 1)


def brute_force(ops, ttl):
    """The rule itself, one operation after the other."""
    out, held = {}, {}
    for event, lock, ts, op in sorted(ops, key=lambda o: (o[2], o[0])):
        if op == "release":
            held.pop(lock, None)
            out[event] = (False, None)
            continue
        granted = lock not in held or held[lock] <= ts
        if granted:
            held[lock] = ts + timedelta(seconds=ttl)
        out[event] = (granted, held[lock])
    return out


def table(spark, ops):
    return spark.createDataFrame(ops, "event_id bigint, lock_name string, ts timestamp_ntz, op string")


def results(df):
    return {r["event_id"]: (r["granted"], r["expires_at"]) for r in df.collect()}


def test_acquire_release_and_expiry(spark):
    at = lambda s: EPOCH + timedelta(seconds=s)
    ops = [
        (1, "a", at(0), "acquire"),
        (2, "a", at(10), "acquire"),
        (3, "a", at(20), "release"),
        (4, "a", at(21), "acquire"),
        (5, "a", at(3621), "acquire"),
        (6, "b", at(5), "release"),
        (7, "b", at(6), "acquire"),
    ]
    got = results(lease_state(table(spark, ops)))
    assert got == brute_force(ops, 3600)
    assert [got[i][0] for i in range(1, 8)] == [True, False, False, True, True, False, True]


def random_ops(seed, n, spread, release, locks):
    rng = random.Random(seed)
    times = [rng.randrange(spread) for _ in range(n)]
    return [
        (
            i,
            "hot" if rng.random() < 0.5 else f"l{rng.randrange(locks)}",
            EPOCH + timedelta(seconds=t),
            "release" if rng.random() < release else "acquire",
        )
        for i, t in enumerate(times)
    ]


@pytest.mark.parametrize(
    ("seed", "n", "spread", "release", "ttl"),
    [(1, 600, 5_000, 0.1, 60), (2, 800, 3_000, 0.0, 40), (3, 500, 400, 0.02, 50), (4, 300, 90_000, 0.2, 3600)],
)
def test_batch_and_one_pass_state_equal_brute_force(spark, seed, n, spread, release, ttl):
    ops = random_ops(seed, n, spread, release, 4)
    want = brute_force(ops, ttl)
    assert results(lease_state(table(spark, ops), ttl, ranges=7)) == want
    assert results(lease_state(table(spark, ops), ttl, ranges=7, slot_rows=2)) == want
    assert results(lease_state_stream(table(spark, ops), ttl)) == want


def test_no_two_live_leases_overlap(spark):
    ops = random_ops(5, 500, 4_000, 0.0, 2)
    got = lease_state(table(spark, ops), 60).where("granted")
    pairs = got.alias("a").join(got.alias("b"), "lock_name").where(
        (F.col("a.event_id") != F.col("b.event_id"))
        & (F.col("a.ts") <= F.col("b.ts"))
        & (F.col("b.ts") < F.col("a.expires_at"))
    )
    assert pairs.count() == 0


def test_streams_keep_the_lease_between_micro_batches(spark, tmp_path):
    ops = random_ops(6, 200, 2_000, 0.1, 2)
    ordered = sorted(ops, key=lambda o: (o[2], o[0]))
    for i in range(4):
        part = table(spark, ordered[i * 50 : i * 50 + 50]).coalesce(1)
        part.write.mode("append").parquet(str(tmp_path / "in"))
    schema = table(spark, ops).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = (
        lease_state_stream(stream, 60)
        .writeStream.format("parquet")
        .option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "marks"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    got = results(spark.read.parquet(str(tmp_path / "out")))
    assert got == brute_force(ops, 60)
    whole = start_lease_state(stream, str(tmp_path / "whole"), str(tmp_path / "whole-marks"), 60)
    whole.awaitTermination()
    assert len(list((tmp_path / "whole" / "live").glob("batch=*"))) == 4
    assert results(read_lease_state(spark, str(tmp_path / "whole"))) == brute_force(ops, 60)


def test_ended_leases_are_not_carried_on(spark, tmp_path):
    # Every micro-batch takes locks of its own; ten batches later their leases are long over.
    for i in range(10):
        ops = [(i * 10 + k, f"lock_{i}_{k}", EPOCH + timedelta(minutes=10 * i), "acquire") for k in range(10)]
        frame = spark.createDataFrame(ops, "event_id bigint, lock_name string, ts timestamp, op string").coalesce(1)
        frame.write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    start_lease_state(stream, str(tmp_path / "out"), str(tmp_path / "marks"), 60, late_seconds=900).awaitTermination()
    live = [spark.read.parquet(str(p)).count() for p in sorted((tmp_path / "out" / "live").glob("batch=*"))]
    assert len(live) == 10 and max(live) <= 20
    assert read_lease_state(spark, str(tmp_path / "out")).where("granted").count() == 100


def run_stream(df, tmp_path):
    query = (
        df.writeStream.format("parquet")
        .option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "marks"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def test_a_hot_lock_is_walked_in_slots(spark, tmp_path):
    ops = random_ops(8, 900, 4_000, 0.1, 2)
    ordered = sorted(ops, key=lambda o: (o[2], o[0]))
    for i in range(3):
        part = table(spark, ordered[i * 300 : i * 300 + 300]).coalesce(1)
        part.write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table(spark, ops).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run_stream(lease_state_stream(stream, 60, most_rows=20, slot_seconds=50), tmp_path)
    assert results(spark.read.parquet(str(tmp_path / "out"))) == brute_force(ops, 60)


def test_timers_remove_ended_leases(spark, tmp_path):
    # Every micro-batch takes locks of its own; ten batches later their leases are long over.
    for i in range(10):
        ops = [(i * 10 + k, f"lock_{i}_{k}", EPOCH + timedelta(minutes=10 * i), "acquire") for k in range(10)]
        frame = spark.createDataFrame(ops, "event_id bigint, lock_name string, ts timestamp, op string").coalesce(1)
        frame.write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = run_stream(lease_state_stream(stream, 60, late_seconds=900), tmp_path)
    assert spark.read.parquet(str(tmp_path / "out")).where("granted").count() == 100
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    # A lease and its timer for the locks of the last batches, not of all.
    assert held[-1] < held[3] + 40 and held[-1] < 100
