"""One key with a third of all rows: results stay whole and no task gets it alone."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from fleetwright.operators import trees
from fleetwright.streaming.lease import lease_state

SMALL = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
}


@pytest.fixture
def large_cluster(spark):
    before = {k: spark.conf.get(k) for k in SMALL}
    for k, v in SMALL.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_hot_group_is_split_in_the_upsert(spark, large_cluster):
    files = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 500).alias("grp"),
        F.col("id").alias("file_key"),
        F.md5(F.col("id").cast("string")).alias("content_hash"),
    )
    source = files.where("file_key % 7 != 0")
    out = trees.upsert_groups(source, files.where("grp % 2 = 0"))
    assert out.count() == out.select("grp", "file_key").distinct().count()
    tasks = out.where("grp = 0").groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert len(tasks) >= 3
    assert max(t["count"] for t in tasks) < 0.6 * sum(t["count"] for t in tasks)
    rows = out.collect()
    want = {(r["grp"], r["file_key"]) for r in source.collect()}
    assert {(r["grp"], r["file_key"]) for r in rows} == want


def test_lock_that_is_never_released(spark):
    """Every second an acquire on one lock: a grant per lifetime, found level by level."""
    start = datetime(2024, 1, 1)
    ops = spark.range(40_000).select(
        F.col("id").alias("event_id"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("l"), F.col("id") % 997)).alias("lock_name"),
        (F.lit(start).cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("id"))).alias("ts"),
        F.lit("acquire").alias("op"),
    )
    got = lease_state(ops, ttl_seconds=900).where("lock_name = 'hot' AND granted")
    times = [r["event_id"] for r in got.orderBy("event_id").collect()]
    assert times == list(range(0, 40_000, 900))
