"""Snapshots of whole tables with a checksum manifest: export, verify, import.

Checksums are taken by the jobs that write, so nothing is read a second time for them. Tables are
written side by side.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Mapping
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_MANIFEST = "_manifest"
# Tables that are written at the same time.
_AT_ONCE = 8
# Parquet pages carry checksums; a damaged page then fails with the name of its file.
_CHECKED = {"parquet.page.verify-checksum.enabled": "true"}


def _sums(df: DataFrame) -> list[Column]:
    """Number of rows and a hash that does not depend on row order."""
    cols = [F.col(f"`{c}`") for c in df.columns]
    # The hash passes over nulls, so their places are hashed as well.
    row_hash = F.xxhash64(*cols, *[c.isNull() for c in cols]).cast("decimal(38,0)")
    return [
        F.count(F.lit(1)).alias("rows"),
        F.coalesce(F.sum(row_hash), F.lit(0)).cast("decimal(38,0)").alias("table_hash"),
    ]


def table_checksum(df: DataFrame, table: str) -> DataFrame:
    """One row: table, rows and a hash that does not depend on row order."""
    return df.agg(*_sums(df)).select(F.lit(table).alias("table"), "rows", "table_hash")


def _write(df: DataFrame, table: str, path: str) -> tuple:
    """Write the table; its rows and hash as they went into the files."""
    seen = Observation(table)
    df.observe(seen, *_sums(df)).write.mode("errorifexists").parquet(path)
    found = seen.get
    # An empty plan may be written without a task that counts.
    return table, found.get("rows", 0), found.get("table_hash", 0)


def _side_by_side(spark: SparkSession, work: Callable[[str], tuple], names: Iterable[str]) -> DataFrame:
    """One row per table, in the order of the names."""
    with ThreadPoolExecutor(_AT_ONCE) as pool:
        done = list(pool.map(inheritable_thread_target(spark)(work), names))
    return spark.createDataFrame([(t, n, int(h)) for t, n, h in done], "table string, rows bigint, table_hash string").select(
        "table", "rows", F.col("table_hash").cast("decimal(38,0)").alias("table_hash")
    )


def export_snapshot(
    spark: SparkSession,
    tables: Mapping[str, DataFrame],
    directory: str,
    parts: int | None = None,
) -> DataFrame:
    """Write every table as parquet parts, and its rows and hash as they were written: the manifest.

    Tables are written with the partitions they have; `parts` asks for another number. The
    manifest comes last, so a folder with one is complete.
    """

    def work(name: str) -> tuple:
        out = tables[name] if parts is None else tables[name].repartition(parts)
        return _write(out, name, f"{directory}/{name}")

    manifest = _side_by_side(spark, work, tables)
    manifest.coalesce(1).write.mode("errorifexists").parquet(f"{directory}/{_MANIFEST}")
    return spark.read.parquet(f"{directory}/{_MANIFEST}")


def _compared(manifest: DataFrame, fresh: DataFrame) -> DataFrame:
    fresh = fresh.select("table", F.col("rows").alias("_rows"), F.col("table_hash").alias("_hash"))
    same = (F.col("rows") == F.col("_rows")) & (F.col("table_hash") == F.col("_hash"))
    return manifest.join(fresh, "table", "left").select(
        "table", F.col("_rows").alias("rows"), F.coalesce(same, F.lit(False)).alias("verified")
    )


def _tables_of(manifest: DataFrame) -> list[str]:
    return [r["table"] for r in manifest.select("table").collect()]


def verify_snapshot(spark: SparkSession, directory: str) -> DataFrame:
    """Compare the files with the manifest: table, rows and verified."""
    manifest = spark.read.parquet(f"{directory}/{_MANIFEST}")
    parts = [table_checksum(spark.read.parquet(f"{directory}/{t}"), t) for t in _tables_of(manifest)]
    return _compared(manifest, reduce(DataFrame.unionByName, parts))


def import_snapshot(
    spark: SparkSession,
    directory: str,
    database: str,
    mode: str,
    location: str | None = None,
    verify: bool = True,
) -> DataFrame:
    """Load a snapshot as the tables of a database: table, rows and verified.

    replace  drop the database if it exists and create it anew
    refuse   fail if the database exists

    The files are read once: they are copied beside `location` (or the warehouse folder of the
    database) while their rows and hashes are taken. Only if every table agrees with the manifest
    (or `verify` is off) is the database dropped and created, with tables over the copies, so
    that a damaged snapshot touches nothing. A damaged part fails by its name.
    """
    if mode not in ("replace", "refuse"):
        raise ValueError(f"unknown mode: {mode}")
    if mode == "refuse" and spark.catalog.databaseExists(database):
        raise ValueError(f"database {database} already exists")
    manifest = spark.read.parquet(f"{directory}/{_MANIFEST}")
    names = _tables_of(manifest)
    base = location or f"{spark.conf.get('spark.sql.warehouse.dir')}/{database}.db"
    staged = f"{base.rstrip('/')}-{uuid.uuid4().hex}"

    def work(name: str) -> tuple:
        return _write(spark.read.options(**_CHECKED).parquet(f"{directory}/{name}"), name, f"{staged}/{name}")

    report = _compared(manifest, _side_by_side(spark, work, names))
    bad = [r["table"] for r in report.where("not verified").collect()] if verify else []
    if bad:
        raise ValueError(f"snapshot differs from its manifest: {', '.join(sorted(bad))}")
    if mode == "replace":
        spark.sql(f"DROP DATABASE IF EXISTS `{database}` CASCADE")
    place = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE DATABASE `{database}`{place}")
    for name in names:
        spark.sql(f"CREATE TABLE `{database}`.`{name}` USING parquet LOCATION '{staged}/{name}'")
    return report
