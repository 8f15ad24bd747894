"""Backup archives: names, formats, choice of the newest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Known dump formats, first match wins, and the file that marks a directory dump.
DUMP_EXTENSIONS = [".sql", ".dump", ".zip", ".sql.gz"]
TABLE_OF_CONTENTS = "toc.dat"


def base_name(path: Column | str) -> Column:
    col = F.col(path) if isinstance(path, str) else path
    return F.regexp_extract(col, r"([^/]*)/*$", 1)


def archive_name(db: Column | str, version: Column | str, ts: Column | str) -> Column:
    """File name of a backup: database, major version and time stamp."""
    cols = [F.col(c) if isinstance(c, str) else c for c in (db, version, ts)]
    major = F.substring_index(cols[1].cast("string"), ".", 1)
    stamp = F.date_format(cols[2], "yyyyMMddHHmmss")
    return F.concat(F.concat_ws("_", cols[0], major, stamp), F.lit(".tar.gz"))


def parse_archive_name(df: DataFrame, filename: str = "filename") -> DataFrame:
    """Add db, version, stamp and valid.

    The last `_` part is the stamp, the one before it the version, all else the database. One
    `_` at the very end closes the last part. Fewer than three parts are invalid.
    """
    stem = F.regexp_replace(base_name(filename), r"\.tar\.gz$", "")
    parts = F.split(F.regexp_replace(stem, "_$", ""), "_")
    valid = F.size("_parts") >= 3
    return (
        df.withColumn("_parts", F.coalesce(parts, F.array().cast("array<string>")))
        .withColumns(
            {
                "db": F.when(valid, F.array_join(F.slice("_parts", 1, F.size("_parts") - 2), "_")),
                "version": F.when(valid, F.element_at("_parts", -2)),
                "stamp": F.when(valid, F.element_at("_parts", -1)),
                "valid": valid,
            }
        )
        .drop("_parts")
    )


def latest_archive(
    archives: DataFrame,
    version: str | None = None,
    db: str | None = None,
    by_db: bool = True,
    filename: str = "filename",
    mtime: str = "mtime_s",
) -> DataFrame:
    """Newest archive by modification time per version, or per database and version.

    Names are parsed first and only exact versions compared; of equal times the greater name
    wins. The maximum is combined on the map side: no window, no skew.
    """
    parsed = parse_archive_name(archives, filename).where("valid")
    if version is not None:
        parsed = parsed.where(F.col("version") == version)
    if db is not None:
        parsed = parsed.where(F.col("db") == db)
    keys = ["db", "version"] if by_db else ["version"]
    return (
        parsed.groupBy(*keys)
        .agg(F.max(F.struct(F.col(mtime).alias("m"), F.col(filename).alias("f"))).alias("_new"))
        .select(*keys, F.col("_new.f").alias("filename"), F.col("_new.m").alias("mtime_s"))
    )


def classify_dump_file(
    df: DataFrame,
    path: str = "path",
    is_dir: str = "is_dir",
    has_toc: str = "has_toc",
    head: str = "head",
    has_sql_member: str = "has_sql_member",
) -> DataFrame:
    """Add base, ext and valid for dump files and directories.

    The first fitting extension counts; a directory without one is taken as `.dump`. Any
    directory needs its table of contents. A zip file needs the member `dump.sql` (null stands
    for a file that is no zip: it passes, as only real zips are looked into); a gzip file its
    magic bytes, unless it is empty.
    """
    name = base_name(path)
    directory = F.coalesce(F.col(is_dir), F.lit(False))
    ext = F.when(directory, F.lit(".dump"))
    base = F.when(directory, name)
    for candidate in reversed(DUMP_EXTENSIONS):
        fits = F.endswith(F.col(path), F.lit(candidate))
        ext = F.when(fits, F.lit(candidate)).otherwise(ext)
        cut = F.substring(name, F.lit(1), F.length(name) - len(candidate))
        base = F.when(fits, cut).otherwise(base)
    magic = F.hex(F.substring(F.col(head), 1, 4))
    real_gzip = F.coalesce(F.startswith(magic, F.lit("1F8B")) | (magic == ""), F.lit(False))
    out = df.withColumns({"base": base, "ext": ext})
    valid = (
        F.when(F.col("ext").isNull(), False)
        .when(directory, F.coalesce(F.col(has_toc), F.lit(False)))
        .when(F.col("ext") == ".zip", F.coalesce(F.col(has_sql_member), F.lit(True)))
        .when(F.col("ext") == ".sql.gz", real_gzip)
        .otherwise(True)
    )
    return out.withColumn("valid", valid)
