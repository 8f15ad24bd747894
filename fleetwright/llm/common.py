"""Reading the given tables, and shared storage between steps."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetwright.session import new_scratch_path

# White space of ASCII as the contracts of this package spell it.
BLANKS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def store(df: DataFrame, name: str) -> DataFrame:
    """Write `df` below the shared folder and read it back.

    Later steps then start from files that every executor sees; a lost executor costs only
    the step that runs.
    """
    path = new_scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def word_count(text: Column | str) -> Column:
    """Number of words of a text, 0 for null."""
    col = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(col, F.lit(WORD)), F.lit(0)).cast("bigint")


def row_key(doc_id: Column | str) -> dict[str, Column]:
    """Columns `_none` and `_id` that name a doc_id of any type without nulls.

    Plain equality then joins null ids, too, and an aggregation after such a join finds its rows
    in place: whole texts are not shuffled a second time, as they are after `eqNullSafe`.
    """
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return {"_none": col.isNull(), "_id": F.coalesce(col.cast("string"), F.lit(""))}


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with so many underscores in front that no column of `df` has it in any case."""
    held = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in held:
            name = f"_{name}"
        held.add(name.lower())
        out.append(name)
    return out


def packed(values: np.ndarray) -> bytes:
    """Whole numbers byte plane by byte plane, compressed; the planes of small numbers are zeros."""
    return zlib.compress(values.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(data), np.uint8).reshape(8, -1).T).view("<i8").ravel()
