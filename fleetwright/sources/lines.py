"""Lines of text files with their place in the file, read by Spark's own text source.

Files are cut into splits, so one large file is read by many tasks; what is counted inside a
split is added up over the splits of a file. Spark passes over names that begin with `_` or `.`;
files with such names, or below such folders, are read as streams by tasks of their own.
"""

from __future__ import annotations

import io
from collections.abc import Iterator, Sequence
from urllib.parse import quote

import pandas as pd

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetwright.functions.blocks import ordinal, running_total
from fleetwright.sources.files import list_tree, open_store

# Characters that Spark leaves as they are in file paths.
_SAFE = "/:=@$,+&;!'()*~"


def _passed_over(part: str) -> bool:
    """Names that Spark's listing leaves out."""
    return part.startswith(".") or (part.startswith("_") and "=" not in part) or part.endswith("._COPYING_")


def _hidden_lines(spark: SparkSession, path: str, line_sep: str | None) -> DataFrame:
    """Lines of the files that Spark's listing passes over."""
    depth = len(open_store(path)[1].rstrip("/").split("/"))
    newline = line_sep if line_sep is not None else None

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name in frame["path"]:
                store, plain = open_store(quote(name, safe=_SAFE))  # a URI, so blanks are escaped
                if not any(map(_passed_over, plain.split("/")[depth:])):
                    continue
                size = store.get_file_info(plain).size
                with store.open_input_stream(plain, compression=None) as raw:
                    text = io.TextIOWrapper(io.BufferedReader(raw), "utf-8", "replace", newline=newline)
                    held: list[tuple[int, str]] = []
                    for number, line in enumerate(text):
                        held.append((number, line.removesuffix("\n")))
                        if len(held) == 10_000:
                            yield _lines_of(name, size, held)
                            held = []
                    if held:
                        yield _lines_of(name, size, held)

    return list_tree(spark, path).select("path").mapInPandas(
        read, "file_id string, split_start bigint, file_size bigint, _seen bigint, line string"
    )


def _lines_of(name: str, size: int, held: list[tuple[int, str]]) -> pd.DataFrame:
    out = pd.DataFrame(held, columns=["_seen", "line"])
    out["file_id"] = quote(name, safe=_SAFE)
    return out.assign(split_start=0, file_size=size)[["file_id", "split_start", "file_size", "_seen", "line"]]


def _raw_lines(
    spark: SparkSession, path: str, hidden: bool, line_sep: str | None = None
) -> DataFrame:
    """Lines as they are read: `_seen` orders the lines of a split."""
    reader = spark.read.option("recursiveFileLookup", "true")
    if line_sep is not None:
        reader = reader.option("lineSep", line_sep)
    shown = reader.text(path).select(
        F.col("_metadata.file_path").alias("file_id"),
        F.col("_metadata.file_block_start").alias("split_start"),
        F.col("_metadata.file_size").alias("file_size"),
        F.monotonically_increasing_id().alias("_seen"),
        F.col("value").alias("line"),
    )
    return shown.unionByName(_hidden_lines(spark, path, line_sep)) if hidden else shown


def scan_config_files(spark: SparkSession, path: str, hidden: bool = True) -> DataFrame:
    """Config files as numbered lines (file_id, line_no, line).

    `hidden=False` is for folders that Spark wrote: what its committers and checksums leave
    there under hidden names is no data.
    """
    numbered = ordinal(_raw_lines(spark, path, hidden), ["file_id"], "split_start", ["_seen"], "line_no")
    return numbered.select("file_id", "line_no", "line")


def scan_log_lines(spark: SparkSession, path: str, hidden: bool = True) -> DataFrame:
    """Complete log lines with their byte position (file, byte_start, line).

    A last line without line end is still being written and is left out. `hidden`: see
    `scan_config_files`.
    """
    size = F.octet_length("line").cast("bigint") + 1
    lines = _raw_lines(spark, path, hidden, "\n").withColumn("_bytes", size)
    placed = running_total(
        lines, ["file_id"], "split_start", ["_seen"], F.col("_bytes"), "byte_start"
    )
    return placed.where(F.col("byte_start") + F.col("_bytes") <= F.col("file_size")).select(
        F.col("file_id").alias("file"), "byte_start", "line"
    )


def log_tail_from_offset(
    lines: DataFrame,
    from_byte: int | Column,
    file: str = "file",
    order: Sequence[str] = ("line_no",),
    block: str = "_block",
) -> DataFrame:
    """Log text from a byte on, as lines (file, byte_start, line).

    The byte is one number for all files or a column of `lines`, such as a joined position per
    file. `lines` holds complete lines in `order`; each counts with its line end. Of the line that
    holds the byte only the rest is returned; bytes that begin inside a character read as
    replacement characters. Positions are summed in blocks of lines (see `functions.blocks`).
    """
    sized = lines.withColumn("_bytes", F.octet_length("line").cast("bigint") + 1)
    placed = running_total(sized, [file], block, list(order), F.col("_bytes"), "_at")
    cut = F.greatest(F.lit(from_byte) - F.col("_at"), F.lit(0))
    bytes_left = F.substring(
        F.encode("line", "UTF-8"), cut.cast("int") + 1, F.col("_bytes").cast("int")
    )
    rest = F.make_valid_utf8(bytes_left.cast("string"))
    return placed.where(F.col("_at") + F.col("_bytes") > F.lit(from_byte)).select(
        file,
        (F.col("_at") + cut).cast("bigint").alias("byte_start"),
        F.when(cut > 0, rest).otherwise(F.col("line")).alias("line"),
    )
