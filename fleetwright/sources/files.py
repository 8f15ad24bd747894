"""Manifests, dumps and whole file trees: listed and read by the executors.

Spark's own file sources pass over empty files and over names that begin with `_` or `.`, which
module trees are full of. These scans therefore list folders with the file system API of Arrow
inside tasks. A tree is walked in rounds: a task that has listed its share hands the folders it has
not opened yet back, and the next round deals them out anew. Contents are read by as many tasks as
`tasks` says, never more than a few megabytes of a file at a time.
"""

from __future__ import annotations

import ast
import hashlib
import os
import re
import zipfile
from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from urllib.parse import quote

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetwright.session import cut_lineage

# Fixed value: the file that makes a folder a module.
MANIFEST = "__manifest__.py"

Batches = Iterator[pd.DataFrame]
_LISTED = 10_000
# Entries that a task lists in the first round of a walk.
WALK_SHARE = 10_000


def open_store(path: str) -> tuple[fs.FileSystem, str]:
    """File system and plain path of a Spark path."""
    uri = re.sub("^file:/(?!/)", "file:///", path)
    uri = re.sub("^s3[an]:", "s3:", uri)
    return fs.FileSystem.from_uri(uri if ":" in uri else os.path.abspath(uri))


def _task_count(spark: SparkSession, tasks: int | None) -> int:
    # A fixed number: rows to be read are few bytes each, and adaptive execution would put
    # them all into one task.
    return tasks or spark.sparkContext.defaultParallelism * 4


def _in_batches(rows: Iterator[tuple], columns: Sequence[str]) -> Batches:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == _LISTED:
            yield pd.DataFrame(held, columns=columns)
            held = []
    if held:
        yield pd.DataFrame(held, columns=columns)


def _entries(path: str, recursive: bool) -> list[fs.FileInfo]:
    store, base = open_store(path)
    selector = fs.FileSelector(base, allow_not_found=True, recursive=recursive)
    return sorted(store.get_file_info(selector), key=lambda e: e.base_name.encode())


def _prefix(path: str) -> str:
    """What to put before a plain path to get the path as Spark writes it."""
    if ":" not in path or path.startswith("file:"):
        return "file:"
    uri = path.rstrip("/")
    return uri[: len(uri) - len(open_store(path)[1].rstrip("/"))]


def _list_roots(
    spark: SparkSession, roots: Sequence[str], expand: Callable[[Batches], Batches], schema: str
) -> DataFrame:
    rows = [(i, r.rstrip("/")) for i, r in enumerate(roots)]
    return spark.createDataFrame(rows, "path_rank int, root string").mapInPandas(expand, schema)


def scan_module_manifests(
    spark: SparkSession, roots: Sequence[str], tasks: int | None = None
) -> DataFrame:
    """(path_rank, seq, name, path, depends) of the modules right below the roots.

    Roots keep their order in `path_rank`, the folders of a root their byte order in `seq`.
    Absent roots and folders without a manifest give no rows; a manifest that cannot be read as
    a literal gives no dependencies.
    """
    listed = ["path_rank", "seq", "name", "path"]

    def folders(batches: Batches) -> Batches:
        def rows():
            for pdf in batches:
                for rank, root in pdf.itertuples(index=False, name=None):
                    for seq, entry in enumerate(_entries(root, recursive=False)):
                        if entry.type == fs.FileType.Directory:
                            yield rank, seq, entry.base_name, f"{root}/{entry.base_name}"

        return _in_batches(rows(), listed)

    def parse(batches: Batches) -> Batches:
        for pdf in batches:
            found = pdf["path"].map(lambda p: _read_manifest(f"{p}/{MANIFEST}"))
            yield pdf.assign(depends=found)[found.notna()]

    schema = "path_rank int, seq bigint, name string, path string"
    modules = _list_roots(spark, roots, folders, schema)
    spread = modules.repartition(_task_count(spark, tasks), "path")
    return spread.mapInPandas(parse, f"{schema}, depends array<string>")


def _read_manifest(path: str) -> list[str] | None:
    store, name = open_store(path)
    if store.get_file_info(name).type != fs.FileType.File:
        return None
    try:
        with store.open_input_stream(name) as data:
            literal = ast.literal_eval(data.read().decode("utf-8"))
        return [str(d) for d in literal.get("depends") or []]
    except Exception:
        return []


def manifest_edges(modules: DataFrame) -> DataFrame:
    """(module, dep) edges of scanned modules."""
    return modules.select(F.col("name").alias("module"), F.explode("depends").alias("dep"))


def walk_tree(spark: SparkSession, root: str, tasks: int | None = None, share: int = WALK_SHARE) -> DataFrame:
    """(path, is_dir, size, mtime) of every file and folder below the root.

    A task opens folders until it has seen `share` entries; what is left goes into the next round,
    with a share four times as large. One folder is listed by one task, a tree below one top
    folder by as many as it needs. Each round is stored, so a lost executor costs one at most.
    """
    prefix = _prefix(root)
    frontier = spark.createDataFrame([(root.rstrip("/"),)], "path string")
    rounds = []
    while True:

        def step(batches: Batches, share: int = share) -> Batches:
            def rows():
                seen = 0
                for pdf in batches:
                    folders = pdf["path"].tolist()
                    while folders:
                        folder = folders.pop()
                        if seen >= share:
                            yield folder, True, True, None, None
                            continue
                        store, base = open_store(folder)
                        for entry in store.get_file_info(fs.FileSelector(base, allow_not_found=True)):
                            seen += 1
                            path = prefix + entry.path
                            if entry.type == fs.FileType.Directory:
                                folders.append(path)
                                yield path, True, False, None, None
                            elif entry.type == fs.FileType.File:
                                yield path, False, False, entry.size, entry.mtime

            return _in_batches(rows(), ["path", "is_dir", "is_left", "size", "mtime"])

        dealt = frontier.repartition(_task_count(spark, tasks), "path")
        found = cut_lineage(dealt.mapInPandas(step, "path string, is_dir boolean, is_left boolean, size bigint, mtime timestamp"))
        rounds.append(found.where("not is_left").drop("is_left"))
        frontier = found.where("is_left").select("path")
        if frontier.isEmpty():
            return reduce(DataFrame.unionByName, rounds)
        share *= 4


def _placed(found: DataFrame, root: str) -> DataFrame:
    """Adds `key`, the path below the root."""
    below = len(_prefix(root) + open_store(root.rstrip("/"))[1].rstrip("/")) + 2
    return found.withColumn("key", F.substring("path", F.lit(below), F.length("path")))


def list_tree(spark: SparkSession, root: str, tasks: int | None = None) -> DataFrame:
    """(grp, file_key, path, size, mtime) of every file below the root.

    The group is the first folder below the root, empty for files right there; the key is the
    rest of the path.
    """
    files = _placed(walk_tree(spark, root, tasks).where("not is_dir"), root)
    at = F.instr("key", "/")
    return files.select(
        F.substring("key", F.lit(1), F.greatest(at - 1, F.lit(0))).alias("grp"),
        F.substring("key", at + 1, F.length("key")).alias("file_key"),
        "path",
        "size",
        "mtime",
    )


def list_groups(spark: SparkSession, root: str, tasks: int | None = None) -> DataFrame:
    """(grp) of every folder right below the root, also those without a file."""
    folders = _placed(walk_tree(spark, root, tasks).where("is_dir"), root)
    return folders.where(~F.contains("key", F.lit("/"))).select(F.col("key").alias("grp"))


def scan_file_inventory(
    spark: SparkSession, root: str, hash_content: bool = True, tasks: int | None = None
) -> DataFrame:
    """(grp, file_key, size, mtime, content_hash) of every file below the root.

    Contents are hashed as streams, so files may have any size. Without `hash_content` no file
    is opened.
    """
    listed = list_tree(spark, root, tasks)
    if not hash_content:
        empty = F.lit(None).cast("string").alias("content_hash")
        return listed.select("grp", "file_key", "size", "mtime", empty)

    def hashed(batches: Batches) -> Batches:
        for pdf in batches:
            yield pdf.assign(content_hash=pdf["path"].map(_stream_hash)).drop(columns="path")

    return (
        listed.repartition(_task_count(spark, tasks), "path")
        .select("grp", "file_key", "path", "size", "mtime")
        .mapInPandas(
            hashed, "grp string, file_key string, size bigint, mtime timestamp, content_hash string"
        )
    )


def _stream_hash(path: str) -> str:
    store, name = open_store(path)
    digest = hashlib.sha256()
    with store.open_input_stream(name) as data:
        while block := data.read(8 << 20):
            digest.update(block)
    return digest.hexdigest()


def scan_dump_files(spark: SparkSession, root: str, tasks: int | None = None) -> DataFrame:
    """What `classify_dump_file` needs, for the dumps right below the root.

    A folder is one dump and counts as having a table of contents if it holds that file. Of
    files only the first bytes are read, of zip files also their directory.
    """

    def peek(batches: Batches) -> Batches:
        for pdf in batches:
            plain = pdf["grp"] == ""
            seen = [_peek(p) if one else (None, None) for p, one in zip(pdf["path"], plain, strict=True)]
            yield pd.DataFrame(
                {
                    "path": pdf["grp"].where(~plain, pdf["file_key"]),
                    "is_dir": ~plain,
                    "has_toc": ~plain & (pdf["file_key"] == "toc.dat"),
                    "head": [head for head, _ in seen],
                    "has_sql_member": [member for _, member in seen],
                }
            )

    schema = "path string, is_dir boolean, has_toc boolean, head binary, has_sql_member boolean"
    entries = list_tree(spark, root, tasks).select("grp", "file_key", "path")
    return entries.mapInPandas(peek, schema).groupBy("path").agg(
        F.bool_or("is_dir").alias("is_dir"),
        F.bool_or("has_toc").alias("has_toc"),
        F.max("head").alias("head"),
        F.bool_or("has_sql_member").alias("has_sql_member"),
    )


def _peek(path: str) -> tuple[bytes, bool | None]:
    store, name = open_store(path)
    with store.open_input_file(name) as data:
        head = data.read(4)
        if not path.endswith(".zip"):
            return head, None
        try:
            # Arrow's files refuse to seek before their begin, as the search for a zip's end does.
            real = zipfile.is_zipfile(data)
        except ValueError:
            real = False
        if not real:
            return head, None
        try:
            with zipfile.ZipFile(data) as archive:
                return head, "dump.sql" in archive.namelist()
        except Exception:
            return head, False


def config_file_ids(spark: SparkSession, root: str) -> DataFrame:
    """(file_id) of every file below the root, also those without lines, named as
    `scan_config_files` names them."""
    quoted = list_tree(spark, root).select("path")

    def encode(batches: Batches) -> Batches:
        for pdf in batches:
            yield pd.DataFrame({"file_id": pdf["path"].map(lambda p: quote(p, safe="/:=@$,+&;!'()*~"))})

    return quoted.mapInPandas(encode, "file_id string")
