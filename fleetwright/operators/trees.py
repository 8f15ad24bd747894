"""Comparing and merging file inventories (group, file, content hash)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetwright.functions.lookup import look_up
from fleetwright.session import cut_lineage

KEYS = ("grp", "file_key")


def path_hygiene_filter(df: DataFrame, path: str = "path") -> DataFrame:
    """Drop what lies below a `.git` directory and files whose name starts with a dot."""
    return df.where(~F.col(path).rlike(r"(^|/)\.git/") & ~F.col(path).rlike(r"(^|/)\.[^/]*$"))


def _has_paths(*trees: DataFrame) -> bool:
    """Whether file keys are paths, in which one file can lie where another tree has a folder."""
    return all(t.schema["file_key"].dataType.typeName() == "string" for t in trees)


def _folders(path: Column) -> Column:
    """All folders above a path, the nearest last: `a/b/c` lies below `a` and `a/b`."""
    parts = F.split(path, "/")
    return F.transform(
        F.sequence(F.lit(1), F.size(parts) - 1, F.lit(1)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")
    )


def _in_folders(files: DataFrame) -> DataFrame:
    """One row per file and folder above it."""
    nested = files.where(F.contains("file_key", F.lit("/")))
    return nested.select(*KEYS, F.explode(_folders(F.col("file_key"))).alias("folder"))


def blocked_files(files: DataFrame, other: DataFrame) -> DataFrame:
    """The keys of `files` that cannot stand beside `other`: where that has a folder of the same
    name, or a file where these need a folder."""
    above = _in_folders(other).select("grp", F.col("folder").alias("file_key")).distinct()
    under = _in_folders(files)
    stops = other.select("grp", F.col("file_key").alias("folder"))
    one = files.select(*KEYS).join(above, list(KEYS), "left_semi")
    two = under.join(stops, ["grp", "folder"], "left_semi").select(*KEYS)
    return one.union(two).distinct()


def _side_by_side(source: DataFrame, target: DataFrame) -> DataFrame:
    left = source.select(*KEYS, F.struct("content_hash").alias("_src"))
    right = target.select(*KEYS, F.struct("content_hash").alias("_tgt"))
    return left.join(right, list(KEYS), "full_outer")


_STATUS = """
    CASE WHEN _tgt IS NULL THEN 'source_only'
         WHEN _src IS NULL THEN 'target_only'
         WHEN _src.content_hash <=> _tgt.content_hash THEN 'same'
         ELSE 'changed' END
"""


def snapshot_diff(source: DataFrame, target: DataFrame) -> DataFrame:
    """State of every file found on either side: source_only, target_only, changed or same.

    A file where the other side has a folder of that name is changed, and so are the files below
    such a folder: neither can be laid beside the other.
    """
    files = _side_by_side(source, target).select(*KEYS, F.expr(_STATUS).alias("status"))
    if not _has_paths(source, target):
        return files
    blocked = blocked_files(source, target).union(blocked_files(target, source)).withColumn("_blocked", F.lit(True))
    return files.join(blocked, list(KEYS), "left").select(
        *KEYS, F.when(F.col("_blocked"), "changed").otherwise(F.col("status")).alias("status")
    )


def _digest(*parts: Column) -> list[Column]:
    """Two numbers whose sums over entries identify the entries, in any order."""
    # A null is told from any text by the length in front.
    cells = [F.coalesce(F.concat(F.length(p.cast("string")), F.lit(":"), p.cast("string")), F.lit("~")) for p in parts]
    code = F.sha2(F.concat(*cells), 256)
    wide = "decimal(38,0)"
    return [F.conv(F.substring(code, at, 15), 16, 10).cast(wide) for at in (1, 16)]


def tree_digests(files: DataFrame) -> DataFrame:
    """(grp, folder, files, digest): what lies below each folder of each group, as a number.

    Folder `` is the whole group. Equal digests mean equal paths and contents below. A digest is
    a sum over files, so a folder of any size is added up where its files are read, and only one
    row per folder and task is shuffled.
    """
    one, two = _digest(F.col("file_key"), F.col("content_hash"))
    rows = files.select("grp", F.col("file_key").cast("string").alias("file_key"), one.alias("one"), two.alias("two"))
    tops = F.array(F.lit(""))
    folders = F.concat(tops, _folders(F.col("file_key"))) if _has_paths(files) else tops
    nested = rows.select("grp", F.explode(F.when(F.contains("file_key", F.lit("/")), folders).otherwise(tops)).alias("folder"), "one", "two")
    return (
        nested.groupBy("grp", "folder")
        .agg(F.count("*").alias("files"), F.sum("one").alias("one"), F.sum("two").alias("two"))
        .select("grp", "folder", "files", F.concat_ws("-", "one", "two").alias("digest"))
    )


def differing_folders(source: DataFrame, target: DataFrame) -> DataFrame:
    """(grp, folder, status) for folders that are not the same, from the digests of both sides."""
    left = source.select("grp", "folder", F.struct("files", "digest").alias("_src"))
    right = target.select("grp", "folder", F.struct("files", "digest").alias("_tgt"))
    status = F.expr(
        """CASE WHEN _tgt IS NULL THEN 'source_only' WHEN _src IS NULL THEN 'target_only'
                WHEN _src = _tgt THEN 'same' ELSE 'changed' END"""
    )
    both = left.join(right, ["grp", "folder"], "full_outer")
    return both.select("grp", "folder", status.alias("status")).where("status <> 'same'")


def tree_changes(source: DataFrame, target: DataFrame) -> DataFrame:
    """The rows of `snapshot_diff` that are not `same`.

    Folders with equal digests are passed over, as a comparison folder by folder does: only files
    right in a folder that differs are compared. Where Spark can hold the list of such folders in
    memory, files of all other folders are never shuffled.
    """
    wanted = cut_lineage(differing_folders(tree_digests(source), tree_digests(target)).select("grp", "folder"))
    holder = F.when(
        F.contains("file_key", F.lit("/")), F.regexp_extract("file_key", r"(?s)^(.*)/[^/]*$", 1)
    ).otherwise("")

    def touched(files: DataFrame) -> DataFrame:
        rows = files.select(*KEYS, "content_hash", holder.alias("folder"))
        return look_up(rows, wanted, ["grp", "folder"], ["file_key"], "left_semi").drop("folder")

    return snapshot_diff(touched(source), touched(target)).where("status <> 'same'")


def _action() -> Column:
    in_source = F.bool_or(F.col("status") != "target_only")
    in_target = F.bool_or(F.col("status") != "source_only")
    same = F.bool_and(F.col("status") == "same")
    return (
        F.when(~in_target, "added")
        .when(~in_source, "target_only")
        .when(same, "same")
        .otherwise("changed")
    )


def group_change_rollup(diff: DataFrame) -> DataFrame:
    """One action per group: added, changed, same, or target_only (kept as it is)."""
    return diff.groupBy("grp").agg(_action().alias("action"))


def group_actions(
    source: DataFrame,
    target: DataFrame,
    source_groups: DataFrame | None = None,
    target_groups: DataFrame | None = None,
) -> DataFrame:
    """The actions of `group_change_rollup` from one digest per group and side: no file is shuffled.

    `source_groups` and `target_groups` (grp) may list groups that hold no file.
    """
    one, two = _digest(F.col("file_key"), F.col("content_hash"))
    zero = F.lit(0).cast("decimal(38,0)")

    def groups(files: DataFrame, listed: DataFrame | None, out: str) -> DataFrame:
        rows = files.select("grp", F.lit(1).alias("files"), one.alias("one"), two.alias("two"))
        if listed is not None:
            rows = rows.union(listed.select("grp", F.lit(0), zero, zero))
        summed = rows.groupBy("grp").agg(*[F.sum(c).alias(c) for c in ("files", "one", "two")])
        return summed.select("grp", F.struct("files", "one", "two").alias(out))

    both = groups(source, source_groups, "_src").join(groups(target, target_groups, "_tgt"), "grp", "full_outer")
    action = (
        F.when(F.col("_tgt").isNull(), "added")
        .when(F.col("_src").isNull(), "target_only")
        .when(F.col("_src") == F.col("_tgt"), "same")
        .otherwise("changed")
    )
    return both.select("grp", action.alias("action"))


def upsert_groups(source: DataFrame, target: DataFrame) -> DataFrame:
    """The next target tree: added and changed groups come whole from the source, all other
    groups of the target stay.

    Groups are told apart by their digests. The action joins back as one row per group, with the
    files of a group dealt out, so that a very large group meets no single task.
    """
    actions = cut_lineage(group_actions(source, target))
    replaced = F.col("action").isin("added", "changed")

    def part(files: DataFrame, groups: DataFrame) -> DataFrame:
        rows = files.select(*KEYS, "content_hash")
        return look_up(rows, groups.select("grp"), ["grp"], ["file_key"], "left_semi")

    return part(source, actions.where(replaced)).union(part(target, actions.where(~replaced)))


def write_upsert(source: DataFrame, target: DataFrame, path: str) -> None:
    """Write the changed and added groups over a tree stored by group, leaving others alone.

    Only the partitions of those groups are replaced. The list of groups is stored before the
    write starts, because `target` is usually read from the very files that are replaced.
    """
    actions = group_actions(source, target)
    wanted = cut_lineage(actions.where(F.col("action").isin("added", "changed")).select("grp"))
    (
        look_up(source, wanted, ["grp"], ["file_key"], "left_semi")
        .select("file_key", "content_hash", "grp")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("grp")
        .parquet(path)
    )


def overlay_merge(base: DataFrame, new: DataFrame) -> DataFrame:
    """Lay the new tree over the base file by file; the new file wins, nothing else is deleted.

    Where one side has a file and the other a folder of that name, the new side wins as well: a
    tree cannot hold both.
    """
    merged = _side_by_side(new, base).select(
        *KEYS, F.coalesce(F.col("_src"), F.col("_tgt"))["content_hash"].alias("content_hash")
    )
    return merged.join(blocked_files(base, new), list(KEYS), "left_anti") if _has_paths(base, new) else merged


def overlay_lookup(
    wanted: DataFrame,
    layers: DataFrame,
    names: Sequence[str],
    path: str = "path",
    rank: str = "layer_rank",
    fallback: str = "backend",
) -> DataFrame:
    """For each wanted path the first layer that holds it, or the fallback.

    `names` are the layer names by rank. Layers are reduced to one row per path first, so the
    join cannot multiply rows.
    """
    best = layers.groupBy(path).agg(F.min(rank).alias("_rank"))
    labels = F.array(*[F.lit(n) for n in names])
    return look_up(wanted, best, [path], wanted.columns, "left").select(
        *wanted.columns,
        F.coalesce(F.get(labels, F.col("_rank")), F.lit(fallback)).alias("layer"),
    )


def checksum_verify(
    files: DataFrame,
    sidecars: DataFrame,
    key: str = "file",
    content: str = "content",
    recorded: str = "recorded_hash",
    skip: bool = False,
) -> DataFrame:
    """Compare the SHA-256 of each file with its recorded one: ok, mismatch or no_sidecar.

    The hash is taken before the join, so only digests are shuffled, never file contents.
    With `skip` no file is read and every status is `skipped`.
    """
    if skip:
        return files.select(key, F.lit("skipped").alias("status"))
    fresh = files.select(key, F.sha2(F.col(content).cast("binary"), 256).alias("_fresh"))
    known = sidecars.groupBy(key).agg(F.max(F.lower(F.col(recorded))).alias("_recorded"))
    status = (
        F.when(F.col("_recorded").isNull(), "no_sidecar")
        .when(F.col("_recorded") == F.col("_fresh"), "ok")
        .otherwise("mismatch")
    )
    return fresh.join(known, key, "left").select(key, status.alias("status"))
