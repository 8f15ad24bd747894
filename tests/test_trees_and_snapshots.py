"""Trees with folders, digests, walks in rounds, snapshots that are hashed while written."""

import os
import random

import pytest

from fleetwright.operators import trees
from fleetwright.sources import files, snapshot


def tree(spark, rows):
    return spark.createDataFrame(rows, "grp string, file_key string, content_hash string")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def random_tree(rng, n):
    """Paths in which no file is also a folder."""
    out = {}
    for _ in range(n):
        path = "/".join(rng.choice("abc") for _ in range(rng.randint(1, 4)))
        if not any(p.startswith(path + "/") or path.startswith(p + "/") for p in out):
            out[path] = rng.choice("12")
    return out


def test_file_against_folder(spark):
    source = tree(spark, [("g", "a", "1"), ("g", "x/y", "1"), ("g", "same", "1")])
    target = tree(spark, [("g", "a/b/c", "1"), ("g", "x", "1"), ("g", "same", "1"), ("h", "a", "1")])
    assert rows(trees.snapshot_diff(source, target)) == [
        ("g", "a", "changed"), ("g", "a/b/c", "changed"), ("g", "same", "same"), ("g", "x", "changed"),
        ("g", "x/y", "changed"), ("h", "a", "target_only"),
    ]
    merged = trees.overlay_merge(base=target, new=source)
    assert rows(merged) == [("g", "a", "1"), ("g", "same", "1"), ("g", "x/y", "1"), ("h", "a", "1")]


@pytest.mark.parametrize("seed", [1, 2])
def test_random_trees(spark, seed):
    rng = random.Random(seed)
    left = {g: random_tree(rng, 12) for g in "pqrst"}
    right = {g: dict(t) for g, t in left.items() if g != "p"} | {"u": random_tree(rng, 5)}
    right["q"] = random_tree(rng, 12)
    right["r"] = {p: "3" if i == 0 else h for i, (p, h) in enumerate(right["r"].items())}
    flat = lambda side: [(g, p, h) for g, t in side.items() for p, h in t.items()]
    source, target = tree(spark, flat(left)), tree(spark, flat(right))
    diff = trees.snapshot_diff(source, target)
    assert rows(trees.tree_changes(source, target)) == rows(diff.where("status <> 'same'"))
    assert rows(trees.group_actions(source, target)) == rows(trees.group_change_rollup(diff))

    def under(side, g, folder):
        return {p: h for p, h in side.get(g, {}).items() if not folder or p.startswith(folder + "/")}

    folders = {(g, "/".join(p.split("/")[:i])) for side in (left, right) for g, t in side.items() for p in t for i in range(len(p.split("/")))}
    want = set()
    for g, f in folders:
        a, b = under(left, g, f), under(right, g, f)
        if a != b:
            want.add((g, f, "source_only" if not b else "target_only" if not a else "changed"))
    got = trees.differing_folders(trees.tree_digests(source), trees.tree_digests(target))
    assert set(map(tuple, got.collect())) == want
    merged = {(g, p) for g, p, _ in rows(trees.overlay_merge(base=target, new=source))}
    assert not any((g, "/".join(p.split("/")[:i])) in merged for g, p in merged for i in range(1, len(p.split("/"))))
    assert {(g, p) for g, t in left.items() for p in t} <= merged


def test_groups_without_files(spark):
    source, target = tree(spark, [("a", "f", "1")]), tree(spark, [("b", "f", "1")])
    listed = lambda *names: spark.createDataFrame([(n,) for n in names], "grp string")
    got = trees.group_actions(source, target, listed("a", "b", "c", "d"), listed("b", "d", "e"))
    assert rows(got) == [("a", "added"), ("b", "changed"), ("c", "added"), ("d", "same"), ("e", "target_only")]


def test_walk_in_rounds(spark, tmp_path):
    rng = random.Random(3)
    want = set()
    for i in range(60):
        folder = "top/" + "/".join(rng.choice("xyz") for _ in range(rng.randint(0, 5)))
        os.makedirs(tmp_path / folder, exist_ok=True)
        (tmp_path / folder / f"_f{i}").write_text("1")
        want.add(os.path.normpath(f"{folder}/_f{i}"))
    (tmp_path / "plain").write_text("")
    os.makedirs(tmp_path / "empty" / "inner")
    found = files.walk_tree(spark, str(tmp_path), tasks=3, share=2).collect()
    paths = [r["path"].removeprefix(f"file:{tmp_path}/") for r in found if not r["is_dir"]]
    assert sorted(paths) == sorted(want | {"plain"})
    listed = {(r["grp"], r["file_key"]) for r in files.list_tree(spark, str(tmp_path)).collect()}
    assert listed == {("top", p.removeprefix("top/")) for p in want} | {("", "plain")}
    assert {r["grp"] for r in files.list_groups(spark, str(tmp_path)).collect()} == {"top", "empty"}


def test_snapshot_of_an_empty_table(spark, tmp_path):
    tables = {"none": spark.range(5).where("id > 9"), "empty": spark.range(0), "some": spark.range(3)}
    folder = str(tmp_path / "snap")
    manifest = snapshot.export_snapshot(spark, tables, folder)
    assert {(r["table"], r["rows"]) for r in manifest.collect()} == {("none", 0), ("empty", 0), ("some", 3)}
    got = snapshot.import_snapshot(spark, folder, "empties", "refuse", location=str(tmp_path / "db"))
    assert all(r["verified"] for r in got.collect()) and spark.table("empties.some").count() == 3
    spark.sql("DROP DATABASE empties CASCADE")


def test_a_damaged_part_fails_by_its_name(spark, tmp_path):
    folder = tmp_path / "snap"
    snapshot.export_snapshot(spark, {"a": spark.range(100_000)}, str(folder), parts=2)
    part = sorted((folder / "a").glob("part-*"))[0]
    data = bytearray(part.read_bytes())
    data[len(data) // 2] ^= 0xFF
    part.write_bytes(bytes(data))
    (folder / "a" / f".{part.name}.crc").unlink(missing_ok=True)
    with pytest.raises(Exception, match=part.name):
        snapshot.import_snapshot(spark, str(folder), "damaged", "replace", location=str(tmp_path / "db"))
    assert not spark.catalog.databaseExists("damaged")
