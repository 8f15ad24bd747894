import hashlib
import zipfile

import pytest

from fleetwright.operators.archives import classify_dump_file
from fleetwright.sources import files, lines, snapshot
from fleetwright.sources.logtail import LogTailSource


def write(path, content):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(content if isinstance(content, bytes) else content.encode())


def test_manifests(spark, tmp_path):
    write(tmp_path / "one/crm/__manifest__.py", "{'name': 'CRM', 'depends': ['base', 'mail'],}")
    write(tmp_path / "one/bad/__manifest__.py", "{'depends': open('x')}")
    write(tmp_path / "one/none/__manifest__.py", "# note\n{'depends': None}")
    write(tmp_path / "one/deep/er/__manifest__.py", "{}")
    write(tmp_path / "two/crm/__manifest__.py", "{}")
    roots = [str(tmp_path / r) for r in ("one", "absent", "two")]
    got = files.scan_module_manifests(spark, roots)
    assert {(r["path_rank"], r["name"], tuple(r["depends"])) for r in got.collect()} == {
        (0, "crm", ("base", "mail")), (0, "bad", ()), (0, "none", ()), (2, "crm", ()),
    }
    assert {tuple(r) for r in files.manifest_edges(got).collect()} == {("crm", "base"), ("crm", "mail")}
    assert files.scan_module_manifests(spark, [str(tmp_path / "absent")]).count() == 0


def test_config_files(spark, tmp_path):
    write(tmp_path / "a.conf", "[options]\r\nx = 1\n\n y\n")
    write(tmp_path / "b.conf", "")
    got = lines.scan_config_files(spark, str(tmp_path)).orderBy("line_no").collect()
    assert [(r["line_no"], r["line"]) for r in got] == [(1, "[options]"), (2, "x = 1"), (3, ""), (4, " y")]
    named = {r["file_id"] for r in files.config_file_ids(spark, str(tmp_path)).collect()}
    assert named == {f"file:{tmp_path}/a.conf", f"file:{tmp_path}/b.conf"}
    assert {r["file_id"] for r in lines.scan_config_files(spark, str(tmp_path)).collect()} < named


def test_inventory(spark, tmp_path):
    write(tmp_path / "crm/models/a.py", "abcdef")
    write(tmp_path / "crm/__init__.py", "")
    write(tmp_path / "top.txt", "xy")
    got = files.scan_file_inventory(spark, str(tmp_path))
    rows = {(r["grp"], r["file_key"], r["size"], r["content_hash"]) for r in got.collect()}
    assert rows == {
        ("crm", "models/a.py", 6, hashlib.sha256(b"abcdef").hexdigest()),
        ("crm", "__init__.py", 0, hashlib.sha256(b"").hexdigest()),
        ("", "top.txt", 2, hashlib.sha256(b"xy").hexdigest()),
    }
    bare = files.scan_file_inventory(spark, str(tmp_path), hash_content=False)
    assert bare.where("content_hash IS NULL AND mtime > DATE'2020-01-01'").count() == 3


def test_dump_files(spark, tmp_path):
    write(tmp_path / "a.sql", "--")
    write(tmp_path / "b.sql.gz", b"\x1f\x8b\x08\x00")
    write(tmp_path / "c.sql.gz", "no")
    write(tmp_path / "d/toc.dat", "toc")
    write(tmp_path / "e.dump/data", "x")
    write(tmp_path / "f.txt", "x")
    write(tmp_path / "nozip.zip", "x")
    write(tmp_path / "broken.zip", b"PK\x03\x04 and no directory")
    write(tmp_path / "empty.sql.gz", b"")
    for name, member in [("good.zip", "dump.sql"), ("bad.zip", "other")]:
        with zipfile.ZipFile(tmp_path / name, "w") as archive:
            archive.writestr(member, "x")
    got = classify_dump_file(files.scan_dump_files(spark, str(tmp_path)))
    assert {r["path"]: (r["base"], r["ext"], r["valid"]) for r in got.collect()} == {
        "a.sql": ("a", ".sql", True), "b.sql.gz": ("b", ".sql.gz", True), "c.sql.gz": ("c", ".sql.gz", False),
        "d": ("d", ".dump", True), "e.dump": ("e", ".dump", False), "f.txt": (None, None, False),
        "broken.zip": ("broken", ".zip", True), "empty.sql.gz": ("empty", ".sql.gz", True),
        "nozip.zip": ("nozip", ".zip", True), "good.zip": ("good", ".zip", True), "bad.zip": ("bad", ".zip", False),
    }


def test_log_lines_over_splits(spark, tmp_path):
    body = "".join(f"line {i} é\n" for i in range(500)) + "not finished"
    write(tmp_path / "big.log", body)
    write(tmp_path / "done.log", "a\n\nb\r\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        got = lines.scan_log_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    big = sorted((r["byte_start"], r["line"]) for r in got if r["file"].endswith("big.log"))
    raw, want, at = body.encode(), [], 0
    for line in raw.split(b"\n")[:-1]:
        want.append((at, line.decode()))
        at += len(line) + 1
    assert big == want
    done = sorted((r["byte_start"], r["line"]) for r in got if r["file"].endswith("done.log"))
    assert done == [(0, "a"), (2, ""), (3, "b\r")]


@pytest.mark.parametrize("start", [0, 1, 3, 4, 5, 9, 100])
def test_tail_from_a_byte(spark, start):
    text = ["éa", "", "b€c"]
    rows = [("f", i, t, i // 2) for i, t in enumerate(text)]
    df = spark.createDataFrame(rows, "file string, line_no bigint, line string, _block bigint")
    got = lines.log_tail_from_offset(df, start).orderBy("byte_start").collect()
    raw = "".join(t + "\n" for t in text).encode()
    assert [r["line"] for r in got] == raw[start:].decode("utf-8", "replace").split("\n")[:-1]


def test_log_stream_follows_a_growing_file(spark, tmp_path):
    spark.dataSource.register(LogTailSource)
    log = tmp_path / "logs" / "a.log"
    rows = [f"row {i}" for i in range(300)]

    def run():
        stream = spark.readStream.format("log_tail").option("path", str(log.parent)).option("rangeBytes", "100").load()
        (
            stream.writeStream.format("parquet").option("path", str(tmp_path / "out"))
            .option("checkpointLocation", str(tmp_path / "marks")).trigger(availableNow=True).start()
            .awaitTermination()
        )
        return spark.read.parquet(str(tmp_path / "out")).orderBy("byte_start").collect()

    write(log, "\n".join(rows[:200]))
    assert [r["line"] for r in run()] == rows[:199]
    write(log, "\n".join(rows) + "\n")
    assert [r["line"] for r in run()] == rows


def test_snapshot_round_trip(spark, tmp_path):
    tables = {"a": spark.range(10), "b": spark.range(5).selectExpr("id", "CAST(id AS STRING) AS s")}
    folder = str(tmp_path / "snap")
    manifest = snapshot.export_snapshot(spark, tables, folder, parts=2)
    assert {(r["table"], r["rows"]) for r in manifest.collect()} == {("a", 10), ("b", 5)}
    for mode in ("refuse", "replace"):
        got = snapshot.import_snapshot(spark, folder, "restored", mode)
        assert {(r["table"], r["rows"], r["verified"]) for r in got.collect()} == {("a", 10, True), ("b", 5, True)}
    with pytest.raises(ValueError, match="exists"):
        snapshot.import_snapshot(spark, folder, "restored", "refuse")
    spark.range(3).write.mode("overwrite").parquet(f"{folder}/a")
    with pytest.raises(ValueError, match="differs from its manifest: a"):
        snapshot.import_snapshot(spark, folder, "restored", "replace")
    assert spark.table("restored.a").count() == 10
    spark.sql("DROP DATABASE restored CASCADE")
