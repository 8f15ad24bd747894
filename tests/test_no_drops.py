"""Nothing is dropped silently: hidden files, null lock names, moved nulls, line ends."""

from datetime import datetime

from fleetwright.operators import runs, waiting
from fleetwright.sources.files import config_file_ids
from fleetwright.sources.lines import scan_config_files, scan_log_lines
from fleetwright.sources.snapshot import table_checksum
from fleetwright.streaming.lease import lease_state
from fleetwright.operators.runs import run_verdict


def test_hidden_files(spark, tmp_path):
    (tmp_path / ".d").mkdir()
    for name in (".a.conf", "_b.conf", "c.conf", ".d/e f.conf"):
        (tmp_path / name).write_bytes(b"[options]\r\nx = 1\ny = 2\n")
    lines = scan_config_files(spark, str(tmp_path))
    got = {}
    for r in lines.orderBy("file_id", "line_no").collect():
        got.setdefault(r["file_id"], []).append((r["line_no"], r["line"]))
    assert len(got) == 4 and all(v == [(1, "[options]"), (2, "x = 1"), (3, "y = 2")] for v in got.values())
    assert set(got) == {r["file_id"] for r in config_file_ids(spark, str(tmp_path)).collect()}
    logs = scan_log_lines(spark, str(tmp_path)).collect()
    assert len(logs) == 12 and {r["byte_start"] for r in logs} == {0, 11, 17}


def test_null_locks(spark):
    at = datetime(2024, 1, 1)
    df = spark.createDataFrame(
        [(1, "a", "acquire", at), (2, None, "acquire", at)], "event_id int, lock_name string, op string, ts timestamp_ntz"
    )
    got = {r["event_id"]: (r["granted"], r["expires_at"] is None) for r in lease_state(df).collect()}
    assert got == {1: (True, False), 2: (False, True)}


def test_moved_nulls(spark):
    one = spark.createDataFrame([("x", None)], "a string, b string")
    two = spark.createDataFrame([(None, "x")], "a string, b string")
    assert table_checksum(one, "t").first() != table_checksum(two, "t").first()


def test_stamps_with_line_ends(spark):
    df = spark.createDataFrame([("1000\n", "999\n"), ("9", "10\n\n"), ("9", "1\n0")], "build_stamp string, recorded_stamp string")
    assert [r["reason"] for r in runs.refresh_gate(df).collect()] == ["record_older", "up_to_date", "record_invalid"]


def test_closed_requests_stay_closed(spark):
    at = lambda s: datetime(2024, 1, 1, 0, 0, s)
    df = spark.createDataFrame(
        [(1, 1, at(1), "done"), (2, 1, at(2), "new"), (3, 2, at(1), "new")],
        "event_id int, request_id int, ts timestamp_ntz, state string",
    )
    got = {r["request_id"]: (r["state"], r["since"], r["terminal"]) for r in runs.request_state(df).collect()}
    assert got == {1: ("done", at(1), True), 2: ("new", at(1), False)}


def test_many_checks(spark):
    at = lambda s: datetime(2024, 1, 1, s // 3600, s // 60 % 60, s % 60)
    states = [("a", at(0), False), ("a", at(7), True), ("a", at(9), False), ("a", at(20), True), ("a", at(21), False), ("a", at(5400), True)]
    o = spark.createDataFrame(states, "target string, ts timestamp_ntz, up boolean")
    w = spark.createDataFrame([(1, "a", at(0)), (2, None, at(0)), (3, "b", at(0))], "waiter_id int, target string, ts timestamp_ntz")
    got = {r["waiter_id"]: (r["attempts"], r["outcome"]) for r in waiting.wait_until_ready(w, o, 5, 1090).collect()}
    # Checks at 20 s meet the second span.
    assert got == {1: (5, "ready"), 2: (1090, "timeout"), 3: (1090, "timeout")}
    got = {r["waiter_id"]: r["attempts"] for r in waiting.wait_until_ready(w.where("waiter_id = 1"), o, 6, 1090).collect()}
    assert got == {1: 901}


def test_failed_names_of_one_prefix(spark):
    """Names with one prefix fall into several ranges; their order and chunks stay exact."""
    names = [f"l10n_{i:04d}" for i in range(400)]
    rows = [(r, n, r == 2 and n > "l10n_0003") for r in (1, 2) for n in names]
    outcomes = spark.createDataFrame(rows, "run_id int, module string, ok boolean")
    got = {(r["run_id"], r["chunk_no"]): r for r in run_verdict(outcomes, chunk=150).collect()}
    assert {k: v["failed"] for k, v in got.items()} == {
        (1, 0): ",".join(names[:150]), (1, 1): ",".join(names[150:300]), (1, 2): ",".join(names[300:]),
        (2, 0): ",".join(names[:4]),
    }
    assert {k: v["verdict"] for k, v in got.items()} == {(1, 0): "fatal", (1, 1): "fatal", (1, 2): "fatal", (2, 0): "partial"}
