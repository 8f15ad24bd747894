import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from fleetwright.functions.text import record_fingerprint, render_template, truthy_flag
from fleetwright.operators import admin, archives, runs, trees, waiting, web


def tree(spark, rows):
    return spark.createDataFrame(rows, "grp string, file_key string, content_hash string")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_tree_sync(spark):
    source = tree(spark, [("addon1", "f", "new"), ("addon2", "g", "x")])
    target = tree(spark, [("addon1", "f", "old"), ("addon1", "gone", "z"), ("mine", "h", "y")])
    diff = trees.snapshot_diff(source, target)
    assert rows(trees.group_change_rollup(diff)) == [
        ("addon1", "changed"), ("addon2", "added"), ("mine", "target_only"),
    ]
    synced = trees.upsert_groups(source, target)
    want = [("addon1", "f", "new"), ("addon2", "g", "x"), ("mine", "h", "y")]
    assert rows(synced) == want
    assert rows(trees.upsert_groups(source, synced)) == want
    merged = trees.overlay_merge(target, source)
    assert rows(merged) == [*want[:1], ("addon1", "gone", "z"), *want[1:]]


def test_one_missing_file_makes_trees_differ(spark):
    same = tree(spark, [("a", "f", "1")])
    assert rows(trees.group_change_rollup(trees.snapshot_diff(same, same))) == [("a", "same")]
    more = tree(spark, [("a", "f", "1"), ("a", "file1", None)])
    assert rows(trees.group_change_rollup(trees.snapshot_diff(more, same))) == [("a", "changed")]
    assert rows(trees.group_change_rollup(trees.snapshot_diff(more, more))) == [("a", "same")]


def test_upsert_on_disk(spark, tmp_path):
    path = str(tmp_path / "tree")
    start = tree(spark, [("a", "f", "old"), ("b", "g", "1"), ("keep", "k", "1")])
    start.write.partitionBy("grp").parquet(path)
    source = tree(spark, [("a", "f", "new"), ("b", "g", "1"), ("c", "h", "2")])
    target = spark.read.parquet(path).select("grp", "file_key", "content_hash")
    want = rows(trees.upsert_groups(source, target))
    trees.write_upsert(source, target, path)
    stored = spark.read.parquet(path).select("grp", "file_key", "content_hash")
    assert rows(stored) == want == [("a", "f", "new"), ("b", "g", "1"), ("c", "h", "2"), ("keep", "k", "1")]


def test_checksum_can_be_skipped(spark):
    files = spark.createDataFrame([("a", "text")], "file string, content string")
    assert rows(trees.checksum_verify(files, files.limit(0), skip=True)) == [("a", "skipped")]


def test_hygiene(spark):
    paths = [".gitignore", "a/.git/x", ".git/x", "a/.github/w", "b/c.py", "a.git/b", "x/.hidden"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    assert {r[0] for r in trees.path_hygiene_filter(df).collect()} == {"a/.github/w", "b/c.py", "a.git/b"}


def test_archive_names(spark):
    files = ["/b/my_db_17_2024.tar.gz", "a_b.tar.gz", "db_17_.tar.gz", "_16_x.tar.gz", "d_18_9.tar.gz", "plain"]
    df = spark.createDataFrame([(f,) for f in files], "filename string")
    got = {r["filename"]: (r["db"], r["version"], r["stamp"], r["valid"]) for r in archives.parse_archive_name(df).collect()}
    none = (None, None, None, False)
    assert [got[f] for f in files] == [
        ("my_db", "17", "2024", True), none, none, ("", "16", "x", True), ("d", "18", "9", True), none,
    ]
    named = spark.createDataFrame([("d", "18.0", datetime(2024, 5, 6, 7, 8, 9))], "d string, v string, t timestamp")
    assert named.select(archives.archive_name("d", "v", "t")).first()[0] == "d_18_20240506070809.tar.gz"


def test_latest_archive_breaks_ties_by_name(spark):
    files = [("db_17_1.tar.gz", 5), ("db_17_2.tar.gz", 5), ("db_17_9.tar.gz", 4), ("x_17_1.tar.gz", 9)]
    df = spark.createDataFrame(files, "filename string, mtime_s bigint")
    assert [r["filename"] for r in archives.latest_archive(df, "17", "db").collect()] == ["db_17_2.tar.gz"]
    assert archives.latest_archive(df, "17", by_db=False).first()["filename"] == "x_17_1.tar.gz"


def test_refresh_gate(spark):
    cases = [
        ("", "5", "build_missing"), (None, "5", "build_missing"), ("1a", None, "build_invalid"),
        ("5", None, "record_missing"), ("5", "", "record_invalid"), ("10", "9", "record_older"),
        ("9", "10", "up_to_date"), ("007", "7", "up_to_date"), ("1" + "0" * 40, "9" * 40, "record_older"),
    ]
    df = spark.createDataFrame([(b, r) for b, r, _ in cases], "build_stamp string, recorded_stamp string")
    got = {(r["build_stamp"], r["recorded_stamp"]): r["reason"] for r in runs.refresh_gate(df).collect()}
    assert got == {(b, r): want for b, r, want in cases}


def test_runs(spark):
    rows_in = [(1, "a", 1, True), (1, "b", 1, False), (1, "b", 2, False), (1, "b", 3, False), (1, "b", 4, True)]
    rows_in += [(1, "c", 1, False), (1, "c", 2, True), (2, "a", 1, False), (3, "a", 1, True)]
    df = spark.createDataFrame(rows_in, "run_id int, module string, attempt bigint, ok boolean")
    outcomes = runs.retry_outcome(df)
    assert ("b", False, 3) in {(r["module"], r["ok"], r["attempts_used"]) for r in outcomes.collect()}
    got = {r["run_id"]: (r["verdict"], r["failed"], r["stamp"]) for r in runs.run_verdict(outcomes).collect()}
    assert got == {1: ("partial", "b", True), 2: ("fatal", "a", False), 3: ("success", "", True)}


def wait_by_hand(start, seen, pause, checks):
    for k in range(checks):
        at = start + k * pause
        up = [u for t, u in sorted(seen) if t <= at]
        if up and up[-1]:
            return k + 1
    return None


def as_times(spark, waiters, seen):
    at = lambda s: datetime(2024, 1, 1) + timedelta(seconds=s)
    w = spark.createDataFrame([(i, t, at(s)) for i, t, s in waiters], "waiter_id int, target string, ts timestamp_ntz")
    o = spark.createDataFrame([(t, at(s), u) for t, s, u in seen], "target string, ts timestamp_ntz, up boolean")
    return w, o


def test_wait_succeeds_after_two_pauses_or_times_out(spark):
    w, o = as_times(spark, [(1, "a", 0), (2, "b", 0)], [("a", -9, False), ("a", 10, True), ("b", 0, False)])
    got = {r["waiter_id"]: (r["attempts"], r["outcome"]) for r in waiting.wait_until_ready(w, o, 5, 3).collect()}
    assert got == {1: (3, "ready"), 2: (3, "timeout")}


@pytest.mark.parametrize("seed", [1, 2])
def test_wait_equals_polling(spark, seed):
    rng = random.Random(seed)
    seen = sorted({(rng.choice("aaab"), s) for s in rng.sample(range(3000), 260)})
    seen = [(t, s, rng.random() < 0.35) for t, s in seen]
    waiters = [(i, rng.choice("aabc"), rng.randrange(3000)) for i in range(150)]
    w, o = as_times(spark, waiters, seen)
    got = {
        r["waiter_id"]: (r["attempts"], r["outcome"])
        for r in waiting.wait_until_ready(w, o, 7, 6, bucket_rows=40, ranges=5).collect()
    }
    for i, target, start in waiters:
        k = wait_by_hand(start, [(s, u) for t, s, u in seen if t == target], 7, 6)
        assert got[i] == ((k, "ready") if k else (6, "timeout")), (i, target, start)


def test_wait_sends_no_starts_to_all_tasks(spark):
    """What was found grows with the waiters and lies in a small file; it is shuffled, never broadcast."""
    w, o = as_times(spark, [(i, "a", i) for i in range(40)], [("a", 10, True)])
    plan = waiting.wait_until_ready(w, o, 5, 3)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_lifecycle(spark):
    at = lambda s: datetime(2024, 1, 1) + timedelta(seconds=s)
    states = ["init", "new", "pending", "progress", "done"]
    events = [(i, 1, at(i * 4000), s) for i, s in enumerate(states)]
    events += [(10, 2, at(0), "progress"), (11, 2, at(1), "new"), (12, 3, at(0), "odd")]
    df = spark.createDataFrame(events, "event_id int, request_id int, ts timestamp_ntz, state string")
    got = {r["event_id"]: r["valid"] for r in runs.lifecycle_audit(df).collect()}
    assert got == {0: True, 1: True, 2: True, 3: True, 4: True, 10: True, 11: False, 12: False}
    last = {r["request_id"]: (r["state"], r["terminal"]) for r in runs.request_state(df).collect()}
    assert last == {1: ("done", True), 2: ("new", False), 3: ("odd", False)}


def test_requests(spark):
    cases = {
        "/web/static/x.cgi": "attack_extension", "/a.php?x=1": "attack_extension", "/q?x=.php": "app",
        "/x/WP-login.php/y": "attack_path", "/.well-known/a": "well_known", "/m/static/a.js": "static",
        "/static/a.js": "app", "/web/filestore/a": "internal", "/web/filestore/static/a": "internal",
    }
    df = spark.createDataFrame([(p,) for p in cases], "path string")
    got = {r["path"]: r["class"] for r in web.classify_request(df).collect()}
    assert got == cases


def test_links(spark):
    body = "HTTP://Shop.example/a http://shop.example http://other.example https://shop.example"
    data = [("text/html; charset=utf-8", body, "Shop.example"), ("image/png", body, "shop.example"), ("text/css", body, None)]
    df = spark.createDataFrame(data, "content_type string, body string, host string")
    got = [r["body"] for r in web.rewrite_insecure_links(df).collect()]
    assert got[0] == "https://shop.example/a https://shop.example http://other.example https://shop.example"
    assert got[1:] == [body, body]


def test_probes(spark):
    data = [
        (1, 1, "https://h", 200, "application/json", '{"status": "pass"}', "healthy"),
        (2, 1, "https://h", 503, "application/json", '{"status": "pass"}', "error"),
        (3, 2, "http://h", 200, "text/html", "", "not_json"),
        (4, 3, "http://h", 200, "application/json", "[1]", "error"),
        (5, 4, "http://h", 200, "application/json", '{"status": "warn"}', "not_pass"),
        (6, 5, "wss://h", 101, None, None, "healthy"),
        (7, 6, "ftp://h", 200, None, None, None),
        (8, 7, "http://h", 200, "application/json", '{"status": "pass"', "error"),
    ]
    df = spark.createDataFrame(
        data, "event_id int, check_id int, url string, http_status int, content_type string, body string, want string"
    )
    probed = web.classify_health_probe(df)
    assert probed.where("NOT verdict <=> want").count() == 0
    got = {r["check_id"]: r["overall"] for r in web.health_rollup(probed).collect()}
    assert got == {1: "fail", 2: "fail", 3: "fail", 4: "fail", 5: "pass", 6: "error", 7: "fail"}


def test_rpc(spark):
    data = [
        ("application/json", '{"result": {"error": null}}', "error", None),
        ("application/json", '{"result": [1]}', "result", None),
        ("application/json", '{"error": {"data": {"message": ""}}}', "error", f"Error: {web.BAD_RESPONSE}"),
        ("application/json", "{oops", "invalid", None),
        ("text/plain", "x", "empty", None),
        ("text/html", "<p>", "html", None),
    ]
    df = spark.createDataFrame(data, "content_type string, body string, want string, said string")
    got = web.rpc_response_extract(df)
    assert got.where("NOT outcome <=> want OR NOT message <=> said").count() == 0


def test_settings_of_a_site(spark):
    configs = spark.createDataFrame([(1, 1, True), (2, 1, False), (3, 2, True), (4, 9, None)], "c int, website_id int, enabled boolean")
    sites = spark.createDataFrame([(1, "GTM-1"), (2, "")], "website_id int, container_key string")
    got = {r["c"]: (r["key"], r["has_key"], r["new_key"], r["valid"]) for r in web.related_setting_join(configs, sites).collect()}
    assert got == {
        1: ("GTM-1", True, "GTM-1", True), 2: ("GTM-1", True, None, True),
        3: ("", False, "", False), 4: ("", False, None, True),
    }


def test_missing_requirements_blank_counts(spark):
    records = spark.createDataFrame([(1,), (2,)], "record_id int")
    present = spark.createDataFrame([(1, "host", "h"), (1, "user", ""), (1, "other", "x")], "record_id int, field string, v string")
    got = admin.missing_requirements(records, present, ["user", "host"], value="v")
    assert {r["record_id"]: r["missing"] for r in got.collect()} == {1: ["user"], 2: ["user", "host"]}


def test_assets(spark):
    data = [(1, "ir.ui.view", "web.assets_a"), (2, "ir.ui.view", "assets"), (3, None, "web.assetsX"), (4, "ir.ui.view", None)]
    df = spark.createDataFrame(data, "id int, res_model string, name string")
    assert {r["id"] for r in admin.delete_by_subquery(df, admin.asset_rows()).collect()} == {2, 3, 4}


def test_text_rules(spark):
    flags = spark.createDataFrame([("TRUE",), (" No ",), (None,), ("",), ("yes",)], "f string")
    rules = {"any_true": [1, 0, 0, 0, 1], "only_true": [1, 0, 0, 0, 0], "not_off": [1, 0, 1, 1, 1], "non_blank": [1, 1, 0, 0, 1]}
    for rule, want in rules.items():
        assert [int(r[0]) for r in flags.select(truthy_flag("f", rule)).collect()] == want, rule
    row = spark.createDataFrame([("a&b\\1$", None)], "host string, port string")
    text = row.select(render_template("{{H}}:{{P}} {{H}} {{X}}", {"H": "host", "P": "port"})).first()[0]
    assert text == "a&b\\1$: a&b\\1$ {{X}}"
    import hashlib

    want = "dump_" + hashlib.sha256(b"a&b\\1$\x1e7\x1e").hexdigest()
    assert row.select(record_fingerprint("host", F.lit(7))).first()[0] == want
