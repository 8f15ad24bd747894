"""Config tables against the rules applied line by line, and small literal cases."""

import random
import re

import pytest
from pyspark.sql import functions as F

from fleetwright.operators import config


def lines(spark, *files):
    rows = [(f, i + 1, t) for f, text in enumerate(files) for i, t in enumerate(text)]
    return spark.createDataFrame(rows, "file_id int, line_no bigint, line string")


def ids(spark, n):
    return spark.range(n).select(F.col("id").cast("int").alias("file_id"))


def texts(df, n=1):
    out = [[] for _ in range(n)]
    for r in df.orderBy("file_id", "line_no").collect():
        out[r["file_id"]].append(r["line"])
        assert r["line_no"] == len(out[r["file_id"]])
    return out


COMMENTED = r"\s*[;#]\s*{}\s*="


def sections(text):
    """The text as [header, lines below it]; what stands above all headers has header None."""
    parts = [[None, []]]
    for t in text:
        if t.strip().startswith("["):
            parts.append([t, []])
        else:
            parts[-1][1].append(t)
    return parts


def joined(parts):
    return [t for header, body in parts for t in ([] if header is None else [header]) + body]


def option(t):
    """(key, value) of an option line, else None."""
    found = re.fullmatch(r"(?!\s*[;#])([^=]*)=(.*)", t)
    return found and (found[1].strip(), found[2].strip())


def without_comments(parts, keys):
    patterns = [COMMENTED.format(re.escape(k)) for k in keys]
    return [[h, [t for t in body if not any(re.match(p, t) for p in patterns)]] for h, body in parts]


def set_by_hand(text, section, pairs):
    """Expected text after setting the pairs, by rewriting a list of sections."""
    parts = without_comments(sections(text), [k for k, _ in pairs])
    mine = [p for p in parts if p[0] is not None and p[0].strip().strip("[]").lower() == section.lower()]
    if not mine:
        mine = [[f"[{section}]", []]]
        parts.append(mine[0])
    for key, value in pairs:
        hit = {id(p): [i for i, t in enumerate(p[1]) if (option(t) or [None])[0] == key] for p in mine}
        for p in mine:
            for i in hit[id(p)]:
                p[1][i] = f"{key} = {value}"
        if not any(hit.values()):
            mine[0][1].append(f"{key} = {value}")
    return joined(parts)


def defaults_by_hand(text, defaults):
    """(expected text, changed) after applying the defaults, by rewriting a list of sections."""
    parts = without_comments(sections(text), defaults)
    mine = [p for p in parts if p[0] is not None and p[0].strip().lower() == "[options]"]
    have = {option(t)[0]: None for p in mine for t in p[1] if option(t)}
    wrong = 0
    for p in mine:
        fixed = [
            f"{option(t)[0]} = {defaults[option(t)[0]]}"
            if option(t) and defaults.get(option(t)[0], option(t)[1]) != option(t)[1]
            else t
            for t in p[1]
        ]
        wrong += fixed != p[1]
        p[1] = fixed
    absent = [f"{k} = {v}" for k, v in defaults.items() if k not in have]
    if not mine:
        parts[0] = ["[options]", parts[0][1] + absent]
    elif parts[-1] is not mine[-1]:
        absent = []
    else:
        mine[0][1] += absent
    return (joined(parts), True) if wrong or absent else (text, False)


POOL = [
    "[options]", " [Options] ", "[[options]]", "[other]", "[queue]", "a = 1", "a=2", " b = x=y ", "; a = old",
    "#b=old", "  # a = z", "c", "", "   ", "; c", "d.e = 5", "a =", "= 3", "ab = 1", "#ab = 2",
]


def random_files(seed, n):
    rng = random.Random(seed)
    return [[rng.choice(POOL) for _ in range(rng.randrange(1, 14))] for _ in range(n)]


def test_set_equals_line_by_line(spark):
    files = random_files(1, 80)
    for section, pairs in [("options", [("a", "9")]), ("Queue", [("d.e", "7"), ("new", "n")])]:
        got = texts(config.config_set(lines(spark, *files), section, pairs, block_rows=3), len(files))
        assert got == [set_by_hand(f, section, pairs) for f in files]


def test_defaults_equal_line_by_line(spark):
    files = random_files(2, 120)
    wanted = {"a": "1", "b": "x=y", "new": "n"}
    out, report = config.config_apply_defaults(lines(spark, *files), wanted, block_rows=3)
    want = [defaults_by_hand(f, wanted) for f in files]
    assert texts(out, len(files)) == [w[0] for w in want]
    changed = {r["file_id"]: r["changed"] for r in report.collect()}
    assert [changed[i] for i in range(len(files))] == [w[1] for w in want]


def test_get_after_set_and_not_found(spark):
    src = lines(spark, ["[options]", "key = old_value"], ["[Options]", "other = 1"])
    done = config.config_set(src, "options", {"key": "new"})
    got = config.config_get(config.config_parse(done), "OPTIONS", "key")
    assert {r["file_id"]: r["value"] for r in got.collect()} == {0: "new", 1: "new"}
    assert config.config_get(config.config_parse(src), "options", "Key").count() == 0


def test_set_in_empty_file_and_null_values(spark):
    empty = lines(spark)
    got = config.config_set(empty, "options", {"key": "v"}, files=ids(spark, 1))
    assert texts(got) == [["[options]", "key = v"]]
    cache = {f"cache_{i}": str(i) for i in range(6)} | {"cache_ca": None}
    got = config.config_set(lines(spark, ["[options]"]), "options", cache)
    assert texts(got) == [["[options]"] + [f"cache_{i} = {i}" for i in range(6)]]


def test_drop_commented(spark):
    src = ["[options]", "; key = old_value", "# another_key = another_value", "key = value", "normal_line"]
    got = config.config_drop_commented(lines(spark, src), "key")
    assert [r["line"] for r in got.orderBy("line_no").collect()] == [src[0]] + src[2:]


def test_defaults_remove_the_comment_and_add(spark):
    src = lines(spark, ["[options]", "existing_key = existing_value", "; paths = /old/path"])
    out, report = config.config_apply_defaults(src, {"paths": "/new"})
    assert texts(out) == [["[options]", "existing_key = existing_value", "paths = /new"]]
    assert report.first()["changed"]


def test_defaults_keep_comments_where_nothing_changes(spark):
    src = ["[options]", "; a = old", "a = 1"]
    out, report = config.config_apply_defaults(lines(spark, src), {"a": "1"})
    assert texts(out) == [src]
    assert not report.first()["changed"]


def test_defaults_do_not_add_when_another_section_is_last(spark):
    src = ["[options]", "a = 0", "[queue]", "x = 1"]
    out, _ = config.config_apply_defaults(lines(spark, src), {"a": "1", "b": "2"})
    assert texts(out) == [["[options]", "a = 1", "[queue]", "x = 1"]]


def test_render_and_header(spark):
    src = lines(spark, ["[other_section]", "k = v"], ["[options]", "k = v"])
    got = {(r["file_id"], r["chunk_no"]): r["text"] for r in config.config_render(src, ids(spark, 3)).collect()}
    assert got == {
        (0, 0): "[options]\n[other_section]\nk = v\n",
        (1, 0): "[options]\nk = v\n",
        (2, 0): "[options]\n",
    }
    parts = config.config_render(src, chunk_lines=1).orderBy("file_id", "chunk_no").collect()
    assert "".join(p["text"] for p in parts if p["file_id"] == 0) == got[(0, 0)]


def test_parse_in_blocks_equals_one_block(spark):
    src = lines(spark, *random_files(3, 20))
    a = config.config_parse(src, block_rows=2).orderBy("file_id", "line_no").collect()
    b = config.config_parse(src).orderBy("file_id", "line_no").collect()
    assert a == b


def test_options_are_validated(spark):
    src = lines(spark, ["# note", " # note", "A=1", " B_2=x ", "C=", "D-E=1", "", "   ", "F=1=2", "é=1"])
    good, bad = config.validate_options(src)
    assert {(r["var"], r["val"]) for r in good.collect()} == {("A", "1"), ("B_2", "x"), ("é", "1")}
    assert {r["line"] for r in bad.collect()} == {"# note", "C=", "D-E=1", "", "F=1=2"}


@pytest.mark.parametrize(
    ("option", "want"), [("--test", True), ("--workers", True), ("--missing", False), ("--work", False)]
)
def test_option_present(spark, option, want):
    args = spark.createDataFrame([(["--test", "--workers=5"],)], "args array<string>")
    assert args.select(config.option_present("args", option)).first()[0] is want


def test_layers(spark):
    rows = [
        ("h", "port", 0, ""), ("h", "port", 1, "6432"), ("h", "port", 2, "5432"),
        ("h", "mode", 0, None), ("h", "mode", 2, "disable"), ("h", "flag", 0, ""),
    ]
    df = spark.createDataFrame(rows, "host_id string, name string, layer_rank int, value string")

    def read(out):
        return {r["name"]: (r["value"], r["layer"], r["conflict"]) for r in out.collect()}

    assert read(config.layered_settings(df)) == {
        "port": ("6432", 1, True), "mode": ("disable", 2, False), "flag": (None, None, False),
    }
    assert read(config.layered_settings(df, presence_ranks=[0])) == {
        "port": ("", 0, True), "mode": ("disable", 2, False), "flag": ("", 0, False),
    }
