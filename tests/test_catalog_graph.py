import random

import pytest
from pyspark.sql import functions as F

from fleetwright.operators import catalog, graph


def names(spark, *items):
    return spark.createDataFrame([(n,) for n in items], "name string")


def test_blocklist(spark):
    df = names(spark, "sale_extra", "crm", "my_test")
    kept = [r["name"] for r in catalog.blocklist_filter(df, "name", "^sale_.*").collect()]
    assert kept == ["crm", "my_test"]
    assert catalog.blocklist_filter(df, "name", "*_test").count() == 2
    assert catalog.blocklist_filter(df, "name", r"(s).*\1").count() == 3
    assert catalog.blocklist_filter(df, "name", None).count() == 3
    assert catalog.blocklist_patterns("a,b c,d\nignored") == ["a", "b", "c", "d"]


def test_first_hit_per_name(spark):
    rows = [(0, 1, "sale_management"), (1, 1, "sale_management"), (0, 2, "crm"), (1, 2, "web"), (0, 9, "web")]
    df = spark.createDataFrame(rows, "path_rank int, seq bigint, name string")
    kept = catalog.blocklist_filter(df, "name", "^sale_.*")
    got = catalog.first_wins_dedup(kept).orderBy("ord").collect()
    assert [(r["name"], r["path_rank"], r["ord"]) for r in got] == [("crm", 0, 1), ("web", 0, 2)]


def test_optional_root_counts_only_with_modules(spark):
    roots = [names(spark, "a"), names(spark, "b")]
    assert catalog.search_roots(*roots, optional=names(spark)).count() == 2
    both = catalog.search_roots(*roots, optional=names(spark, "c"))
    assert {(r["name"], r["path_rank"]) for r in both.collect()} == {("a", 0), ("b", 1), ("c", 2)}


def test_locale_filter(spark):
    lists = spark.createDataFrame([(1, "en_AU,en_US"), (2, "fr,zh_Hant_TW,en_AU,de_AU"), (3, "")], "id int, l string")
    codes = {}
    for r in catalog.locale_codes(lists, "id", "l").orderBy("id", "ord").collect():
        codes.setdefault(r["id"], []).append(r["code"])
    assert codes == {1: ["au", "us"], 2: ["hant_tw", "au"], 3: ["au", "ca", "in", "nz", "uk", "us"]}
    df = names(spark, "l10n_au", "l10n_de", "base", "l10n_generic", "x_l10n_us_y")
    kept = {r["name"] for r in catalog.locale_module_filter(df, "name", codes[1]).collect()}
    assert kept == {"l10n_au", "base", "x_l10n_us_y"}


def test_mandatory_names_go_last(spark):
    df = spark.createDataFrame([("crm", 1), ("base", 2)], "name string, ord bigint")
    got = catalog.mandatory_append(df, ["web", "base"]).orderBy("ord").collect()
    assert [(r["name"], r["ord"]) for r in got] == [("crm", 1), ("base", 2), ("web", 3)]
    got = catalog.mandatory_append(df.limit(0), ["web", "base"]).orderBy("ord").collect()
    assert [r["name"] for r in got] == ["web", "base"]


def test_list_in_chunks(spark):
    df = spark.range(25).select((24 - F.col("id")).alias("n"), F.concat(F.lit("m"), "id").alias("name"))
    got = catalog.ordered_list_agg(df, "name", ["n"], F.floor(F.col("n") / 4).cast("bigint"), chunk=10)
    parts = [r["names"] for r in got.orderBy("chunk_no").collect()]
    assert [p.count(",") + 1 for p in parts] == [10, 10, 5]
    assert ",".join(parts) == ",".join(f"m{i}" for i in range(24, -1, -1))


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "module string, dep string")


def modules(spark, items):
    return spark.createDataFrame([(m, i) for i, m in enumerate(items)], "module string, seq bigint")


def order(df):
    return {r["module"]: (r["level"], r["ord"]) for r in df.collect()}


def test_dependencies_come_first(spark):
    got = order(graph.dependency_order(modules(spark, "cab"), edges(spark, [("a", "b"), ("c", "a"), ("c", "no")])))
    assert got == {"b": (0, 1), "a": (1, 2), "c": (2, 3)}


def test_without_edges(spark):
    got = order(graph.dependency_order(modules(spark, "ba"), edges(spark, [("z", "y"), ("a", "a")])))
    assert got == {"b": (0, 1), "a": (0, 2)}
    assert graph.cycle_members(edges(spark, [("a", "b"), ("b", "c")])).count() == 0


def test_whole_graph_is_a_cycle(spark):
    ring = edges(spark, [("a", "b"), ("b", "c"), ("c", "a")])
    got = order(graph.dependency_order(modules(spark, "abc"), ring))
    assert sorted(got.values()) == [(0, 1), (0, 2), (0, 3)]


def reach(pairs):
    nodes = {n for p in pairs for n in p}
    out = {n: {d for m, d in pairs if m == n} for n in nodes}
    for k in nodes:
        for i in nodes:
            if k in out[i]:
                out[i] |= out[k]
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_graphs(spark, seed):
    rng = random.Random(seed)
    items = [f"n{i:02d}" for i in range(24)]
    pairs = sorted({(rng.choice(items), rng.choice(items)) for _ in range([22, 30, 45][seed - 1])})
    closure = reach(pairs)
    found = {r["module"] for r in graph.cycle_members(edges(spark, pairs)).collect()}
    assert found == {n for n, r in closure.items() if n in r}
    got = order(graph.dependency_order(modules(spark, items), edges(spark, pairs)))
    assert sorted(o for _, o in got.values()) == list(range(1, 25))
    for module, dep in pairs:
        if module not in closure.get(dep, ()):
            assert got[dep][0] < got[module][0] and got[dep][1] < got[module][1]
