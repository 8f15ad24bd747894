"""Blocklists as tables of patterns against testing every pair."""

import random
import re

import pytest

from fleetwright.operators.patterns import blocklist_by_table, literal, matched_names


@pytest.mark.parametrize(
    ("pattern", "want"),
    [
        ("^sale_.*", "sale_"), ("abc?de", "ab"), ("ab+cde", "cde"), ("a(bcd)e", "a"), ("x[abc]yz", "yz"), ("a|b", ""),
        (r"a\.b", "a.b"), (r"\d+abc", "abc"), ("(?i)abc", ""), ("abc{2}de", "ab"), ("[]x]abc", "abc"), ("", ""), ("abc*", "ab"),
    ],
)
def test_literals(pattern, want):
    assert literal(pattern) == want


def test_every_match_holds_the_literal():
    rng = random.Random(3)
    parts = ["a", "b", "ab", "ba?", "(a|b)", "[ab]", ".", "a+", "b*", "(ab)?", r"\.", "a{1,2}", "(b)"]
    for _ in range(400):
        pattern = "".join(rng.choice(parts) for _ in range(rng.randint(1, 6)))
        for _ in range(30):
            text = "".join(rng.choice("ab.") for _ in range(rng.randint(0, 8)))
            found = re.search(pattern, text)
            assert not found or literal(pattern) in found[0], (pattern, text)


def test_table_equals_testing_every_pair(spark):
    rng = random.Random(4)
    words = ["sale", "stock", "crm", "web", "l10n", "au", "de", "account", "hr"]
    names = sorted({"_".join(rng.choice(words) for _ in range(rng.randint(1, 4))) for _ in range(300)})
    patterns = ["*_web$", "^crm", "s.*k_h", "^(sale|hr)$", "[x-z]", r"(\w)\1_au", "^...$", "", "acc.unt_+web", "l10n_(au|de)", "_h", r"(a)\w+\1$"]
    df = spark.createDataFrame([(n, i) for i, n in enumerate(names)] + [(None, -1)], "name string, seq int")
    table = spark.createDataFrame([(p,) for p in [*patterns, None]], "pattern string")
    want = {n: min((p.lstrip("*") for p in patterns if p and re.search(p.lstrip("*"), n)), default=None) for n in names}
    got = {r["name"]: r["pattern"] for r in matched_names(df, table).collect()}
    assert got == {n: p for n, p in want.items() if p}
    kept = {r["name"] for r in blocklist_by_table(df, table).collect()}
    assert kept == {n for n, p in want.items() if not p} | {None}
    assert blocklist_by_table(df, table.limit(0)).count() == len(names) + 1


def test_many_patterns_meet_no_nested_loop(spark):
    df = spark.range(3000).selectExpr("concat('module_', id) AS name")
    table = spark.range(10_000).selectExpr("concat('^module_', id * 7, '$') AS pattern")
    kept = blocklist_by_table(df, table)
    plan = kept._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert kept.count() == 3000 - 429
