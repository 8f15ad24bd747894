"""Every registered query against its SQL twin, on the smallest data folder."""

import pytest

import __spark_entry__ as entry
from check_oracle import compare, open_duckdb
from fleetwright.plans.oracle import oracle_sql
from fleetwright.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
ORACLE = oracle_sql()


@pytest.fixture(scope="module")
def con():
    return open_duckdb(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, name):
    result = compare(spark, con, SF, name, ORACLE[name])
    assert result.startswith("ok"), result


def test_every_sql_twin_has_a_query():
    assert set(ORACLE) == set(QUERIES)
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_has_rows(spark):
    assert entry.entry(spark).columns == ["grp", "file_key", "content_hash"]
