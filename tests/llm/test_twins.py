"""The registered queries of this package that have a SQL twin."""

import pytest

import __spark_entry__ as entry
from check_oracle import compare, open_duckdb
from fleetwright.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    assert compare(spark, open_duckdb(SF), SF, name, ORACLE[name]).startswith("ok")


def test_all_are_registered():
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())
