"""Every registered query with SQL gives the rows that DuckDB gives."""

import pytest
from oracle import connect, difference

from __spark_entry__ import entry, oracle_sql, queries

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_same_as_duckdb(spark, duck, name):
    assert difference(queries()[name](spark, FOLDER), duck, oracle_sql()[name]) is None


def test_every_sql_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    rows = entry(spark).collect()
    assert len(rows) == 11 and len(rows[0]) == 31
