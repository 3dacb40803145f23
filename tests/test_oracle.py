"""Every registered query with oracle SQL against DuckDB on tables that give every query rows."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as registry

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in os.listdir(SF):
        connection.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return connection


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return value.item() if hasattr(value, "item") else value


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_oracle(spark, duck, name):
    got = registry.queries()[name](spark, SF)
    want = duck.sql(registry.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = sorted(str([plain(r[c]) for c in columns]) for r in got.collect())
    at = [want.columns.index(c) for c in columns]
    assert rows == sorted(str([plain(r[i]) for i in at]) for r in want.fetchall())
    assert rows


def test_entry(spark):
    assert registry.entry(spark).count() > 0
