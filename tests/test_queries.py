"""Registered queries against their SQL, at the smallest scale."""

from __future__ import annotations

import pytest
from compare import database, same, spark_rows, sql_rows

from __spark_entry__ import entry, oracle_sql, queries
from tidewatch.plans.catalog import QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return database(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_its_sql(spark, con, name):
    columns, rows = spark_rows(queries()[name](spark, FOLDER))
    expected_columns, expected = sql_rows(con, oracle_sql()[name])
    assert columns == expected_columns
    assert len(rows) == len(expected)
    for row, want in zip(rows, expected):
        assert all(map(same, row, want)), (row, want)


def test_entry(spark):
    assert entry(spark).columns == ["topic", "ts_ms", "views"]
    assert entry(spark).count() > 0
