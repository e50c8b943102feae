"""Every query that has SQL gives the same rows as DuckDB on the smallest tables."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from cataloom.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    connection.sql("SET TimeZone='UTC'")
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    return round(value, 9) if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    mine = sorted(repr([plain(row[c]) for c in columns]) for row in df.collect())
    found = duck.sql(ORACLES[name])
    assert sorted(found.columns) == columns
    theirs = sorted(repr([plain(row[found.columns.index(c)]) for c in columns]) for row in found.fetchall())
    assert mine == theirs


def test_entry_and_registry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
