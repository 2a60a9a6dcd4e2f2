"""Registered queries against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from check_queries import TABLES, compare

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query(spark, tables, name):
    state, note, _ = compare(spark, tables, FOLDER, name, entry.queries()[name], entry.oracle_sql()[name])
    assert state == "OK", note
