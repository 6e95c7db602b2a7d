"""Every registered query against its SQL equivalent, over whole tables."""

import datetime
import decimal
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from lakesight.sources.tables import TABLES

FOLDER = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="driver tables are not here")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


def plain(value):
    if isinstance(value, decimal.Decimal):
        return ("decimal", str(value))
    if isinstance(value, datetime.datetime):
        return ("time", value.replace(tzinfo=None).isoformat())
    return (type(value).__name__, repr(value))


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, duck, name):
    result = entry.queries()[name](spark, str(FOLDER))
    rows = [tuple(r) for r in result.collect()]
    oracle = entry.oracle_sql().get(name)
    if oracle is None:
        assert rows
        return
    cursor = duck.execute(oracle)
    expected = cursor.fetchall()
    assert table(result.columns, rows) == table([c[0] for c in cursor.description], expected)


def test_entry(spark):
    assert entry.entry(spark).columns[0] == "brand"


def test_every_oracle_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
