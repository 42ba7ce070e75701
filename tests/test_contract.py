"""The registered queries against their SQL on the smallest tables."""

from collections import Counter
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from trackmill.plans import registry

FOLDER = Path("/root/testdata/sf0.001")

@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for path in FOLDER.glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def multiset(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(row[i] for i in order) for row in rows)


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.SQL)
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_sql(spark, database, name):
    frame = entry.queries()[name](spark, str(FOLDER))
    result = database.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(frame.columns)
    assert multiset(frame.columns, frame.collect()) == multiset(columns, result.fetchall())
