"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="session")
def duck():
    connection = duckdb.connect()
    for table in TABLES.split():
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return connection


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(tuple(row[i]) if isinstance(row[i], list) else row[i] for i in order) for row in rows)


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, FOLDER)
    found = rows_of(df.columns, df.collect())
    assert found
    if name in entry.oracle_sql():
        cursor = duck.execute(entry.oracle_sql()[name])
        names = [d[0] for d in cursor.description]
        assert sorted(names) == sorted(df.columns)
        assert found == rows_of(names, cursor.fetchall())


def test_entry(spark):
    assert entry.entry(spark).columns == ["channel", "month", "total_messages"]


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
