"""Every registered query that has SQL against the same result from DuckDB: column names, kinds of type, and exact values."""

from __future__ import annotations

import os
from decimal import Decimal

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from ledgertally.plans.table_queries import QUERIES

TABLES = """region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels
conversations""".split()


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(row[i] for i in order) for row in rows)


def spark_kind(name):
    return {"int": "integer", "bigint": "bigint", "double": "double", "string": "varchar"}.get(name, name)


@pytest.fixture(scope="module")
def duck(tables):
    connection = duckdb.connect()
    for name in TABLES:
        path = os.path.join(tables, f"{name}.parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return connection


def test_every_query_has_sql():
    assert set(QUERIES) <= set(oracle_sql()) <= set(queries())


def test_entry(spark):
    assert len(entry(spark).collect()) == 10


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query(spark, tables, duck, name):
    result = queries()[name](spark, tables)
    ours = rows_of(result.columns, [tuple(row) for row in result.collect()])
    cursor = duck.execute(oracle_sql()[name])
    columns = [column[0] for column in cursor.description]
    theirs = rows_of(columns, cursor.fetchall())
    assert sorted(result.columns) == sorted(columns)
    described = duck.execute(f"DESCRIBE {oracle_sql()[name]}").fetchall()
    assert {n: spark_kind(t) for n, t in result.dtypes} == {row[0]: row[1].lower() for row in described}
    assert len(ours) == len(theirs) > 0
    for mine, other in zip(ours, theirs):
        for a, b in zip(mine, other):
            assert type(a) is type(b) or {type(a), type(b)} <= {int, Decimal}, (mine, other)
            assert a == b, (mine, other)
