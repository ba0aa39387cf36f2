"""Every registered query against its check SQL in a second engine."""

import duckdb
import pytest

import __spark_entry__ as contract
from lorekeep.plans.queries import QUERIES
from lorekeep.sources.tables import TABLES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def other():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


def in_order(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(row[i]) for i in order) for row in rows)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, other, name):
    df = contract.queries()[name](spark, FOLDER)
    result = other.execute(contract.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    assert sorted(df.columns) == sorted(columns)
    assert in_order(df.columns, df.collect()) == in_order(columns, result.fetchall())


def test_entry(spark):
    assert contract.entry(spark).count() > 0
