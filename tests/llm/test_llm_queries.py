"""The queries with check SQL against a second engine, over whole small tables."""

import duckdb
import pytest

from lorekeep.llm.queries import CHECKS, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", CHECKS)
def test_check(spark, name):
    other = duckdb.connect()
    for table in ("documents", "embeddings", "conversations"):
        other.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    df = QUERIES[name](spark, FOLDER)
    result = other.execute(CHECKS[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*columns).collect())) == sorted(result.fetchall())
