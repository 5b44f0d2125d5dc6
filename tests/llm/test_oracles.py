"""Queries that SQL can express, against their SQL."""

import duckdb
import pytest

from tarnflow.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(spark, name):
    connection = duckdb.connect()
    connection.sql(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    expected = connection.sql(queries.ORACLES[name])
    got = queries.QUERIES[name](spark, DATA).select(*expected.columns)
    assert sorted(tuple(r) for r in got.collect()) == sorted(expected.fetchall())
