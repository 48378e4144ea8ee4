"""Queries with SQL against that SQL."""

from __future__ import annotations

import duckdb
import pytest

from grantmill.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_agrees_with_its_sql(spark, sf_dir, name):
    df = queries.QUERIES[name](spark, sf_dir)
    con = duckdb.connect()
    for table in ("documents", "embeddings", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    result = con.execute(queries.ORACLES[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted(tuple(row[columns.index(c)] for c in df.columns) for row in result.fetchall())
    assert sorted(tuple(r) for r in df.collect()) == want
    assert want
