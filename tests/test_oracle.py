"""Every registered query against its SQL oracle."""

from __future__ import annotations

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry_points
from checks.registry import CHECKS

TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "string": "VARCHAR",
    "double": "DOUBLE",
    "date": "DATE",
    "boolean": "BOOLEAN",
}


@pytest.fixture(scope="module")
def oracle(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path).removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    yield con
    con.close()


def comparable(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "NULL"
    return repr(round(value, 9)) if isinstance(value, float) else str(value)


def table(columns, rows):
    order = [columns.index(c) for c in sorted(columns)]
    return sorted(tuple(comparable(row[i]) for i in order) for row in rows)


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_query_matches_oracle(spark, sf_dir, oracle, name):
    df = entry_points.queries()[name](spark, sf_dir)
    found = [tuple(row) for row in df.collect()]
    result = oracle.execute(entry_points.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    types = {c[0]: str(c[1]) for c in result.description}
    expected = result.fetchall()
    assert {c: TYPES[t] for c, t in df.dtypes} == types
    assert found, "a query without rows checks nothing"
    assert table(df.columns, found) == table(columns, expected)


def test_entry_returns_ranked_inventors(spark):
    top = entry_points.entry(spark)
    assert top.columns == ["inventor", "country", "patent_count"]
    counts = [row.patent_count for row in top.collect()]
    assert len(counts) == 20 and counts == sorted(counts, reverse=True)


def test_every_query_has_an_oracle():
    assert set(CHECKS) <= set(entry_points.queries())
    assert set(CHECKS) <= set(entry_points.oracle_sql())
