"""Queries with SQL counterparts, compared on small test data."""

import glob
import os

import pytest

from twinfinder.llm.queries import ORACLE, QUERIES

duckdb = pytest.importorskip("duckdb")
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def tables():
    connection = duckdb.connect()
    for file in glob.glob(f"{SF}/*.parquet"):
        path = file if os.path.isfile(file) else f"{file}/*.parquet"
        connection.execute(f"CREATE VIEW {os.path.basename(file)[:-8]} AS SELECT * FROM '{path}'")
    return connection


def comparable(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(repr(row[i]) for i in order) for row in found)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, tables, name):
    df = QUERIES[name](spark, SF)
    got = df.collect()
    cursor = tables.execute(ORACLE[name])
    names = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(names)
    assert comparable(df.columns, got) == comparable(names, cursor.fetchall())
