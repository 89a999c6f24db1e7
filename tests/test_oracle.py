"""Every registered query against its SQL counterpart on the smallest test data."""

import glob
import os

import pytest

import __spark_entry__ as entry_module
from twinfinder.oracle import ORACLE as SQL
from twinfinder.queries import all_queries

duckdb = pytest.importorskip("duckdb")
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES = all_queries()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def tables():
    connection = duckdb.connect()
    for file in glob.glob(f"{SF}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(file)[:-8]} AS SELECT * FROM '{file}'")
    return connection


def comparable(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(repr(row[i]) for i in order) for row in found)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, tables, name):
    df = QUERIES[name](spark, SF)
    got = df.collect()
    cursor = tables.execute(SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(names)
    assert comparable(df.columns, got) == comparable(names, cursor.fetchall())


def test_every_query_is_checked():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(entry_module.queries())


def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.count() == 21 and "rank" in df.columns
