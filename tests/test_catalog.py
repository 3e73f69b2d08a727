"""Registered queries against their SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from corvane.catalog import ORACLES, QUERIES
from corvane.session import configure
from tests.conftest import SF
from tools.check import TABLES, rows_of

NAMES = [n for n in QUERIES if n in ORACLES]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, duck, name):
    df = QUERIES[name](configure(spark), SF)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cursor = duck.execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    assert got == rows_of(columns, cursor.fetchall())


def test_entry_point(spark):
    assert entry.entry(spark).columns == ["qid", "id", "score", "rank"]
