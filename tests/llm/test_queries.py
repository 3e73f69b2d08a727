"""The registered queries against their SQL, and the pipeline against brute force."""

import re

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from corvane.llm import simhash
from corvane.llm.queries import ORACLES, QUERIES
from tests.conftest import SF
from tests.llm.test_operators import ODD, brute_groups, docs
from tools.check import TABLES, rows_of


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cursor = duck.execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(columns, cursor.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_has_its_rows(spark, name):
    table = {"op1": "pages", "op12": "embeddings"}.get(name.split("_")[0], "documents")
    rows = QUERIES[name](spark, SF).count()
    # eight components of each vector
    there = spark.read.parquet(f"{SF}/{table}.parquet").count() * (8 if name.startswith("op12_") else 1)
    assert rows > 0 if name.startswith("op9_") else rows == there


def test_every_operator_is_registered():
    numbers = sorted(int(m[1]) for n in entry.queries() if (m := re.match(r"op(\d+)_", n)))
    assert numbers == list(range(1, 14)) and "pipeline" in entry.queries()


def test_pipeline_stages(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    rows, seen = table, []
    for name, stage in corpus_pipeline.STAGES:
        rows = stage(spark, rows, SF).cache()
        seen.append(rows.count())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert sorted(rows.columns) == sorted(corpus_pipeline.COLUMNS)
    assert seen[0] >= seen[1] >= seen[2] > 0 and seen[3] == seen[4]


def test_near_stage_keeps_one_of_each_group(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r["doc_id"] for r in corpus_pipeline.near(spark, table, SF).select("doc_id").collect()}
    prints = {r["doc_id"]: simhash.fingerprint(r["text"]) for r in table.select("doc_id", "text").collect()}
    assert kept == set(brute_groups(dict(sorted(prints.items()))).values())


def test_near_stage_with_null_and_repeated_ids(spark):
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(300))
    rows = [
        (None, text(1), "en", "s"), (None, text(2), "en", "s"), (5, text(2), "en", "s"), (7, text(3), "en", "s"), (7, text(3), "en", "s"),
        (8, text(4), "en", "s"), (8, text(5), "en", "s"), (3, text(5), "en", "s"), (None, text(6), "en", "s"), (None, text(6), "en", "s")]
    got = sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.near(spark, docs(spark, rows), SF).collect()), key=lambda r: r[1])
    assert got == [(None, text(1)), (5, text(2)), (7, text(3)), (8, text(4)), (3, text(5)), (None, text(6))]


def test_pipeline_on_odd_rows(spark):
    rows = docs(spark, ODD)
    for _, stage in corpus_pipeline.STAGES:
        rows = stage(spark, rows, SF)
    assert rows.count() >= 0
    assert rows.filter(F.size("ids") == 0).count() == 0
    empty = docs(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, SF)
    assert empty.count() == 0
