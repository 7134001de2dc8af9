"""Every query with SQL, against DuckDB on the smallest tables; those without give rows of a fixed schema."""

import datetime as dt
import os

import duckdb
import pytest

from tidewater.plans import catalogue, depth, pages, streams, tagged, tpch  # noqa: F401  all of them add their queries

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{name}'")
    return con


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, dt.datetime) and value.tzinfo:
        return value.replace(tzinfo=None)
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return value.hex() if isinstance(value, (bytes, bytearray)) else value


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_and_sql_agree(spark, tables, name):
    want = tables.execute(catalogue.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    df = catalogue.QUERIES[name](spark, FOLDER)
    assert sorted(df.columns) == sorted(columns)
    got = [[plain(v) for v in r] for r in df.select(*columns).collect()]
    assert sorted(got, key=repr) == sorted(([plain(v) for v in r] for r in want.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_query_without_sql_reads_all_documents(spark, name):
    df = catalogue.QUERIES[name](spark, FOLDER)
    n = spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    rows = df.collect()
    assert 0 < len({r[0] for r in rows}) <= n and (name in ("korean_hygiene", "korean_aspects") or len(rows) == n)


def test_clauses_of_odd_texts_and_sql_agree(spark, tmp_path):
    texts = ["0 cars and 11 seats and 202", " first one  and  second one ", "a and b", "ab", "", " ", None, "one\u00a0and\u00a0two", "one\x0band\x0btwo", "one\tand\n two \u3000and\fthree", "abc and and def", "and only", " 00 and 11 and 222 "]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = [tuple(r) for r in catalogue.QUERIES["clause_chunks"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(con.execute(catalogue.ORACLE_SQL["clause_chunks"]).fetchall())


def test_parts_and_their_words_are_not_broadcast(spark):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    for made in (tpch.described, tpch.tagged):
        assert "BroadcastHashJoin" not in plan(made(spark, FOLDER)) and "SortMergeJoin" in plan(made(spark, FOLDER))
    assert "lineitem" not in plan(catalogue.QUERIES["model_ranking"](spark, FOLDER)), "reviews are read once, before the ranking"
