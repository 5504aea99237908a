"""Operators against their SQL on DuckDB, on the corpus of odd texts and on the smallest tables."""

import os

import pytest

from rarespark.llm import queries

SF = "/root/testdata/sf0.001"


def compare(spark, sf, name):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        at = f"{sf}/{t}.parquet"
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{at}/*.parquet')" if os.path.isdir(at) else f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{at}')")
    want = c.execute(queries.oracle_sql()[name]).fetchall()
    names = [x[0] for x in c.description]
    got = queries.queries()[name](spark, sf)
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(tuple, got.select(*names).collect()), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_on_odd_texts(spark, docs, corpus, tmp_path, name):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    items = [(1, corpus[40][1]), (10, corpus[40][1][40:200]), (2, "a"), (3, None), (4, "..."), (5, "x " * 14), (6, "日本語 日本語"), (7, "A B")]
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    compare(spark, str(tmp_path), name)


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_on_the_smallest_tables(spark, name):
    if not os.path.isdir(SF):
        pytest.skip("no test tables here")
    compare(spark, SF, name)
