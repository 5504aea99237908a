"""The pipeline's stages on a small corpus, one by one and together."""

import os

import pytest

import corpus_pipeline
from rarespark.llm.common import materialize


@pytest.fixture()
def sf(docs, corpus, spark, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, corpus[5][1])], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


def test_stages(spark, sf, docs):
    held = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = materialize(stage(spark, held, sf), name)
        assert got.schema.names == docs.schema.names
        assert got.count() <= held.count()
        # columns that share a name with an operator's results are the documents' own
        assert all(r.score == float(r.doc_id) and r.keep for r in got.collect())
        held = got
    assert 5 not in {r.doc_id for r in held.collect()}
    assert len({r.doc_id for r in held.collect()}) == held.count()
    done = corpus_pipeline.run(spark, sf)
    assert sorted(r.doc_id for r in done.collect()) == sorted(r.doc_id for r in held.collect())
    assert all(r.n_tokens == len(r.ids) for r in done.collect())


def test_no_documents(spark, docs, tmp_path):
    docs.limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_queries_are_registered():
    import __spark_entry__

    names = list(__spark_entry__.queries())
    assert [n for n in range(1, 11) if not any(x.startswith(f"op{n}_") for x in names)] == []
    assert "pipeline" in names and os.path.exists("corpus_pipeline.py")
