"""Each query against its SQL on DuckDB, at the smallest scale."""

import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
OWN = [n for n in entry.oracle_sql() if not n.startswith("op") and n != "pipeline"]


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(SF):
        pytest.skip("no test tables here")
    c = duckdb.connect()
    for t in ("orders", "events", "documents"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", OWN)
def test_query_equals_its_sql(spark, duck, name):
    got = entry.queries()[name](spark, SF)
    columns = sorted(got.columns)
    want = duck.sql(entry.oracle_sql()[name])
    assert columns == sorted(want.columns)

    def rows(all_rows, names):
        order = [names.index(c) for c in columns]
        return sorted((tuple(float(r[i]) if isinstance(r[i], int | float) and not isinstance(r[i], bool) else r[i] for i in order) for r in all_rows), key=repr)

    assert rows([tuple(r) for r in got.collect()], got.columns) == rows(want.fetchall(), list(want.columns))


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 1


def test_evaluate_grid_runs_all_splits(monkeypatch):
    import inspect

    from rarespark.plans import queries as q

    asked = []
    signature = inspect.signature(q.evaluate)
    monkeypatch.setattr(q, "frame", lambda *_: None)
    monkeypatch.setattr(q, "evaluate", lambda *a, **k: asked.append(signature.bind(*a, **k)))
    q.evaluate_grid(None, None)
    asked[0].apply_defaults()
    assert asked[0].arguments["n_reps"] == 50
