"""What large tables bring: orders cut in pieces, and tables of many equal rows."""

import os
import subprocess
import sys
import threading

import numpy as np
import pytest
from pyspark import cloudpickle

import __spark_entry__ as entry
from rarespark.operators import series, synth
from rarespark.operators.resampler import Resampler
from rarespark.sources import series as sources


@pytest.fixture(scope="module")
def repeated(tmp_path_factory):
    """Events that each occur six times at one time, as in tables made of copies; no difference is ordinary but 0."""
    duckdb = pytest.importorskip("duckdb")
    place = tmp_path_factory.mktemp("repeated")
    c = duckdb.connect()
    c.sql(
        f"""COPY (SELECT i + 50 * copy AS event_id, TIMESTAMP '2024-01-01' + INTERVAL (i * 7) MINUTE AS ts, i % 3 AS user_id, 'view' AS event_type,
        CAST((i * 37) % 101 AS DOUBLE) AS value, '' AS props FROM range(50) r(i), range(6) q(copy)) TO '{place}/events.parquet'"""
    )
    c.sql(f"CREATE VIEW events AS SELECT * FROM read_parquet('{place}/events.parquet')")
    return str(place), c


def same_as_sql(spark, repeated, name):
    place, duck = repeated
    got, want = entry.queries()[name](spark, place), duck.sql(entry.oracle_sql()[name])
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    plain = lambda rows, names: sorted((tuple(float(v) if isinstance(v, int | float) and not isinstance(v, bool) else v for v in (r[names.index(c)] for c in columns)) for r in rows), key=repr)
    rows = plain(want.fetchall(), list(want.columns))
    assert plain([tuple(r) for r in got.collect()], got.columns) == rows
    return rows


def cut_in_pieces(monkeypatch):
    monkeypatch.setattr(series, "WINDOW_ROWS", 10)
    monkeypatch.setattr(series, "PIECE_ROWS", 40)


def test_positions_in_pieces_join_nothing(spark, repeated, monkeypatch):
    cut_in_pieces(monkeypatch)
    got = series.series_index(spark.read.parquet(f"{repeated[0]}/events.parquet"), "value", ["ts", "event_id"])
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r.t for r in got.collect()) == list(range(300))


def test_a_hot_value_is_cut_by_the_second_column(spark, monkeypatch):
    cut_in_pieces(monkeypatch)
    rows = [(g, 0.0 if i % 10 else float(i - 250), i) for i in range(500) for g in (0, 1)]
    df = spark.createDataFrame(rows, "g int, y double, t bigint")
    seen = []
    count = type(df).groupBy
    monkeypatch.setattr(type(df), "groupBy", lambda self, *c: (seen.append(self) if "_piece" in c else None, count(self, *c))[1])
    got = series.position(df, ["y", "t"], "pos", ["g"], 1000).collect()
    for g in (0, 1):
        assert [r.t for r in sorted((r for r in got if r.g == g), key=lambda r: r.pos)] == [t for _, y, t in sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], r[2]))]
    assert max(r["count"] for r in count(seen[0], "g", "_piece").count().collect()) < 120


@pytest.mark.parametrize("name", ["bump_targets_given", "bump_targets_over", "bump_targets_under", "bump_targets_smote", "bumps_over", "bumps_under", "prefs_temporal"])
def test_bumps_where_none_is_normal(spark, repeated, monkeypatch, name):
    cut_in_pieces(monkeypatch)
    assert same_as_sql(spark, repeated, name)


@pytest.mark.parametrize("block", [65_536, 40])
def test_neighbours_among_many_equal_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(synth, "BLOCK", block)
    monkeypatch.setattr(synth, "LEAF", 8)
    rng = np.random.default_rng(3)
    rows = [(b, i, 0.0 if i % 3 else float(rng.integers(0, 40)) / 7, -0.0 if i % 5 else float(rng.normal())) for b in (0, 4) for i in range(400 + b)] + [(9, 0, 1.0, 1.0), (9, 1, 2.0, 1.0)]
    df = spark.createDataFrame(rows, "bump int, pos bigint, x0 double, x1 double")
    plain = lambda d: sorted(map(tuple, d.select("bump", "pos", "nn", "nn_rank", "d").collect()))
    assert plain(synth.neighbours(df, ["x0", "x1"], 5)) == plain(synth.neighbours_sql(df, ["x0", "x1"], 5))


def test_a_vector_is_searched_once(spark, monkeypatch):
    """Copies and far cells cost no pairs: the seeds and candidates of a search are few."""
    df = spark.range(30_000).selectExpr("0 AS bump", "id AS pos", "CAST(id % 100 AS DOUBLE) AS x0", "0D AS x1")
    got = synth.neighbours(df, ["x0", "x1"], 5)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroups" not in plan
    assert got.where("d > 0").count() == 0 and got.count() == 150_000


@pytest.mark.parametrize("name", ["knn_neighbours", "smote_b", "smote_t", "smote_tphi", "smote_tphi_no_quirks", "synthetic_cases"])
def test_synthesis_of_repeated_rows(spark, repeated, monkeypatch, name):
    cut_in_pieces(monkeypatch)
    same_as_sql(spark, repeated, name)


def one_after_the_other(s):
    """The plain way: each gap by a pass over all windows."""
    held, donors = np.r_[np.full(9, np.nan), s], sources.Donors(s)
    for t in np.flatnonzero(np.isnan(s)):
        held[t + 9] = donors.value_after(held[t : t + 9])
    return held[9:]


@pytest.mark.parametrize("kind", ["noise", "steps", "constant", "far"])
def test_gaps_filled_together_are_as_one_after_the_other(monkeypatch, kind):
    monkeypatch.setattr(sources, "DONORS", 300)
    monkeypatch.setattr(sources, "MOST", 500)
    rng = np.random.default_rng(5)
    s = {"noise": rng.exponential(30, 6000), "steps": rng.integers(0, 3, 6000) * 1.0, "constant": np.ones(6000), "far": rng.normal(1e6, 1, 6000) + (np.arange(6000) == 77) * 1e9}[kind]
    s[rng.random(6000) < 0.02] = np.nan
    s[[0, 1, 500, 501, 502, 503, *range(900, 915)]] = np.nan
    np.testing.assert_allclose(sources.fill_gaps(s), one_after_the_other(s), rtol=1e-12, equal_nan=True)


def test_few_passes_fill_many_gaps(monkeypatch):
    passes = []
    monkeypatch.setattr(sources.Donors, "value_after", lambda self, before: passes.append(1) or 0.0)
    s = np.random.default_rng(1).random(3000)
    s[20::25] = np.nan
    assert not np.isnan(sources.fill_gaps(s)).any() and not passes


@pytest.mark.parametrize("kind", ["noise", "walk", "signed zeros", "copies", "kept", "far", "infinite"])
def test_a_tree_of_windows_finds_the_nearest(monkeypatch, kind):
    for name, size in {"LEAF": 8, "FAN": 4, "DONORS": 20, "MOST": 500}.items():
        monkeypatch.setattr(sources, name, size)
    rng = np.random.default_rng(6)
    n = 2400
    zeros = np.where(rng.random(n) < 0.5, 0.0, -0.0)
    s = {
        "noise": lambda: rng.exponential(30, n).round(1),
        "walk": lambda: np.cumsum(rng.normal(size=n)),
        "signed zeros": lambda: np.where(rng.random(n) < 0.99, zeros, rng.normal(size=n)),
        "copies": lambda: np.tile(rng.exponential(30, n // 12).round(2), 12),
        "kept": lambda: np.repeat(rng.exponential(30, n // 12).round(2), 12),
        "far": lambda: rng.normal(size=n) * 1e200,
        "infinite": lambda: np.where(np.arange(n) == 300, np.inf, rng.random(n)),
    }[kind]()
    s[rng.random(n) < 0.03] = np.nan
    s[[0, 1, 4, 5, *range(900, 930)]] = np.nan
    with np.errstate(all="ignore"):
        np.testing.assert_array_equal(sources.fill_gaps(s), one_after_the_other(s))


@pytest.mark.parametrize("repeat", [np.tile, np.repeat])
def test_a_gap_is_compared_with_few_windows(monkeypatch, repeat):
    compared, distance = [], sources.Donors._distance
    monkeypatch.setattr(sources.Donors, "_distance", lambda self, windows, *a: compared.append(len(windows)) or distance(self, windows, *a))
    s = repeat(np.random.default_rng(7).exponential(50, 2000).round(2), 60)
    s[50::97] = np.nan
    windows, gaps = int(sum(~np.isnan(s))), int(sum(np.isnan(s)))
    assert not np.isnan(sources.fill_gaps(s)).any() and sum(compared) < 0.001 * windows * gaps


def test_gaps_are_filled_where_the_package_is_not_installed(tmp_path):
    (tmp_path / "fill").write_bytes(cloudpickle.dumps(sources.fill_gaps))
    code = "import sys; from pyspark import cloudpickle; import numpy as np; s = np.arange(60) % 3.0; s[40] = np.nan; print(cloudpickle.loads(open('fill', 'rb').read())(s)[40], 'rarespark' in sys.modules)"
    clean = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=clean, capture_output=True, text=True, timeout=60).stdout.split() == ["1.0", "False"]


def test_a_filled_series_is_numbered_where_it_is_filled(spark):
    df = spark.createDataFrame([(3 * i, None if i in (0, 30) else float(i % 3)) for i in range(60)], "t bigint, y double")
    with pytest.warns(UserWarning, match="dropped 1 leading"):
        got = sources.imputed(df, "knn")
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, got.collect())) == [(i - 1, float(i % 3)) for i in range(1, 60)]


def test_a_filled_series_is_written_once(spark, monkeypatch):
    names, write = [], sources.written
    monkeypatch.setattr(sources, "written", lambda df, name: names.append(name) or write(df, name))
    df = spark.createDataFrame([(i, None if i == 30 else float(i % 3)) for i in range(60)], "t bigint, y double")
    assert [r.y for r in sources.imputed(df, "knn").orderBy("t").collect()] == [float(i % 3) for i in range(60)] and names == ["series-filled"]


def test_control_points_are_fitted_beside_each_other(spark, monkeypatch):
    from rarespark.plans import evaluate as plans

    threads, fit = [], plans.control_points
    monkeypatch.setattr(plans, "control_points", lambda *a: threads.append(threading.current_thread()) or fit(*a))
    df = spark.createDataFrame([(i, float(i % 7), float(i * 37 % 11)) for i in range(60)], "t bigint, x0 double, y double")
    got = plans.evaluate(df, ["x0"], strategies={"baseline": None}, n_reps=2).collect()
    assert len(got) == 8 and len(threads) == 2 and threading.main_thread() not in threads


def some_series(spark, kind):
    y = [100.0 + i % 3 if i % 10 == 9 else (-80.0 if i % 25 == 3 else float(i * 37 % 11)) for i in range(240)]
    if kind == "tied":  # the median is the upper whisker: control points are not strict
        y = [-50.0 if i % 24 == 0 else i * 37 % 11 / 4 if i % 3 == 0 else v if v > 99 else 3.0 for i, v in enumerate(y)]
    if kind == "even":
        y = [float(i % 7) for i in range(240)]
    return spark.createDataFrame([(i + 5, y[i - 1] if i else 0.0, y[i - 2] if i > 1 else -0.0, y[i]) for i in range(240)], "t bigint, x0 double, x1 double, y double")


@pytest.mark.parametrize("kind", ["plain", "tied"])
def test_cells_of_a_split_in_one_task_are_the_operators(spark, monkeypatch, kind):
    from rarespark.plans import evaluate as plans

    grid = plans.default_strategies(7) | {"plain T": Resampler("smote", "temporal", seed=1, r_quirks=False, k=2), "o": Resampler("over", o=2.5)}
    if kind == "tied":
        grid = {n: grid[n] for n in ("baseline", "OVERTPhi", "SMOTEB", "SMOTETPhi", "plain T")}
    df = some_series(spark, kind)
    values = lambda: {(r.strategy, r.split, r.metric): r.value for r in plans.evaluate(df, ["x0", "x1"], strategies=grid, n_reps=1, seed=3).collect()}
    together = values()
    assert list(together.values()).count(together["baseline", 0, "sera"]) == 1  # every strategy has cases of its own
    monkeypatch.setattr(plans, "TASK_ROWS", 0)
    assert len(together) == 4 * len(grid) and together == pytest.approx(values(), rel=1e-9)


def test_the_grid_starts_no_jobs_by_cell(spark, monkeypatch):
    from rarespark.plans import evaluate as plans

    monkeypatch.setattr(Resampler, "fit_resample", lambda *_: pytest.fail("a job of a cell's own"))
    got = plans.evaluate(some_series(spark, "plain"), ["x0", "x1"], n_reps=50).collect()
    assert len({(r.strategy, r.split, r.metric) for r in got}) == len(got) == 50 * 10 * 4
    with pytest.warns(UserWarning, match="no rare"):
        same = plans.evaluate(some_series(spark, "even"), ["x0"], strategies={"baseline": None, "UNDERB": Resampler("under")}, n_reps=1).collect()
    assert {(r.metric, r.value) for r in same if r.strategy == "UNDERB"} == {(r.metric, r.value) for r in same if r.strategy == "baseline"}


def test_nearest_other_rows():
    rng = np.random.default_rng(2)
    x = rng.integers(-3, 3, (300, 2)) * np.array([1.0, 0.0])  # both zeros, and far more copies than neighbours
    d = np.sqrt(((x[:, None] - x) ** 2).sum(axis=2))
    d[np.arange(300), np.arange(300)] = np.inf
    assert (synth.nearest_others(x, 5) == np.argsort(d, axis=1, kind="stable")[:, :5]).all()
    assert synth.nearest_others(x[:3], 5).tolist()[0][2:] == [-1, -1, -1]
