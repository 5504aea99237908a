"""Bumps, counts, draws, synthesis and the nine strategies, against worked examples."""

import pytest
from pyspark.sql import functions as F

from rarespark import Resampler
from rarespark.functions.relevance import ControlPoints
from rarespark.functions.rng import uniform, uniform_py
from rarespark.operators import bumps, counts, draws, series, synth
from rarespark.operators.bumps import Bump
from rarespark.operators.resampler import in_order

Y = [5, 1, 3, 9, 7, 2, 8]
PHI = [0, 1, 0.2, 1, 0.5, 0.9, 0.9]


def cases(spark, y=Y, p=PHI):
    return spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(y, p, strict=True))], "t bigint, y double, phi double")


def groups(df):
    out = {}
    for r in df.orderBy("y", "t").collect():
        out.setdefault(r.bump, []).append(r.t)
    return [out[k] for k in sorted(out)]


def test_bumps_by_window(spark):
    over = bumps.label_by_window(cases(spark), "y", "phi", "t", 0.9, "over")
    assert groups(over) == [[1, 5], [2, 0, 4], [6, 3]]
    assert [(b.rare, b.normal) for b in bumps.table(over, "phi", 0.9, "over")] == [(True, False), (False, True), (True, False)]
    under = bumps.label_by_window(cases(spark), "y", "phi", "t", 0.9, "under")
    assert groups(under) == [[1], [5, 2, 0, 4, 6], [3]]


@pytest.mark.parametrize("rule", ["over", "under"])
@pytest.mark.parametrize("cp", [(2, 1, 5, 0, 8, 1), (2, 0, 5, 0, 8, 1), (2, 1, 5, 0, 8, 0), (-5, 1, 5, 0, 15, 1), (4.9, 1, 5, 0, 5.1, 1)])
@pytest.mark.parametrize("y", [list(range(11)), [0, 0, 5, 5, 10], [0, 10], [3, 5, 5, 7.9], [1, 1, 5]])
def test_bumps_without_a_sort_are_the_same(spark, rule, cp, y):
    from rarespark import phi

    c = ControlPoints(cp[0], cp[1], cp[2], cp[3], cp[4], cp[5])
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(y)], "t bigint, y double").withColumn("phi", phi("y", c))
    assert groups(bumps.label_by_value(df, "y", "phi", c, 0.9, rule)) == groups(bumps.label_by_window(df, "y", "phi", "t", 0.9, rule))


def test_no_rare_bump_warns_and_returns_the_input(spark):
    df = cases(spark).select("t", "y", F.lit(1.0).alias("x0"))
    with pytest.warns(UserWarning, match="no rare bump"):
        got = Resampler("under", relevance=[(0, 0), (5, 0), (9, 0)]).fit_resample(df, ["x0"], "y", "t")
    assert got.count() == 7 and {r.origin for r in got.collect()} == {"original"}


def three():
    return [Bump(0, 2, 1, True, False), Bump(1, 15, 0, False, True), Bump(2, 3, 1, True, False)]


@pytest.mark.parametrize(
    ("strategy", "o", "u", "sizes"),
    [("under", None, None, [2, 4, 3]), ("over", None, None, [9, 15, 10]), ("smote", None, None, [7, 7, 7]), ("under", None, 0.5, [2, 7, 3]), ("under", None, 1.2, [2, 15, 3]), ("over", 2, None, [6, 15, 9]), ("smote", 2.5, 0, [5, 0, 7])],
)
def test_counts(strategy, o, u, sizes):
    assert [b.n_out for b in counts.assign(three(), 20, strategy, o, u)] == sizes


def test_counts_round_half_to_even():
    found = [Bump(0, 6, 1, True, False), Bump(1, 15, 0, False, True)]
    assert [b.n_out for b in counts.assign(found, 21, "smote")] == [10, 10]


@pytest.mark.parametrize(("strategy", "o", "u"), [("under", 1, None), ("over", None, 1), ("over", 0.5, None), ("smote", -1, None)])
def test_percentages_are_checked_even_without_bumps(spark, strategy, o, u):
    with pytest.raises(ValueError):
        Resampler(strategy, o=o, u=u).fit_resample(cases(spark), ["phi"], "y", "t")


def test_preferences(spark):
    under = bumps.label_by_window(cases(spark), "y", "phi", "t", 0.9, "under")
    found = bumps.table(under, "phi", 0.9, "under")
    rows = draws.ranked(under, found, "t")
    by = lambda bias: {r.t: r.p for r in draws.preferences(rows, bias).where("bump = 1").collect()}
    assert by("temporal") == pytest.approx({5: 4 / 15, 2: 2 / 15, 0: 1 / 15, 4: 3 / 15, 6: 5 / 15})
    assert by("temporal+phi") == pytest.approx({5: 0.36, 2: 0.04, 0: 0, 4: 0.15, 6: 0.45})
    assert by(None) == pytest.approx(dict.fromkeys([0, 2, 4, 5, 6], 0.2))


def test_topping_up_takes_every_weighted_case_and_warns(spark):
    df = cases(spark, range(10), [0.1, 0.1] + [0.0] * 8).withColumn("bump", F.lit(0))
    b = Bump(0, 10, 0.02, False, True, positive=2, n_out=5)
    with pytest.warns(UserWarning, match="only 2 cases"):
        got = draws.without_replacement(draws.ranked(df, [b], "t"), [b], "temporal+phi", 1, "t").collect()
    assert len({r.t for r in got}) == 5 and {0, 1} <= {r.t for r in got}


@pytest.mark.parametrize("piece", [500_000, 2])
def test_draws_follow_their_weights(spark, monkeypatch, piece):
    monkeypatch.setattr(series, "PIECE_ROWS", piece)
    df = cases(spark, range(4), [0.0, 0.5, 0.5, 1.0]).withColumn("bump", F.lit(0))
    b = Bump(0, 4, 0.5, True, False, positive=3)
    rows = draws.ranked(df, [b], "t")
    for bias, w in ((None, [1, 1, 1, 1]), ("temporal", [1, 2, 3, 4]), ("temporal+phi", [0, 1, 1.5, 4])):
        n = {r.t: r["count"] for r in draws.with_replacement(rows, [b], {0: 4000}, bias, 3).groupBy("t").count().collect()}
        assert sum(n.values()) == 4000
        for t, x in enumerate(w):
            assert n.get(t, 0) / 4000 == pytest.approx(x / sum(w), abs=0.03)


def test_randomness_is_the_same_on_the_driver(spark):
    got = spark.range(1).select(uniform(7, "split", F.lit(3))).first()[0]
    assert got == uniform_py(7, "split", 3) and 0 < got < 1


X3 = [[0, 0], [10, 5], [1, 3]]


def triple(spark):
    rows = [(i, float(a), float(b), y, p, 0) for i, ((a, b), y, p) in enumerate(zip(X3, [5.0, 1.0, 3.0], [0.2, 1.0, 0.5], strict=True))]
    return spark.createDataFrame(rows, "t bigint, x0 double, x1 double, y double, phi double, bump int")


@pytest.mark.parametrize(
    ("bias", "quirks", "pairs"),
    [("temporal", True, {(1, 0), (2, 0), (0, 2)}), ("temporal", False, {(0, 2), (1, 2), (2, 1)}), ("temporal+phi", True, {(1, 2), (2, 0), (0, 2)}), ("temporal+phi", False, {(0, 1), (1, 2), (2, 1)})],
)
def test_seeds_and_neighbours(spark, bias, quirks, pairs):
    job = Bump(0, 3, 0.5, True, False, c=2.0, n_out=6)
    df = triple(spark)
    made = synth.synthesize(df, [job], ["x0", "x1"], "y", "t", bias, 5, 1, quirks)
    order = [r.t for r in (df.orderBy("y", "t") if quirks else df.orderBy("t")).collect()]
    assert {(order[r.pos], order[r.nn_pos]) for r in made.collect()} == pairs


def test_midpoint_where_distances_agree(spark):
    df = spark.createDataFrame([(0, 2.0, 0.0, 4.0, 1.0, 0), (1, 2.0, 10.0, 8.0, 1.0, 0)], "t bigint, x0 double, x1 double, y double, phi double, bump int")
    job = Bump(0, 2, 1, True, False, c=2.0, n_out=4)
    assert [r.y for r in synth.synthesize(df, [job], ["x0", "x1"], "y", "t", None, 1, 1).collect()] == [6, 6]


def test_neighbours_in_blocks_equal_the_join(spark, monkeypatch):
    monkeypatch.setattr(synth, "BLOCK", 16)
    df = spark.range(60).select(F.lit(0).alias("bump"), F.col("id").alias("pos"), (F.col("id") * 37 % 11).cast("double").alias("x0"), (F.col("id") * 17 % 7).cast("double").alias("x1"))
    rows = lambda d: sorted((r.pos, r.nn_rank, r.nn) for r in d.collect())
    assert rows(synth.neighbours(df, ["x0", "x1"], 5)) == rows(synth.neighbours_sql(df, ["x0", "x1"], 5))


def series_frame(spark):
    y = [100.0 if i % 10 == 9 else (-80.0 if i % 25 == 3 else float(i % 7)) for i in range(120)]
    return spark.createDataFrame([(i, y[i - 1] if i else 0.0, float(i % 5), y[i]) for i in range(120)], "t bigint, x0 double, x1 double, y double")


@pytest.mark.parametrize("strategy", ["under", "over", "smote"])
@pytest.mark.parametrize("bias", [None, "temporal", "temporal+phi"])
def test_every_strategy_gives_the_planned_sizes(spark, strategy, bias):
    df = series_frame(spark)
    r = Resampler(strategy, bias, seed=5)
    got, found = r.labelled(df, "y", "t")
    counts.assign(found, 120, strategy)
    out = r.fit_resample(df, ["x0", "x1"], "y", "t")
    rows = in_order(out, "t").collect()
    assert len(rows) == sum(b.n_out for b in found)
    assert [x.t for x in rows] == sorted(x.t for x in rows)
    assert rows == in_order(r.copy().fit_resample(df.repartition(3), ["x0", "x1"], "y", "t"), "t").collect()
    if strategy == "under":
        assert len({x.t for x in rows}) == len(rows)


def test_parameters(spark):
    r = Resampler("over", k=3)
    assert r.copy().get_params() == r.get_params() and r.set_params(k=4).k == 4
    with pytest.raises(ValueError, match="no parameter"):
        r.set_params(z=1)
    for bad in ({"strategy": "x"}, {"bias": "x"}):
        with pytest.raises(ValueError, match="expected one of"):
            Resampler(**bad).fit_resample(cases(spark), ["phi"], "y", "t")
    with pytest.raises(ValueError, match="k: expected"):
        Resampler("under", k=0).fit_resample(cases(spark), ["phi"], "y", "t")
    with pytest.raises(ValueError, match="finite"):
        Resampler("under").fit_resample(cases(spark, p=[float("nan")] * 7), ["phi"], "y", "t")
    with pytest.raises(ValueError, match="at least 2"):
        Resampler("under").fit_resample(cases(spark).limit(1), ["phi"], "y", "t")
