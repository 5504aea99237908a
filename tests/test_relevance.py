"""Control points, phi, summaries; expected values are worked by hand."""

import math

import pytest
from pyspark.sql import functions as F

from rarespark import ControlPoints, control_points, imbalance_summary, phi
from rarespark.functions.relevance import as_control_points, phi_py
from rarespark.operators.relevance import control_points_by, hinge_ranks, resolve, tukey_hinges
from rarespark.operators.series import order_statistics, position

Y = [4, 1, 9, 2, 100, 3, 8, 5, 7, 6]


def col(spark, values, name="y"):
    return spark.createDataFrame([(float(v) if v is not None else None,) for v in values], f"{name} double")


def test_hinges_are_tukeys(spark):
    # n = 10: depth floor(13/2)/2 = 3, median at 5.5, upper at 8
    assert hinge_ranks(10) == [(3, 3), (5, 6), (8, 8)]
    assert tukey_hinges(col(spark, Y), "y") == (3.0, 5.5, 8.0)


def test_control_points_with_an_outlier_above(spark):
    assert control_points(col(spark, Y), "y") == ControlPoints(1, 0, 5.5, 0, 9, 1)


def test_missing_values_do_not_count(spark):
    assert control_points(col(spark, [*Y, None, float("nan")]), "y") == ControlPoints(1, 0, 5.5, 0, 9, 1)
    with pytest.raises(ValueError, match="no non-NaN values"):
        control_points(col(spark, [None, float("nan")]), "y")


def test_a_single_value(spark):
    assert control_points(col(spark, [3]), "y") == ControlPoints(3, 0, 3, 0, 3, 0)


def test_phi_values(spark):
    cp = ControlPoints(1, 0, 5.5, 0, 9, 1)
    given = [-3, 1, 3, 5.5, 7.25, 8.125, 9, 100]
    got = [r[0] for r in col(spark, given).select(phi("y", cp)).collect()]
    # halfway up the step is 1/2; three quarters is 3 * 9/16 - 2 * 27/64
    assert got == pytest.approx([0, 0, 0, 0, 0.5, 0.84375, 1, 1], abs=1e-12)
    assert [phi_py(v, cp) for v in given] == pytest.approx(got, abs=1e-15)


def test_phi_of_tied_knots_is_the_later_knots(spark):
    cp = ControlPoints(2, 1, 2, 0, 2, 1)
    assert [r[0] for r in col(spark, [1, 2, 3]).select(phi("y", cp)).collect()] == [1, 1, 1]
    low = ControlPoints(1, 0, 1, 0, 3, 1)
    assert [r[0] for r in col(spark, [0, 1, 2, 3]).select(phi("y", low)).collect()] == pytest.approx([0, 0, 0.5, 1])


def test_control_points_are_checked():
    assert as_control_points([(0, 1, 0), (1, 0, 0), (2, 1, 0)]) == ControlPoints(0, 1, 1, 0, 2, 1)
    for bad in ([(0, 1), (1, 0)], [(0, 1, 1), (1, 0, 0), (2, 1, 0)], [(0, 2), (1, 0), (2, 1)]):
        with pytest.raises(ValueError, match="control points"):
            as_control_points(bad)


def test_relevance_arguments(spark):
    df = col(spark, Y)
    with pytest.raises(ValueError, match="relevance"):
        resolve("other", df, "y")
    with pytest.raises(ValueError, match=r"\[0, 1\]"):
        resolve(lambda c: c, df, "y")
    p, cp = resolve(lambda c: F.lit(0.5), df, "y")
    assert cp is None and df.select(p).first()[0] == 0.5


def test_summary(spark):
    r = imbalance_summary(col(spark, Y), "y").first()
    assert (r.N, r.n_normal, r.n_rare, r.IR, r.pct_rare) == (10, 8, 2, 0.25, 20.0)
    with pytest.raises(ValueError, match="at least 2"):
        imbalance_summary(col(spark, [1]), "y")
    with pytest.raises(ValueError, match="finite"):
        imbalance_summary(col(spark, [1, float("inf")]), "y")
    assert math.isinf(imbalance_summary(col(spark, [1, 2]), "y", relevance=lambda c: F.lit(1.0)).first().IR)


def test_many_series_in_one_plan(spark):
    df = spark.createDataFrame([("a", float(v)) for v in Y] + [("b", 1.0), ("b", 2.0)], "k string, y double")
    got = {r.k: r for r in control_points_by(df, "y", "k").collect()}
    assert (got["a"].x_lo, got["a"].med, got["a"].x_hi, got["a"].p_hi) == (1, 5.5, 9, 1)
    assert got["b"].p_hi == 0


def test_large_paths_agree_with_small_ones(spark, monkeypatch):
    from rarespark.operators import series

    df = spark.range(5000).select((F.col("id") * 7919 % 1009).cast("double").alias("v"), "id")
    small = order_statistics(df, "v", [1, 700, 2500, 5000], 5000)
    values = sorted(i * 7919 % 1009 for i in range(5000))
    assert small == {k: values[k - 1] for k in (1, 700, 2500, 5000)}
    # as if there were many more rows: brackets from approximate quantiles
    monkeypatch.setattr(series, "WINDOW_ROWS", 10)
    monkeypatch.setattr(series, "PIECE_ROWS", 700)
    got = position(df, ["v", "id"], "p", None, 5000).orderBy("v", "id").collect()
    assert [r.p for r in got] == list(range(5000))
