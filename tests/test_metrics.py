"""Metrics, splits and evaluation."""

import pytest
from pyspark.sql import functions as F

from rarespark import evaluate, evaluate_metrics, f1_phi, precision_phi, recall_phi, sera, sera_curve, temporal_windows
from rarespark.operators.resampler import Resampler
from rarespark.plans.splits import split_frames

BOTH = [(-1, 1), (0, 0), (1, 1)]


def pairs(spark, y, p):
    return spark.createDataFrame([(float(a), float(b)) for a, b in zip(y, p, strict=True)], "y double, p double")


def test_sera_curve(spark):
    y = [1, -1, 0, 0.5]
    df = pairs(spark, y, [v + 1 for v in y])
    got = sera_curve(df, "y", "p", BOTH, step=0.25).orderBy("t").collect()
    assert [(r.t, r.ser) for r in got] == [(0, 4), (0.25, 3), (0.5, 3), (0.75, 2), (1, 2)]
    # the trapezoid of that curve: 0.25 * (4/2 + 3 + 3 + 2 + 2/2)
    assert sera(df, "y", "p", BOTH, step=0.25) == pytest.approx(2.75)
    assert sera(df, "y", "p", lambda c: F.lit(1.0), step=0.25) == pytest.approx(4.0)
    for step in (0, 0.3, 2):
        with pytest.raises(ValueError, match="step"):
            sera(df, "y", "p", BOTH, step=step)


def test_perfect_forecast(spark):
    y = [0.1, -0.2, 3, 0, 0.3, -0.1, 0.2, -2.5]
    assert f1_phi(pairs(spark, y, y), "y", "p") == pytest.approx(1.0)


def test_nothing_relevant_gives_the_floor(spark):
    df = pairs(spark, [0, 0.1, 0.2], [0, 0, 0])
    assert recall_phi(df, "y", "p", BOTH) == precision_phi(df, "y", "p", BOTH) == 1e-5


def test_worst_forecast(spark):
    df = pairs(spark, [1, 0], [-1, 0])
    assert recall_phi(df, "y", "p", BOTH) == 0
    assert f1_phi(df, "y", "p", BOTH) == 0


def test_metric_arguments(spark):
    df = pairs(spark, [1, 2], [1, 2])
    for bad in ("x", lambda c: c, F.lit(0.5)):
        with pytest.raises(ValueError):
            evaluate_metrics(df, "y", "p", bad)
    with pytest.raises(ValueError, match="finite"):
        evaluate_metrics(pairs(spark, [1, float("nan")], [1, 2]), "y", "p")


def test_windows(spark):
    got = list(temporal_windows(721, 20, seed=3))
    assert all((b - a, e - b) == (360, 180) and 0 <= a and e <= 721 for a, b, e in got) and len(set(got)) > 10
    for kw in ({"train": 0.8, "test": 0.3}, {"train": 0.001}):
        with pytest.raises(ValueError):
            list(temporal_windows(100, 1, **kw))
    rows = split_frames(spark.range(721).withColumnRenamed("id", "t"), got[:2]).groupBy("split", "part").count().collect()
    assert sorted((r.split, r.part, r["count"]) for r in rows) == [(0, "test", 180), (0, "train", 360), (1, "test", 180), (1, "train", 360)]


def test_evaluate_fits_relevance_on_training_targets(spark):
    y = [50.0 if i % 9 == 8 else float(i % 5) for i in range(80)]
    df = spark.createDataFrame([(i, y[i - 1] if i else 0.0, y[i]) for i in range(80)], "t bigint, x0 double, y double")
    seen = []

    def probe(frame, y_true, y_pred, *, relevance):
        seen.append(relevance)
        return 1.0

    got = evaluate(df, ["x0"], strategies={"baseline": None, "OVERB": Resampler("over")}, metrics={"probe": probe}, splitter=lambda d: [(d.where("t < 40"), d.where("t >= 40").withColumn("y", F.col("y") * 1000))]).collect()
    assert sorted((r.strategy, r.split, r.metric, r.value) for r in got) == [("OVERB", 0, "probe", 1.0), ("baseline", 0, "probe", 1.0)]
    assert all(cp.x_hi <= 50 for cp in seen)
    rows = evaluate(df, ["x0"], strategies={"baseline": None, "OVERB": Resampler("over")}, n_reps=1).collect()
    assert {(r.strategy, r.metric) for r in rows} == {(s, m) for s in ("baseline", "OVERB") for m in ("precision_phi", "recall_phi", "f1_phi", "sera")}
