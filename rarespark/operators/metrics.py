"""Relevance-aware metrics of a forecast, all from one aggregation over its rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rarespark.functions.relevance import ControlPoints, as_control_points, phi
from rarespark.functions.utility import utility
from rarespark.operators.relevance import Relevance, control_points, resolve
from rarespark.operators.series import check

FLOOR = 1e-5  # of precision and recall where no case counts


def _pair(df: DataFrame, y_true: str, y_pred: str) -> DataFrame:
    check(df, [y_true, y_pred], "metrics: y_true and y_pred")
    return df


def utility_points(relevance: Relevance, df: DataFrame, y_true: str) -> ControlPoints:
    """Control points for the utility surface; "auto" fits them on ``y_true``."""
    if isinstance(relevance, str) and relevance == "auto":
        return control_points(df, y_true)
    if isinstance(relevance, ControlPoints) or (not isinstance(relevance, str | Column) and not callable(relevance)):
        return as_control_points(relevance)
    raise ValueError("precision, recall and F need relevance='auto' or control points; relevance by case or by function gives neither phi of the forecast nor utility bumps.")


def sera_weight(p: Column, steps: int) -> Column:
    """The trapezoid's share of [0, 1] that a squared error of relevance ``p`` counts for."""
    near = F.floor(p * steps).cast("int")
    step = 1.0 / steps
    m = near + 1 + F.when((near + 1) * step <= p, 1).otherwise(0) - F.when(near * step > p, 1).otherwise(0)
    return F.when(m >= steps + 1, 1.0).otherwise((m - 0.5) / steps)


def sera_steps(step: float) -> int:
    n = round(1 / step) if 0 < step <= 1 else 0
    if not n or abs(n * step - 1) > 1e-9:
        raise ValueError(f"sera: step must be 1/m for an integer m >= 1; got {step}.")
    return n


def evaluate_metrics(df: DataFrame, y_true: str, y_pred: str, relevance: Relevance = "auto", rel_threshold: float = 0.9, beta: float = 1.0, step: float = 0.001) -> DataFrame:
    """One row: precision_phi, recall_phi, f1_phi, sera."""
    steps = sera_steps(step)
    cp = utility_points(relevance, _pair(df, y_true, y_pred), y_true)
    u, phi_y, phi_p = utility(y_pred, y_true, cp), phi(y_true, cp), phi(y_pred, cp)
    held = df.select(F.col(y_true).cast("double").alias("_y"), F.col(y_pred).cast("double").alias("_p"), u.alias("_u"), phi_y.alias("_fy"), phi_p.alias("_fp"))
    sums = {}
    for name, p in (("recall_phi", "_fy"), ("precision_phi", "_fp")):
        chosen = F.col(p) >= rel_threshold
        sums[name] = F.coalesce(F.sum(F.when(chosen, F.abs(F.col("_u") + 1.0))) / F.sum(F.when(chosen, F.abs(F.col(p) + 1.0))), F.lit(FLOOR))
    error = F.col("_y") - F.col("_p")
    sums["sera"] = F.sum(error * error * sera_weight(F.col("_fy"), steps))
    got = held.agg(*(c.alias(k) for k, c in sums.items()))
    p, r, b2 = F.col("precision_phi"), F.col("recall_phi"), beta * beta
    f = F.when((p == 0) | (r == 0), 0.0).otherwise((1 + b2) * p * r / (b2 * p + r))
    return got.select("precision_phi", "recall_phi", f.alias("f1_phi"), "sera")


def precision_phi(df: DataFrame, y_true: str, y_pred: str, relevance: Relevance = "auto", rel_threshold: float = 0.9) -> float:
    return evaluate_metrics(df, y_true, y_pred, relevance, rel_threshold).first()["precision_phi"]


def recall_phi(df: DataFrame, y_true: str, y_pred: str, relevance: Relevance = "auto", rel_threshold: float = 0.9) -> float:
    return evaluate_metrics(df, y_true, y_pred, relevance, rel_threshold).first()["recall_phi"]


def f1_phi(df: DataFrame, y_true: str, y_pred: str, relevance: Relevance = "auto", rel_threshold: float = 0.9, beta: float = 1.0) -> float:
    return evaluate_metrics(df, y_true, y_pred, relevance, rel_threshold, beta).first()["f1_phi"]


def sera(df: DataFrame, y_true: str, y_pred: str, relevance: Relevance = "auto", step: float = 0.001) -> float:
    """Squared error-relevance area; takes every form of relevance."""
    steps = sera_steps(step)
    p, _ = resolve(relevance, _pair(df, y_true, y_pred), y_true)
    e = F.col(y_true).cast("double") - F.col(y_pred).cast("double")
    return df.agg(F.sum(e * e * sera_weight(p, steps)).alias("s")).first()["s"]


def sera_curve(df: DataFrame, y_true: str, y_pred: str, relevance: Relevance = "auto", step: float = 0.001) -> DataFrame:
    """(t, ser): the squared error of cases of relevance t or more, on the whole grid."""
    steps = sera_steps(step)
    p, _ = resolve(relevance, _pair(df, y_true, y_pred), y_true)
    near = F.floor(p * steps).cast("int")
    cell = near + F.when((near + 1) * (1.0 / steps) <= p, 1).otherwise(0) - F.when(near * (1.0 / steps) > p, 1).otherwise(0)
    e = F.col(y_true).cast("double") - F.col(y_pred).cast("double")
    sums = df.select(F.least(cell, F.lit(steps)).alias("i"), (e * e).alias("e")).groupBy("i").agg(F.sum("e").alias("e"))
    grid = df.sparkSession.range(steps + 1).select(F.col("id").cast("int").alias("i"))
    w = Window.orderBy("i").rowsBetween(0, Window.unboundedFollowing)
    return grid.join(F.broadcast(sums), "i", "left").select((F.col("i") / steps).alias("t"), F.sum(F.coalesce("e", F.lit(0.0))).over(w).alias("ser"))
