"""Fitting control points, and resolving what a caller gives as relevance."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rarespark.functions.relevance import ControlPoints, as_control_points, phi
from rarespark.operators.series import FEW_ROWS, order_statistics, ranked_values, value_counts

WHISKER = 1.5


def hinge_ranks(n: int) -> list[tuple[int, int]]:
    """For both hinges and the median the two 1-based ranks whose mean they are."""
    depth = math.floor((n + 3) / 2) / 2
    return [(math.floor(d), math.ceil(d)) for d in (depth, (n + 1) / 2, n + 1 - depth)]


def knots(least: float, low: float, med: float, high: float, most: float) -> ControlPoints:
    """Of the extremes, the whiskers and the median."""
    return ControlPoints(*((low, 1.0) if least < low else (least, 0.0)), med, 0.0, *((high, 1.0) if most > high else (most, 0.0)))


def _clean(df: DataFrame, value: str, rows: int | None) -> tuple[DataFrame, int]:
    clean = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    n = clean.count() if rows is None else rows
    if not n:
        raise ValueError("control_points: y has no non-NaN values; expected >= 1.")
    return clean, n


def tukey_hinges(df: DataFrame, value: str, rows: int | None = None) -> tuple[float, float, float]:
    """Lower hinge, median and upper hinge; ``rows`` is the number of values, if known."""
    clean, n = _clean(df, value, rows)
    ranks = hinge_ranks(n)
    found = order_statistics(clean, value, [r for pair in ranks for r in pair], n)
    return tuple(0.5 * (found[a] + found[b]) for a, b in ranks)


def control_points(df: DataFrame, value: str, rows: int | None = None) -> ControlPoints:
    """Fit on all non-null, non-NaN values: the outer knots are the whiskers with phi 1, or the
    extremes with phi 0 on a side without outliers. ``rows`` is the number of values, if known."""
    clean, n = _clean(df, value, rows)
    if n <= FEW_ROWS:  # one pass brings the counted values, and all else follows from them
        held = value_counts(clean, value)
        ranks = hinge_ranks(n)
        found = ranked_values(held, [r for pair in ranks for r in pair])
        q1, med, q3 = (0.5 * (found[a] + found[b]) for a, b in ranks)
        inside = [v for v, _ in held if q1 - WHISKER * (q3 - q1) <= v <= q3 + WHISKER * (q3 - q1)]
        least, most, low, high = held[0][0], held[-1][0], inside[0], inside[-1]
    else:
        q1, med, q3 = tukey_hinges(df, value, n)
        lo, hi = q1 - WHISKER * (q3 - q1), q3 + WHISKER * (q3 - q1)
        y = F.col(value).cast("double")
        least, most, low, high = clean.agg(F.min(y), F.max(y), F.min(F.when(y >= lo, y)), F.max(F.when(y <= hi, y))).first()
    return knots(least, low, med, high, most)


def control_points_by(df: DataFrame, value: str, by: str) -> DataFrame:
    """(by, n, q1, med, q3, x_lo, p_lo, x_hi, p_hi) of many series in one plan; a series is sorted in one task."""
    y = F.col(value).cast("double")
    clean = df.select(F.col(by), y.alias("y")).where(F.col("y").isNotNull() & ~F.isnan("y"))
    ranked = clean.withColumns({"rn": F.row_number().over(Window.partitionBy(by).orderBy("y")), "n": F.count("*").over(Window.partitionBy(by))})
    ranked = ranked.withColumn("d1", F.floor((F.col("n") + 3) / 2) / 2)
    depth = {"q1": F.col("d1"), "med": (F.col("n") + 1) / 2, "q3": F.col("n") + 1 - F.col("d1")}
    at = lambda d: (F.max(F.when(F.col("rn") == F.floor(d), F.col("y"))) + F.max(F.when(F.col("rn") == F.ceil(d), F.col("y")))) * 0.5
    h = ranked.groupBy(by).agg(F.max("n").alias("n"), *(at(d).alias(k) for k, d in depth.items()))
    both = clean.join(h, by)
    iqr = F.col("q3") - F.col("q1")
    got = both.groupBy(by, "n", "q1", "med", "q3").agg(
        F.min("y").alias("a"), F.max("y").alias("b"), F.min(F.when(F.col("y") >= F.col("q1") - WHISKER * iqr, F.col("y"))).alias("lw"), F.max(F.when(F.col("y") <= F.col("q3") + WHISKER * iqr, F.col("y"))).alias("uw")
    )
    low, high = F.col("a") < F.col("lw"), F.col("b") > F.col("uw")
    return got.select(
        by, "n", "q1", "med", "q3",
        F.when(low, F.col("lw")).otherwise(F.col("a")).alias("x_lo"), F.when(low, 1.0).otherwise(0.0).alias("p_lo"),
        F.when(high, F.col("uw")).otherwise(F.col("b")).alias("x_hi"), F.when(high, 1.0).otherwise(0.0).alias("p_hi"),
    )


Relevance = str | ControlPoints | list | Column | Callable[[Column], Column]


def resolve(relevance: Relevance, df: DataFrame, target: str, rows: int | None = None) -> tuple[Column, ControlPoints | None]:
    """phi of ``target``: "auto" fits on it, control points are used as they are, a Column is phi
    per row, a callable makes it of the target. The last two must lie in [0, 1], without NaN."""
    if isinstance(relevance, Column) or callable(relevance):
        got = relevance if isinstance(relevance, Column) else relevance(F.col(target))
        p = got.cast("double")
        if df.where(p.isNull() | F.isnan(p) | (p < 0) | (p > 1)).limit(1).count():
            raise ValueError("relevance: values must lie in [0, 1] (and not be NaN).")
        return p, None
    if isinstance(relevance, str):
        if relevance != "auto":
            raise ValueError(f"relevance: expected 'auto', control points, a column or a callable; got {relevance!r}.")
        cp = control_points(df, target, rows)
    else:
        cp = as_control_points(relevance)
    return phi(target, cp), cp
