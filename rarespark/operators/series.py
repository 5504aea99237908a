"""Ordered series: positions, order statistics, differences, embedding and their checks.

A position among all rows normally needs one task to see them all. Beyond ``WINDOW_ROWS`` rows
the order is cut at quantiles instead, each piece numbered apart, and the pieces' exact counts added.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WINDOW_ROWS = 2_000_000
FEW_ROWS = 100_000
PIECE_ROWS = 500_000
SPAN = 1 << 16  # times a task looks at together where rows meet their neighbours in time


def finite(c: Column) -> Column:
    c = c.cast("double")
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(math.inf))


def check(df: DataFrame, columns: list[str], what: str, least: int = 1) -> int:
    """One pass: the number of rows; an error where a value is null, NaN or infinite."""
    got = df.agg(F.count("*").alias("n"), *(F.sum(F.when(finite(F.col(c)), 0).otherwise(1)).alias(f"bad_{i}") for i, c in enumerate(columns))).first()
    if got["n"] < least:
        raise ValueError(f"{what}: need at least {least} values; got {got['n']}.")
    for i, c in enumerate(columns):
        if got[f"bad_{i}"]:
            raise ValueError(f"{what}: {c} must be finite (no NaN or inf); {got[f'bad_{i}']} values are not. Impute or drop them first.")
    return got["n"]


def position(df: DataFrame, order: list[str], out: str, group: list[str] | None = None, rows: int | None = None) -> DataFrame:
    """Add ``out``: 0, 1, ... in ``order``, within each of the few ``group`` values. The first
    two order columns are numeric or times when the input is large."""
    group = group or []
    if rows is None or rows <= WINDOW_ROWS:
        w = (Window.partitionBy(*group) if group else Window).orderBy(*order)
        return df.withColumn(out, F.row_number().over(w).cast("long") - 1)
    pieces = -(-rows // PIECE_ROWS)
    at = [_number(df, c) for c in order[:2]]
    keys = df.select(*(c.alias(f"v{i}") for i, c in enumerate(at)))
    every = [i / pieces for i in range(1, pieces)]
    quantiles = keys.approxQuantile("v0", every, 0.1 / pieces)
    cuts = {(v, -math.inf) for v in quantiles}
    # a value that fills pieces of its own is cut by the second column
    for v in sorted({v for v in quantiles if quantiles.count(v) > 1}) if len(at) > 1 else ():
        n = quantiles.count(v) + 1
        cuts |= {(v, w) for w in keys.where(F.col("v0") == v).approxQuantile("v1", [i / n for i in range(1, n)], 0.1 / n)}
    here = F.struct(at[0].alias("v"), (at[1] if len(at) > 1 else F.lit(0.0)).alias("w"))
    edges = F.array(*(F.struct(F.lit(float(v)).alias("v"), F.lit(float(w)).alias("w")) for v, w in sorted(cuts)))
    cut = df.withColumn("_piece", F.array_size(F.filter(edges, lambda c: c <= here)))
    sizes: dict[tuple, list[int]] = {}
    for r in cut.groupBy(*group, "_piece").count().collect():
        sizes.setdefault(tuple(r[c] for c in group), [0] * (len(cuts) + 1))[r["_piece"]] = r["count"]
    # counts are looked up, not joined: a join by ``_piece`` lets Spark derive a filter of its side from the other's columns
    shift = F.lit(0)
    for g, held in sizes.items():
        before = F.element_at(F.array(*(F.lit(n).cast("bigint") for n in accumulate(held[:-1], initial=0))), F.col("_piece") + 1)
        same = F.lit(True)
        for c, v in zip(group, g, strict=True):
            same = same & F.col(c).eqNullSafe(F.lit(v))
        shift = F.when(same, before).otherwise(shift)
    w = Window.partitionBy(*group, "_piece").orderBy(*order)
    return cut.withColumn(out, F.row_number().over(w).cast("long") - 1 + shift).drop("_piece")


def _number(df: DataFrame, name: str) -> Column:
    """A numeric column or one of times as a double in the same order."""
    return F.col(name).cast("timestamp").cast("double") if "timestamp" in dict(df.dtypes)[name] else F.col(name).cast("double")


def value_counts(df: DataFrame, value: str) -> list[tuple[float, int]]:
    """The distinct values of a frame of at most ``FEW_ROWS`` rows, in order, and how often each occurs."""
    got = df.groupBy(F.col(value).cast("double").alias("v")).agg(F.count("*").alias("n")).collect()
    return sorted((r.v, r.n) for r in got)


def ranked_values(counted: list[tuple[float, int]], ranks: list[int]) -> dict[int, float]:
    ends = list(accumulate(n for _, n in counted))
    return {k: counted[bisect_left(ends, k)][0] for k in ranks}


def order_statistics(df: DataFrame, value: str, ranks: list[int], rows: int) -> dict[int, float]:
    """The exact values at 1-based ``ranks``, without a global sort: an approximate quantile
    brackets each rank, and only the brackets' distinct values come to the driver."""
    col = F.col(value).cast("double")
    if rows <= FEW_ROWS:
        return ranked_values(value_counts(df, value), ranks)
    error = 20_000 / rows
    wanted = sorted(set(ranks))
    probs = [min(1.0, max(0.0, k / rows + s * 2 * error)) for k in wanted for s in (-1, 1)]
    q = df.select(col.alias("v")).approxQuantile("v", probs, error)
    spans: list[list[float]] = []
    for lo, hi in sorted(zip(q[::2], q[1::2], strict=True)):
        if spans and lo <= spans[-1][1]:
            spans[-1][1] = max(hi, spans[-1][1])
        else:
            spans.append([lo, hi])
    below = df.agg(*(F.sum(F.when(col < lo, 1).otherwise(0)).alias(f"b{i}") for i, (lo, _) in enumerate(spans))).first()
    inside = None
    for lo, hi in spans:
        inside = col.between(lo, hi) if inside is None else inside | col.between(lo, hi)
    held = sorted((r.v, r.n) for r in df.where(inside).groupBy(col.alias("v")).agg(F.count("*").alias("n")).collect())
    found = {}
    for i, (lo, hi) in enumerate(spans):
        seen = below[f"b{i}"]
        for v, n in held:
            if lo <= v <= hi:
                found |= {k: v for k in wanted if seen < k <= seen + n}
                seen += n
    return found


def series_index(df: DataFrame, value: str, order_by: list[str], by: str | None = None) -> DataFrame:
    """(by?, t, y): the series with its position as time."""
    rows = None if by else df.count()
    got = position(df, order_by, "t", [by] if by else None, rows)
    return got.select(*([by] if by else []), "t", F.col(value).cast("double").alias("y"))


def in_spans(series: DataFrame, back: int, ahead: int, by: str | None, near) -> DataFrame:
    """``near(rows, window)`` of ``series``, where the window shows each time its ``back``
    predecessors and ``ahead`` successors. ``t`` counts 0, 1, ... without gaps. It is cut into
    spans, and rows near a cut go to both sides, so no task sees more than a span and its edges."""
    t = F.col("t")
    spans = F.sequence(F.greatest(F.floor((t - ahead) / SPAN), F.lit(0).cast("bigint")), F.floor((t + back) / SPAN))
    cut = series.withColumn("_span", F.explode(spans))
    got = near(cut, Window.partitionBy(*([by] if by else []), "_span").orderBy("t"))
    return got.where(F.floor(t / SPAN) == F.col("_span")).drop("_span")


def difference(series: DataFrame, by: str | None = None) -> DataFrame:
    """First differences, of n - 1 values, at times 0 to n - 2."""
    got = in_spans(series, 1, 0, by, lambda rows, w: rows.withColumn("y", F.col("y") - F.lag("y").over(w))).where("t > 0")
    return got.withColumn("t", F.col("t") - 1)


def embed(series: DataFrame, k: int, horizon: int = 1, exog: list[str] | None = None, by: str | None = None, checked: bool = True) -> DataFrame:
    """(by?, t, x0..xk, exog..., y): time t's value and its k predecessors, most recent first,
    the exogenous columns of the same row, and the value ``horizon`` later.

    ``series`` has ``t`` (0, 1, ...) and ``y``. Every x is of an earlier time than its target.
    """
    if k < 1:
        raise ValueError(f"embed: expected k >= 1; got k={k}.")
    if horizon < 1:
        raise ValueError(f"embed: expected horizon >= 1; got horizon={horizon}.")
    if checked:
        n = check(series, ["y"], "embed: series")
        if not by and n < k + horizon + 1:
            raise ValueError(f"embed: series too short: {n} values give no rows with k={k}, horizon={horizon}; need at least {k + horizon + 1}.")

    def near(rows: DataFrame, w) -> DataFrame:
        lags = [F.col("y").alias("x0"), *(F.lag("y", j).over(w).alias(f"x{j}") for j in range(1, k + 1))]
        return rows.select(*([by] if by else []), "t", "_span", *lags, *(exog or []), F.lead("y", horizon).over(w).alias("_y"))

    got = in_spans(series, k, horizon, by, near)
    return got.where((F.col("t") >= k) & F.col("_y").isNotNull()).withColumnRenamed("_y", "y")
