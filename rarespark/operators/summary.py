"""Imbalance summaries: how many cases are rare."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rarespark.functions.relevance import phi
from rarespark.operators.relevance import Relevance, control_points_by, resolve
from rarespark.operators.series import check


def imbalance_summary(df: DataFrame, value: str, rel_threshold: float = 0.9, relevance: Relevance = "auto") -> DataFrame:
    """One row: N, n_normal, n_rare, IR (rare over normal, infinite if none is normal), pct_rare."""
    base = df.select(F.col(value).cast("double").alias(value)) if not hasattr(relevance, "_jc") else df
    check(base, [value], "imbalance_summary", least=2)
    p, _ = resolve(relevance, base, value)
    rare = F.sum(F.when(p >= rel_threshold, 1).otherwise(0))
    return _ratios(base.agg(F.count("*").alias("N"), rare.alias("n_rare")))


def _ratios(counted: DataFrame, *by: str) -> DataFrame:
    normal = F.col("N") - F.col("n_rare")
    ratio = F.when(normal > 0, F.col("n_rare") / F.greatest(normal, F.lit(1))).otherwise(F.lit(math.inf))
    return counted.select(*by, F.col("N").cast("bigint"), normal.cast("bigint").alias("n_normal"), F.col("n_rare").cast("bigint"), ratio.alias("IR"), (100.0 * F.col("n_rare") / F.col("N")).alias("pct_rare"))


def imbalance_summary_by(df: DataFrame, value: str, by: str, rel_threshold: float = 0.9) -> DataFrame:
    """A row for each series, fitted on its own values, in one plan."""
    check(df, [value], "imbalance_summary")
    cp = control_points_by(df, value, by)
    knots = {k: F.col(k) for k in ("x_lo", "p_lo", "med", "x_hi", "p_hi")}
    rare = F.sum(F.when(phi(value, knots) >= rel_threshold, 1).otherwise(0))
    return _ratios(df.select(by, value).join(cp, by).groupBy(by).agg(F.count("*").alias("N"), rare.alias("n_rare")), by)
