"""Bumps: runs of cases in value order between crossings of the relevance threshold."""

from __future__ import annotations

import warnings
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rarespark.functions.relevance import ControlPoints


@dataclass
class Bump:
    bump: int
    size: int
    mean_phi: float
    rare: bool
    normal: bool
    positive: int = 0
    c: float = 1.0
    n_out: int = 0


def _is_rare(phi: Column, threshold: float, rule: str) -> Column:
    return phi >= threshold if rule == "over" else phi > threshold


def label_by_window(df: DataFrame, target: str, phi: str, order_by: str, threshold: float, rule: str) -> DataFrame:
    """Add ``bump``, for any phi: a sort of all rows by value in one task."""
    w = Window.orderBy(target, order_by)
    p = F.col(phi)
    if rule == "over":
        cut = (p >= threshold) != F.lag(p >= threshold).over(w)
    else:
        s = F.when(p > threshold, -p).otherwise(p)
        cut = s * F.lag(s).over(w) < 0
    return df.withColumn("_cut", F.when(cut, 1).otherwise(0)).withColumn("bump", F.sum("_cut").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_cut")


def label_by_value(df: DataFrame, target: str, phi: str, cp: ControlPoints, threshold: float, rule: str) -> DataFrame:
    """Add ``bump`` without a sort. With increasing control points phi falls to the median and
    rises from it, so bumps are intervals of values. A side's rare cases are a bump of their own
    unless (under, smote) the nearest other case, that of most relevance, has none."""
    y, rare = F.col(target), _is_rare(F.col(phi), threshold, rule)
    side = F.when(rare & (y < cp.med), 0).when(rare, 3).when(y < cp.med, 1).otherwise(2)
    p = F.col(phi)
    got = {r.s: r for r in df.groupBy(side.alias("s")).agg(F.min_by(p, y).alias("first"), F.max_by(p, y).alias("last")).collect()}
    # phi of the least and of the largest value that isn't rare
    ordinary = [got[s] for s in (1, 2) if s in got]
    edge = {0: ordinary[0]["first"], 3: ordinary[-1]["last"]} if ordinary else {}
    bump, ids, last = 0, {}, None
    for s in sorted(got):
        crosses = last is not None and (s == 3) != (last == 0)
        # both sides rare and nothing between them: there is no edge to fall below
        if crosses and (rule == "over" or edge[0 if last == 0 else 3] > 0):
            bump += 1
        ids[s], last = bump, s
    tree = F.lit(None).cast("int")
    for s, b in ids.items():
        tree = F.when(side == s, F.lit(b)).otherwise(tree)
    return df.withColumn("bump", tree)


def label(df: DataFrame, target: str, phi: str, order_by: str, threshold: float, rule: str, cp: ControlPoints | None) -> DataFrame:
    if cp is not None and cp.strict and cp.p_med == 0 and threshold > 0:
        return label_by_value(df, target, phi, cp, threshold, rule)
    return label_by_window(df, target, phi, order_by, threshold, rule)


def measured(labelled: DataFrame, phi: str, threshold: float, rule: str) -> list[Bump]:
    """All bumps, in value order. A mean of exactly the threshold makes a bump of under and smote neither."""
    rows = labelled.groupBy("bump").agg(F.count("*").alias("n"), F.avg(phi).alias("m"), F.sum(F.when(F.col(phi) > 0, 1).otherwise(0)).alias("p")).orderBy("bump").collect()
    return [Bump(r.bump, r.n, r.m, r.m >= threshold if rule == "over" else r.m > threshold, r.m < threshold, r.p) for r in rows]


def table(labelled: DataFrame, phi: str, threshold: float, rule: str) -> list[Bump]:
    """The bumps; [] with a warning without a rare or without a normal one."""
    return balanced(measured(labelled, phi, threshold, rule), threshold)


def balanced(found: list[Bump], threshold: float) -> list[Bump]:
    """What there is to balance: ``found``, or [] with a warning."""
    missing = [kind for kind in ("rare", "normal") if not any(getattr(b, kind) for b in found)]
    if missing:
        warnings.warn(f"bumps: no {' and no '.join(missing)} bump at t_R={threshold}; nothing to resample, the input is returned unchanged.", UserWarning, stacklevel=4)
        return []
    return found
