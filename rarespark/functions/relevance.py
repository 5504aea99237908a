"""The relevance function phi over three control points, as a column expression."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ControlPoints:
    """Low, median and high knot: x and phi of each. phi at the median is 0 when fitted."""

    x_lo: float
    p_lo: float
    med: float
    p_med: float
    x_hi: float
    p_hi: float

    @property
    def strict(self) -> bool:
        return self.x_lo < self.med < self.x_hi

    def rows(self) -> list[tuple[float, float]]:
        return [(self.x_lo, self.p_lo), (self.med, self.p_med), (self.x_hi, self.p_hi)]


def as_control_points(rows: Sequence[Sequence[float]] | ControlPoints) -> ControlPoints:
    """Three rows (x, phi), or (x, phi, slope) with slopes of 0."""
    if isinstance(rows, ControlPoints):
        return rows
    got = [list(map(float, r)) for r in rows]
    if len(got) != 3 or {len(r) for r in got} not in ({2}, {3}):
        raise ValueError(f"control points: expected three rows (x, phi) or (x, phi, slope); got {rows!r}.")
    if any(r[2] != 0 for r in got if len(r) == 3):
        raise ValueError("control points: slopes (third column) must all be 0.")
    if not all(0 <= r[1] <= 1 for r in got):
        raise ValueError("control points: phi values must lie in [0, 1].")
    return ControlPoints(got[0][0], got[0][1], got[1][0], got[1][1], got[2][0], got[2][1])


def _step(y: Column, x0: Column, p0: Column, x1: Column, p1: Column) -> Column:
    width = x1 - x0
    t = (y - x0) / F.when(width > 0, width).otherwise(F.lit(1.0))
    t = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
    return p0 + (p1 - p0) * (3.0 * t * t - 2.0 * t * t * t)


def phi(y: Column | str, cp: ControlPoints | dict[str, Column]) -> Column:
    """Smoothstep between knots, constant beyond the outer ones, exact at them. With tied knots a
    value takes the segment of the last knot at or below it."""
    y = (F.col(y) if isinstance(y, str) else y).cast("double")
    if isinstance(cp, ControlPoints):
        knots = {k: F.lit(float(getattr(cp, k))) for k in ("x_lo", "p_lo", "med", "p_med", "x_hi", "p_hi")}
    else:
        knots = {"p_med": F.lit(0.0)} | cp
    x_lo, p_lo, med, p_med, x_hi, p_hi = (knots[k] for k in ("x_lo", "p_lo", "med", "p_med", "x_hi", "p_hi"))
    low, high = _step(y, x_lo, p_lo, med, p_med), _step(y, med, p_med, x_hi, p_hi)
    plain = F.when(y <= x_lo, p_lo).when(y >= x_hi, p_hi).when(y < med, low).otherwise(high)
    tied = F.when(y >= x_hi, p_hi).when(y >= med, high).when(y >= x_lo, low).otherwise(p_lo)
    if isinstance(cp, ControlPoints):
        return plain if cp.strict else tied
    return F.when((x_lo < med) & (med < x_hi), plain).otherwise(tied)


def phi_py(y: float, cp: ControlPoints) -> float:
    """The same for one number on the driver."""

    def step(x0: float, p0: float, x1: float, p1: float) -> float:
        t = min(max((y - x0) / (x1 - x0 if x1 > x0 else 1.0), 0.0), 1.0)
        return p0 + (p1 - p0) * (3.0 * t * t - 2.0 * t * t * t)

    if math.isnan(y):
        return math.nan
    if cp.strict and y <= cp.x_lo:
        return cp.p_lo
    if y >= cp.x_hi:
        return cp.p_hi
    if y >= cp.med:
        return step(cp.med, cp.p_med, cp.x_hi, cp.p_hi)
    return step(cp.x_lo, cp.p_lo, cp.med, cp.p_med) if y >= cp.x_lo else cp.p_lo
