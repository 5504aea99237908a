"""``Resampler``: builds the plan of one of the nine strategies. The training frame is written once,
checked, fitted and labelled; it is written again with its bumps and positions, and all that the
result is made of reads that table."""

from __future__ import annotations

import copy as copying
import random
from collections.abc import Callable
from types import SimpleNamespace
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rarespark.operators import bumps, counts, draws, synth
from rarespark.operators.relevance import Relevance, resolve
from rarespark.operators.series import check, position
from rarespark.sources.shared import written


class Resampler:
    """Rebalance an imbalanced regression training frame.

    strategy: "under", "over" or "smote"; bias: None, "temporal" or "temporal+phi". ``relevance``
    is "auto", control points, a column or a callable of the target's column. ``o`` and ``u``
    multiply rare and normal bumps instead of balancing. ``r_quirks`` keeps the original method's
    reading of neighbours by value and its target weights from the first feature.

    ``fit_resample`` returns the features and target with ``order_by``, ``origin`` (original, copy
    or synthetic) and ``seq`` (its number among rows of one origin and time). Rows sort in time by
    (order_by, origin = synthetic, seq). Times must be unique. Without a ``seed`` every call draws anew.
    """

    _names = ("strategy", "bias", "rel_threshold", "relevance", "k", "o", "u", "r_quirks", "seed")

    def __init__(self, strategy: str = "smote", bias: str | None = None, *, rel_threshold: float = 0.9, relevance: Relevance = "auto", k: int = 5, o: float | None = None, u: float | None = None, r_quirks: bool = True, seed: int | None = None):
        given = locals()
        for name in self._names:
            setattr(self, name, given[name])

    def get_params(self, deep: bool = True) -> dict[str, Any]:
        return {n: getattr(self, n) for n in self._names}

    def set_params(self, **params: Any) -> Resampler:
        for n, v in params.items():
            if n not in self._names:
                raise ValueError(f"Resampler has no parameter {n!r}.")
            setattr(self, n, v)
        return self

    def copy(self) -> Resampler:
        return Resampler(**{n: copying.copy(v) if isinstance(v, list | dict) else v for n, v in self.get_params().items()})

    def for_tasks(self) -> SimpleNamespace:
        """The checked parameters, without relevance, in a form that workers get by value."""
        self._check()
        return SimpleNamespace(**{n: v for n, v in self.get_params().items() if n != "relevance"})

    def _check(self) -> None:
        for name, allowed in (("strategy", counts.STRATEGIES), ("bias", draws.BIASES)):
            if getattr(self, name) not in allowed:
                raise ValueError(f"{name}: expected one of {allowed}; got {getattr(self, name)!r}.")
        if not isinstance(self.k, int) or isinstance(self.k, bool) or self.k < 1:
            raise ValueError(f"k: expected an integer >= 1; got {self.k!r}.")
        counts.check_percentages(self.strategy, self.o, self.u)

    def labelled(self, df: DataFrame, target: str, order_by: str, rows: int | None = None, listed: Callable[..., list[bumps.Bump]] = bumps.table) -> tuple[DataFrame, list[bumps.Bump]]:
        """Rows with phi and bump, and the bumps; with ``bumps.measured`` also where there is nothing to balance."""
        phi, cp = resolve(self.relevance, df, target, rows)
        with_phi = df.withColumn("phi", phi)
        got = bumps.label(with_phi, target, "phi", order_by, self.rel_threshold, self.strategy, cp)
        return got, listed(got, "phi", self.rel_threshold, self.strategy)

    def fit_resample(self, df: DataFrame, features: list[str], target: str, order_by: str) -> DataFrame:
        self._check()
        base = df.select(order_by, *(F.col(f).cast("double").alias(f) for f in features), F.col(target).cast("double").alias(target))
        base = written(base, "resample-rows")
        n = check(base, [*features, target], "resample: X and y", least=2)
        seed = random.SystemRandom().getrandbits(31) if self.seed is None else self.seed
        got, found = self.labelled(base, target, order_by, n)
        out = [order_by, *features, target]
        as_is = lambda d, origin, seq: d.select(*out, F.lit(origin).alias("origin"), seq.cast("bigint").alias("seq"))
        zero = F.lit(0)
        if not found:
            return as_is(base, "original", zero)
        counts.assign(found, n, self.strategy, self.o, self.u)
        rows = draws.ranked(got, found, order_by)
        if self.strategy == "smote":
            rows = position(rows, [target, order_by], "by_value", ["bump"], n)
        got = rows = written(rows, "resample-bumps")
        if self.strategy == "over":
            extra = {b.bump: b.n_out - b.size for b in found}
            drawn = draws.with_replacement(rows, [b for b in found if extra[b.bump]], extra, self.bias, seed, "over")
            return as_is(got, "original", zero).unionByName(as_is(drawn, "copy", F.col("draw")))
        shrunk = [b for b in found if b.n_out < b.size]
        kept = [b.bump for b in found if b.n_out >= b.size]
        parts = as_is(got.where(F.col("bump").isin(kept)), "original", zero)
        if self.strategy == "under":
            return parts.unionByName(as_is(draws.without_replacement(rows, shrunk, self.bias, seed, order_by), "original", zero))
        if any(b.n_out for b in shrunk):
            drawn = draws.with_replacement(rows, shrunk, {b.bump: b.n_out for b in shrunk}, self.bias, seed, "smote_under")
            parts = parts.unionByName(as_is(drawn, "copy", F.col("draw")))
        jobs = [b for b in found if b.n_out > b.size]
        if jobs:
            made = synth.synthesize(got, jobs, features, target, order_by, self.bias, self.k, seed, self.r_quirks)
            parts = parts.unionByName(as_is(made.withColumnRenamed("seed_t", order_by), "synthetic", F.col("copy")))
        return parts


def in_order(df: DataFrame, order_by: str) -> DataFrame:
    """Resampled rows in time order, each synthetic case after its seed."""
    return df.orderBy(order_by, F.when(F.col("origin") == "synthetic", 1).otherwise(0), "seq")
