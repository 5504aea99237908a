"""Evaluation of strategies over splits, without leakage: relevance is fitted on training targets only."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from concurrent.futures import Future, ThreadPoolExecutor

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rarespark.functions.rng import uniform_py
from rarespark.operators.metrics import evaluate_metrics
from rarespark.operators.relevance import control_points
from rarespark.operators.resampler import Resampler
from rarespark.operators.series import finite
from rarespark.plans import cells
from rarespark.plans.splits import temporal_split, temporal_windows

SCHEMA = "strategy string, split int, metric string, value double"
TASK_ROWS = 5_000_000  # of a window whose cells are one task


def solved(s: np.ndarray) -> np.ndarray:
    """The weights that the sums of products give."""
    return np.linalg.lstsq(s[:-1, :-1], s[:-1, -1], rcond=None)[0]


class LeastSquares:
    """Linear regression by the normal equations, whose sums are one aggregation."""

    def fit(self, df: DataFrame, features: list[str], target: str) -> LeastSquares:
        cols = [F.lit(1.0), *(F.col(f) for f in features), F.col(target)]
        n = len(cols)
        row = df.agg(*(F.sum(cols[i] * cols[j]).alias(f"s{i}_{j}") for i in range(n) for j in range(i, n))).first()
        s = np.zeros((n, n))
        for i in range(n):
            for j in range(i, n):
                s[i, j] = s[j, i] = row[f"s{i}_{j}"]
        self.weights = solved(s)
        self.features = features
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        out = F.lit(float(self.weights[0]))
        for w, f in zip(self.weights[1:], self.features, strict=True):
            out = out + float(w) * F.col(f)
        return df.withColumn("prediction", out)


class MLEstimator:
    """Any ``pyspark.ml`` regressor with the columns features, label and prediction."""

    def __init__(self, estimator):
        self.estimator = estimator

    def fit(self, df: DataFrame, features: list[str], target: str) -> MLEstimator:
        from pyspark.ml.feature import VectorAssembler

        got = MLEstimator(self.estimator.copy())
        got.assembler = VectorAssembler(inputCols=features, outputCol="features")
        got.model = got.estimator.fit(got.assembler.transform(df).withColumn("label", F.col(target)))
        return got

    def predict(self, df: DataFrame) -> DataFrame:
        return self.model.transform(self.assembler.transform(df)).drop("features")


def default_strategies(seed: int | None = None) -> dict[str, Resampler | None]:
    """No resampling, and the nine strategies."""
    grid: dict[str, Resampler | None] = {"baseline": None}
    for strategy in ("under", "over", "smote"):
        for bias, suffix in ((None, "B"), ("temporal", "T"), ("temporal+phi", "TPhi")):
            grid[strategy.upper() + suffix] = Resampler(strategy, bias, seed=seed)
    return grid


def _cell_seed(strategy: Resampler, seed: int, split: int, name: str) -> int:
    return int(uniform_py(seed, "cell", split, name) * (2**31 - 1)) if strategy.seed is None else strategy.seed


def _in_tasks(df: DataFrame, features: list[str], target: str, time: str, strategies: Mapping[str, Resampler | None], n_reps: int, seed: int) -> list[tuple] | None:
    """The rows of ``evaluate``; None where a window isn't one task's work, or for the operators to refuse."""
    fit = F.lit(True)
    for c in (time, *features, target):
        fit = fit & finite(F.col(c))
    low = df.agg(F.min(time).alias("a"), F.count("*").alias("n"), F.count(F.when(fit, 1)).alias("fit")).first()
    if not isinstance(low.a, int) or low.fit < low.n:
        return None
    windows = [(a + low.a, b + low.a, e + low.a) for a, b, e in temporal_windows(low.n, n_reps, seed=seed)]
    if windows[0][1] - windows[0][0] < 2 or windows[0][2] - windows[0][0] > TASK_ROWS:
        return None
    names, held = list(strategies), list(strategies.values())
    seeds = [[0 if s is None else _cell_seed(s, seed, i, name) for name, s in strategies.items()] for i in range(n_reps)]
    got = cells.together(df, features, target, time, windows, held, seeds, solved)
    return [(names[j], i, cells.METRICS[m], v) for i, j, m, v in got]


def evaluate(df: DataFrame, features: list[str], target: str = "y", time: str = "t", estimator=None, strategies: Mapping[str, Resampler | None] | None = None, metrics: Mapping[str, Callable[..., float]] | None = None, splitter: Callable[[DataFrame], Iterable[tuple[DataFrame, DataFrame]]] | None = None, n_reps: int = 50, seed: int = 0, parallelism: int = 4) -> DataFrame:
    """(strategy, split, metric, value) of every cell of the grid.

    ``time`` counts rows 0, 1, ... without gaps. A metric is f(df, y_true, y_pred, relevance=);
    by default all four come from one aggregation. Strategies without a seed get one of their own
    in every cell, so equal splits differ. Resampled cells of the default estimator, metrics and splitter run in
    one job, a split in a task (windows of at most ``TASK_ROWS`` rows); all others from ``parallelism`` threads.
    """
    spark = df.sparkSession
    strategies = strategies or default_strategies()
    resamples = any(strategies.values()) and all(s is None or type(s) is Resampler for s in strategies.values())
    if resamples and (estimator is None or type(estimator) is LeastSquares) and not metrics and splitter is None:
        rows = _in_tasks(df, features, target, time, strategies, n_reps, seed)
        if rows is not None:
            return spark.createDataFrame(rows, SCHEMA)

    def parts() -> Iterable[tuple[DataFrame, DataFrame]]:
        return splitter(df) if splitter is not None else temporal_split(df, n_reps, seed=seed, time=time)

    def cell(i: int, train: DataFrame, test: DataFrame, points: Future, name: str, strategy: Resampler | None) -> list[tuple]:
        fitted_on, cp = train, points.result()
        if strategy is not None:
            own = strategy.copy().set_params(relevance=cp)
            own.seed = _cell_seed(own, seed, i, name)
            fitted_on = own.fit_resample(train, features, target, time)
        got = (estimator or LeastSquares()).fit(fitted_on, features, target).predict(test)
        if metrics:
            return [(name, i, m, float(f(got, target, "prediction", relevance=cp))) for m, f in metrics.items()]
        row = evaluate_metrics(got, target, "prediction", cp).first()
        return [(name, i, m, float(row[m])) for m in ("precision_phi", "recall_phi", "f1_phi", "sera")]

    with ThreadPoolExecutor(parallelism) as pool:
        jobs = []
        for i, (train, test) in enumerate(parts()):
            # ahead of the cells that wait for it in the queue
            points = pool.submit(control_points, train, target)
            jobs += [pool.submit(cell, i, train, test, points, name, s) for name, s in strategies.items()]
        rows = [r for j in jobs for r in j.result()]
    return spark.createDataFrame(rows, SCHEMA)
