"""Monte Carlo temporal splits: contiguous training windows, each followed by its test window."""

from __future__ import annotations

import math
import random
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rarespark.functions.rng import uniform_py


def temporal_windows(n: int, n_reps: int = 50, train: float = 0.5, test: float = 0.25, seed: int = 0) -> Iterator[tuple[int, int, int]]:
    """(start, end of training, end of test), ends excluded; errors come with the first one."""
    if n_reps < 1 or train <= 0 or test <= 0 or train + test > 1:
        raise ValueError(f"temporal_split: expected n_reps >= 1 and train, test > 0 with train + test <= 1; got {n_reps}, {train}, {test}.")
    n_train, n_test = math.floor(train * n), math.floor(test * n)
    if not n_train or not n_test:
        raise ValueError(f"temporal_split: {n} cases give an empty window with train={train}, test={test}.")
    for i in range(n_reps):
        a = math.floor(uniform_py(seed, "split", i) * (n - n_train - n_test + 1))
        yield a, a + n_train, a + n_train + n_test


def temporal_split(df: DataFrame, n_reps: int = 50, train: float = 0.5, test: float = 0.25, seed: int | None = None, time: str = "t") -> Iterator[tuple[DataFrame, DataFrame]]:
    """The training and the test rows of each split. ``time`` counts rows without gaps, from any
    start. Without a ``seed`` every call splits anew."""
    low = df.agg(F.min(time).alias("a"), F.count("*").alias("n")).first()
    seed = random.SystemRandom().getrandbits(31) if seed is None else seed
    for a, b, e in temporal_windows(low.n, n_reps, train, test, seed):
        at = F.col(time) - F.lit(low.a)
        yield df.where((at >= a) & (at < b)), df.where((at >= b) & (at < e))


def split_table(spark, windows: list[tuple[int, int, int]]) -> DataFrame:
    return spark.createDataFrame([(i, *w) for i, w in enumerate(windows)], "split int, a bigint, b bigint, e bigint")


def split_frames(df: DataFrame, windows: list[tuple[int, int, int]], time: str = "t") -> DataFrame:
    """All splits at once: rows with split and part (train or test), by a broadcast range join
    with the few windows."""
    w = F.broadcast(split_table(df.sparkSession, windows))
    got = df.join(w, (df[time] >= w["a"]) & (df[time] < w["e"]))
    return got.withColumn("part", F.when(F.col(time) < F.col("b"), "train").otherwise("test")).drop("a", "b", "e")
