"""Preference weights within bumps, and weighted draws that need no driver and no row order.

Without replacement the cases of smallest -ln(u)/w are taken, which has the same inclusion
probabilities as drawing one after the other. With replacement each draw's number is turned into
a rank by the inverse of the weights' distribution.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rarespark.functions.rng import uniform
from rarespark.operators.bumps import Bump
from rarespark.operators import series
from rarespark.operators.series import position

#: Keys of cases without weight come after all others.
LAST = 1e300
BIASES = (None, "temporal", "temporal+phi")


def weight(bias: str | None, phi: str = "phi") -> Column:
    """Of a row with its 1-based ``rank`` in time within its bump and the bump's ``size``."""
    if bias is None:
        return 1.0 / F.col("size")
    w = F.col("rank") / F.col("size")
    return w * F.col(phi) if bias == "temporal+phi" else w


def ranked(labelled: DataFrame, found: list[Bump], order_by: str) -> DataFrame:
    """Add ``rank`` (1 up, in time, within the bump) and ``size``."""
    rows = sum(b.size for b in found)
    got = position(labelled, [order_by], "rank", ["bump"], rows).withColumn("rank", F.col("rank") + 1)
    return got.withColumn("size", _of(found, "size", "bigint"))


def _of(found: list[Bump], field: str, kind: str) -> Column:
    out = F.lit(None).cast(kind)
    for b in found:
        out = F.when(F.col("bump") == b.bump, F.lit(getattr(b, field)).cast(kind)).otherwise(out)
    return out


def preferences(rows: DataFrame, bias: str | None, phi: str = "phi") -> DataFrame:
    """Add ``p``: probabilities that sum to 1 in each bump; uniform where all weights are 0."""
    w = rows.withColumn("_w", weight(bias, phi))
    total = F.sum("_w").over(Window.partitionBy("bump"))
    return w.withColumn("p", F.when(total > 0, F.col("_w") / total).otherwise(1.0 / F.col("size"))).drop("_w")


def topped_up(b: Bump, bias: str | None) -> None:
    """Warn where a bump has fewer cases with a weight than are drawn without replacement."""
    if bias == "temporal+phi" and 0 < b.positive < b.n_out:
        warnings.warn(f"draw: only {b.positive} cases have positive preference but {b.n_out} are needed without replacement; the rest are drawn uniformly.", UserWarning, stacklevel=4)


def without_replacement(rows: DataFrame, found: list[Bump], bias: str | None, seed: int, order_by: str, stream: str = "under") -> DataFrame:
    """``n_out`` distinct rows of each bump of ``found``. Where fewer rows have a weight, all of
    these are taken, the rest uniformly, with a warning."""
    if not found:
        return rows.where(F.lit(False))
    for b in found:
        topped_up(b, bias)
    u = uniform(seed, stream, "bump", order_by)
    w = weight(bias)
    keyed = rows.where(F.col("bump").isin([b.bump for b in found]))
    keyed = keyed.withColumn("_key", F.when(w > 0, -F.log(u) / w).otherwise((u + 1.0) * LAST))
    got = position(keyed, ["_key", order_by], "_take", ["bump"], sum(b.size for b in found))
    return got.where(F.col("_take") < _of(found, "n_out", "bigint")).drop("_take", "_key")


def draw_ranks(spark, found: list[Bump], draws: dict[int, int], seed: int, stream: str) -> DataFrame:
    """(bump, size, draw, u): one row a draw, made where it is used."""
    out = spark.createDataFrame([(b.bump, b.size, draws[b.bump]) for b in found if draws.get(b.bump)], "bump int, size bigint, n bigint")
    frames = [spark.range(1, draws[b.bump] + 1).select(F.lit(b.bump).alias("bump"), F.lit(b.size).cast("bigint").alias("size"), F.col("id").alias("draw")) for b in found if draws.get(b.bump)]
    if not frames:
        return out.select("bump", "size", F.col("n").alias("draw"), F.lit(0.0).alias("u"))
    got = frames[0]
    for f in frames[1:]:
        got = got.unionByName(f)
    return got.withColumn("u", uniform(seed, stream, "bump", "draw"))


def with_replacement(rows: DataFrame, found: list[Bump], draws: dict[int, int], bias: str | None, seed: int, stream: str = "over") -> DataFrame:
    """``draws[bump]`` rows of each bump, with ``draw`` (1 up); ``rows`` are ``ranked``."""
    spark = rows.sparkSession
    asked = draw_ranks(spark, found, draws, seed, stream)
    weighted = bias == "temporal+phi" and any(b.positive for b in found)
    if not weighted:
        r, u = F.col("size").cast("double"), F.col("u")
        j = F.floor(u * r) + 1 if bias != "temporal" else F.floor((F.sqrt(1.0 + 4.0 * u * r * (r + 1.0)) - 1.0) / 2.0) + 1
        j = F.least(F.greatest(j, F.lit(1)), F.col("size"))
        return asked.select("bump", "draw", j.alias("rank")).join(rows, ["bump", "rank"])
    # the first row whose cumulative weight exceeds u * total; a bump without weights is uniform
    none = [b.bump for b in found if not b.positive]
    w = F.when(F.col("bump").isin(none), 1.0).otherwise(weight(bias)) if none else weight(bias)
    held = rows.where(F.col("bump").isin([b.bump for b in found])).withColumn("_w", w).where("_w > 0")
    # ranks are dense, so pieces of them have a bounded size and their sums are few
    held = held.withColumn("_piece", F.floor((F.col("rank") - 1) / series.PIECE_ROWS).cast("int"))
    offsets, tops = [], {}
    for r in held.groupBy("bump", "_piece").agg(F.sum("_w").alias("s")).orderBy("bump", "_piece").collect():
        start, ends = tops.get(r["bump"], (0.0, []))
        offsets.append((r["bump"], r["_piece"], start))
        tops[r["bump"]] = (start + r["s"], [*ends, (start + r["s"], r["_piece"])])
    shift = F.broadcast(spark.createDataFrame(offsets, "bump int, _piece int, _shift double"))
    order = Window.partitionBy("bump", "_piece").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    held = held.join(shift, ["bump", "_piece"]).withColumn("_to", F.col("_shift") + F.sum("_w").over(order))
    ends = [(bump, top, [e for e, _ in at[:-1]], [p for _, p in at]) for bump, (top, at) in tops.items()]
    bounds = F.broadcast(spark.createDataFrame(ends, "bump int, _total double, _ends array<double>, _pieces array<int>"))
    points = asked.join(bounds, "bump").withColumn("_at", F.col("u") * F.col("_total"))
    points = points.withColumn("_piece", F.element_at("_pieces", F.size(F.filter("_ends", lambda e: e <= F.col("_at"))) + 1))
    none = F.lit(None).cast("bigint")
    both = held.select("bump", "_piece", F.col("_to").alias("_at"), none.alias("draw"), "rank").unionByName(points.select("bump", "_piece", "_at", "draw", none.alias("rank")))
    ahead = Window.partitionBy("bump", "_piece").orderBy(F.desc("_at"), F.col("draw").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    # sums added in another order may leave a draw beyond the piece's last case: it is that one
    last = F.max("rank").over(Window.partitionBy("bump", "_piece"))
    hit = both.withColumn("_hit", F.coalesce(F.last("rank", ignorenulls=True).over(ahead), last)).where("draw is not null")
    return hit.select("bump", "draw", F.col("_hit").alias("rank")).join(rows, ["bump", "rank"])
