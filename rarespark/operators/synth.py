"""Synthetic cases: exact nearest neighbours within a bump, and interpolation towards one.

The neighbour search looks at each different vector once, with the least positions that hold it.
A bump's vectors are cut into cells of about ``BLOCK``; each is searched in its own cell, and then in
the other cells whose box is no farther than the last neighbour found. A sample decides only where
cells are cut. No vectors beside the sample come to the driver.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rarespark.functions.rng import uniform
from rarespark.operators.bumps import Bump
from rarespark.operators.series import position
from rarespark.sources.shared import written

BLOCK, LEAF, SAMPLE = 65_536, 128, 100_000
# what workers run goes to them by value: this module need not be on their path
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def kd_order(x: np.ndarray, leaf: int) -> list[np.ndarray]:
    """Rows of ``x`` in groups of at most ``leaf`` that lie near each other."""
    out, rest = [], [np.arange(len(x))]
    while rest:
        rows = rest.pop()
        if len(rows) <= leaf:
            out.append(rows)
            continue
        held = x[rows]
        rows = rows[np.argpartition(held[:, np.argmax(np.ptp(held, axis=0))], len(rows) // 2)]
        rest += [rows[len(rows) // 2 :], rows[: len(rows) // 2]]
    return out


def gap_to(lo: np.ndarray, hi: np.ndarray, los: np.ndarray, his: np.ndarray) -> np.ndarray:
    """What the distance of any of a box to any of each of the others is at least; rounding keeps the order."""
    gap = np.maximum(np.maximum(los - hi, lo - his), 0.0)
    return distance(list(gap.T))


def distance(gaps: list[np.ndarray]) -> np.ndarray:
    """The root of the sum of squares, added in order, as the SQL does."""
    total = np.square(gaps[0])
    for g in gaps[1:]:
        total += np.square(g)
    return np.sqrt(total, out=total)


def nearest(seeds: np.ndarray, within: np.ndarray, x: np.ndarray, pos: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distances and positions of the ``k`` rows of ``x`` nearest to each seed and no farther than
    ``within``, ties to the smaller position; inf and -1 where there are fewer."""
    best, at = np.full((len(seeds), k), np.inf), np.full((len(seeds), k), -1)
    groups = kd_order(x, LEAF)
    los, his = (np.array([f(x[g], axis=0) for g in groups]) for f in (np.min, np.max))
    for own in kd_order(seeds, LEAF):
        part = seeds[own]
        far = gap_to(part.min(axis=0), part.max(axis=0), los, his)
        order, done, step = np.argsort(far, kind="stable"), 0, 2
        top, who = best[own], at[own]
        while done < len(order) and far[order[done]] <= (limit := np.minimum(top[:, -1], within[own]).max()):
            near = order[done : done + step]
            done, step = done + len(near), min(2 * step, 32)
            rows = np.concatenate([groups[g] for g in near[far[near] <= limit]])
            d = distance([np.subtract.outer(part[:, c], x[rows, c]) for c in range(x.shape[1])])
            d = np.concatenate([top, d], axis=1)
            p = np.concatenate([who, np.broadcast_to(pos[rows], (len(part), len(rows)))], axis=1)
            cut = np.minimum(np.partition(d, k - 1, axis=1)[:, k - 1], within[own])
            r, c = np.nonzero((d <= cut[:, None]) & (d < np.inf))
            v, w = d[r, c], p[r, c]
            o = np.lexsort((w, v, r))
            r, v, w = r[o], v[o], w[o]
            place = np.arange(len(r)) - np.searchsorted(r, r)
            keep = place < k
            top, who = np.full(top.shape, np.inf), np.full(who.shape, -1)
            top[r[keep], place[keep]], who[r[keep], place[keep]] = v[keep], w[keep]
        best[own], at[own] = top, who
    return best, at


def nearest_others(x: np.ndarray, k: int) -> np.ndarray:
    """The rows of the ``k`` nearest other rows of each, nearest first, ties to the smaller; -1 where there are fewer."""
    x = x + 0.0  # -0.0 and 0.0 are one vector
    order = np.lexsort(x.T)
    new = np.r_[True, (x[order][1:] != x[order][:-1]).any(axis=1)]
    first, which = np.flatnonzero(new), np.empty(len(x), np.int64)
    which[order] = np.cumsum(new) - 1
    # lexsort is stable: k + 1 least rows of a vector do for all that hold it
    some = order[np.arange(len(x)) - first[np.cumsum(new) - 1] <= k]
    seeds = x[order[first]]
    at = nearest(seeds, np.full(len(seeds), np.inf), x[some], some, k + 1)[1][which]
    last = np.argsort(at == np.arange(len(x))[:, None], axis=1, kind="stable")[:, :k]
    return np.take_along_axis(at, last, axis=1)


def cells(x: np.ndarray, n: int) -> list:
    """A tree of cuts (column, value, left, right) that parts the sample ``x`` of ``n`` vectors; a leaf is []."""
    wide = np.ptp(x, axis=0) if len(x) else np.zeros(1)
    if n <= BLOCK or not wide.max() > 0:
        return []
    c = int(np.argmax(wide))
    v = np.median(x[:, c])
    v = float(v if v < x[:, c].max() else x[x[:, c] < v, c].max())
    left = x[:, c] <= v
    share = left.mean()
    return [c, v, cells(x[left], round(n * share)), cells(x[~left], round(n * (1 - share)))]


def cell_of(tree: list, x: np.ndarray) -> np.ndarray:
    out, count, rest = np.zeros(len(x), np.int32), 0, [(tree, np.arange(len(x)))]
    while rest:
        node, rows = rest.pop()
        if not node:
            out[rows], count = count, count + 1
            continue
        left = x[rows, node[0]] <= node[1]
        rest += [(node[3], rows[~left]), (node[2], rows[left])]
    return out


def _matrix(t: pa.Table | pa.RecordBatch, name: str = "x") -> np.ndarray:
    col = t.column(name)
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return col.flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)


def _lists(best: np.ndarray, at: np.ndarray) -> pa.Array:
    there = best < np.inf
    ends = np.r_[0, np.cumsum(there.sum(axis=1))].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(best[there]), pa.array(at[there])], ["d", "nn"]))


def neighbours(cases: DataFrame, features: list[str], k: int) -> DataFrame:
    """(bump, pos, nn, nn_rank, d): the ``k`` nearest other cases of each, by Euclidean distance on
    unscaled features, ties to the smaller position; fewer where a bump is smaller."""
    # 0.0 + x: -0.0 and 0.0 are one vector. k + 1 positions of a vector do for all that hold it.
    side = cases.select("bump", "pos", F.array(*(F.lit(0.0) + F.col(f).cast("double") for f in features)).alias("x"))
    w = Window.partitionBy("bump", "x").orderBy("pos")
    some = side.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k + 1)
    points = written(some.groupBy("bump", "x").agg(F.sort_array(F.collect_list("pos")).alias("held")), "neighbours-vectors")
    sizes = {r["bump"]: r["count"] for r in points.groupBy("bump").count().collect()}
    trees = {}
    for b, n in sizes.items():
        held = [r.x for r in points.where(F.col("bump") == b).sample(min(1.0, SAMPLE / n), seed=1).select("x").limit(2 * SAMPLE).collect()] if n > BLOCK else []
        trees[b] = cells(np.array(held).reshape(-1, len(features)), n)
    kinds = "bump int, cell int, x array<double>, held array<bigint>"

    def placed(batches):
        for t in batches:
            bump, x = t.column("bump").to_numpy(), _matrix(t)
            cell = np.zeros(len(bump), np.int32)
            for b in np.unique(bump):
                cell[bump == b] = cell_of(trees[int(b)], x[bump == b])
            yield pa.RecordBatch.from_arrays([t.column("bump"), pa.array(cell), t.column("x"), t.column("held")], ["bump", "cell", "x", "held"])

    points = points.mapInArrow(placed, kinds)
    best_kind = "best array<struct<d:double,nn:bigint>>"

    def rows_of(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        held = t.column("held").combine_chunks()
        return np.repeat(_matrix(t), np.diff(held.offsets.to_numpy()), axis=0), held.flatten().to_numpy()

    def own(t: pa.Table) -> pa.Table:
        seeds = _matrix(t)
        best, at = nearest(seeds, np.full(len(seeds), np.inf), *rows_of(t), k + 1)
        return pa.table([t.column("bump"), t.column("cell"), t.column("x"), pa.array(best[:, -1]), _lists(best, at)], ["bump", "cell", "x", "far", "best"])

    found = points.groupBy("bump", "cell").applyInArrow(own, f"bump int, cell int, x array<double>, far double, {best_kind}")
    if any(trees.values()):
        found = written(found, "neighbours-own")
        boxes: dict[int, list] = {}
        axes = [f(F.col("x")[i]).alias(f"{n}{i}") for i in range(len(features)) for n, f in (("lo", F.min), ("hi", F.max))]
        for r in found.groupBy("bump", "cell").agg(*axes).collect():
            boxes.setdefault(r["bump"], []).append((r["cell"], [r[f"lo{i}"] for i in range(len(features))], [r[f"hi{i}"] for i in range(len(features))]))
        boxes = {b: tuple(map(np.array, zip(*sorted(v), strict=True))) for b, v in boxes.items()}

        def visits(batches):
            for t in batches:
                bump, cell, far, x = (t.column("bump").to_numpy(), t.column("cell").to_numpy(), t.column("far").to_numpy(), _matrix(t))
                rows, other = [], []
                for b in np.unique(bump):
                    own_rows = np.flatnonzero(bump == b)
                    for c, lo, hi in zip(*boxes[int(b)], strict=True):
                        at = own_rows[cell[own_rows] != c]
                        at = at[gap_to(lo, hi, x[at], x[at]) <= far[at]]
                        rows.append(at)
                        other.append(np.full(len(at), c, np.int32))
                rows = np.concatenate(rows)
                yield pa.RecordBatch.from_arrays([t.column("bump").take(pa.array(rows)), pa.array(np.concatenate(other)), t.column("x").take(pa.array(rows)), pa.array(far[rows])], ["bump", "cell", "x", "far"])

        def there(seeds: pa.Table, t: pa.Table) -> pa.Table:
            if not seeds.num_rows or not t.num_rows:
                return pa.table([pa.array([], pa.int32()), pa.array([], pa.list_(pa.float64())), _lists(np.zeros((0, 1)), np.zeros((0, 1), np.int64))], ["bump", "x", "best"])
            got = _lists(*nearest(_matrix(seeds), seeds.column("far").to_numpy(), *rows_of(t), k + 1))
            return pa.table([seeds.column("bump"), seeds.column("x"), got], ["bump", "x", "best"])

        asked = found.select("bump", "cell", "x", "far").mapInArrow(visits, "bump int, cell int, x array<double>, far double")
        more = asked.groupBy("bump", "cell").cogroup(points.groupBy("bump", "cell")).applyInArrow(there, f"bump int, x array<double>, {best_kind}")
        both = found.select("bump", "x", "best").unionByName(more)
        found = both.groupBy("bump", "x").agg(F.slice(F.sort_array(F.flatten(F.collect_list("best"))), 1, k + 1).alias("best"))
    near = F.slice(F.filter("best", lambda e: e["nn"] != F.col("pos")), 1, k)
    got = side.join(found.select("bump", "x", "best"), ["bump", "x"]).select("bump", "pos", F.posexplode(near).alias("_i", "_e"))
    return got.select("bump", "pos", F.col("_e.nn").alias("nn"), (F.col("_i") + 1).alias("nn_rank"), F.col("_e.d").alias("d"))


def neighbours_sql(cases: DataFrame, features: list[str], k: int) -> DataFrame:
    """The same as a join of each bump with itself; for small bumps and for comparison."""
    a = cases.select("bump", "pos", *(F.col(f).alias(f"a_{i}") for i, f in enumerate(features)))
    b = cases.select("bump", F.col("pos").alias("nn"), *(F.col(f).alias(f"b_{i}") for i, f in enumerate(features)))
    d = None
    for i in range(len(features)):
        gap = F.col(f"a_{i}") - F.col(f"b_{i}")
        d = gap * gap if d is None else d + gap * gap
    w = Window.partitionBy("bump", "pos").orderBy("d", "nn")
    return a.join(b, "bump").where("pos <> nn").withColumn("d", F.sqrt(d)).withColumn("nn_rank", F.row_number().over(w)).where(F.col("nn_rank") <= k).select("bump", "pos", "nn", "nn_rank", "d")


def plan(cases: DataFrame, jobs: list[Bump], seed: int) -> DataFrame:
    """(bump, pos, copy): every position as often as it is a seed; extra seeds are those of the
    smallest hash."""
    pos = cases.select("bump", "pos")
    copies, extra = F.lit(0), F.lit(0).cast("bigint")
    for b in jobs:
        whole = math.floor(b.c - 1)
        copies = F.when(F.col("bump") == b.bump, F.lit(whole)).otherwise(copies)
        extra = F.when(F.col("bump") == b.bump, F.lit(math.floor(b.size * (b.c - 1 - whole))).cast("bigint")).otherwise(extra)
    w = Window.partitionBy("bump").orderBy(uniform(seed, "extra", "bump", "pos"), "pos")
    n = copies + F.when(F.row_number().over(w) <= extra, 1).otherwise(0)
    return pos.withColumn("_n", n).where("_n > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_n")))).drop("_n")


def synthesize(labelled: DataFrame, jobs: list[Bump], features: list[str], target: str, order_by: str, bias: str | None, k: int, seed: int, r_quirks: bool = True) -> DataFrame:
    """(bump, pos, copy, nn_pos, seed_t, features, target) of all synthetic cases.

    Positions are joined, never rows: with ``r_quirks`` the neighbours of a temporal bias are
    found among positions in time and read from positions in value.
    """
    rows = sum(b.size for b in jobs)
    held = labelled.where(F.col("bump").isin([b.bump for b in jobs]))
    known = {"rank", "by_value"} <= set(labelled.columns)
    by_value = held.withColumn("pos", F.col("by_value")) if known else position(held, [target, order_by], "pos", ["bump"], rows)
    by_time = held.withColumn("pos", F.col("rank") - 1) if known else position(held, [order_by], "pos", ["bump"], rows)
    search = by_value if bias is None and r_quirks else by_time
    read = by_value if r_quirks else by_time
    near = neighbours(search, features, k)
    size = F.lit(None).cast("int")
    for b in jobs:
        size = F.when(F.col("bump") == b.bump, F.lit(min(k, b.size - 1))).otherwise(size)
    if bias is None:
        asked = plan(search, jobs, seed)
        asked = asked.withColumn("nn_rank", F.least(F.floor(uniform(seed, "pick", "bump", "pos", "copy") * size) + 1, size).cast("int"))
        picked = asked.join(near, ["bump", "pos", "nn_rank"]).select("bump", "pos", "copy", F.col("nn").alias("nn_pos"))
    else:
        if bias == "temporal":
            choice = near.groupBy("bump", "pos").agg(F.max("nn").alias("nn_pos"))
        else:
            with_phi = near.join(by_time.select("bump", F.col("pos").alias("nn"), F.col("phi").alias("_phi")), ["bump", "nn"])
            most = F.max("nn").over(Window.partitionBy("bump", "pos"))
            with_phi = with_phi.withColumn("_score", (F.col("nn") + 1.0) / (most + 1.0) * F.col("_phi"))
            w = Window.partitionBy("bump", "pos").orderBy(F.desc("_score"), "nn_rank")
            choice = with_phi.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("bump", "pos", F.col("nn").alias("nn_pos"))
        picked = plan(search, jobs, seed).join(choice, ["bump", "pos"])
    a = read.select("bump", "pos", F.col(order_by).alias("seed_t"), F.col(target).alias("_ya"), *(F.col(f).cast("double").alias(f"_a_{f}") for f in features))
    b = read.select("bump", F.col("pos").alias("nn_pos"), F.col(target).alias("_yb"), *(F.col(f).cast("double").alias(f"_b_{f}") for f in features))
    both = picked.join(a, ["bump", "pos"]).join(b, ["bump", "nn_pos"]).withColumn("_l", uniform(seed, "lambda", "bump", "pos", "copy"))
    both = both.withColumns({f: F.col(f"_a_{f}") + F.col("_l") * (F.col(f"_b_{f}") - F.col(f"_a_{f}")) for f in features})
    used = features[:1] if r_quirks else features

    def distance(side: str):
        if r_quirks:
            return F.abs(F.col(f"_{side}_{used[0]}") - F.col(used[0]))
        total = None
        for f in used:
            gap = F.col(f"_{side}_{f}") - F.col(f)
            total = gap * gap if total is None else total + gap * gap
        return F.sqrt(total)

    both = both.withColumns({"_d1": distance("a"), "_d2": distance("b")})
    middle = (F.col("_ya") + F.col("_yb")) / 2.0
    value = F.when(F.col("_d1") == F.col("_d2"), middle).otherwise((F.col("_d2") * F.col("_ya") + F.col("_d1") * F.col("_yb")) / (F.col("_d1") + F.col("_d2")))
    return both.withColumn(target, value).select("bump", "pos", "copy", "nn_pos", "seed_t", *features, target)

