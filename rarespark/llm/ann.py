"""Operator 3, nearest neighbours by learned partitions.

Fitted on a sample of at most ``SAMPLE`` vectors: their neighbour graph is cut into equal parts by
recursive spectral bisection, refined by swaps over the cuts, and a small network (one hidden
layer) learns to give a vector the parts of its neighbours. Every vector of the table is indexed
under its most probable part; a query goes to as many of its most probable parts as, on sample
vectors that the network did not see, reach ``RECALL``. Each part is held in blocks of bounded
size, so a part with a third of all vectors is many tasks; a block returns each query's best, and
the best of these, scored in double precision on the given vectors, are the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SAMPLE = 10_000
RECALL = 0.965
BLOCK = 20_000
HIDDEN = 128
PER_PART = 40


def valid(df: DataFrame, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(key, v array<double>) of rows with a key and a vector of finite parts, not all zero, of
    the table's most frequent length (the larger of equally frequent ones)."""
    v = F.col(vector).cast("array<double>")
    ok = F.col(vector).isNotNull() & F.col(key).isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    got = df.select(F.col(key).cast("long").alias("vec_id"), v.alias("v"), ok.alias("ok")).where("ok").drop("ok")
    size = got.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return got.where(F.size("v") == (size.d if size else 0))


def neighbours(x: np.ndarray, k: int, of: np.ndarray | None = None) -> np.ndarray:
    """The k rows of largest inner product with each row (or row of ``of``), the row itself not."""
    k = min(k, len(x) - 1)
    rows = np.arange(len(x)) if of is None else of
    out = np.empty((len(rows), k), np.int64)
    for i in range(0, len(rows), 1000):
        s = x[rows[i : i + 1000]] @ x.T
        s[np.arange(len(s)), rows[i : i + 1000]] = -np.inf
        out[i : i + 1000] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def cut(near: np.ndarray, parts: int) -> np.ndarray:
    """A balanced partition of the graph into a power of two of parts."""
    n, k = near.shape
    a, b = np.repeat(np.arange(n), k), near.ravel()
    a, b = np.r_[a, b], np.r_[b, a]
    label = np.zeros(n, np.int64)
    rng = np.random.RandomState(7)
    p = 1
    while p < parts:
        inside = label[a] == label[b]
        i, j = a[inside], b[inside]
        degree = np.maximum(np.bincount(i, minlength=n), 1)
        v = rng.normal(size=n)
        for _ in range(60):  # smoothing along edges, kept orthogonal to each part's constant
            v -= (np.bincount(label, v, p) / np.maximum(np.bincount(label, minlength=p), 1))[label]
            v = 0.5 * v + 0.5 * np.bincount(i, v[j], n) / degree
        side = np.zeros(n, np.int64)
        for q in range(p):
            own = np.flatnonzero(label == q)
            side[own[np.argsort(v[own], kind="stable")[len(own) // 2 :]]] = 1
        for _ in range(8):  # swap the vertices that gain most by crossing, as many from each side
            other = np.bincount(i, side[i] != side[j], n) - np.bincount(i, side[i] == side[j], n)
            for q in range(p):
                zero, one = (np.flatnonzero((label == q) & (side == s)) for s in (0, 1))
                zero, one = zero[np.argsort(-other[zero], kind="stable")], one[np.argsort(-other[one], kind="stable")]
                m = min(len(zero), len(one))
                m = int(np.argmin(np.r_[(other[zero[:m]] + other[one[:m]] > 1), False])) // 2
                side[zero[:m]], side[one[:m]] = 1, 0
        label, p = label * 2 + side, p * 2
    return label


@dataclass
class Router:
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    probes: int = 1

    def logits(self, x: np.ndarray) -> np.ndarray:
        x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
        return np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def parts(self, x: np.ndarray, probes: int) -> np.ndarray:
        z = self.logits(x)
        return np.argsort(-z, axis=1, kind="stable")[:, :probes]


def learn(x: np.ndarray, target: np.ndarray, rounds: int = 25) -> Router:
    """Soft-label cross-entropy by Adam; ``target`` is the share of neighbours in each part."""
    rng = np.random.RandomState(3)
    d, m = x.shape[1], target.shape[1]
    p = [rng.normal(size=(d, HIDDEN)) * np.sqrt(2 / d), np.zeros(HIDDEN), rng.normal(size=(HIDDEN, m)) * np.sqrt(1 / HIDDEN), np.zeros(m)]
    p = [a.astype(np.float32) for a in p]
    mean, square, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    for r in range(rounds):
        order = rng.permutation(len(x))
        for i in range(0, len(x), 256):
            o = order[i : i + 256]
            h = np.maximum(x[o] @ p[0] + p[1], 0)
            z = h @ p[2] + p[3]
            e = np.exp(z - z.max(1, keepdims=True))
            g = (e / e.sum(1, keepdims=True) - target[o]) / len(o)
            gh = (g @ p[2].T) * (h > 0)
            t += 1
            for a, (w, gw) in enumerate(zip(p, (x[o].T @ gh, gh.sum(0), h.T @ g, g.sum(0)), strict=True)):
                mean[a] = 0.9 * mean[a] + 0.1 * gw
                square[a] = 0.999 * square[a] + 0.001 * gw * gw
                w -= 0.004 * (1 - r / rounds) * (mean[a] / (1 - 0.9**t)) / (np.sqrt(square[a] / (1 - 0.999**t)) + 1e-7)
    return Router(*p)


def fit(x: np.ndarray, parts: int, k: int) -> Router:
    held = np.arange(len(x)) % 10 == 3
    if parts == 1 or held.sum() < 5:
        d = x.shape[1] if x.ndim == 2 else 0
        return Router(np.zeros((d, 1), np.float32), np.zeros(1, np.float32), np.zeros((1, 1), np.float32), np.zeros(1, np.float32))
    seen = x[~held]
    near = neighbours(seen, 16)
    label = cut(near, parts)
    target = np.zeros((len(seen), parts), np.float32)
    np.add.at(target, (np.arange(len(seen))[:, None], label[near]), 1.0)
    np.add.at(target, (np.arange(len(seen)), label), 4.0)
    router = learn(seen, target / target.sum(1, keepdims=True))
    queries = np.flatnonzero(held)
    truth = router.parts(x, 1)[neighbours(x, k, queries), 0]
    order = np.argsort(-router.logits(x[queries]), axis=1, kind="stable")
    rank = np.argsort(order, axis=1)
    reached = [(np.take_along_axis(rank, truth, 1) < p).mean() for p in range(1, parts + 1)]
    router.probes = 1 + int(np.argmax(np.array(reached) >= RECALL))
    return router


_V = "vec_id bigint, v array<double>"


def _matrix(col: pa.Array) -> np.ndarray:
    n = len(col)
    return np.asarray(col.flatten()).reshape(n, -1) if n else np.empty((0, 0))


def search(df: DataFrame, is_query, k: int = 20, vector: str = "embedding", key: str = "vec_id", sample: int = SAMPLE) -> DataFrame:
    """(query_id, rank, vec_id, score): for each valid row where ``is_query`` holds, its ``k``
    rows of largest inner product found, nearest first, ties to the smaller id.

    A query's candidates are all valid rows of another id. It is compared with what its probed
    parts hold, and goes on to its next parts until these hold ``k`` candidates; so it gets ``k``
    neighbours, or all candidates where these are fewer. Rows that share an id are one item with
    several vectors: two items score as their best pair of vectors does, an item is listed once
    for a query and is never its own neighbour. Empty tables give no rows. There is a part for
    every 4 ``k`` rows, as far as each then has ``PER_PART`` sampled vectors to learn from: give a
    larger ``sample`` for more parts.
    """
    rows = valid(df, vector, key)
    n = rows.count()
    parts = 1 << max(0, int(np.log2(max(1.0, min(n / (4 * k), min(n, sample) / PER_PART)))))
    got = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toArrow()
    router = fit(_matrix(got.column("v").combine_chunks()), parts, k)

    def place(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            part = router.parts(_matrix(b.column(1)), 1)[:, 0] if b.num_rows else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(part, pa.int32())], ["vec_id", "v", "part"])

    # a part's rows are dealt over blocks by id; blocks follow the largest part's size. Only items
    # whose vectors all lie in one part count for it, so counts of several parts add up.
    placed = rows.mapInArrow(place, _V + ", part int")
    held, own = np.zeros(parts, np.int64), np.zeros(parts, np.int64)
    item = placed.groupBy("vec_id").agg(F.min("part").alias("part"), F.max("part").alias("b"), F.count("*").alias("n"))
    for r in item.groupBy("part").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("part") == F.col("b"), 1).otherwise(0)).alias("own")).collect():
        held[r.part], own[r.part] = r.n, r.own
    blocks = max(1, -(-int(held.max()) // BLOCK))

    def route(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            part = router.parts(_matrix(b.column(1)), parts) if b.num_rows else np.empty((0, 1), np.int64)
            # on down the ranked parts until these hold k items besides the query's own
            before = np.cumsum(own[part], axis=1) - own[part]
            asks = (np.arange(part.shape[1]) < router.probes) | (before < k + 1)
            rows_, rank = np.nonzero(asks)
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(rows_)) for c in b.columns), pa.array(part[rows_, rank], pa.int32())], ["vec_id", "v", "part"])

    side = placed.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    asked = rows.where(is_query).mapInArrow(route, _V + ", part int").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def best(key: tuple[pa.Scalar, ...], queries: pa.Table, held: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        kinds = [pa.int64(), pa.int64(), pa.float64()]
        if not queries.num_rows or not held.num_rows:
            return pa.table([pa.array([], t) for t in kinds], names)
        ids = np.asarray(held.column("vec_id").combine_chunks())
        order = np.argsort(ids, kind="stable")
        x = _matrix(held.column("v").combine_chunks())[order]
        ids, first = np.unique(ids[order], return_index=True)
        last = np.r_[first[1:], len(x)]
        q_ids, q = np.asarray(queries.column("vec_id").combine_chunks()), _matrix(queries.column("v").combine_chunks())
        out = []
        step = max(1, (1 << 22) // len(x))
        for i in range(0, len(q), step):
            s = q[i : i + step] @ x.T
            if len(ids) < len(x):
                s = np.maximum.reduceat(s, first, axis=1)
            s[q_ids[i : i + step, None] == ids] = -np.inf
            m = min(k, len(ids))
            least = -np.partition(-s, m - 1, axis=1)[:, m - 1]
            # a matrix product rounds as its shape has it: near ties all go on
            slack = 1e-9 * np.maximum(np.abs(least), 1e-30)
            r, c = np.nonzero((s >= (least - slack)[:, None]) & (s > -np.inf))
            # products summed term by term, so that a pair scores the same in any block
            v = (q[i + r] * x[first[c]]).sum(1)
            for z in np.flatnonzero(last[c] - first[c] > 1):
                v[z] = (q[i + r[z]] * x[first[c[z]] : last[c[z]]]).sum(1).max()
            o = np.lexsort((ids[c], -v, r))
            r, c, v = r[o], c[o], v[o]
            keep = np.arange(len(r)) - np.searchsorted(r, r) < k
            out.append((q_ids[i + r[keep]], ids[c[keep]], v[keep]))
        return pa.table([pa.array(np.concatenate(z), t) for z, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    found = asked.groupBy("part", "block").cogroup(side.groupBy("part", "block")).applyInArrow(best, "query_id bigint, vec_id bigint, score double")
    # one exchange by query serves both: an item found by several of its vectors counts once
    once = found.repartition("query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return once.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3(embeddings: DataFrame) -> DataFrame:
    return search(embeddings, F.col("vec_id") % 20 == 0)
