"""All cells of a split in one task: what ``Resampler``, ``LeastSquares`` and ``evaluate_metrics`` do, on arrays.

A cell of the operators has some ten jobs, each of which costs more than the work on a window's rows. Draws come from
the same hashes and follow the same order, so a cell holds the same cases here and there. Sums may differ in their
last digits, and with them a draw by weight that falls on the border of two cases, as by the order of Spark's rows.
"""

from __future__ import annotations

import hashlib
import math
import sys
import warnings
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rarespark.functions.relevance import ControlPoints
from rarespark.functions.utility import surface
from rarespark.operators import bumps, counts, draws, metrics, relevance
from rarespark.operators.bumps import Bump
from rarespark.operators.resampler import Resampler
from rarespark.operators.synth import distance, nearest_others
from rarespark.plans.splits import split_frames

BATCH = 1 << 16  # hashes made at a time
METRICS = ("precision_phi", "recall_phi", "f1_phi", "sera")
KIND = "split int, strategy int, metric string, value double, note string"
FLOOR, LAST, STEPS = metrics.FLOOR, draws.LAST, metrics.sera_steps(0.001)
WHISKER, hinge_ranks, knots = relevance.WHISKER, relevance.hinge_ranks, relevance.knots
assign, balanced, topped_up = counts.assign, bumps.balanced, draws.topped_up
# what workers run goes to them by value: these modules need not be on their path
for _name in (__name__, *(f.__module__ for f in (ControlPoints, surface, balanced, assign, topped_up, hinge_ranks))):
    cloudpickle.register_pickle_by_value(sys.modules[_name])


def uniforms(seed: int, stream: str, bump: int, *keys: np.ndarray) -> np.ndarray:
    """``uniform`` of a bump's rows with these integer ``keys``."""
    out, md5 = np.empty(len(keys[0])), hashlib.md5
    head, form = f"{seed}|{stream}|{bump}|".encode(), b"|".join([b"%d"] * len(keys))
    for at in range(0, len(out), BATCH):
        part = zip(*(k[at : at + BATCH].tolist() for k in keys), strict=True)
        held = np.frombuffer(b"".join([md5(head + form % k).digest() for k in part]), ">u8")[::2]
        out[at : at + BATCH] = ((held >> np.uint64(12)).astype(float) + 0.5) / float(1 << 52)
    return out


def fitted(s: np.ndarray) -> ControlPoints:
    """Control points of the sorted values ``s``."""
    q1, med, q3 = (float(0.5 * (s[a - 1] + s[b - 1])) for a, b in hinge_ranks(len(s)))
    low = s[np.searchsorted(s, q1 - WHISKER * (q3 - q1))]
    high = s[np.searchsorted(s, q3 + WHISKER * (q3 - q1), "right") - 1]
    return knots(*map(float, (s[0], low)), med, *map(float, (high, s[-1])))


def phi(y: np.ndarray, cp: ControlPoints) -> np.ndarray:
    def step(x0: float, p0: float, x1: float, p1: float) -> np.ndarray:
        t = np.clip((y - x0) / (x1 - x0 if x1 > x0 else 1.0), 0.0, 1.0)
        return p0 + (p1 - p0) * (3.0 * t * t - 2.0 * t * t * t)

    low, high = step(cp.x_lo, cp.p_lo, cp.med, cp.p_med), step(cp.med, cp.p_med, cp.x_hi, cp.p_hi)
    if cp.strict:
        return np.where(y <= cp.x_lo, cp.p_lo, np.where(y >= cp.x_hi, cp.p_hi, np.where(y < cp.med, low, high)))
    return np.where(y >= cp.x_hi, cp.p_hi, np.where(y >= cp.med, high, np.where(y >= cp.x_lo, low, cp.p_lo)))


def utility(p: np.ndarray, y: np.ndarray, cp: ControlPoints, phi_p: np.ndarray, phi_y: np.ndarray) -> np.ndarray:
    s, loss, both = surface(cp), np.abs(p - y), 0.5 * phi_p + 0.5 * phi_y

    def on_hill(inner: np.ndarray, width: float, other_peak: float) -> np.ndarray:
        def share(reach: float) -> np.ndarray:
            limit = np.full(len(y), width) if math.isinf(reach) else np.where(inner, np.minimum(width, np.abs(y - reach)), width)
            return np.divide(loss, limit, out=np.ones(len(y)), where=loss < limit)

        return phi_y * (1.0 - share(s.parting)) - both * share(other_peak)

    return np.where(y < s.parting, on_hill(p >= y, s.low_width, s.high), on_hill(p < y, s.high_width, s.low))


def scores(y: np.ndarray, p: np.ndarray, cp: ControlPoints) -> tuple[float, ...]:
    """``METRICS`` of a forecast."""
    phi_y, phi_p = phi(y, cp), phi(p, cp)
    worth = np.abs(utility(p, y, cp, phi_p, phi_y) + 1.0)
    precision, recall = (float(worth[f >= 0.9].sum() / np.abs(f[f >= 0.9] + 1.0).sum()) if (f >= 0.9).any() else FLOOR for f in (phi_p, phi_y))
    f1 = 0.0 if precision == 0 or recall == 0 else 2 * precision * recall / (precision + recall)
    near, step = np.floor(phi_y * STEPS), 1.0 / STEPS
    m = near + 1 + ((near + 1) * step <= phi_y) - (near * step > phi_y)
    return precision, recall, f1, float(np.sum((y - p) ** 2 * np.where(m >= STEPS + 1, 1.0, (m - 0.5) / STEPS)))


class Window:
    """A split's training rows, in order of time, and what its cells have in common."""

    def __init__(self, t: np.ndarray, x: np.ndarray, y: np.ndarray):
        self.t, self.x, self.y = t, x, y
        self.by_value = np.argsort(y, kind="stable")
        self.cp = fitted(y[self.by_value])
        self.phi = phi(y, self.cp)
        self._known: dict[tuple, object] = {}

    def known(self, key: tuple, make: Callable[[], object]):
        if key not in self._known:
            self._known[key] = make()
        return self._known[key]

    def bumps(self, rule: str, threshold: float) -> tuple[list[Bump], list[np.ndarray]]:
        """The bumps, and the rows of each in order of value."""
        p = self.phi[self.by_value]
        rare = p >= threshold if rule == "over" else p > threshold
        cut = rare[1:] != rare[:-1]
        if rule != "over":
            cut &= (p[1:] > 0) & (p[:-1] > 0)
        rows, found = np.split(self.by_value, np.flatnonzero(cut) + 1), []
        for b, held in enumerate(rows):
            m = float(self.phi[held].mean())
            found.append(Bump(b, len(held), m, m >= threshold if rule == "over" else m > threshold, m < threshold, int((self.phi[held] > 0).sum())))
        return found, rows

    def resampled(self, r: Resampler, seed: int) -> tuple[np.ndarray, list[np.ndarray]]:
        """How often each row is a case, and the synthetic cases as matrices of features and target."""
        times, made = np.ones(len(self.y)), []
        every, rows = self.bumps(r.strategy, r.rel_threshold)
        found = balanced(every, r.rel_threshold)
        for b in assign(found, len(self.y), r.strategy, r.o, r.u) if found else ():
            held = rows[b.bump]
            if r.strategy == "over":
                if b.n_out > b.size:
                    times += self.drawn(np.sort(held), b, b.n_out - b.size, r.bias, seed, "over")
            elif b.n_out < b.size:
                times[held] = 0
                if r.strategy == "under":
                    times[self.kept(np.sort(held), b, r, seed)] = 1
                elif b.n_out:
                    times += self.drawn(np.sort(held), b, b.n_out, r.bias, seed, "smote_under")
            elif b.n_out > b.size:
                made.append(self.synthetic(held, b, r, seed))
        return times, made

    def weight(self, rows: np.ndarray, bias: str | None) -> np.ndarray:
        """Of a bump's ``rows`` in order of time."""
        if bias is None:
            return np.full(len(rows), 1.0 / len(rows))
        w = np.arange(1, len(rows) + 1) / len(rows)
        return w * self.phi[rows] if bias == "temporal+phi" else w

    def kept(self, rows: np.ndarray, b: Bump, r: Resampler, seed: int) -> np.ndarray:
        """``n_out`` of the rows, without replacement."""
        topped_up(b, r.bias)
        u = self.known((seed, "under", r.rel_threshold, b.bump), lambda: uniforms(seed, "under", b.bump, self.t[rows]))
        w = self.weight(rows, r.bias)
        key = np.divide(-np.log(u), w, out=(u + 1.0) * LAST, where=w > 0)
        return rows[np.argsort(key, kind="stable")[: b.n_out]]

    def drawn(self, rows: np.ndarray, b: Bump, n: int, bias: str | None, seed: int, stream: str) -> np.ndarray:
        """How often each row of the window is among ``n`` draws of ``rows`` with replacement."""
        u = self.known((seed, stream, b.bump, n), lambda: uniforms(seed, stream, b.bump, np.arange(1, n + 1)))
        size = float(b.size)
        if bias == "temporal+phi" and b.positive:
            w = self.weight(rows, bias)
            ends = np.cumsum(w)
            at = np.minimum(np.searchsorted(ends, u * ends[-1], "right"), np.flatnonzero(w > 0)[-1])
        elif bias == "temporal":
            at = np.floor((np.sqrt(1.0 + 4.0 * u * size * (size + 1.0)) - 1.0) / 2.0).astype(np.int64)
        else:
            at = np.floor(u * size).astype(np.int64)
        return np.bincount(rows[np.clip(at, 0, b.size - 1)], minlength=len(self.y))

    def synthetic(self, by_value: np.ndarray, b: Bump, r: Resampler, seed: int) -> np.ndarray:
        by_time = np.sort(by_value)
        value_search = r.bias is None and r.r_quirks
        search, read = by_value if value_search else by_time, by_value if r.r_quirks else by_time
        near = self.known((r.strategy, r.rel_threshold, b.bump, value_search, r.k), lambda: nearest_others(self.x[search], r.k))
        whole = math.floor(b.c - 1)
        n = np.full(b.size, whole)
        extra = math.floor(b.size * (b.c - 1 - whole))
        if extra:
            u = self.known((seed, "extra", b.bump, b.size), lambda: uniforms(seed, "extra", b.bump, np.arange(b.size)))
            n[np.argsort(u, kind="stable")[:extra]] += 1
        pos = np.repeat(np.arange(b.size), n)
        copy = np.arange(len(pos)) - np.repeat(np.cumsum(n) - n, n) + 1
        hashed = lambda stream: self.known((seed, stream, b.bump, b.size, b.c), lambda: uniforms(seed, stream, b.bump, pos, copy))
        if r.bias is None:
            most = min(r.k, b.size - 1)
            nn = near[pos, np.minimum(np.floor(hashed("pick") * most).astype(np.int64), most - 1)]
        elif r.bias == "temporal":
            nn = near.max(axis=1)[pos]
        else:
            score = (near + 1.0) / (near.max(axis=1, keepdims=True) + 1.0) * self.phi[by_time][near]
            nn = near[np.arange(b.size), np.where(near < 0, -np.inf, score).argmax(axis=1)][pos]
        there = nn >= 0
        a, z = read[pos[there]], read[nn[there]]
        xa, xz, ya, yz = self.x[a], self.x[z], self.y[a], self.y[z]
        x = xa + hashed("lambda")[there, None] * (xz - xa)
        used = slice(0, 1) if r.r_quirks else slice(None)
        d1, d2 = (distance(list((side - x)[:, used].T)) for side in (xa, xz))
        y = np.divide(d2 * ya + d1 * yz, d1 + d2, out=(ya + yz) / 2.0, where=d1 != d2)
        return np.column_stack([x, y])


def sums(x: np.ndarray, y: np.ndarray, times: np.ndarray | None = None) -> np.ndarray:
    """Of the products of all pairs of 1, the features and the target."""
    z = np.column_stack([np.ones(len(y)), x, y])
    return z.T @ (z if times is None else z * times[:, None])


def cells_of(t: np.ndarray, x: np.ndarray, y: np.ndarray, cut: int, resamplers: list, seeds: list[int], solve: Callable) -> Iterator[tuple]:
    """(strategy, metric, value, note) of a split whose rows are in order of time, the first ``cut`` for training.
    A note is a warning's text, or an error's with the metric "error"."""
    window = Window(t[:cut], x[:cut], y[:cut])
    for j, (r, seed) in enumerate(zip(resamplers, seeds, strict=True)):
        with warnings.catch_warnings(record=True) as said:
            warnings.simplefilter("always")
            times, made = (None, []) if r is None else window.resampled(r, seed)
        yield from ((j, "", None, str(w.message)) for w in said)
        w = solve(sum((sums(m[:, :-1], m[:, -1]) for m in made), sums(window.x, window.y, times)))
        p = w[0] + x[cut:] @ w[1:]
        if not np.isfinite(p).all():
            yield j, "error", None, f"metrics: y_true and y_pred: prediction must be finite (no NaN or inf); {int((~np.isfinite(p)).sum())} values are not."
            return
        yield from ((j, m, v, None) for m, v in zip(METRICS, scores(y[cut:], p, window.cp), strict=True))


def together(df: DataFrame, features: list[str], target: str, time: str, windows: list[tuple[int, int, int]], resamplers: list[Resampler | None], seeds: list[list[int]], solve: Callable) -> list[tuple[int, int, int, float]]:
    """(split, strategy, number in ``METRICS``, value) of all cells, a task for each of the ``windows`` (of values of ``time``)."""
    n, plain = len(features), [None if r is None else r.for_tasks() for r in resamplers]
    cuts = [b for _, b, _ in windows]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[pa.RecordBatch]] = {}
        for batch in batches:
            split = batch.column(0).to_numpy()
            for s in np.unique(split):
                held.setdefault(int(s), []).append(batch if (split == s).all() else batch.filter(pa.array(split == s)))
        while held:
            s, parts = held.popitem()
            table = pa.Table.from_batches(parts)
            del parts
            t = table.column(1).to_numpy()
            order = np.argsort(t, kind="stable")
            x = np.empty((len(t), n))
            for i in range(n):
                x[:, i] = table.column(2 + i).to_numpy()[order]
            t, y = t[order], table.column(2 + n).to_numpy()[order]
            del table, order
            with np.errstate(all="ignore"):
                rows = [(s, *r) for r in cells_of(t, x, y, int(np.searchsorted(t, cuts[s])), plain, seeds[s], solve)]
            kinds = (pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["split", "strategy", "metric", "value", "note"])

    cases = split_frames(df.withColumn("_t", F.col(time).cast("bigint")), windows, "_t")
    cases = cases.select("split", "_t", *(F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)), F.col(target).cast("double").alias("y"))
    got = cases.repartitionById(len(windows), "split").mapInArrow(run, KIND).collect()
    for r in sorted(r for r in got if r.note is not None):
        if r.metric == "error":
            raise ValueError(r.note)
        warnings.warn(r.note, UserWarning, stacklevel=3)
    return sorted((r.split, r.strategy, METRICS.index(r.metric), r.value) for r in got if r.note is None)
