"""Operator 2, toxicity by a bidirectional gated recurrent network with attention pooling.

A word enters as evidence and embeddings from two sides: the word itself (hashed, twice, so that a
collision must happen twice to count) and its characters (hashed byte n-grams between word
boundaries). A run without spaces of more than ``LONG`` bytes is read as overlapping pieces, each a
word of its own, that together hold all the run's n-grams. The network reads every window of ``LENGTH`` words, windows starting every ``STRIDE``
words to the text's end; attention pools the states of both directions, and a text's score is
that of its highest window, calibrated on whole texts. Forward and backward passes are numpy.

It is trained on the driver, on at most ``SAMPLE`` labelled documents of each class, and on at most
``SAMPLE_BYTES`` of text: whole texts in the order of the hashed id. The model has
a fixed size, some MB. Scoring keeps, of a chunk, one input row for each distinct word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rarespark.llm.common import batches, carried, extended, remainder, text_view, words
from rarespark.llm.hashing import Ranges, mix

SAMPLE, SAMPLE_BYTES = 2_500, 64 << 20
LENGTH, STRIDE = 32, 8
BINS, ROWS = 1 << 18, 1 << 13
WORD_DIM = CHAR_DIM = 4
HIDDEN, ATTENTION = 8, 8
GRAMS = (4, 5, 6)
LONG, PIECE = 64, 24
SHRINK = 3.0
BLOCK = 4_096
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.isin(np.arange(256), range(48, 58)) | np.isin(np.arange(256), range(97, 123)) | (np.arange(256) >= 128)


def pieces(starts: np.ndarray, ends: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, ...]:
    """Starts, ends and rows of words, those over ``LONG`` bytes cut into pieces of ``PIECE`` that
    overlap by all but one byte of the longest n-gram; and whether a piece begins or ends within a word."""
    size, step = ends - starts, PIECE - max(GRAMS) + 1
    n = np.where(size > LONG, 1 - (PIECE - size) // step, 1)
    of = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    first = starts[of] + place * step
    last = place == n[of] - 1
    return first, np.where(last, ends[of], first + PIECE), row[of], place > 0, ~last


class Tokens:
    """The words of a chunk of texts: distinct ones with their features' places."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray):
        low = _LOWER[buf]
        # capital letters with accents in two-byte Latin: C3 80-9E to C3 A0-BE
        lead = np.flatnonzero(low[:-1] == 0xC3) + 1 if len(low) > 1 else np.empty(0, np.int64)
        up = lead[(low[lead] >= 0x80) & (low[lead] <= 0x9E) & (low[lead] != 0x97)]
        low[up] += 0x20
        starts, ends, self.row, begun, goes_on = pieces(*words(low, offs, _IN_WORD))
        h = Ranges(low)(starts, ends)
        cut = begun | goes_on
        h[cut] = mix(h[cut] + begun[cut] + np.uint64(2) * goes_on[cut])
        self.hash, first, self.at = np.unique(h, return_index=True, return_inverse=True)
        starts, ends = starts[first], ends[first]
        # bytes of the distinct words, each between two boundary bytes
        size = ends - starts + 2
        at = np.r_[0, np.cumsum(size)]
        flat = np.full(at[-1], 0x5F, np.uint8)
        inner = np.repeat(starts - at[:-1] - 1, size) + np.arange(at[-1])
        body = np.ones(at[-1], bool)
        body[at[:-1]] = body[at[1:] - 1] = False
        flat[body] = low[inner[body]]
        word = np.repeat(np.arange(len(size)), size)
        # where a word was cut is no boundary
        word[at[:-1][begun[first]]] = word[at[1:][goes_on[first]] - 1] = -1
        grams, owner = [], []
        for n in GRAMS:
            g = Ranges(flat).grams(n)
            inside = (word[: len(g)] == word[n - 1 :]) & (word[: len(g)] >= 0) if len(g) else np.empty(0, bool)
            grams.append(g[inside])
            owner.append(word[: len(g)][inside])
        self.gram, self.owner = np.concatenate(grams), np.concatenate(owner)
        order = np.argsort(self.owner, kind="stable")
        self.gram, self.owner = self.gram[order], self.owner[order]

    def bins(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return (self.hash % np.uint64(BINS)).astype(np.int64), (mix(self.hash) % np.uint64(BINS)).astype(np.int64), (self.gram % np.uint64(BINS)).astype(np.int64)


def _by_owner(values: np.ndarray, owner: np.ndarray, n: int, how, empty: float = 0.0) -> np.ndarray:
    out = np.full((n, *values.shape[1:]), empty, np.float32)
    if len(values):
        heads = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        out[owner[heads]] = how(values, heads)
    return out


def windows(row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, number of words and text of each window; a text without words has one of none."""
    count = np.bincount(row, minlength=n)
    head = np.r_[0, np.cumsum(count)[:-1]]
    per = 1 + np.maximum(0, -(-(count - LENGTH) // STRIDE))
    of = np.repeat(np.arange(n), per)
    first = (np.arange(len(of)) - np.repeat(np.r_[0, np.cumsum(per)[:-1]], per)) * STRIDE
    return head[of] + first, np.minimum(count[of] - first, LENGTH), of


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    def __init__(self, seed: int = 11):
        rng = np.random.RandomState(seed)
        d, h = 3 + WORD_DIM + CHAR_DIM, HIDDEN
        r = lambda *s: (rng.normal(size=s) / np.sqrt(s[0])).astype(np.float32)
        self.evidence = {"word": np.zeros(BINS, np.float32), "again": np.zeros(BINS, np.float32), "char": np.zeros(BINS, np.float32)}
        self.p = {"ew": r(ROWS, WORD_DIM), "ec": r(ROWS, CHAR_DIM), "wx": r(d, 6 * h), "b": np.zeros(6 * h, np.float32), "uf": r(h, 3 * h), "ub": r(h, 3 * h), "wa": r(2 * h, ATTENTION), "va": r(ATTENTION), "uo": r(2 * h), "bo": np.zeros(1, np.float32)}
        self.calibration = (1.0, 0.0)

    def inputs(self, t: Tokens) -> np.ndarray:
        """The input of each distinct word; one more, all zero, is no word."""
        n = len(t.hash)
        w1, w2, c = t.bins()
        word = np.where(np.abs(self.evidence["word"][w1]) < np.abs(self.evidence["again"][w2]), self.evidence["word"][w1], self.evidence["again"][w2])
        char = self.evidence["char"][c]
        x = np.zeros((n + 1, 3 + WORD_DIM + CHAR_DIM), np.float32)
        x[:n, 0] = word
        x[:n, 1] = _by_owner(char, t.owner, n, np.maximum.reduceat)
        size = np.maximum(np.bincount(t.owner, minlength=n), 1)[:, None]
        x[:n, 2] = _by_owner(char, t.owner, n, np.add.reduceat) / size[:, 0]
        x[:n, 3 : 3 + WORD_DIM] = self.p["ew"][w1 % ROWS]
        x[:n, 3 + WORD_DIM :] = _by_owner(self.p["ec"][c % ROWS], t.owner, n, np.add.reduceat) / size
        return x

    def forward(self, g: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Logits of windows; g: (length, windows, both directions' gates), mask: (length, windows)."""
        h, steps, n = HIDDEN, *mask.shape
        states = np.zeros((steps, n, 2 * h), np.float32)
        cache = []
        for side, u in ((0, self.p["uf"]), (1, self.p["ub"])):
            s = np.zeros((n, h), np.float32)
            for t in range(steps) if side == 0 else range(steps - 1, -1, -1):
                x = g[t, :, side * 3 * h : (side + 1) * 3 * h]
                a = s @ u
                zr = _sigmoid(x[:, : 2 * h] + a[:, : 2 * h])
                z, r = zr[:, :h], zr[:, h:]
                c = np.tanh(x[:, 2 * h :] + r * a[:, 2 * h :])
                new = c + z * (s - c)
                m = mask[t][:, None]
                if keep is not None:
                    cache.append((side, t, s, z, r, c, a[:, 2 * h :]))
                s = np.where(m, new, s)
                states[t, :, side * h : (side + 1) * h] = s
        e = np.tanh(states @ self.p["wa"])
        score = np.where(mask, e @ self.p["va"], -1e9)
        alpha = np.exp(score - score.max(0))
        alpha *= mask
        alpha /= np.maximum(alpha.sum(0), 1e-9)
        pooled = (alpha[:, :, None] * states).sum(0)
        if keep is not None:
            keep.update(cache=cache, states=states, e=e, alpha=alpha, pooled=pooled, mask=mask)
        return pooled @ self.p["uo"] + self.p["bo"]

    def backward(self, k: dict, dz: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the weights after the input, and of g, from those of the logits."""
        p, h = self.p, HIDDEN
        states, alpha, e, mask = k["states"], k["alpha"], k["e"], k["mask"]
        grad = {"uo": k["pooled"].T @ dz, "bo": dz.sum(keepdims=True)}
        dp = dz[:, None] * p["uo"]
        d_alpha = (states * dp).sum(2)
        ds = alpha[:, :, None] * dp
        d_score = alpha * (d_alpha - (alpha * d_alpha).sum(0))
        grad["va"] = np.tensordot(d_score, e, ([0, 1], [0, 1]))
        de = d_score[:, :, None] * p["va"] * (1 - e * e)
        grad["wa"] = np.tensordot(states, de, ([0, 1], [0, 1]))
        ds = ds + de @ p["wa"].T
        dg = np.zeros((*mask.shape, 6 * h), np.float32)
        for side, name in ((0, "uf"), (1, "ub")):
            u, gu, back = p[name], np.zeros_like(p[name]), np.zeros((mask.shape[1], h), np.float32)
            for s_, t, s, z, r, c, an in reversed([x for x in k["cache"] if x[0] == side]):
                m = mask[t][:, None]
                out = ds[t, :, side * h : (side + 1) * h] + back
                d = out * m
                dc = d * (1 - z) * (1 - c * c)
                dzz = d * (s - c) * z * (1 - z)
                dr = dc * an * r * (1 - r)
                gates = np.concatenate([dzz, dr, dc], 1)
                dg[t, :, side * 3 * h : (side + 1) * 3 * h] = gates
                inner = np.concatenate([dzz, dr, dc * r], 1)
                gu += s.T @ inner
                back = inner @ u.T + d * z + out * ~m
            grad[name] = gu
        return grad, dg

    def logits(self, t: Tokens, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Logits of windows of a chunk's words."""
        gates = self.inputs(t) @ self.p["wx"] + self.p["b"]
        out = np.empty(len(first), np.float32)
        at = np.r_[t.at, len(t.hash)]
        steps = np.arange(LENGTH)[:, None]
        for i in range(0, len(first), BLOCK):
            mask = steps < size[i : i + BLOCK]
            token = np.where(mask, first[i : i + BLOCK] + steps, len(at) - 1)
            out[i : i + BLOCK] = self.forward(gates[at[token]], mask)
        return out

    def texts(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """The highest window's logit of each text."""
        n = len(offs) - 1
        t = Tokens(buf, offs)
        first, size, of = windows(t.row, n)
        z = self.logits(t, first, size)
        return np.maximum.reduceat(z, np.searchsorted(of, np.arange(n))) if n else z

    def scores(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        a, b = self.calibration
        return 1 / (1 + np.exp(-np.clip(a * self.texts(buf, offs).astype(np.float64) + b, -30, 30)))


def _evidence(n_pos: int, n_neg: int, pos: np.ndarray, neg: np.ndarray) -> np.ndarray:
    return (np.log((pos + SHRINK) / (n_pos + 2 * SHRINK)) - np.log((neg + SHRINK) / (n_neg + 2 * SHRINK))).astype(np.float32)


def fit(texts: list[str], labels: np.ndarray, rounds: int = 3) -> Network | None:
    """Train on whole texts; None unless there are both classes."""
    pos, neg = int((labels == 1).sum()), int((labels == 0).sum())
    if not pos or not neg:
        return None
    net = Network()
    order = np.random.RandomState(5).permutation(len(texts))
    texts, labels = [texts[i] for i in order], labels[order]
    groups = []
    for i in range(0, len(texts), 200):
        buf, offs = text_view(pa.array(texts[i : i + 200], pa.string()))
        t = Tokens(buf, offs)
        groups.append((t, windows(t.row, len(offs) - 1), labels[i : i + 200]))
    counts = {k: np.zeros((2, BINS)) for k in net.evidence}
    for t, _, y in groups:
        w1, w2, c = t.bins()
        pair = np.unique(t.row * len(t.hash) + t.at)
        d, w = pair // max(len(t.hash), 1), pair % max(len(t.hash), 1)
        for name, b in (("word", w1), ("again", w2)):
            key = np.unique(d * BINS + b[w])
            for label in (0, 1):
                counts[name][label] += np.bincount((key % BINS)[y[key // BINS] == label], minlength=BINS)
        lo, hi = np.searchsorted(t.owner, w), np.searchsorted(t.owner, w, "right")
        n = hi - lo
        g = np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        key = np.unique(np.repeat(d, n) * BINS + c[g])
        for label in (0, 1):
            counts["char"][label] += np.bincount((key % BINS)[y[key // BINS] == label], minlength=BINS)
    for name in counts:
        # shrunk towards no evidence, centred on what an unseen feature gets
        net.evidence[name] = _evidence(pos, neg, counts[name][1], counts[name][0]) - _evidence(pos, neg, np.zeros(1), np.zeros(1))
    rng = np.random.RandomState(9)
    state, step = {}, 0
    for turn in range(rounds):
        for g in rng.permutation(len(groups)):
            t, (first, size, of), y = groups[g]
            if turn == 0:  # the window with most evidence
                e = np.r_[0, np.cumsum(np.maximum(net.inputs(t)[t.at, 1], 0))]
                key = e[first + size] - e[first]
            else:
                key = net.logits(t, first, size)
            heads = np.searchsorted(of, np.arange(len(y)))
            best = np.lexsort((-key, of))[heads]
            extra = np.flatnonzero((y[of] == 0) & (rng.random_sample(len(of)) < 0.05))
            take = rng.permutation(np.r_[best, extra])
            for i in range(0, len(take), 128):
                step += 1
                _step(net, t, first[take[i : i + 128]], size[take[i : i + 128]], y[of[take[i : i + 128]]], state, step, 0.01 / (1 + turn))
    z = np.concatenate([np.maximum.reduceat(net.logits(t, first, size), np.searchsorted(of, np.arange(len(y)))) for t, (first, size, of), y in groups]).astype(float)
    y = np.concatenate([y for _, _, y in groups]).astype(float)
    net.calibration = _platt(z, y)
    return net


def _step(net: Network, t: Tokens, first, size, y, state, step, rate) -> None:
    x = net.inputs(t)
    mask = np.arange(LENGTH)[:, None] < size
    at = np.r_[t.at, len(t.hash)]
    token = at[np.where(mask, first + np.arange(LENGTH)[:, None], len(at) - 1)]
    used, back = np.unique(token, return_inverse=True)
    back = back.reshape(token.shape)
    gates = x[used] @ net.p["wx"] + net.p["b"]
    keep: dict = {}
    z = net.forward(gates[back], mask, keep)
    weight = np.where(y == 1, 0.5 / max((y == 1).sum(), 1), 0.5 / max((y == 0).sum(), 1))
    grad, dg = net.backward(keep, ((_sigmoid(z) - y) * weight).astype(np.float32))
    per = np.zeros_like(gates)
    np.add.at(per, back.ravel(), (dg * mask[:, :, None]).reshape(-1, dg.shape[2]))
    grad["wx"], grad["b"] = x[used].T @ per, per.sum(0)
    dx = per @ net.p["wx"].T
    w1, _, c = t.bins()
    real = used < len(t.hash)
    word, dx = used[real], dx[real]
    grad["ew"] = np.zeros_like(net.p["ew"])
    np.add.at(grad["ew"], w1[word] % ROWS, dx[:, 3 : 3 + WORD_DIM])
    grad["ec"] = np.zeros_like(net.p["ec"])
    lo, hi = np.searchsorted(t.owner, word), np.searchsorted(t.owner, word, "right")
    n = hi - lo
    g = np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
    np.add.at(grad["ec"], c[g] % ROWS, np.repeat(dx[:, 3 + WORD_DIM :] / np.maximum(n, 1)[:, None], n, axis=0))
    for k, v in grad.items():
        m, s = state.setdefault(k, [np.zeros_like(v), np.zeros_like(v)])
        m += 0.1 * (v - m)
        s += 0.01 * (v * v - s)
        net.p[k] -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-7)).astype(np.float32)


def _platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    a, b = 1.0, 0.0
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    target = np.where(y == 1, 0.999, 0.001)
    for _ in range(500):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        d = weight * (p - target)
        scale = weight * p * (1 - p) + 1e-6 * weight
        haa, hab, hbb = (scale * z * z).sum() + 1e-6, (scale * z).sum(), scale.sum() + 1e-6
        ga, gb = (d * z).sum() + 1e-6 * a, d.sum() + 1e-6 * b
        det = haa * hbb - hab * hab
        a, b = a - 0.5 * (hbb * ga - hab * gb) / det, b - 0.5 * (haa * gb - hab * ga) / det
    return float(max(a, 1e-3)), float(b)


def train(docs: DataFrame, labels: DataFrame, text: str = "text", sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Network | None:
    """Fit on at most ``sample`` labelled documents of each class, those of lowest hashed id, whose
    texts have at most ``sample_bytes`` together: one that would pass this is left out whole. Of
    repeated rows one is read.

    A null label or id is no label; an id labelled both ways counts with either, if sampled. Other
    columns, whatever their names, are not read.
    """
    wanted = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", "toxic").distinct()
    chosen = None
    for label in (0, 1):
        one = wanted.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        chosen = one if chosen is None else chosen.unionByName(one)
    joined = docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    joined = joined.withColumns({"h": F.xxhash64("doc_id"), "a": F.xxhash64("text"), "n": F.octet_length("text")})
    joined = joined.dropDuplicates(["h", "doc_id", "toxic", "a"])
    order = ["h", "doc_id", "toxic", "a"]
    room, picked = sample_bytes, set()
    for r in joined.select(*order, "n").orderBy(*order).limit(2 * sample).collect():
        if r.n <= room:
            room -= r.n
            picked.add((r.h, r.a))
    keep = F.broadcast(docs.sparkSession.createDataFrame(sorted(picked), "h bigint, a bigint"))
    got = joined.join(keep, ["h", "a"], "left_semi").orderBy(*order).limit(2 * sample).select("text", "toxic").toArrow()
    return fit(got.column("text").to_pylist(), np.asarray(got.column("toxic")))


def score(docs: DataFrame, net: Network | None, text: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 if score >= 0.5, else 0).

    Null and empty texts have one window of no words. Without a network (one class only) all
    scores are 0. Columns named as the new ones are replaced.
    """
    base = docs.drop("score", "predicted")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, buf, offs in batches(it, text, 1 << 20):
            s = net.scores(buf, offs) if net else np.zeros(rows.num_rows)
            same, called = carried(rows, text, keep_text)
            yield pa.RecordBatch.from_arrays([*same, pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], [*called, "score", "predicted"])

    return base.mapInArrow(run, extended(base if keep_text else base.drop(text), "score double, predicted int"))


def op2(docs: DataFrame, labels: DataFrame) -> DataFrame:
    held = remainder(5) == 0
    net = train(docs.where(~held), labels.where(~held))
    return score(docs.select("doc_id", held.alias("held_out"), "text"), net, keep_text=False)
