"""Operator 10, a quality classifier from weak labels.

1. Heuristic labellers look at each whole text and vote good, bad or nothing.
2. How often each pattern of votes occurs is counted over all documents; there are at most
   3**labellers patterns. Expectation-maximisation over these counts estimates the share of good
   documents and each labeller's accuracy, without any given label, and so each pattern's posterior.
3. Posterior labels train a hashed linear scorer (logistic regression on frequencies of hashed
   character-shape trigrams), on at most ``SAMPLE`` documents.
The scorer decides. Given quality labels are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rarespark.llm.common import batches, carried, extended, words
from rarespark.llm.hashing import Ranges

SAMPLE = 6_000
FEATURES = 1_024
CHUNK = 1 << 18  # of bytes whose features are held at once
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_UPPER = np.isin(np.arange(256), range(65, 91))
_LETTER = _UPPER | np.isin(np.arange(256), range(97, 123)) | (np.arange(256) >= 128)
_DIGIT = np.isin(np.arange(256), range(48, 58))
_SYMBOL = np.isin(np.arange(256), [ord(c) for c in "#$%&*+/<=>@\\^_`{|}~"])
_STOP = np.isin(np.arange(256), [ord(c) for c in ".?!"])
_SHOUT = np.arange(256) == ord("!")
_BAR = np.arange(256) == ord("|")
LABELLERS = ("case", "symbols", "shouting", "tables", "letters", "sentences", "word_length", "repetition", "echo", "digits")


def _sums(mask: np.ndarray, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    total = np.r_[0, np.cumsum(mask[buf], dtype=np.int64)]
    return (total[offs[1:]] - total[offs[:-1]]).astype(float)


def measures(buf: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """What the labellers look at, of each text; shares of nothing are 0."""
    n = np.diff(offs)
    starts, ends, row = words(buf, offs, ~_SPACE)
    count = np.bincount(row, minlength=len(n)).astype(float)
    of = lambda a, b: a / np.maximum(b, 1)
    letters = _sums(_LETTER, buf, offs)
    space = _sums(_SPACE, buf, offs)
    hashes = Ranges(buf)(starts, ends)
    order = np.lexsort((hashes, row))
    h, r = hashes[order], row[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (r[1:] != r[:-1])] if len(h) else np.empty(0, bool)
    kinds = np.bincount(r[new], minlength=len(n)).astype(float)
    # words that follow an equal word, or come after it again at two words' distance
    echo = np.zeros(len(hashes), bool)
    for back in (1, 2):
        echo[back:] |= (hashes[back:] == hashes[:-back]) & (row[back:] == row[:-back])
    return {
        "words": count,
        "case": of(_sums(_UPPER, buf, offs), letters),
        "symbols": of(_sums(_SYMBOL, buf, offs), n - space),
        "shouting": of(_sums(_SHOUT, buf, offs), count),
        "tables": of(_sums(_BAR, buf, offs), count),
        "letters": of(letters, n - space),
        "sentences": of(_sums(_STOP, buf, offs), count),
        "word_length": of(np.bincount(row, ends - starts, len(n)), count),
        "repetition": np.log(np.maximum(kinds, 1)) / np.log(np.maximum(count, 2)),
        "echo": of(np.bincount(row, echo, len(n)), count),
        "digits": of(_sums(_DIGIT, buf, offs), n - space),
    }


#: Labellers of shares of words look at texts of so many words or more.
ENOUGH = 5
_OF_WORDS = ("shouting", "tables", "sentences", "word_length", "repetition", "echo")

#: By labeller: bad below, good from, good to, bad above; between them it doesn't vote.
THRESHOLDS = {
    "case": (-1, 0, 0.15, 0.4),
    "symbols": (-1, 0, 0.01, 0.05),
    "shouting": (-1, 0, 0.02, 0.2),
    "tables": (-1, 0, 0.0, 0.1),
    "letters": (0.7, 0.85, 1, 2),
    "sentences": (0.004, 0.02, 0.4, 0.6),
    "word_length": (2, 3, 10, 16),
    "repetition": (0.7, 0.8, 1, 2),
    "echo": (-1, 0, 0.04, 0.15),
    "digits": (-1, 0, 0.05, 0.4),
}


def votes(m: dict[str, np.ndarray]) -> np.ndarray:
    """0 no vote, 1 good, 2 bad, by text and labeller; texts of no words get no vote, those of fewer
    than ``ENOUGH`` none on shares of words."""
    out = []
    for name in LABELLERS:
        bad_below, good_from, good_to, bad_above = THRESHOLDS[name]
        v = m[name]
        x = np.where((v < bad_below) | (v > bad_above), 2, np.where((v >= good_from) & (v <= good_to), 1, 0))
        out.append(np.where(m["words"] >= (ENOUGH if name in _OF_WORDS else 1), x, 0))
    return np.stack(out, 1)


def patterns(v: np.ndarray) -> np.ndarray:
    return v @ (3 ** np.arange(v.shape[1]))


def estimate(counts: dict[int, int], labellers: int = len(LABELLERS), rounds: int = 100) -> tuple[dict[int, float], np.ndarray]:
    """The posterior of good by pattern, and each labeller's probabilities (class, vote).
    No vote is no evidence."""
    if not counts:
        return {}, np.full((labellers, 2, 2), 1 / 2)
    keys = np.array(sorted(counts))
    n = np.array([counts[k] for k in keys], float)
    v = keys[:, None] // 3 ** np.arange(labellers) % 3
    good, bad = (v == 1).sum(1), (v == 2).sum(1)
    post = np.where(bad >= 1, 0.2, 0.9) + 0.05 * np.tanh(good - 2.0 * bad)
    for _ in range(rounds):
        w = np.stack([post, 1 - post]) * n
        share = (w.sum(1) + 1) / (n.sum() + 2)
        # sums by labeller, class and vote, with a count of 1 for each vote
        p = np.stack([[[(w[c] * (v[:, j] == x)).sum() + 1 for x in (1, 2)] for c in range(2)] for j in range(labellers)])
        p /= p.sum(2, keepdims=True)
        log = np.log(share)[:, None] + sum(np.where(v[:, j] > 0, np.log(p[j][:, v[:, j] - 1]), 0) for j in range(labellers))
        now = 1 / (1 + np.exp(np.clip(log[1] - log[0], -700, 700)))
        if np.abs(now - post).max() < 1e-6:
            break
        post = now
    return dict(zip(keys.tolist(), post.tolist(), strict=True)), p


def _shapes() -> np.ndarray:
    """A small code for each byte: letters by case, digits, space, and each sign for itself."""
    out = np.arange(256)
    out[_LETTER] = 1
    out[_UPPER] = 2
    out[_DIGIT] = 3
    out[_SPACE] = 4
    return out.astype(np.uint64)


_SHAPES = _shapes()


def features(buf: np.ndarray, offs: np.ndarray, v: np.ndarray) -> np.ndarray:
    """By text: square roots of the shares of hashed shape trigrams, and the hashed votes."""
    n = len(offs) - 1
    out = np.zeros((n, FEATURES), np.float32)
    ballot = (np.arange(v.shape[1]) * 3 + v + 1).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(54)
    np.add.at(out, (np.arange(n)[:, None], ballot.astype(np.int64)), np.float32(0.5))
    if len(buf) < 3:
        return out
    s = _SHAPES[buf]
    code = (s[:-2] << np.uint64(16) | s[1:-1] << np.uint64(8) | s[2:]) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(54)
    row = np.repeat(np.arange(n), np.diff(offs))
    inside = row[:-2] == row[2:]
    got = np.bincount(row[:-2][inside] * FEATURES + code[inside].astype(np.int64), minlength=n * FEATURES).reshape(n, FEATURES)
    total = got.sum(1, keepdims=True)
    return out + np.sqrt(got / np.maximum(total, 1)).astype(np.float32)


def fit(x: np.ndarray, y: np.ndarray, steps: int = 400) -> np.ndarray:
    """Weights (the last one the constant) of a logistic regression on soft labels, by Adam."""
    x = np.c_[x, np.ones(len(x), np.float32)]
    w, m, s = (np.zeros(x.shape[1]) for _ in range(3))
    # both classes weigh the same, so that a rare class is learnt
    mass = np.array([max(y.sum(), 1e-9), max((1 - y).sum(), 1e-9)])
    weight = (y / mass[0] + (1 - y) / mass[1]) / 2
    for i in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w.astype(np.float32), -30, 30)))
        g = x.T @ (weight * (p - y)).astype(np.float32) + 1e-5 * w
        m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
        w -= 0.1 * (m / (1 - 0.9**i)) / (np.sqrt(s / (1 - 0.99**i)) + 1e-9)
    return w


def train(docs: DataFrame, text: str = "text", sample: int = SAMPLE) -> tuple[np.ndarray | None, dict[int, float]]:
    """The scorer's weights (None without documents) and the posterior by vote pattern."""

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, buf, offs in batches(it, text, 1 << 20):
            k, n = np.unique(patterns(votes(measures(buf, offs))), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(n, pa.int64())], ["k", "n"])

    only = docs.select(text)
    post, _ = estimate(dict(only.mapInArrow(count, "k bigint, n bigint").groupBy("k").agg(F.sum("n")).collect()))
    keyed = docs.select(F.xxhash64(*[c for c, t in docs.dtypes if "map<" not in t]).alias("_h"), text)
    lowest = keyed.select("_h").distinct().orderBy("_h").limit(sample).agg(F.max("_h")).first()[0]
    if lowest is None:
        return None, post

    def look(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, buf, offs in batches(it, text, CHUNK):
            v = votes(measures(buf, offs))
            y = [post[k] for k in patterns(v).tolist()]
            x = [f.tobytes() for f in features(buf, offs, v).astype(np.float16)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()), pa.array(y, pa.float64())], ["x", "y"])

    got = keyed.where(F.col("_h") <= lowest).dropDuplicates(["_h"]).select(text).mapInArrow(look, "x binary, y double").limit(sample).toArrow()
    x = np.frombuffer(b"".join(got.column("x").to_pylist()), np.float16).reshape(-1, FEATURES).astype(np.float32)
    order = np.lexsort((x.sum(1), np.asarray(got.column("y"))))
    return fit(x[order], np.asarray(got.column("y"))[order]), post


def classify(docs: DataFrame, text: str = "text", sample: int = SAMPLE, keep_text: bool = True) -> DataFrame:
    """``docs`` with weak_posterior, score (0 to 1, higher is better) and keep (score >= 0.5).

    Null counts as the empty text; texts of any length are read whole; a score of exactly 0.5 is kept.
    Repeated rows count each in the votes, once in the scorer's sample. A text without words has no vote; it gets the posterior of no
    votes and the scorer's constant. Empty input gives no rows. Equal texts score alike. Columns
    named as the new ones are replaced.
    """
    w, post = train(docs, text, sample)
    names = ["weak_posterior", "score", "keep"]
    base = docs.drop(*names)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, buf, offs in batches(it, text, CHUNK):
            v = votes(measures(buf, offs))
            p = [post[k] for k in patterns(v).tolist()]
            z = features(buf, offs, v) @ w[:-1].astype(np.float32) + w[-1]
            score = 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30)))
            same, called = carried(rows, text, keep_text)
            yield pa.RecordBatch.from_arrays([*same, pa.array(p, pa.float64()), pa.array(score), pa.array(score >= 0.5)], [*called, *names])

    return base.mapInArrow(run, extended(base if keep_text else base.drop(text), "weak_posterior double, score double, keep boolean"))


def op10(docs: DataFrame) -> DataFrame:
    return classify(docs.select("doc_id", "text"), keep_text=False)
