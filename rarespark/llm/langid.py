"""Operator 9, language identification with hyperdimensional profiles.

Every letter has a fixed random vector of +1 and -1. A letter n-gram is the product (binding) of
its letters' vectors, each rotated by its place from the end; a text's profile is the sum
(bundling) of its n-grams', and a language's prototype the sum over its training texts. A text
gets the language whose prototype has the largest cosine with its profile.

Prototypes are summed where the texts lie: a task sends one vector for each language it met.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rarespark.llm.common import carried, extended, remainder, sub_batches

DIMENSIONS = 512
GRAM = 3
SHARPNESS = 40.0
CACHE_GRAMS = 60_000
BLOCK, CELLS = 1 << 15, 1 << 24
_LETTERS: dict[int, np.ndarray] = {}


def letter_vector(code: int, dimensions: int) -> np.ndarray:
    """The vector of a code point; 0 is whatever lies between letters."""
    key = code * 65_536 + dimensions
    if key not in _LETTERS:
        bits = np.random.Generator(np.random.PCG64([code, dimensions])).integers(0, 2, dimensions, dtype=np.int8)
        _LETTERS[key] = bits * 2 - 1
    return _LETTERS[key]


class Grams:
    """The vectors of the n-grams met so far; a vector depends on its letters only."""

    def __init__(self, dimensions: int, size: int):
        self.dimensions, self.size = dimensions, size
        self.at: dict[tuple[int, ...], int] = {}
        self.table = np.empty((1024, dimensions), np.int8)

    def rows(self, grams: np.ndarray) -> np.ndarray:
        """Rows of ``table`` for n-grams given as an array of code points."""
        keys = list(map(tuple, grams.tolist()))
        if len(self.at) > CACHE_GRAMS:
            self.at.clear()
        new = [k for k in keys if k not in self.at]
        if new:
            n, m = len(self.at), len(new)
            if n + m > len(self.table):
                grown = np.empty((max(2 * len(self.table), n + m), self.dimensions), np.int8)
                grown[:n] = self.table[:n]
                self.table = grown
            codes = np.array(new)
            got = np.ones((m, self.dimensions), np.int8)
            for place in range(self.size):
                distinct, back = np.unique(codes[:, place], return_inverse=True)
                letters = np.stack([np.roll(letter_vector(int(c), self.dimensions), self.size - 1 - place) for c in distinct])
                got *= letters[back]
            self.table[n : n + m] = got
            self.at.update(zip(new, range(n, n + m), strict=True))
        return np.array([self.at[k] for k in keys])


_GRAMS: dict[tuple[int, int], Grams] = {}


def gram_counts(texts: list[str | None], size: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a chunk: its distinct n-grams as rows of code points; text, n-gram and number of each
    that occurs; and which texts have a letter. Case doesn't count; whatever is between letters
    counts as one gap, as do a text's ends."""
    low = [(t or "").lower() for t in texts]
    row = np.repeat(np.arange(len(low)), [len(t) + 1 for t in low])
    code = np.frombuffer((" ".join(low) + " ").encode("utf-32-le"), np.uint32)
    met = np.flatnonzero(np.bincount(code))
    letters = np.array([c for c in met.tolist() if chr(c).isalpha()], np.int64)
    alphabet = np.r_[0, letters]
    small = np.zeros(int(met[-1]) + 1, np.int64)
    small[letters] = np.arange(1, len(alphabet))
    code = small[code]
    keep = np.ones(len(code), bool)
    keep[1:] = (code[1:] != 0) | (code[:-1] != 0)
    code, row = code[keep], row[keep]
    has = np.bincount(row[code != 0], minlength=len(low)) > 0
    # every text ends in a gap; put one before its first letter too
    head = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    head = head[code[head] != 0]
    code, row = np.insert(code, head, 0), np.insert(row, head, row[head])
    k = len(alphabet)
    if k**size > 1 << 62:
        raise ValueError(f"{k} letters in one chunk; n-grams of {size} of them have no code")
    n = max(len(code) - size + 1, 0)
    gram = np.zeros(n, np.int64)
    for place in range(size):
        gram = gram * k + code[place : place + n]
    inside = row[:n] == row[size - 1 : size - 1 + n]
    gram, of = gram[inside], row[:n][inside]
    if k**size <= 1 << 24:
        kinds = np.flatnonzero(np.bincount(gram, minlength=k**size))
        place_of = np.zeros(k**size, np.int64)
        place_of[kinds] = np.arange(len(kinds))
        gram = place_of[gram]
    else:
        kinds, gram = np.unique(gram, return_inverse=True)
    key = np.sort(of * max(len(kinds), 1) + gram)
    heads = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
    count = np.diff(np.r_[heads, len(key)])
    key = key[heads]
    spelled = np.stack([alphabet[kinds // k ** (size - 1 - p) % k] for p in range(size)], 1)
    return spelled, key // max(len(kinds), 1), key % max(len(kinds), 1), count, has


def bundle(group: np.ndarray, n: int, spelled: np.ndarray, gram: np.ndarray, count: np.ndarray, dimensions: int = DIMENSIONS) -> np.ndarray:
    """The bundled vectors of ``n`` groups of n-grams: their counts times the n-grams' vectors, at
    most ``BLOCK`` n-grams and about ``CELLS`` counts at once."""
    grams = _GRAMS.setdefault((dimensions, spelled.shape[1]), Grams(dimensions, spelled.shape[1]))
    out = np.zeros((n, dimensions), np.float32)
    step = max(1, min(BLOCK, CELLS // max(n, 1)))
    if len(spelled) > step:
        order = np.argsort(gram, kind="stable")
        group, gram, count = group[order], gram[order], count[order]
    for i in range(0, len(spelled), step):
        some = spelled[i : i + step]
        lo, hi = np.searchsorted(gram, [i, i + step]) if len(spelled) > step else (0, len(gram))
        rows = grams.rows(some)
        vectors = grams.table[rows].astype(np.float32)
        dense = np.zeros((n, len(some)), np.float32)
        np.add.at(dense, (group[lo:hi], gram[lo:hi] - i), count[lo:hi].astype(np.float32))
        out += dense @ vectors
    return out


def profiles(texts: list[str | None], dimensions: int = DIMENSIONS, size: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Each text's bundled vector, and whether it has a letter."""
    spelled, of, gram, count, has = gram_counts(texts, size)
    return bundle(of, len(texts), spelled, gram, count, dimensions), has


def train(docs: DataFrame, text: str = "text", lang: str = "lang") -> dict[str, np.ndarray]:
    """Prototypes of all languages of rows with a language; rows without letters add nothing."""

    def partial(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for rows in sub_batches(it, "text", 1 << 20):
            spelled, of, gram, count, _ = gram_counts(rows.column(0).to_pylist())
            names = sorted(set(rows.column(1).to_pylist()))
            group = np.array([names.index(x) for x in rows.column(1).to_pylist()])
            got = bundle(group[of], len(names), spelled, gram, count).astype(np.float64)
            for i, x in enumerate(names):
                sums[x] = sums.get(x, 0) + got[i]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array(list(sums.values()), pa.list_(pa.float64()))], ["lang", "v"])

    # summed place by place, so that no task holds all of a language's vectors
    only = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    parts = only.mapInArrow(partial, "lang string, v array<double>").select("lang", F.posexplode("v").alias("place", "x"))
    got: dict[str, np.ndarray] = {}
    for r in parts.groupBy("lang", "place").agg(F.sum("x").alias("x")).collect():
        got.setdefault(r.lang, np.zeros(DIMENSIONS))[r.place] = r.x
    return {x: got[x] for x in sorted(got) if np.any(got[x])}


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], text: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with lang_pred and score (0 to 1: a softmax of the cosines).

    Texts that are null or have no letter, and all texts where there is no prototype, get ``und``
    and 0. Ties go to the first language by name. Columns named as the new ones are replaced.
    """
    langs = list(prototypes)
    p = np.array([v / np.linalg.norm(v) for v in prototypes.values()], np.float32).reshape(len(langs), DIMENSIONS)
    base = docs.drop("lang_pred", "score")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in sub_batches(it, text, 1 << 20):
            got, has = profiles(rows.column(rows.schema.get_field_index(text)).to_pylist())
            if langs:
                cos = got @ p.T / np.maximum(np.linalg.norm(got, axis=1, keepdims=True), 1e-9)
                best = cos.argmax(1)
                e = np.exp(SHARPNESS * (cos - cos.max(1, keepdims=True)).astype(np.float64))
                score = np.where(has, 1 / e.sum(1), 0.0)
                name = [langs[b] if h else "und" for b, h in zip(best, has, strict=True)]
            else:
                name, score = ["und"] * rows.num_rows, np.zeros(rows.num_rows)
            same, called = carried(rows, text, keep_text)
            yield pa.RecordBatch.from_arrays([*same, pa.array(name, pa.string()), pa.array(score, pa.float64())], [*called, "lang_pred", "score"])

    return base.mapInArrow(run, extended(base if keep_text else base.drop(text), "lang_pred string, score double"))


def op9(docs: DataFrame) -> DataFrame:
    held = remainder(3) == 1
    prototypes = train(docs.where(~held).select("text", "lang"))
    return predict(docs.select("doc_id", held.alias("held_out"), "text"), prototypes, keep_text=False)
