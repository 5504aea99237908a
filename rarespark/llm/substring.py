"""Operator 5, exact substring deduplication by a depth-limited radix sort of suffixes.

Every start of a window of ``depth`` bytes is a suffix, read through ``depth`` bytes only. The
passes go from the digit that parts most suffixes to the last; after each, only groups of two or
more go on, and the groups that are left are exactly the repeated windows:

1. The suffix's anchor: the least-hashed ``gram`` bytes within its window. Equal windows have
   equal anchors at equal offsets, so suffixes that share an anchor place are sorted as one run.
2. The run's whole content. Where all runs of an anchor are equal, their suffixes are all
   repeated, and none needs a look of its own.
3. For the other runs, each suffix through its full depth.

Groups are counted, not gathered: tasks send counted blocks of digit hashes (``store``), and read
the texts again in the next pass. A passage in a third of all documents costs one entry a block.
Anchors only part the suffixes, so 64 bits of a quick hash do; runs and suffixes are told apart by
93 bits of their bytes, the run's shape included.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rarespark.llm.common import batches, extended
from rarespark.llm.hashing import Fields, Ranges, chain, mix
from rarespark.llm.store import Store, bucket_count, tally, text_bytes

PIECE, CHUNK = 2 << 20, 1 << 20
_LOW = np.uint64(0xFFFFFF)


class Runs:
    """The windows of a buffer of at most 2**24 bytes: runs of starts that share an anchor."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray, depth: int, gram: int):
        self.depth, n = depth, len(buf) - depth + 1
        sizes = np.diff(offs)
        long = sizes >= depth
        self.first = self.last = self.anchor = np.empty(0, np.int64)
        self.gram = np.empty(0, np.uint64)
        if n < 1 or not long.any():
            return
        self.fields = Fields(buf)
        grams = Ranges(buf).grams(gram)
        x = (grams & ~_LOW) | np.arange(len(grams), dtype=np.uint64)
        width, span = depth - gram + 1, 1
        while span * 2 <= width:
            x = np.minimum(x[:-span], x[span:])
            span *= 2
        low = np.minimum(x[:n], x[width - span : width - span + n]) & _LOW
        step = np.zeros(n + 1, np.int8)
        step[offs[:-1][long]] += 1
        step[(offs[1:] - depth + 1)[long]] -= 1
        valid = np.cumsum(step[:n], dtype=np.int8) > 0
        new = valid.copy()
        new[1:] &= ~valid[:-1] | (low[1:] != low[:-1])
        self.first = np.flatnonzero(new)
        end = valid.copy()
        end[:-1] &= ~valid[1:] | (low[1:] != low[:-1])
        self.last = np.flatnonzero(end)
        self.anchor = low[self.first].astype(np.int64)
        self.gram = mix(grams[self.anchor])  # least of many, so near 0: spread again over the buckets

    def whole(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        f, e = self.first[which], self.last[which] + self.depth
        if not len(f):
            return np.empty(0, np.uint64), np.empty(0, np.uint32)
        return chain(self.fields(f, e), (self.anchor[which] - f).astype(np.uint64)), self.fields.check(f, e)

    def starts(self, which: np.ndarray) -> np.ndarray:
        f, size = self.first[which], self.last[which] - self.first[which] + 1
        return np.repeat(f - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum()) if len(f) else f

    def windows(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.fields(starts, starts + self.depth), self.fields.check(starts, starts + self.depth)


def pieces(buf: np.ndarray, offs: np.ndarray, depth: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The buffer, or, where one text is longer than ``PIECE``, stretches of it that overlap so
    that each window lies in exactly one."""
    if len(buf) <= PIECE + depth:
        yield 0, buf, offs
        return
    for i in range(0, len(buf), PIECE):
        part = buf[i : i + PIECE + depth - 1]
        yield i, part, np.array([0, len(part)])


def repeated_starts(buf: np.ndarray, offs: np.ndarray, depth: int, gram: int, stores: list[Store]) -> np.ndarray:
    """All starts, in order, of windows that the stores show to be repeated."""
    out = []
    for base, part, at in pieces(buf, offs, depth):
        runs = Runs(part, at, depth, gram)
        which, same = _sorted_out(runs, stores)
        mixed = runs.starts(which[~same])
        if len(mixed):
            mixed = mixed[stores[2].counts(*runs.windows(mixed)) > 1]
        out += [base + runs.starts(which[same]), base + mixed]
    return np.sort(np.concatenate(out)) if out else np.empty(0, np.int64)


def _sorted_out(runs: Runs, stores: list[Store]) -> tuple[np.ndarray, np.ndarray]:
    """The runs whose anchor is repeated, and of these which have an anchor all of whose runs are
    equal."""
    if not len(runs.first):
        return np.empty(0, np.int64), np.empty(0, bool)
    seen = stores[0].counts(runs.gram)
    which = np.flatnonzero(seen > 1)
    if not len(which):
        return which, np.empty(0, bool)
    return which, stores[1].counts(*runs.whole(which)) == seen[which]


def sort_suffixes(docs: DataFrame, depth: int = 200, gram: int = 64, text: str = "text") -> list[Store]:
    only = docs.select(text)
    size = text_bytes(only, text)

    def anchors(it):
        for _, buf, offs in batches(it, text, CHUNK):
            for _, part, at in pieces(buf, offs, depth):
                yield Runs(part, at, depth, gram).gram

    stores = [tally(only, anchors, bucket_count(size, 96 << 20), "suffix-anchors", 2)[0]]

    def contents(it):
        for _, buf, offs in batches(it, text, CHUNK):
            for _, part, at in pieces(buf, offs, depth):
                runs = Runs(part, at, depth, gram)
                if len(runs.first):
                    yield runs.whole(np.flatnonzero(stores[0].counts(runs.gram) > 1))

    stores.append(tally(only, contents, bucket_count(size, 256 << 20), "suffix-runs", 2, True)[0])

    def windows(it):
        for _, buf, offs in batches(it, text, CHUNK):
            for _, part, at in pieces(buf, offs, depth):
                runs = Runs(part, at, depth, gram)
                which, same = _sorted_out(runs, stores)
                starts = runs.starts(which[~same])
                if len(starts):
                    yield runs.windows(starts)

    stores.append(tally(only, windows, bucket_count(size, 16 << 20), "suffix-windows", 2, True)[0])
    return stores


def spans(starts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The maximal runs of bytes that windows at ``starts`` (of one text, in order) cover."""
    if not len(starts):
        return starts, starts
    cut = np.flatnonzero(np.diff(starts) > depth)
    return starts[np.r_[0, cut + 1]], starts[np.r_[cut, len(starts) - 1]] + depth


def _each(it, text: str, depth: int, gram: int, stores: list[Store]):
    """For each chunk: its rows, and for each row the bytes and the spans to remove."""
    for rows, buf, offs in batches(it, text, CHUNK):
        starts = repeated_starts(buf, offs, depth, gram, stores)
        cuts = np.searchsorted(starts, offs)
        out = []
        for i in range(len(offs) - 1):
            a, b = spans(starts[cuts[i] : cuts[i + 1]] - offs[i], depth)
            out.append((buf[offs[i] : offs[i + 1]], a, b))
        yield rows, out


def _kept(data: np.ndarray, a: np.ndarray, b: np.ndarray) -> bytes:
    if not len(a):
        return data.tobytes()
    return b"".join(data[i:j].tobytes() for i, j in zip(np.r_[0, b], np.r_[a, len(data)], strict=True))


def remove_repeats(docs: DataFrame, depth: int = 200, gram: int = 64, text: str = "text") -> DataFrame:
    """``docs`` with ``kept`` (binary: the text's UTF-8 bytes without those that a repeated window
    covers), ``kept_text`` (these bytes' whole characters) and ``removed`` (array of start, end of
    the removed bytes).

    A window of ``depth`` bytes is repeated if the same bytes start at any other place of any
    text, overlaps included; no window crosses texts. Null is the empty text; texts shorter than
    ``depth`` keep all. Equal rows are places of their own, so both lose all they share. Other
    columns pass; columns named as the new ones are replaced.
    """
    stores = sort_suffixes(docs, depth, gram, text)
    base = docs.drop("kept", "kept_text", "removed")
    schema = extended(base, "kept binary, kept_text string, removed array<struct<start:bigint,end:bigint>>")
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, got in _each(it, text, depth, gram, stores):
            kept = pa.array([_kept(*x) for x in got], pa.binary())
            whole = pa.array([k.as_py().decode("utf-8", "ignore") for k in kept], pa.string())
            cut = pa.array([[{"start": int(i), "end": int(j)} for i, j in zip(a, b, strict=True)] for _, a, b in got], kind)
            yield pa.RecordBatch.from_arrays([*rows.columns, kept, whole, cut], [*rows.schema.names, "kept", "kept_text", "removed"])

    return base.mapInArrow(run, schema)


def op5(docs: DataFrame, depth: int = 200, gram: int = 64) -> DataFrame:
    stores = sort_suffixes(docs, depth, gram)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, got in _each(it, "text", depth, gram, stores):
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column(0),
                    pa.array([len(x) for x, _, _ in got], pa.int64()),
                    pa.array([int((b - a).sum()) for _, a, b in got], pa.int64()),
                    pa.array([len(a) for _, a, _ in got], pa.int64()),
                    pa.array([hashlib.sha256(_kept(*x)).hexdigest() for x in got], pa.string()),
                ],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
