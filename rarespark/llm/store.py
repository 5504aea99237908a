"""Counting hashed values across all tasks, into sorted arrays that workers memory-map.

A map task sorts and counts up to ``FLUSH`` values at a time and sends each bucket (a range of the
value space) a compressed block, so a value that is frequent everywhere costs one entry a block,
not one a row. A reduce task merges its bucket's blocks and writes one file of sorted values and
counts into the shared folder; readers find values by binary search in the mapped files. The
number of buckets follows the input, so that a bucket's entries fit a task; beyond ``DIRECT``
buckets blocks are dealt in two steps, so that their number stays in proportion to the input.

A value has 64 bits, and 32 more where the tally is ``checked``: then values are equal only if
both parts are. Counts are exact: those of 2**32 and more lie apart in the file. Every bucket that
has values has a file of a known size, and one that is missing or short is an error.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rarespark.llm.common import local_path, new_dir, write_file

FLUSH = 1 << 21
DIRECT = 1 << 11
MOST = np.uint64(0xFFFFFFFF)
_CODEC = pa.Codec("zstd", compression_level=1)


def text_bytes(df: DataFrame, text: str = "text") -> int:
    return df.agg(F.coalesce(F.sum(F.octet_length(text) + 1), F.lit(0))).first()[0]


def bucket_count(size: int, per_bucket: int) -> int:
    return max(1, -(-size // per_bucket))


def bounds(buckets: int) -> np.ndarray:
    """The lowest value of each bucket but the first."""
    return np.array([(i << 64) // buckets for i in range(1, buckets)], np.uint64)


def pack(arrays: list[np.ndarray]) -> bytes:
    """Arrays of one length; the first sorted, as differences. Bytes of one place lie together."""
    n = len(arrays[0])
    out = [np.int64(n).tobytes(), np.int64(len(arrays)).tobytes()]
    for i, x in enumerate(arrays):
        x = np.diff(x, prepend=x.dtype.type(0)) if not i else x
        out.append(np.int64(x.dtype.itemsize).tobytes() + np.ascontiguousarray(x.view(np.uint8).reshape(n, -1).T).tobytes())
    raw = b"".join(out)
    return len(raw).to_bytes(8, "little") + _CODEC.compress(raw, asbytes=True)


def unpack(blob: bytes) -> list[np.ndarray]:
    raw = np.frombuffer(_CODEC.decompress(blob[8:], int.from_bytes(blob[:8], "little"), asbytes=True), np.uint8)
    n, k = (int(x) for x in raw[:16].view(np.int64))
    out, at = [], 16
    for i in range(k):
        wide = int(raw[at : at + 8].copy().view(np.int64)[0])
        x = np.ascontiguousarray(raw[at + 8 : at + 8 + n * wide].reshape(wide, n).T).view(f"u{wide}").reshape(n)
        out.append(np.cumsum(x, dtype=x.dtype) if not i else x)
        at += 8 + n * wide
    return out


def _in_order(values: np.ndarray, checks: np.ndarray | None, kind: str | None) -> tuple[np.ndarray, np.ndarray]:
    """An order that sorts the values (and their checks), and where new ones begin in it."""
    order = np.argsort(values, kind=kind)
    v = values[order]
    if not len(v):
        return order, order
    new = v[1:] != v[:-1]
    if checks is not None:
        c = checks[order]
        other = c[1:] != c[:-1]
        if (other & ~new).any():
            order = np.lexsort((checks, values))
            v, c = values[order], checks[order]
            new, other = v[1:] != v[:-1], c[1:] != c[:-1]
        new = new | other
    return order, np.flatnonzero(np.r_[True, new])


def merge(values: np.ndarray, *sums: np.ndarray, checks: np.ndarray | None = None) -> list[np.ndarray]:
    """Distinct sorted values (with their checks, if any), and for each array the sums by value."""
    order, heads = _in_order(values, checks, "stable")
    kept = [x[order[heads]] for x in ([values] if checks is None else [values, checks])]
    return [*kept, *(np.add.reduceat(s[order], heads) if len(heads) else s for s in sums)]


def count_distinct(values: np.ndarray, checks: np.ndarray | None = None) -> list[np.ndarray]:
    if checks is None:
        values = np.sort(values)
        heads = np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else np.empty(0, np.int64)
        return [values[heads], np.diff(np.r_[heads, len(values)]).astype(np.uint64)]
    order, heads = _in_order(values, checks, None)
    at = order[heads]
    return [values[at], checks[at], np.diff(np.r_[heads, len(order)]).astype(np.uint64)]


def distinct(values: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct values with their checks, and where each given one is among them."""
    order, heads = _in_order(values, checks, None)
    back = np.empty(len(values), np.int64)
    back[order] = np.repeat(np.arange(len(heads)), np.diff(np.r_[heads, len(order)]))
    return values[order[heads]], checks[order[heads]], back


def _cut(arrays: list[np.ndarray], edges: np.ndarray) -> pa.RecordBatch:
    """(bucket, blob): sorted arrays cut at the edges of buckets."""
    cuts = [0, *np.searchsorted(arrays[0], edges).tolist(), len(arrays[0])]
    rows = [(b, pack([x[i:j] for x in arrays])) for b, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if j > i]
    return pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], ["bucket", "blob"])


def blocks(df: DataFrame, values: Callable[[Iterator[pa.RecordBatch]], Iterator], buckets: int, checked: bool = False) -> DataFrame:
    """(bucket, blob): the counted values of each stretch of each task. ``values`` yields arrays,
    or pairs of arrays (values, checks)."""
    edges = bounds(buckets)
    wide = 1 if buckets <= DIRECT else math.isqrt(buckets - 1) + 1
    first = edges[wide - 1 :: wide]

    def flush(held: list) -> pa.RecordBatch:
        parts = [np.concatenate(x) for x in zip(*held, strict=True)]
        *keys, c = count_distinct(*parts)
        return _cut([*keys, c.astype(np.uint32)], first)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for x in values(it):
            x = x if checked else (x,)
            if len(x[0]):
                held.append(x)
                n += len(x[0])
            if n >= FLUSH:
                yield flush(held)
                held, n = [], 0
        if n:
            yield flush(held)

    def again(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in it:
            for blob in batch.column(1):
                held.append(unpack(blob.as_buffer().to_pybytes()))
                n += len(held[-1][0])
                if n >= FLUSH:
                    yield _cut(_merged(held, 1, checked), edges)
                    held, n = [], 0
        if held:
            yield _cut(_merged(held, 1, checked), edges)

    got = df.mapInArrow(run, "bucket int, blob binary")
    return got if wide == 1 else got.repartition(F.col("bucket")).mapInArrow(again, "bucket int, blob binary")


def _merged(held: list[list[np.ndarray]], sums: int, checked: bool) -> list[np.ndarray]:
    parts = [np.concatenate(x) for x in zip(*held, strict=True)]
    return merge(parts[0], *(x.astype(np.uint64) for x in parts[-sums:]), checks=parts[1] if checked else None)


def gather(table: pa.Table, sums: int = 1, checked: bool = False) -> list[np.ndarray]:
    """The merged content of a bucket's blocks, of ``sums`` summed columns; merges as it goes."""
    whole: list[np.ndarray] | None = None
    held: list[list[np.ndarray]] = []
    n = 0

    def fold() -> list[np.ndarray]:
        return _merged(held if whole is None else [whole, *held], sums, checked)

    for blob in table.column("blob"):
        got = unpack(blob.as_buffer().to_pybytes())
        held.append(got)
        n += len(got[0])
        if n > FLUSH:
            whole, held, n = fold(), [], 0
    return fold() if held else whole


def write_counts(uri: str, arrays: list[np.ndarray]) -> None:
    """One file of a bucket: how many values and how many large counts; the large counts' places
    and themselves; the values; their checks, if any; the counts."""
    *keys, c = arrays
    large = np.flatnonzero(c >= MOST)
    write_file(uri, [np.array([len(c), len(large)], np.int64), large.astype(np.int64), c[large].astype(np.uint64), *keys, np.minimum(c, MOST).astype(np.uint32)])


class Store:
    """Where a tally lies: a file ``uri/bucket`` for each bucket that holds values; ``sizes`` says how many."""

    def __init__(self, uri: str, sizes: np.ndarray, checked: bool = False):
        self.uri, self.sizes, self.checked, self.edges = uri, sizes, checked, bounds(len(sizes))
        self.opened: dict[int, tuple[np.ndarray, ...]] = {}

    def __getstate__(self):
        return {"uri": self.uri, "sizes": self.sizes, "checked": self.checked}

    def __setstate__(self, state):
        self.__init__(**state)

    def open(self, bucket: int) -> tuple[np.ndarray, ...]:
        """Values, checks, counts, places of large counts, and these."""
        if bucket not in self.opened:
            if len(self.opened) >= 512:
                self.opened.clear()
            n = int(self.sizes[bucket])
            if n:
                raw = np.memmap(local_path(f"{self.uri}/{bucket}"), np.uint8, "r")
                m = int(raw[8:16].view(np.int64)[0]) if len(raw) >= 16 else -1
                each = 16 if self.checked else 12
                if m < 0 or int(raw[:8].view(np.int64)[0]) != n or len(raw) != 16 + 16 * m + each * n:
                    raise OSError(f"{self.uri}/{bucket}: {len(raw)} bytes, not those of {n} values")
                at = 16 + 16 * m
                values, checks = raw[at : at + 8 * n].view(np.uint64), raw[at + 8 * n : at + (each - 4) * n].view(np.uint32)
                self.opened[bucket] = values, checks, raw[at + (each - 4) * n :].view(np.uint32), raw[16 : 16 + 8 * m].view(np.int64), raw[16 + 8 * m : at].view(np.uint64)
            else:
                self.opened[bucket] = np.empty(0, np.uint64), np.empty(0, np.uint32), np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.uint64)
        return self.opened[bucket]

    def find(self, values: np.ndarray, checks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each value its count (0: not there), its bucket and its place in it."""
        order = np.argsort(values)
        v = values[order]
        cuts = np.r_[0, np.searchsorted(v, self.edges), len(v)]
        counts, places, buckets = np.zeros(len(v), np.int64), np.zeros(len(v), np.int64), np.zeros(len(v), np.int64)
        for b in np.flatnonzero(np.diff(cuts)):
            i, j = cuts[b], cuts[b + 1]
            keys, known, n, large, much = self.open(int(b))
            buckets[order[i:j]] = b
            if len(keys):
                at = np.searchsorted(keys, v[i:j])
                at[at == len(keys)] = 0
                hit = keys[at] == v[i:j]
                if self.checked:
                    c = checks[order[i:j]]
                    while len(past := np.flatnonzero(hit & (known[at] != c))):  # the next of equal values
                        at[past] += 1
                        out = at[past] == len(keys)
                        at[past[out]] = 0
                        hit[past] = ~out & (keys[at[past]] == v[i:j][past])
                places[order[i:j]] = at
                got = np.where(hit, n[at], 0).astype(np.int64)
                if len(large) and len(over := np.flatnonzero(got == int(MOST))):
                    got[over] = much[np.searchsorted(large, at[over])]
                counts[order[i:j]] = got
        return counts, buckets, places

    def counts(self, values: np.ndarray, checks: np.ndarray | None = None) -> np.ndarray:
        if self.checked:
            return self.find(values, checks)[0]
        distinct, back = np.unique(values, return_inverse=True)
        return self.find(distinct)[0][back]


def tally(df: DataFrame, values, buckets: int, name: str, least: int = 1, checked: bool = False) -> tuple[Store, list]:
    """Count what ``values`` makes of ``df``; keep the values counted at least ``least`` times.
    Returns the store and, by bucket, how many values it keeps and the sum of their counts."""
    uri = new_dir(df.sparkSession, name)

    def reduce(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        b = key[0].as_py()
        got = gather(table, 1, checked)
        if least > 1:
            enough = got[-1] >= least
            got = [x[enough] for x in got]
        write_counts(f"{uri}/{b}", got)
        return pa.table({"bucket": pa.array([b], pa.int32()), "n": pa.array([len(got[0])], pa.int64()), "total": pa.array([int(got[-1].sum())], pa.int64())})

    kept = blocks(df, values, buckets, checked).groupBy("bucket").applyInArrow(reduce, "bucket int, n bigint, total bigint").collect()
    sizes = np.zeros(buckets, np.int64)
    for r in kept:
        sizes[r.bucket] = r.n
    return Store(uri, sizes, checked), kept
