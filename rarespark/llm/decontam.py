"""Operator 6, benchmark decontamination with an FM-index per training shard.

A shard is the documents of one task's stretch of input. Only words that occur in the benchmark
can be part of a match, so the shard's indexed text is its maximal runs of such words, with a
separator after each. Suffixes are sorted by prefix doubling; the Burrows-Wheeler transform is
held as a wavelet matrix with sampled popcounts, and all test phrases are searched backward
together, one symbol a step. Occurrences are located by walking back to a sampled suffix
position, and a document's overlapping occurrences merge into spans. A shard needs nothing of
another, so a lost one is indexed again alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rarespark.llm.common import batches, carried, extended, lower_ascii, text_view, words
from rarespark.llm.hashing import Fields

SHARD_BYTES = 24 << 20
BENCHMARK_BYTES = 64 << 20
EVERY = 8
_LOWER = lower_ascii()
_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 256)]] = True


def hashed_words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    low = _LOWER[buf]
    starts, ends, row = words(low, offs, _WORD)
    return Fields(low)(starts, ends), row, starts, ends


class Bits:
    """A bit vector with ranks from counts every 64 bits."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        padded = np.zeros(-(-(n + 1) // 64) * 64, np.uint8)
        padded[:n] = bits
        self.blocks = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.r_[0, np.cumsum(np.bitwise_count(self.blocks), dtype=np.int64)]

    def rank(self, i: np.ndarray) -> np.ndarray:
        block, bit = i >> 6, (i & 63).astype(np.uint64)
        return self.before[block] + np.bitwise_count(self.blocks[block] & ((np.uint64(1) << bit) - np.uint64(1)))

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.blocks[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)


class Wavelet:
    """A wavelet matrix: ranks and access of symbols below 2**bits."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.levels, self.zeros, self.bits = [], [], bits
        x = symbols
        for level in range(bits - 1, -1, -1):
            bit = (x >> level) & 1
            self.levels.append(Bits(bit))
            order = np.r_[np.flatnonzero(bit == 0), np.flatnonzero(bit)]
            self.zeros.append(int(len(x) - bit.sum()))
            x = x[order]

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How many of the first ``i`` symbols are ``symbol``."""
        start = np.zeros_like(i)
        for k, (bits, zeros) in enumerate(zip(self.levels, self.zeros, strict=True)):
            one = (symbol >> (self.bits - 1 - k)) & 1
            a, b = bits.rank(start), bits.rank(i)
            start, i = np.where(one, zeros + a, start - a), np.where(one, zeros + b, i - b)
        return i - start

    def step(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at ``i`` and its rank there."""
        symbol, start = np.zeros_like(i), np.zeros_like(i)
        for bits, zeros in zip(self.levels, self.zeros, strict=True):
            one = bits.get(i).astype(np.int64)
            symbol = symbol << 1 | one
            a, b = bits.rank(start), bits.rank(i)
            start, i = np.where(one, zeros + a, start - a), np.where(one, zeros + b, i - b)
        return symbol, i - start


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Of symbols where each 0 ends a run and is less than all others, earlier zeros first."""
    n = len(text)
    zero = text == 0
    rank = text.astype(np.int64) + int(zero.sum())
    rank[zero] = np.arange(int(zero.sum()))
    order = np.argsort(rank, kind="stable")
    span = 1
    while True:
        sorted_ = rank[order]
        new = np.r_[True, sorted_[1:] != sorted_[:-1]]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new) - 1
        if new.all():
            return order
        second = np.full(n, -1, np.int64)
        second[: n - span] = rank[span:]
        rank = rank * (n + 1) + second + 1
        tied = np.r_[~new[1:], False] | ~new  # only places in groups move
        at = np.flatnonzero(tied)
        part = order[at]
        order[at] = part[np.argsort(rank[part], kind="stable")]
        span *= 2


class Index:
    def __init__(self, text: np.ndarray, alphabet: int):
        self.n = len(text)
        order = suffix_array(text)
        # zeros are one symbol here; no phrase holds one, and no walk needs to pass one
        transformed = text[order - 1]
        self.wavelet = Wavelet(transformed, max(1, int(alphabet).bit_length()))
        self.below = np.r_[0, np.cumsum(np.bincount(text, minlength=alphabet + 1))]
        self.sampled = Bits((order % EVERY == 0) | (text[order - 1] == 0))
        self.samples = order[(order % EVERY == 0) | (text[order - 1] == 0)]

    def search(self, phrases: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of the suffixes that begin with each phrase; phrases are padded rows."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n)
        for back in range(int(sizes.max(initial=0))):
            live = np.flatnonzero((back < sizes) & (low < high))
            if not len(live):
                break
            c = phrases[live, sizes[live] - 1 - back]
            low[live] = self.below[c] + self.wavelet.rank(c, low[live])
            high[live] = self.below[c] + self.wavelet.rank(c, high[live])
        return low, np.maximum(high, low)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        out, steps = np.empty(len(rows), np.int64), 0
        left, at = np.arange(len(rows)), rows.copy()
        while len(left):
            hit = self.sampled.get(at).astype(bool)
            out[left[hit]] = self.samples[self.sampled.rank(at[hit])] + steps
            left, at = left[~hit], at[~hit]
            symbol, rank = self.wavelet.step(at)
            at = self.below[symbol] + rank
            steps += 1
        return out


@dataclass
class Phrases:
    """The benchmark's distinct windows, as symbols; 0 is no word."""

    vocabulary: np.ndarray  # sorted hashes; a word's symbol is its place plus 1
    windows: np.ndarray
    sizes: np.ndarray
    item_of: np.ndarray  # pairs window, item
    items: list[str]


def phrases(benchmark: DataFrame, size: int, text: str = "text", item: str = "item_id") -> Phrases:
    """The benchmark is a test set of bounded size: above ``BENCHMARK_BYTES`` this refuses it."""
    total = benchmark.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    if total > BENCHMARK_BYTES:
        raise ValueError(f"benchmark of {total} bytes; at most {BENCHMARK_BYTES} are indexed against")
    rows = benchmark.select(F.col(item).cast("string"), F.col(text)).where(F.col(text).isNotNull()).collect()
    data = [r[1].encode() for r in rows]
    offs = np.r_[0, np.cumsum([len(x) for x in data])].astype(np.int64)
    hashes, row, _, _ = hashed_words(np.frombuffer(b"".join(data), np.uint8), offs)
    vocabulary = np.unique(hashes)
    symbols = np.searchsorted(vocabulary, hashes) + 1
    # every start of a window, its size, and the windows as padded rows of symbols
    count = np.bincount(row, minlength=len(rows))
    head = np.r_[0, np.cumsum(count)]
    of = np.repeat(np.arange(len(rows)), np.where(count > 0, np.maximum(1, count - size + 1), 0))
    start = head[of] + np.arange(len(of)) - np.searchsorted(of, of)
    wide = np.minimum(count[of], size)
    padded = np.r_[symbols, np.zeros(size, symbols.dtype)]
    cells = np.where(np.arange(size) < wide[:, None], padded[start[:, None] + np.arange(size)], 0) if len(of) else np.zeros((0, size), np.int64)
    table, which = np.unique(cells, axis=0, return_inverse=True)
    pairs = np.unique(np.c_[which.reshape(-1), of], axis=0)
    names = [r[0] if r[0] is not None else "" for r in rows]
    return Phrases(vocabulary, table.astype(np.int64), (table > 0).sum(1), pairs.astype(np.int64).reshape(-1, 2), names)


def _shards(it, text: str) -> Iterator[list]:
    held, size = [], 0
    for rows, buf, offs in batches(it, text):
        held.append((rows, buf, offs))
        size += len(buf)
        if size >= SHARD_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def _matches(shard: list, p: Phrases) -> list[tuple]:
    """For each chunk of the shard: rows, words by row, and by row the merged spans (first word,
    last word + 1), their bytes, and the items found."""
    symbols, docs, places, chunks_, base = [], [], [], [], 0
    least = int(p.sizes.min(initial=1 << 30))
    for rows, buf, offs in shard:
        hashes, row, starts, ends = hashed_words(buf, offs)
        n_words = np.bincount(row, minlength=len(offs) - 1)
        if len(p.vocabulary):
            at = np.searchsorted(p.vocabulary, hashes)
            at[at == len(p.vocabulary)] = 0
            known = p.vocabulary[at] == hashes
        else:
            at, known = np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        new = np.r_[True, (row[1:] != row[:-1]) | ~known[:-1]] & known if len(known) else known
        first = np.flatnonzero(new)
        last = np.flatnonzero(known & np.r_[(row[1:] != row[:-1]) | ~known[1:], True]) + 1 if len(known) else first
        long = last - first >= least
        first, size = first[long], (last - first)[long]
        # each run's words, then a place for its separator
        take = np.repeat(first - np.r_[0, np.cumsum(size + 1)[:-1]], size + 1) + np.arange((size + 1).sum()) if len(first) else first
        s = at[np.minimum(take, max(len(at) - 1, 0))] + 1 if len(take) else take
        s[np.cumsum(size + 1) - 1] = 0
        symbols.append(s)
        places.append(take)
        docs.append(np.full(len(take), len(chunks_)))
        small = [x.astype(np.int32) for x in (row, starts, ends)]  # a chunk is far below 2**31 bytes or one text
        chunks_.append((rows, n_words, *small, np.r_[0, np.cumsum(n_words)]))
    text, place, chunk = (np.concatenate(x) for x in (symbols, places, docs))
    got: list[list[tuple[int, int, int]]] = [[] for _ in chunks_]
    found = None
    if len(text) and len(p.windows):
        index = Index(text, len(p.vocabulary))
        low, high = index.search(p.windows, p.sizes)
        count = high - low
        which = np.repeat(np.arange(len(low)), count)
        rows_ = np.repeat(low - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())
        at = index.locate(rows_)
        found = chunk[at], place[at], p.sizes[which], which
    out = []
    for i, (rows, n_words, row, starts, ends, heads) in enumerate(chunks_):
        spans: list[list] = [[] for _ in range(rows.num_rows)]
        items: list = [()] * rows.num_rows
        if found is not None and (mine := found[0] == i).any():
            word, size, which = found[1][mine], found[2][mine], found[3][mine]
            doc = row[word]
            order = np.argsort(word, kind="stable")
            for d, a, b in zip(doc[order].tolist(), (word - heads[doc])[order].tolist(), (word - heads[doc] + size)[order].tolist(), strict=True):
                if spans[d] and a <= spans[d][-1][1]:
                    spans[d][-1][1] = max(b, spans[d][-1][1])
                else:
                    spans[d].append([a, b])
            pair = np.unique(np.c_[doc, which], axis=0)
            lo, hi = np.searchsorted(p.item_of[:, 0], pair[:, 1]), np.searchsorted(p.item_of[:, 0], pair[:, 1], "right")
            cuts = np.r_[np.flatnonzero(np.r_[True, pair[1:, 0] != pair[:-1, 0]]), len(pair)]
            for i_, j_ in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                items[pair[i_, 0]] = sorted({p.items[k] for x in range(i_, j_) for k in p.item_of[lo[x] : hi[x], 1]})
        out.append((rows, n_words, spans, items, starts, ends, heads))
    del chunk
    return out


_NEW = "n_words bigint, n_hit bigint, items array<string>, removed array<struct<start:bigint,end:bigint>>, contaminated boolean"


def find(docs: DataFrame, benchmark: DataFrame, size: int = 13, text: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with n_words, n_hit, items (ids as sorted strings), removed (byte spans, end
    excluded, of the merged occurrences) and contaminated (at least a twentieth of its words hit).

    A phrase is ``size`` consecutive words of an item, or all of a shorter one. Null or wordless
    texts have no words and are clean; items without words match nothing; equal items all count.
    Texts of any length are one shard at least, never parted; repeated rows are each found.
    Other columns pass; columns named as the new ones are replaced.
    ``keep_text=False`` leaves the text out of the result, and so out of what goes back to the JVM.
    """
    shared = docs.sparkSession.sparkContext.broadcast(phrases(benchmark, size))  # at most some times ``BENCHMARK_BYTES``
    names = ["n_words", "n_hit", "items", "removed", "contaminated"]
    base = docs.drop(*names)
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.bool_()]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        for shard in _shards(it, text):
            for rows, n_words, spans, items, starts, ends, heads in _matches(shard, p):
                buf_at = text_view(rows.column(rows.schema.get_field_index(text)))[1]
                hit = [sum(b - a for a, b in s) for s in spans]
                cut = [[{"start": int(starts[heads[d] + a] - buf_at[d]), "end": int(ends[heads[d] + b - 1] - buf_at[d])} for a, b in s] for d, s in enumerate(spans)]
                bad = [h > 0 and 20 * h >= n for h, n in zip(hit, n_words.tolist(), strict=True)]
                new = [pa.array(x, k) for x, k in zip((n_words, hit, items, cut, bad), kinds, strict=True)]
                same, called = carried(rows, text, keep_text)
                yield pa.RecordBatch.from_arrays([*same, *new], [*called, *names])

    return base.mapInArrow(run, extended(base if keep_text else base.drop(text), _NEW))


def op6(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    got = find(docs.select("doc_id", "text"), benchmark, keep_text=False)
    joined = F.sha2(F.concat_ws(",", "items"), 256)
    return got.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), joined.alias("items_sha256"), "contaminated")
