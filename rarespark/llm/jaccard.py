"""Operator 8, n-gram Jaccard join with Bayesian candidate pruning.

Documents are sets of hashed word shingles; equal sets are one class from the start. Bands of
MinHash values that occur more than once (``store``) give candidate pairs; a pair whose Jaccard
similarity is the threshold shares no band with a probability of (1 - t**ROWS)**BANDS, 1e-7 at 0.8.
A pair is looked at in the first band it shares, only: its MinHash values are compared ``STEP`` at
a time, and it is dropped as soon as the posterior probability (uniform prior) of reaching the
threshold falls below ``TOLERANCE``. What is left is verified exactly on whole shingle sets.

Bands' members are rows of (band, class); those of a large band are dealt over blocks, and every
pair of blocks is a group of its own. No pair leaves its task: tasks return, for each class, how
many links they found and the smallest class it is connected to. Classes' values and sets lie in
files of the shared folder, which tasks map into memory.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rarespark.llm.common import batches, local_path, lower_ascii, materialize, new_dir, words, write_file
from rarespark.llm.hashing import Fields, mix
from rarespark.llm.store import Store, bounds, bucket_count, tally, text_bytes

WORDS, THRESHOLD = 5, 0.8
BANDS, ROWS, STEP = 40, 5, 20
VALUES = BANDS * ROWS
TOLERANCE = 1e-6
BLOCK = 512
PAIRS = 1 << 14
_LOWER = lower_ascii()
_WORD = np.ones(256, bool)
_WORD[[0x20, *range(0x09, 0x0E)]] = False
_RNG = np.random.RandomState(1234)
_A = (_RNG.randint(0, 1 << 31, VALUES).astype(np.uint32) << np.uint32(1)) | np.uint32(1)
_B = _RNG.randint(0, 1 << 32, VALUES, dtype=np.uint64).astype(np.uint32)


def shingles(buf: np.ndarray, offs: np.ndarray, size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct shingle hashes, sorted, and where rows begin. Words are what white
    space parts, A-Z in lower case; fewer than ``size`` words are one shingle, none are none."""
    low = _LOWER[buf]
    starts, ends, row = words(low, offs, _WORD)
    h = Fields(low)(starts, ends)
    n = len(offs) - 1
    count = np.bincount(row, minlength=n)
    head = np.r_[0, np.cumsum(count)]
    total = np.zeros(len(h), np.uint64)
    for i in range(size):  # words past a text's end add nothing
        shifted = np.zeros(len(h), np.uint64)
        m = len(h) - i
        if m > 0:
            shifted[:m] = np.where(row[i:] == row[:m], h[i:], 0)
        total = total * np.uint64(0xD6E8FEB86659FD93) + shifted
    place = np.arange(len(h)) - head[row]
    keep = (place == 0) | (place <= count[row] - size)
    total, row = mix(total[keep]), row[keep]
    order = np.lexsort((total, row))
    total, row = total[order], row[order]
    new = np.r_[True, (total[1:] != total[:-1]) | (row[1:] != row[:-1])] if len(total) else np.empty(0, bool)
    total, row = total[new], row[new]
    return total, np.searchsorted(row, np.arange(n + 1))


def signatures(h: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """MinHash values of the rows that have shingles: (rows, VALUES)."""
    at = heads[:-1][heads[1:] > heads[:-1]]
    out = np.empty((VALUES, len(at)), np.uint32)
    x = (h >> np.uint64(32)).astype(np.uint32)
    if len(at):
        for i in range(VALUES):
            out[i] = np.minimum.reduceat(x * _A[i] + _B[i], at)
    return np.ascontiguousarray(out.T)


def bands(sig: np.ndarray) -> np.ndarray:
    """(rows, BANDS) hashes whose six lowest bits are the band's number."""
    v = sig.reshape(len(sig), BANDS, ROWS).astype(np.uint64)
    h = np.zeros((len(sig), BANDS), np.uint64)
    for r in range(ROWS):
        h = mix(h * np.uint64(0xD6E8FEB86659FD93) + v[:, :, r] + np.uint64(1))
    return mix(h + np.arange(BANDS, dtype=np.uint64)) & ~np.uint64(63) | np.arange(BANDS, dtype=np.uint64)


def keys_of(h: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """One hash of each row's set; rows without shingles get 0."""
    total = np.r_[np.uint64(0), np.cumsum(mix(h ^ np.uint64(0x5851F42D4C957F2D)))]
    size = heads[1:] - heads[:-1]
    return np.where(size > 0, mix(total[heads[1:]] - total[heads[:-1]] + size.astype(np.uint64)), np.uint64(0))


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> list[int]:
    """After each ``STEP`` values, the fewest matches with which a pair may still reach the
    threshold: below, P(J >= t | m of n) under a uniform prior is less than the tolerance."""
    out = []
    for n in range(STEP, VALUES + 1, STEP):
        # the tail of Beta(m+1, n-m+1) above t is P(Binomial(n+1, t) <= m)
        total, m = 0.0, 0
        for m in range(n + 2):
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if total >= tolerance:
                break
        out.append(m)
    return out


class Classes:
    """The candidates' values and sets: a file for each range of keys, with sorted keys."""

    def __init__(self, uri: str, buckets: int):
        self.uri, self.buckets, self.edges = uri, buckets, bounds(buckets)
        self.opened: dict[int, tuple[np.ndarray, ...]] = {}

    def __getstate__(self):
        return {"uri": self.uri, "buckets": self.buckets}

    def __setstate__(self, state):
        self.__init__(**state)

    def open(self, bucket: int) -> tuple[np.ndarray, ...]:
        if bucket not in self.opened:
            if len(self.opened) >= 256:
                self.opened.clear()
            raw = np.memmap(local_path(f"{self.uri}/{bucket}"), np.uint8, "r")
            n = int(raw[:8].view(np.int64)[0])
            a, b = 8 + 8 * n, 8 + 8 * n + 8 * (n + 1)
            self.opened[bucket] = raw[8:a].view(np.uint64), raw[a:b].view(np.int64), raw[b : b + 4 * VALUES * n].view(np.uint32).reshape(n, VALUES), raw[b + 4 * VALUES * n :].view(np.uint64)
        return self.opened[bucket]

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """MinHash values and sets of distinct sorted keys."""
        sig, sets = np.empty((len(keys), VALUES), np.uint32), []
        cuts = [0, *np.searchsorted(keys, self.edges).tolist(), len(keys)]
        for b, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            if j > i:
                known, offs, values, h = self.open(b)
                at = np.searchsorted(known, keys[i:j])
                sig[i:j] = values[at]
                sets += [h[offs[x] : offs[x + 1]] for x in at]
        return sig, sets


def verified(a: np.ndarray, b: np.ndarray, sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which pairs of sets reach the threshold, exactly. ``a`` is sorted."""
    out = np.zeros(len(a), bool)
    if not len(a):
        return out
    used = np.unique(np.r_[a, b])
    size = np.array([len(sets[i]) for i in used])
    _, local = np.unique(np.concatenate([sets[i] for i in used]), return_inverse=True)
    place = np.r_[0, np.cumsum(size)]
    at_a, at_b = np.searchsorted(used, a), np.searchsorted(used, b)
    flag = np.zeros(int(local.max()) + 1, bool)
    heads = np.r_[np.flatnonzero(np.r_[True, a[1:] != a[:-1]]), len(a)]
    for i, j in zip(heads[:-1], heads[1:], strict=True):
        x = at_a[i]
        own = local[place[x] : place[x + 1]]
        flag[own] = True
        y = at_b[i:j]
        n = size[y]
        ends = np.cumsum(n)
        hit = flag[local[np.repeat(place[y] - ends + n, n) + np.arange(ends[-1])]]
        common = np.add.reduceat(hit.astype(np.int64), ends - n)
        flag[own] = False
        out[i:j] = common >= threshold * (len(own) + n - common) - 1e-9
    return out


class Found:
    """Links of a task: counts by class, and a forest that connects linked classes."""

    def __init__(self):
        self.links: dict[int, int] = {}
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (p := self.parent.get(x, x)) != x:
            self.parent[x] = self.parent.get(p, p)
            x = p
        return x

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        """Links between keys ``a`` and ``b``; equal ones of ``a`` lie together."""
        if not len(a):
            return
        k, n = np.unique(np.r_[a, b], return_counts=True)
        for x, m in zip(k.tolist(), n.tolist(), strict=True):
            self.links[x] = self.links.get(x, 0) + m
        # one root a run, and each of its partners that isn't under it yet
        heads = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
        for h, e in zip(heads.tolist(), [*heads[1:].tolist(), len(a)], strict=True):
            x = self.root(int(a[h]))
            for y in b[h:e].tolist():
                if self.parent.get(y) == x:
                    continue
                y = self.root(y)
                if x != y:
                    self.parent[max(x, y)] = min(x, y)
                    x = min(x, y)

    def batch(self) -> pa.RecordBatch:
        k = list(self.links)
        signed = lambda v: pa.array(np.array(v, np.uint64).view(np.int64))
        return pa.RecordBatch.from_arrays([signed(k), pa.array([self.links[x] for x in k], pa.int64()), signed([self.root(x) for x in k])], ["key", "links", "root"])


def _first(a: np.ndarray, b: np.ndarray, band: np.ndarray, of_bands: np.ndarray) -> np.ndarray:
    """Which pairs share no band before the one they were met in."""
    left = np.flatnonzero(band > 0)
    out = np.ones(len(a), bool)
    s = 0
    while len(left):
        same = of_bands[s, a[left]] == of_bands[s, b[left]]
        out[left[same]] = False
        s += 1
        left = left[~same]
        left = left[band[left] > s]
    return out


def _compare(a: np.ndarray, b: np.ndarray, band: np.ndarray, held: tuple, least: list[int], threshold: float, found: Found) -> None:
    """Look at pairs of places in ``held``: the keys, MinHash values, bands and sets of a batch."""
    keys, sig, of_bands, sets = held
    new = _first(a, b, band, of_bands)
    a, b = a[new], b[new]
    kept = []
    for i in range(0, len(a), PAIRS):
        x, y = a[i : i + PAIRS], b[i : i + PAIRS]
        matches = np.zeros(len(x), np.int64)
        for step, need in enumerate(least):
            part = slice(step * STEP, (step + 1) * STEP)
            matches += (sig[x, part] == sig[y, part]).sum(1)
            stay = matches >= need
            x, y, matches = x[stay], y[stay], matches[stay]
        kept.append((x, y))
    if kept:
        x, y = (np.concatenate(z) for z in zip(*kept, strict=True))
        order = np.argsort(x, kind="stable")
        x, y = x[order], y[order]
        ok = verified(x, y, sets, threshold)
        found.add(keys[x[ok]], keys[y[ok]])


def _groups(it: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """Whole groups (rows of one band and pair of blocks lie together), many at a time."""
    rest: list[np.ndarray] | None = None
    for batch in it:
        now = [np.asarray(c) for c in batch.columns]
        if rest is not None:
            now = [np.concatenate(z) for z in zip(rest, now, strict=True)]
        band, i, j = now[0], now[2], now[3]
        if not len(band):
            continue
        last = np.flatnonzero((band != band[-1]) | (i != i[-1]) | (j != j[-1]))
        cut = int(last[-1]) + 1 if len(last) else 0
        rest = [x[cut:] for x in now]
        if cut:
            yield tuple(x[:cut] for x in now)
    if rest is not None and len(rest[0]):
        yield tuple(rest)


def _links(it: Iterator[pa.RecordBatch], classes: Classes, least: list[int], threshold: float) -> Iterator[pa.RecordBatch]:
    found = Found()
    for band, key, i, j, block in _groups(it):
        heads = np.flatnonzero(np.r_[True, (band[1:] != band[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
        ends = np.r_[heads[1:], len(band)]
        number = (band.view(np.uint64) & np.uint64(63)).astype(np.int64)
        distinct, place = np.unique(key.view(np.uint64), return_inverse=True)
        sig, sets = classes.get(distinct)
        batch = distinct, sig, np.ascontiguousarray(bands(sig).T), sets
        held, n = [], 0
        for h, e in zip(heads.tolist(), ends.tolist(), strict=True):
            if i[h] == j[h]:
                a, b = np.triu_indices(e - h, 1)
            else:
                left, right = np.flatnonzero(block[h:e] == i[h]), np.flatnonzero(block[h:e] == j[h])
                a, b = np.repeat(left, len(right)), np.tile(right, len(left))
            if len(a):
                held.append((place[a + h], place[b + h], np.full(len(a), number[h])))
                n += len(a)
            if n >= 1 << 18:
                _compare(*(np.concatenate(z) for z in zip(*held, strict=True)), batch, least, threshold, found)
                held, n = [], 0
        if held:
            _compare(*(np.concatenate(z) for z in zip(*held, strict=True)), batch, least, threshold, found)
        if len(found.links) > 200_000:
            yield found.batch()
            found = Found()
    if found.links:
        yield found.batch()


def components(edges: DataFrame) -> DataFrame:
    """(key, root): the smallest key of each connected component; edges (key, root), by
    alternating large and small stars, each a minimum and a join. A centre of very many edges is
    one row on the joins' other side, so Spark may split its rows over tasks (adaptive skew joins)."""
    e = materialize(edges.select(F.greatest("key", "root").alias("u"), F.least("key", "root").alias("v")).where("u <> v").distinct(), "join-edges")
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select("v", "m", "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        e = materialize(small, "join-edges")
        now = e.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)).alias("s")).first()
        if now == before:
            return e.select(F.col("u").alias("key"), F.col("v").alias("root"))
        before = now


def join(docs: DataFrame, threshold: float = THRESHOLD, size: int = WORDS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, class_id, n_links, n_copies, copy_of) of each row of ``docs``.

    ``class_id`` is the smallest id of all documents that chains of links connect with it,
    ``n_links`` the number of different shingle sets within the threshold of its own, ``n_copies``
    the number of documents of its set, itself included, ``copy_of`` the smallest id of these.
    Texts without words are alone. Rows whose id is null belong to their set's class like others
    but name none; a class of such rows only has a null id. Repeated rows count each. Texts of any
    length are read whole. Sets are told apart by 64 bits. Empty input gives no rows; other columns
    are not read.
    """
    only = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    spark = docs.sparkSession
    size_ = text_bytes(only)

    def all_bands(it):
        for _, buf, offs in batches(it, "text", 1 << 20):
            yield bands(signatures(*shingles(buf, offs, size))).ravel()

    repeated: Store = tally(only.select("text"), all_bands, bucket_count(size_, 256 << 20), "join-bands", 2)[0]
    kind = docs.schema[key].dataType.simpleString()

    def look(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()
        for rows, buf, offs in batches(it, "text", 1 << 20):
            h, heads = shingles(buf, offs, size)
            set_key = keys_of(h, heads)
            full = np.flatnonzero(heads[1:] > heads[:-1])
            sig = signatures(h, heads)
            hashes = bands(sig)
            hit = repeated.counts(hashes.ravel()).reshape(hashes.shape) > 1
            shared: list = [None] * rows.num_rows
            data: list = [None] * rows.num_rows
            for x in np.flatnonzero(hit.any(1)).tolist():
                r = int(full[x])
                if (k := int(set_key[r])) not in sent:
                    sent.add(k)
                    shared[r] = hashes[x][hit[x]].view(np.int64)
                    data[r] = sig[x].tobytes() + h[heads[r] : heads[r + 1]].tobytes()
            none = set_key == 0
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(set_key.view(np.int64), pa.int64(), mask=none), pa.array(shared, pa.list_(pa.int64())), pa.array(data, pa.binary())], ["id", "key", "bands", "data"])

    seen = materialize(only.mapInArrow(look, f"id {kind}, key bigint, bands array<bigint>, data binary"), "join-seen")
    # a class has its set, of at most some bytes a byte of text, and MinHash values of a fixed size
    buckets = bucket_count(size_ + 4 * VALUES * seen.where("data is not null").count(), 24 << 20)
    uri = new_dir(spark, "join-classes")
    edges = bounds(buckets)

    def assign(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            k = np.asarray(b.column(0)).view(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(np.searchsorted(edges, k, "right"), pa.int32()), *b.columns], ["bucket", "key", "data"])

    def write(group: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        k = np.asarray(table.column("key").combine_chunks()).view(np.uint64)
        order = np.unique(k, return_index=True)[1]
        data = [table.column("data")[int(i)].as_buffer() for i in order]
        sig = [np.frombuffer(d, np.uint32, VALUES) for d in data]
        sets = [np.frombuffer(d, np.uint64, offset=4 * VALUES) for d in data]
        offs = np.r_[0, np.cumsum([len(s) for s in sets])].astype(np.int64)
        write_file(f"{uri}/{group[0].as_py()}", [np.array([len(order)], np.int64), k[order], offs, np.concatenate(sig), np.concatenate(sets)])
        return pa.table({"n": pa.array([len(order)], pa.int64())})

    held = seen.where("data is not null")
    held.select("key", "data").mapInArrow(assign, "bucket int, key bigint, data binary").groupBy("bucket").applyInArrow(write, "n bigint").agg(F.sum("n")).collect()
    classes, least = Classes(uri, buckets), least_matches(threshold)
    members = held.select(F.explode("bands").alias("band"), "key").distinct()
    sizes = members.groupBy("band").count().where("count > 1").withColumn("blocks", F.ceil(F.col("count") / BLOCK).cast("int")).drop("count")
    dealt = members.join(sizes, "band").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("band", "key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block")
    dealt = dealt.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j")
    links = materialize(dealt.mapInArrow(lambda it: _links(it, classes, least, threshold), "key bigint, links bigint, root bigint"), "join-links")
    root = components(links.select("key", "root"))
    count = links.groupBy("key").agg(F.sum("links").alias("n_links"))
    of_set = seen.where("key is not null").groupBy("key").agg(F.min("id").alias("copy_of"), F.count("*").alias("n_copies"))
    of_set = of_set.join(count, "key", "left").join(root, "key", "left").withColumn("root", F.coalesce("root", "key"))
    of_class = of_set.groupBy("root").agg(F.min("copy_of").alias("class_id"))
    of_set = materialize(of_set.join(of_class, "root").select("key", "copy_of", "n_copies", "n_links", "class_id"), "join-sets")
    got = seen.select("id", "key").join(of_set, "key", "left")
    return got.select(
        F.col("id").alias(key),
        F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        F.coalesce("n_copies", F.lit(1)).cast("bigint").alias("n_copies"),
        F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("copy_of")).alias("copy_of"),
    )


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD, size: int = WORDS) -> DataFrame:
    """Of each class of ``docs`` the row of smallest doc_id, of equal ids that of the smaller hash
    of its text. Rows without an id all stay; of repeated rows of one id and text, one stays."""
    row = F.struct("doc_id", F.xxhash64("text").alias("a"), F.xxhash64(F.lit(1), "text").alias("b"))
    named = docs.where("doc_id is not null").withColumn("_row", row)
    got = join(named, threshold, size, key="_row")
    kept = got.where(F.col("_row") == F.col("class_id")).select("_row").distinct()
    return named.join(kept, "_row", "left_semi").dropDuplicates(["_row"]).drop("_row").select(*docs.columns).unionByName(docs.where("doc_id is null"))


def op8(docs: DataFrame) -> DataFrame:
    return join(docs)
