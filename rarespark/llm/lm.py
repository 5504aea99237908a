"""Operator 1, an interpolated modified Kneser-Ney bigram model, counted in Spark.

1. Tokens of the training texts are tallied by hash (``store``): a word's id is its rank.
2. Pairs of ids are tallied; each bucket's task writes its pairs and counts, and sends on, for
   the words in it, how many kinds of successors were seen once, twice and more often, and how
   many kinds of predecessors.
3. Those sums are gathered by ranges of ids, beside the words' own arrays.

Nothing but a few totals reaches the driver. Scoring maps the sorted arrays into memory and looks
each chunk's distinct tokens and pairs up by binary search. With c a pair's count, D its discount:
p(w|h) = (c(hw) - D(c)) / c(h) + l(h) p(w), l(h) the discounts' sum over c(h), and p(w) likewise
from the kinds of predecessors, its own left-over spread evenly over V + 1 tokens. The start of a
text is a history of its own, its end a token. Tokens are told apart by 93 bits of their bytes, pairs
by both ids; counts have no upper limit.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rarespark.llm.common import batches, carried, extended, local_path, lower_ascii, materialize, new_dir, remainder, words, write_file
from rarespark.llm.hashing import Fields, mix
from rarespark.llm.store import Store, blocks, bucket_count, distinct, gather, pack, tally, text_bytes, write_counts

END, END_CHECK = np.uint64(0x5A17E9D1C3B24F60), np.uint32(0xFFFFFFFF)  # no word's check has 32 bits
_LOWER = lower_ascii()
_WORD = np.ones(256, bool)
_WORD[[0x20, *range(0x09, 0x0E)]] = False
_I1, _I2 = (np.uint64(pow(m, -1, 1 << 64)) for m in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def unmix(x: np.ndarray) -> np.ndarray:
    """The inverse of ``hashing.mix``."""
    x = x ^ (x >> np.uint64(31)) ^ (x >> np.uint64(62))
    x *= _I2
    x ^= (x >> np.uint64(27)) ^ (x >> np.uint64(54))
    x *= _I1
    x ^= (x >> np.uint64(30)) ^ (x >> np.uint64(60))
    return x


def token_hashes(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each row's tokens, its end among them, one row after the other; their checks; and where rows begin."""
    low = _LOWER[buf]
    starts, ends, row = words(low, offs, _WORD)
    n = len(offs) - 1
    heads = np.r_[0, np.cumsum(np.bincount(row, minlength=n) + 1)]
    out, checks = np.empty(len(starts) + n, np.uint64), np.empty(len(starts) + n, np.uint32)
    at, fields = np.arange(len(starts)) + row, Fields(low)
    out[at], checks[at] = fields(starts, ends), fields.check(starts, ends)
    out[heads[1:] - 1], checks[heads[1:] - 1] = END, END_CHECK
    return out, checks, heads


def discounts(n: list[int]) -> np.ndarray:
    """Discounts of counts 0, 1, 2 and more, from how many counts are 1, 2, 3 and 4."""
    if min(n) <= 0:
        return np.array([0.0, 0.5, 1.0, 1.5])
    y = n[0] / (n[0] + 2 * n[1])
    d = [1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2]]
    return np.array([0.0, *(x if 0 < x <= i + 1 else (i + 1) / 2 for i, x in enumerate(d))])


@dataclass
class Model:
    vocabulary: Store
    pairs: Store
    stats: str
    base: list[int]  # the first id of each of the vocabulary's buckets, and how many there are
    tokens: int
    texts: int
    of_pairs: list[float]
    of_words: list[float]
    kinds: int
    leftover: float

    def _stats(self, bucket: int) -> np.ndarray:
        held = self.__dict__.setdefault("_held", {})
        if bucket not in held:
            if len(held) >= 512:
                held.clear()
            n = self.base[bucket + 1] - self.base[bucket] if bucket < len(self.base) - 1 else int(self.texts > 0)
            held[bucket] = np.memmap(local_path(f"{self.stats}/{bucket}"), np.uint32, "r", shape=(4, n)) if n else np.zeros((4, 1), np.uint32)
        return held[bucket]

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_held"}

    def score(self, tokens: np.ndarray, checks: np.ndarray, heads: np.ndarray) -> dict[str, np.ndarray]:
        """Sums by row of log10 probabilities, and counts."""
        v = self.base[-1]
        kind, check, at = distinct(tokens, checks)
        count, bucket, place = self.vocabulary.find(kind, check)
        ids = np.asarray(self.base)[bucket] + place
        kinds = np.zeros((4, len(kind)), np.float64)
        for b in np.unique(bucket[count > 0]):
            m = (bucket == b) & (count > 0)
            kinds[:, m] = self._stats(int(b))[:, place[m]]
        d1, d0 = np.asarray(self.of_pairs), np.asarray(self.of_words)
        low = self.leftover / (v + 1) + np.maximum(kinds[3] - d0[np.minimum(kinds[3], 3).astype(int)], 0) / max(self.kinds, 1)
        back = np.where(count > 0, (kinds[:3] * d1[1:, None]).sum(0) / np.maximum(count, 1), 1.0)
        start = self._stats(len(self.base) - 1)[:, 0].astype(float)
        start_back = (start[:3] * d1[1:]).sum() / self.texts if self.texts else 1.0
        n = len(heads) - 1
        first = np.zeros(len(tokens), bool)
        first[heads[:-1]] = True
        before = np.r_[0, at[:-1]]
        history = np.where(first, v, ids[before]).astype(np.uint64)
        total = np.where(first, self.texts, count[before])
        known = (count[at] > 0) & (total > 0)
        seen = np.zeros(len(tokens), np.int64)
        seen[known] = self.pairs.counts(mix(history[known] << np.uint64(32) | ids[at[known]].astype(np.uint64)))
        p = np.maximum(seen - d1[np.minimum(seen, 3)], 0) / np.maximum(total, 1) + np.where(first, start_back, back[before]) * low[at]
        plain = np.log10((count + 0.1) / (self.tokens + 0.1 * (v + 1)))
        add = lambda x: np.add.reduceat(x, heads[:-1]) if n else x[:0]
        return {"n_tokens": np.diff(heads), "n_known": add((count[at] > 0).astype(np.int64)), "base_score": add(plain[at]), "score": add(np.log10(np.maximum(p, 1e-300)))}


def train(texts: DataFrame, text: str = "text") -> Model:
    """Fit on all rows of ``texts``; null is the empty text. Without rows every token is as likely."""
    only = texts.select(text)
    spark = only.sparkSession
    size = text_bytes(only, text)

    def tokens(it):
        for _, buf, offs in batches(it, text):
            yield token_hashes(buf, offs)[:2]

    buckets = bucket_count(size, 64 << 20)
    vocabulary, kept = tally(only, tokens, buckets, "lm-words", checked=True)
    base = [0, *np.cumsum(vocabulary.sizes).tolist()]
    if base[-1] >= (1 << 32) - 1:
        raise ValueError(f"{base[-1]} distinct tokens; ids of 32 bits hold fewer")
    first_of = np.asarray(base)

    def ids(it):
        for _, buf, offs in batches(it, text):
            *got, heads = token_hashes(buf, offs)
            kind, check, at = distinct(*got)
            _, bucket, place = vocabulary.find(kind, check)
            now = (first_of[bucket] + place)[at].astype(np.uint64)
            before = np.r_[np.uint64(0), now[:-1]]
            before[heads[:-1]] = base[-1]
            yield mix(before << np.uint64(32) | now)

    pair_buckets = bucket_count(size, 12 << 20)
    uri = new_dir(spark, "lm-pairs")
    edges = np.asarray(base[1:])

    def reduce(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        b = key[0].as_py()
        v, c = gather(table)
        write_counts(f"{uri}/{b}", [v, c])
        pair = unmix(v)
        h, w = (pair >> np.uint64(32)).astype(np.int64), (pair & np.uint64(0xFFFFFFFF)).astype(np.int64)
        word, back = np.unique(np.r_[h, w], return_inverse=True)
        n = [np.bincount(back[: len(h)][m], minlength=len(word)) for m in (c == 1, c == 2, c > 2)] + [np.bincount(back[len(h) :], minlength=len(word))]
        cuts = [0, *np.searchsorted(word, edges).tolist(), len(word)]
        rows = [(i, pack([word[x:y].astype(np.uint64), *(k[x:y].astype(np.uint32) for k in n)])) for i, (x, y) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if y > x]
        of = [int((c == i).sum()) for i in (1, 2, 3, 4)]
        none = [0] * (len(rows) - 1)
        return pa.table({"bucket": pa.array([i for i, _ in rows], pa.int32()), "blob": pa.array([x for _, x in rows], pa.binary()), "pairs": pa.array([b] * len(rows), pa.int32()), "held": pa.array([len(v), *none], pa.int64()), **{f"n{i + 1}": pa.array([of[i], *none], pa.int64()) for i in range(4)}})

    sent = materialize(blocks(only, ids, pair_buckets).groupBy("bucket").applyInArrow(reduce, "bucket int, blob binary, pairs int, held bigint, n1 bigint, n2 bigint, n3 bigint, n4 bigint"), "lm-sent")
    stats = new_dir(spark, "lm-stats")

    def place(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        b = key[0].as_py()
        word, *n = gather(table, 4)
        at = word.astype(np.int64) - base[b]
        out = np.zeros((4, base[b + 1] - base[b] if b < buckets else 1), np.uint32)
        out[:, at] = np.array(n)
        write_file(f"{stats}/{b}", [out.reshape(-1)])
        c = out[3]
        return pa.table({f"n{i}": pa.array([int((c == i).sum())], pa.int64()) for i in (1, 2, 3, 4)} | {"kinds": pa.array([int(c.sum(dtype=np.uint64))], pa.int64()), "some": pa.array([int((c > 0).sum())], pa.int64())})

    zero = lambda *cols: [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in cols]
    p = sent.agg(*zero("n1", "n2", "n3", "n4")).first()
    names = ("n1", "n2", "n3", "n4", "kinds", "some")
    w = sent.select("bucket", "blob").groupBy("bucket").applyInArrow(place, ", ".join(f"{x} bigint" for x in names)).agg(*zero(*names)).first()
    sizes = np.zeros(pair_buckets, np.int64)
    for r in sent.groupBy("pairs").agg(F.sum("held").alias("n")).collect():
        sizes[r.pairs] = r.n
    d = discounts([w.n1, w.n2, w.n3, w.n4])
    leftover = (d[1] * w.n1 + d[2] * w.n2 + d[3] * (w.some - w.n1 - w.n2)) / w.kinds if w.kinds else 1.0
    n_texts = int(vocabulary.find(np.array([END]), np.array([END_CHECK]))[0][0]) if base[-1] else 0
    return Model(vocabulary, Store(uri, sizes), stats, base, int(sum(r.total for r in kept)), n_texts, discounts([p.n1, p.n2, p.n3, p.n4]).tolist(), d.tolist(), int(w.kinds), float(leftover))


def score(docs: DataFrame, model: Model, text: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with n_tokens, n_known, train_tokens (long), base_score, score and perplexity.

    ``score`` is the log10 probability of the text with its end; a null or empty text is its end
    alone. Repeated rows each get the same. Other columns pass; columns named as the new ones are replaced.
    """
    new = ["n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"]
    base = docs.drop(*new)
    schema = extended(base if keep_text else base.drop(text), "n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, perplexity double")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, buf, offs in batches(it, text):
            got = model.score(*token_hashes(buf, offs))
            got["train_tokens"] = np.full(rows.num_rows, model.tokens)
            got["perplexity"] = 10.0 ** np.minimum(-got["score"] / got["n_tokens"], 300)
            same, called = carried(rows, text, keep_text)
            yield pa.RecordBatch.from_arrays([*same, *(pa.array(got[c]) for c in new)], [*called, *new])

    return base.mapInArrow(run, schema)


def op1(docs: DataFrame) -> DataFrame:
    held = (remainder(10) == 0).alias("held_out")
    model = train(docs.where(remainder(10) != 0))
    return score(docs.select("doc_id", held, "text"), model, keep_text=False)
