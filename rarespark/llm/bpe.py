"""Operator 7, byte-level BPE by batched numpy merge rounds.

A text is cut by the tokenizer's pattern; each worker keeps the ids of pieces it has met. The new
pieces of a batch are merged together: their symbols lie in one flat array, every round finds the
rank of each neighbouring pair by binary search over the sorted pair keys, takes each piece's
lowest rank and merges all its occurrences, until no pair has a rank. What is left of long pieces
after ``ROUNDS`` goes on in rounds of one rank each, lowest first, that touch only the places where
this rank occurs, so a piece of any length costs in proportion to it. The result of a piece does
not depend on the batch, so neither batches nor the bounded cache change any text's ids.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from rarespark.llm.common import extended, sub_batches

CACHE_PIECES = 150_000
ROUNDS = 48
_NONE = np.int64(1) << 62

# The white space of the tokenizer's pattern, and the pattern itself.
_SPACE = r"\t\n\x0b\x0c\r \x85\xa0  -     　"
_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, n = [""] * 256, 0
    for b in range(256):
        if b in kept:
            out[b] = chr(b)
        else:
            out[b] = chr(256 + n)
            n += 1
    return out


class Tokenizer:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        to_byte = {c: b for b, c in enumerate(letters)}
        vocab: dict[str, int] = spec["model"]["vocab"]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = {k: np.array([v], "<u4").tobytes() for k, v in special.items()}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.find = regex.compile(_PATTERN).findall
        n = max([*vocab.values(), *special.values()]) + 1
        self.pieces = [b""] * n
        for t, i in vocab.items():
            self.pieces[i] = bytes(to_byte[c] for c in t)
        for t, i in special.items():
            self.pieces[i] = t.encode()
        self.first = np.array([vocab[c] for c in letters], np.int64)
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        keys = left << 32 | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.made = keys[order], np.arange(len(keys))[order], made
        self.cache: dict[str, bytes] = {}

    def merge(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, as little-endian unsigned 32-bit integers."""
        if not words:
            return []
        sizes = np.array([len(w) for w in words])
        out: list[bytes] = [b""] * len(words)
        ids = self.first[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), sizes)
        turn = 0
        while len(ids):
            if turn == ROUNDS:
                ids, word = self._by_rank(ids, word)
            turn += 1
            best = np.full(len(ids), _NONE)
            if len(ids) > 1:
                key = ids[:-1] << 32 | ids[1:]
                at = np.searchsorted(self.keys, key)
                at[at == len(self.keys)] = 0
                hit = (self.keys[at] == key) & (word[:-1] == word[1:])
                best[:-1][hit] = self.rank[at[hit]]
            heads = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            low = np.minimum.reduceat(best, heads)
            counts = np.diff(np.r_[heads, len(ids)])
            over = low == _NONE
            if over.any():  # finished words leave the array
                flat = ids.astype("<u4")
                for h, c in zip(heads[over], counts[over], strict=True):
                    out[word[h]] = flat[h : h + c].tobytes()
                stay = np.repeat(~over, counts)
                ids, word, best = ids[stay], word[stay], best[stay]
                low, counts = low[~over], counts[~over]
                if not len(ids):
                    break
            lowest = np.repeat(low, counts)
            take = best == lowest
            run = np.flatnonzero(take[1:] & take[:-1])
            if len(run):  # a pair of one symbol with itself overlaps its neighbour: every second one
                starts = np.flatnonzero(take & ~np.r_[False, take[:-1]])
                at = np.flatnonzero(take)
                offset = at - starts[np.searchsorted(starts, at, "right") - 1]
                take[at[offset % 2 == 1]] = False
            at = np.flatnonzero(take)
            ids[at] = self.made[lowest[at]]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            ids, word = ids[keep], word[keep]
        return out

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.rank[at], _NONE)

    def _by_rank(self, ids: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge all there is to merge. Symbols are a linked list; ``waiting`` holds, by rank, the
        places where a pair of that rank was seen, of which some may be gone by its turn."""
        n = len(ids)
        ids, live = ids.copy(), np.ones(n, bool)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        last = np.r_[word[1:] != word[:-1], True]
        after[last] = n
        before[np.r_[True, last[:-1]]] = -1
        now = np.full(n, _NONE)  # the rank of the pair that begins at a place
        waiting: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []

        def see(at: np.ndarray) -> None:
            now[at] = _NONE
            at = at[after[at] < n]
            rank = self._ranks(ids[at], ids[after[at]])
            now[at] = rank
            at, rank = at[rank < _NONE], rank[rank < _NONE]
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            heads = np.flatnonzero(np.r_[True, rank[1:] != rank[:-1]]) if len(rank) else rank
            for r, places in zip(rank[heads].tolist(), np.split(at, heads[1:]), strict=True) if len(rank) else ():
                if r not in waiting:
                    waiting[r] = []
                    heapq.heappush(queue, r)
                waiting[r].append(places)

        see(np.arange(n))
        while queue:
            rank = heapq.heappop(queue)
            at = np.unique(np.concatenate(waiting.pop(rank)))
            at = at[live[at] & (now[at] == rank)]
            # a pair of one symbol with itself overlaps its neighbour: every second one of a run
            follows = np.r_[False, after[at[:-1]] == at[1:]] if len(at) else np.empty(0, bool)
            if follows.any():
                starts = np.flatnonzero(~follows)
                place = np.arange(len(at))
                at = at[(place - starts[np.searchsorted(starts, place, "right") - 1]) % 2 == 0]
            if not len(at):
                continue
            gone = after[at]
            ids[at] = self.made[rank]
            live[gone] = False
            after[at] = after[gone]
            on = after[at] < n
            before[after[at[on]]] = at[on]
            see(np.unique(np.r_[at, before[at[before[at] >= 0]]]))
        return ids[live], word[live]

    def _pieces(self, text: str) -> list[str]:
        if self.cut is None:
            return self.find(text)
        got: list[str] = []
        for i, part in enumerate(self.cut.split(text)):
            if i % 2:
                got.append(part)
            elif part:
                got += self.find(part)
        return got

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        cut = [self._pieces(t or "") for t in texts]
        cache = self.cache
        if len(cache) > CACHE_PIECES:
            cache.clear()
        cache.update(self.special)
        new = list({p for pieces in cut for p in pieces if p not in cache})
        cache.update(zip(new, self.merge([p.encode() for p in new]), strict=True))
        return [b"".join([cache[p] for p in pieces]) for pieces in cut]

    def decode(self, ids: bytes) -> str:
        table = self.pieces
        return b"".join([table[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


_LOADED: dict[str, Tokenizer] = {}


def tokenizer(path: str) -> Tokenizer:
    if path not in _LOADED:
        _LOADED[path] = Tokenizer(path)
    return _LOADED[path]


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``docs`` with its token ids (array of int) and the text decoded from them.

    Null is the empty text: no ids, empty decoded text. Special-token strings in a text become
    their ids and decode to themselves. Other columns pass; columns named as the new ones are
    replaced. ``path`` is a tokenizer file that every worker can open.
    """
    base = docs.drop(ids, decoded)
    schema = extended(base, f"`{ids}` array<int>, `{decoded}` string")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        for rows in sub_batches(it, text):
            got = t.encode_batch(rows.column(rows.schema.get_field_index(text)).to_pylist())
            arrays = pa.array([np.frombuffer(g, "<i4") for g in got], pa.list_(pa.int32()))
            back = pa.array([t.decode(g) for g in got], pa.string())
            yield pa.RecordBatch.from_arrays([*rows.columns, arrays, back], [*rows.schema.names, ids, decoded])

    return base.mapInArrow(run, schema)


def digest(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256, of the same ids and texts as
    ``encode``'s, hashed where they are made."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        for rows in sub_batches(it, text):
            got = t.encode_batch(rows.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array([len(g) // 4 for g in got], pa.int64()), pa.array([hashlib.sha256(g).hexdigest() for g in got], pa.string()), pa.array([hashlib.sha256(t.decode(g).encode()).hexdigest() for g in got], pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text).mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
