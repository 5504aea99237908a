"""Operator 4, sharding by histogram sort, in DataFrame operations only.

Rows are ordered by a 126-bit key (hash of the text, then hash of the row), so that equal texts
lie together. Splitters between shards are found without moving a row: each round counts, with
map-side partial sums, the exact bytes below candidate boundaries in every bracket that is still
too wide, and keeps the cell that holds a target; a text whose copies outweigh the tolerance is
split inside, by the row hash. Where equal rows alone outweigh it, rows are written out with a
number of their own, which then is part of the row hash. When all splitters meet the tolerance the rows are exchanged once,
by fine cells of the same key, whose exact counts give each row its slot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from rarespark.llm.common import materialize

HASH_BITS = 62
CELL_ROWS = 500_000
COUNTS = 1 << 18


def _hash62(*cols) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*cols), 2)


def keyed(df: DataFrame, text: str = "text", row: tuple[str, ...] | None = None) -> DataFrame:
    """Add ``_size``, ``_hi`` (62 bits of the text's hash) and ``_lo`` (62 bits of the row's)."""
    cols = [F.col(f"`{c}`") for c in (row or [c for c, kind in df.dtypes if "map<" not in kind and c != text])]
    hi = _hash62(F.coalesce(F.col(f"`{text}`"), F.lit("")), F.col(f"`{text}`").isNull())
    return df.withColumns(
        {
            "_size": F.coalesce(F.octet_length(F.col(f"`{text}`")).cast("long"), F.lit(0).cast("long")) + 1,
            "_hi": hi,
            "_lo": _hash62(F.lit(7), *cols, hi),
        }
    )


def _refine(keys: DataFrame, targets: list[int], tolerance: int, fanout: int) -> list[tuple[int, int]] | None:
    """For each target the boundary (hi, lo) below which the bytes come within ``tolerance`` of
    it, or within one row. A boundary's lo is 0 unless copies of one text hold too much. None if
    rows of one key hold too much."""
    open_ = [{"hi": None, "lo": 0, "width": 1 << HASH_BITS, "below": 0, "t": t} for t in targets]
    done: dict[int, tuple[int, int]] = {}
    while open_:
        brackets: dict[tuple, list[dict]] = {}
        for o in open_:
            brackets.setdefault((o["hi"], o["lo"], o["width"]), []).append(o)
        order = sorted(brackets, key=lambda b: (b[0] if b[0] is not None else b[1], b[1]))
        spans = [((lo, 0), (lo + width, 0)) if hi is None else ((hi, lo), (hi, lo + width)) for hi, lo, width in order]
        edges = sorted({e for span in spans for e in span})
        which = {edges.index(first): i for i, (first, _) in enumerate(spans)}  # brackets don't overlap
        piece = _below(edges)
        fan = max(8, min(fanout, COUNTS // len(order)))  # bounds what a round sends to the driver
        mode, base, steps = [-1] * (len(edges) + 1), [0] * (len(edges) + 1), [1] * (len(edges) + 1)
        for e, i in which.items():
            hi, lo, width = order[i]
            mode[e + 1], base[e + 1], steps[e + 1] = int(hi is not None), lo, max(1, width // fan)
        rule = f"(if({_at(mode, 'int', '_p')} = 0, _hi, _lo) - {_at(base, 'bigint', '_p')}) div {_at(steps, 'bigint', '_p')}"
        counts: dict[int, dict[int, tuple[int, int]]] = {}
        for r in keys.withColumn("_p", piece).where(f"{_at(mode, 'int', '_p')} >= 0").withColumn("_c", F.expr(rule)).groupBy("_p", "_c").agg(F.sum("_size").alias("b"), F.count("*").alias("n")).collect():
            counts.setdefault(which[r["_p"] - 1], {})[r["_c"]] = (r.b, r.n)
        open_ = []
        for i, (hi, lo, width) in enumerate(order):
            step = max(1, width // fan)
            found = counts.get(i, {})
            for o in brackets[hi, lo, width]:
                below, at, inner, rows = o["below"], lo, 0, 0
                for c in sorted(found):
                    at, (inner, rows) = lo + c * step, found[c]
                    if below + inner > o["t"]:
                        break
                    below, at, inner, rows = below + inner, at + step, 0, 0
                where = (lambda v: (v, 0)) if hi is None else (lambda v, h=hi: (h, v))
                left, right = o["t"] - below, below + inner - o["t"]
                if min(left, right) > tolerance and rows > 1 and hi is not None and step == 1:
                    return None
                if min(left, right) <= tolerance or rows <= 1:
                    done[o["t"]] = where(at if left <= right else at + step)
                elif step > 1:
                    open_.append({"hi": hi, "lo": at, "width": step, "below": below, "t": o["t"]})
                else:
                    open_.append({"hi": at, "lo": 0, "width": 1 << HASH_BITS, "below": below, "t": o["t"]})
    return [done[t] for t in targets]


def _at(values: list[int], kind: str, index: str) -> str:
    """SQL for the ``index``-th of a literal list; a literal, not code, so its length costs nothing a row."""
    return f"element_at(cast(split('{' '.join(map(str, values))}', ' ') as array<{kind}>), {index} + 1)"


def _below(splits: list[tuple[int, int]]) -> Column:
    """How many of the ordered splits are at or below the row's key, in two levels of search."""
    if not splits:
        return F.lit(0)
    wide = max(1, int(len(splits) ** 0.5))
    array = lambda part: f"arrays_zip(cast(split('{' '.join(str(a) for a, _ in part)}', ' ') as array<bigint>), cast(split('{' '.join(str(b) for _, b in part)}', ' ') as array<bigint>))"
    key = "named_struct('0', _hi, '1', _lo)"
    coarse = f"size(filter({array(splits[wide - 1 :: wide])}, s -> s <= {key}))"
    return F.expr(f"{coarse} * {wide} + size(filter(slice({array(splits)}, {coarse} * {wide} + 1, {wide}), s -> s <= {key}))")


def shard_by_bytes(df: DataFrame, shards: int = 16, text: str = "text", tolerance: float = 0.0005, cells: int | None = None, fanout: int = 1024, row: tuple[str, ...] | None = None) -> DataFrame:
    """All rows of ``df`` with ``_size``, ``shard`` (0 to shards - 1) and ``slot`` (0 up, gapless
    within a shard).

    A shard's bytes (text bytes plus 1 a row, null: none) come within ``tolerance`` of the mean at
    either end, or within one row. Equal texts share a shard unless their own bytes exceed that;
    so do equal rows, of which any may then go to either side. ``cells`` ordered pieces of each
    shard are numbered apart, so no task sorts a whole shard: by default 16, and more for every
    ``CELL_ROWS`` rows. Empty input: no rows. Null ids and texts count like values of their own;
    columns named _size, _hi, _lo, _tie, _cell, shard or slot are replaced.
    """
    df = df.drop("_size", "_hi", "_lo", "_tie", "_cell", "shard", "slot")
    got = _sharded(df, shards, text, tolerance, cells, fanout, row)
    if got is None:  # equal rows hold too much: give each a number that stays
        numbered = materialize(df.withColumn("_tie", F.monotonically_increasing_id()), "shard-rows")
        row = (*(row or [c for c, kind in df.dtypes if "map<" not in kind and c != text]), "_tie")
        got = _sharded(numbered, shards, text, tolerance, cells, fanout, row).drop("_tie")
    return got


def _sharded(df: DataFrame, shards: int, text: str, tolerance: float, cells: int | None, fanout: int, row: tuple[str, ...] | None) -> DataFrame | None:
    k = keyed(df, text, row)
    keys = materialize(k.select("_hi", "_lo", "_size"), "shard-keys")
    total, rows = keys.agg(F.coalesce(F.sum("_size"), F.lit(0)), F.count("*")).first()
    n = shards * (cells or max(16, -(-rows // (shards * CELL_ROWS))))
    targets = sorted({total * i // n for i in range(1, n)} - {0})
    found = _refine(keys, targets, int(total / shards * tolerance), fanout)
    if found is None:
        return None
    at = dict(zip(targets, found, strict=True))
    ends = [at[t] for i in range(1, shards) if (t := total * i // shards) in at]
    splits = sorted(set(at.values()))
    sizes = dict(keys.withColumn("_cell", _below(splits)).groupBy("_cell").count().collect())
    shard_of, start, before = [], [], 0
    for c in range(len(splits) + 1):
        s = sum(e <= splits[c - 1] for e in ends) if c else 0
        before = before if shard_of and s == shard_of[-1] else 0
        shard_of.append(s)
        start.append(before)
        before += sizes.get(c, 0)
    w = Window.partitionBy("_cell").orderBy("_hi", "_lo")
    k = k.withColumn("_cell", _below(splits)).withColumn("slot", F.row_number().over(w).cast("long") - 1)
    return k.withColumns({"shard": F.expr(_at(shard_of, "int", "_cell")), "slot": F.col("slot") + F.expr(_at(start, "bigint", "_cell"))}).drop("_hi", "_lo", "_cell")


def op4(docs: DataFrame, shards: int = 16) -> DataFrame:
    """The digest of ``shard_by_bytes`` over ``documents``; texts are not exchanged for it."""
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    got = shard_by_bytes(docs.select("doc_id", "text", crc.alias("text_crc32")), shards, row=("doc_id",))
    return got.select("doc_id", F.col("_size").alias("size"), "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast(T.IntegerType()).alias("grown_shard"))
