"""What used to have a limit: large counts, lost files, many buckets, texts made to collide, repeated rows and ids."""

import hashlib
import os
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rarespark.llm import ann, bpe, lm, queries, sharding, store, substring, toxicity
from rarespark.llm.hashing import Fields, mix


def thue_morse(n):
    """Two texts of n bytes that no polynomial modulo 2**64 tells apart once n is large."""
    bits = np.array([bin(i).count("1") & 1 for i in range(n)], np.uint8)
    return (97 + bits).tobytes().decode(), (98 - bits).tobytes().decode()


@pytest.mark.parametrize("n", [128, 256, 1024, 2048])
def test_complementary_texts_have_hashes_of_their_own(spark, n):
    a, b = (np.frombuffer(x.encode(), np.uint8) for x in thue_morse(n))
    buf = np.r_[a, b, a]
    f = Fields(buf)
    h, c = f(np.array([0, n, 2 * n]), np.array([n, 2 * n, 3 * n])), f.check(np.array([0, n, 2 * n]), np.array([n, 2 * n, 3 * n]))
    assert h[0] == h[2] != h[1] and c[0] == c[2] != c[1]
    assert (h[0] ^ h[1]) & np.uint64(0xFFFFFFFF)


def test_complementary_texts_are_no_copies_and_no_one_token(spark):
    a, b = thue_morse(2048)
    docs = spark.createDataFrame([(1, a), (2, b), (3, "x " + a[:1024])], "doc_id bigint, text string")
    want = Counter(x[i : i + 1024] for x in (a, b, "x " + a[:1024]) for i in range(len(x) - 1023))
    got = {r.doc_id: r for r in substring.op5(docs, 1024, 64).collect()}
    for i, x in ((1, a), (2, b), (3, "x " + a[:1024])):
        cut = np.zeros(len(x), bool)
        for j in range(len(x) - 1023):
            if want[x[j : j + 1024]] > 1:
                cut[j : j + 1024] = True
        assert got[i].n_removed == cut.sum()
        assert got[i].kept_sha256 == hashlib.sha256(np.frombuffer(x.encode(), np.uint8)[~cut].tobytes()).hexdigest()
    model = lm.train(spark.createDataFrame([(a,), (a,)], "text string"))
    assert [r.n_known for r in lm.score(docs.where("doc_id < 3"), model).orderBy("doc_id").collect()] == [2, 1]


def test_values_of_one_hash_and_other_checks_are_apart(tmp_path):
    v = np.array([5, 5, 5, 9, 5], np.uint64)
    c = np.array([1, 2, 1, 1, 3], np.uint32)
    keys, checks, n = store.count_distinct(v, c)
    assert list(zip(keys.tolist(), checks.tolist(), n.tolist(), strict=True)) == [(5, 1, 2), (5, 2, 1), (5, 3, 1), (9, 1, 1)]
    k, x, back = store.distinct(v, c)
    assert (k[back] == v).all() and (x[back] == c).all()
    store.write_counts(f"{tmp_path}/0", [keys, checks, n])
    s = store.Store(str(tmp_path), np.array([4]), True)
    assert s.counts(np.array([5, 9, 5, 5, 9, 7], np.uint64), np.array([3, 1, 4, 2, 2, 1], np.uint32)).tolist() == [1, 1, 0, 1, 0, 0]


def test_counts_have_no_limit(tmp_path):
    n = np.array([1, (1 << 32) - 1, 1 << 40, 7], np.uint64)
    store.write_counts(f"{tmp_path}/0", [np.arange(4, dtype=np.uint64) * 10, n])
    assert store.Store(str(tmp_path), np.array([4])).counts(np.arange(0, 40, 10, dtype=np.uint64)).tolist() == n.tolist()
    parts = [[np.array([3], np.uint64), np.array([1 << 33], np.uint64)]] * 2
    assert store._merged(parts, 1, False)[1].tolist() == [1 << 34]


def _values():
    def values(it):
        for b in it:
            yield mix(np.asarray(b.column(0)).astype(np.uint64) % np.uint64(300))

    return values


def test_a_lost_file_is_an_error(spark):
    s, _ = store.tally(spark.range(1000), _values(), 3, "t")
    asked = mix(np.arange(300, dtype=np.uint64))
    assert s.counts(asked).sum() == 1000
    os.remove(s.uri.removeprefix("file:").replace("//", "/", 1) + "/1")
    lost = store.Store(s.uri, s.sizes)
    with pytest.raises((OSError, ValueError)):
        lost.counts(asked)


def test_many_buckets_are_dealt_in_two_steps(spark, monkeypatch):
    df = spark.range(5000).repartition(5)
    want = {r.bucket: (r.n, r.total) for r in store.tally(df, _values(), 40, "t")[1]}
    monkeypatch.setattr(store, "DIRECT", 10)
    monkeypatch.setattr(store, "FLUSH", 100)
    s, kept = store.tally(df, _values(), 40, "t")
    assert {r.bucket: (r.n, r.total) for r in kept} == want
    assert s.counts(mix(np.arange(300, dtype=np.uint64))).sum() == 5000


def test_a_session_on_a_cluster_must_name_its_folder():
    from rarespark.llm import common

    class Context:
        master = "spark://there:7077"

        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return None

    session = type("S", (), {"sparkContext": Context(), "conf": type("C", (), {"get": lambda self, k, d: d})()})()
    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_root(session)


# ---- 2 ---------------------------------------------------------------------------------------


def test_training_reads_a_bounded_number_of_bytes(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda texts, y: seen.append(texts))
    docs = spark.createDataFrame([(i, f"t{i} " * (5000 if i % 7 == 0 else 10)) for i in range(60)], "doc_id bigint, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    toxicity.train(docs.unionByName(docs), labels, sample_bytes=1200)
    assert sum(map(len, seen[0])) <= 1200 and len(seen[0]) > 10 and len(set(seen[0])) == len(seen[0])
    toxicity.train(docs, labels)
    assert len(seen[1]) == 60


# ---- 3 ---------------------------------------------------------------------------------------


def nearest(rows, k):
    """By query: ids in order, one line an item, the best of its vectors' products."""
    out = {}
    ids = sorted({i for i, _ in rows})
    of = {i: np.array([v for j, v in rows if j == i]) for i in ids}
    for q in (i for i in ids if i % 20 == 0):
        score = sorted(((-float((of[q] @ of[i].T).max()), i) for i in ids if i != q))
        out[q] = [i for _, i in score[:k]]
    return out


def test_repeated_ids_are_listed_once(spark):
    rng = np.random.RandomState(0)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(100)]
    rows += [rows[0], rows[3], (3, rng.normal(size=8).tolist()), rows[50]]
    got = {}
    for r in ann.search(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    want = nearest(rows, 20)
    assert set(got) == set(want)
    for q, found in got.items():
        assert [x for x, _ in found] == list(range(1, 21)) and len({i for _, i in found}) == 20
    assert np.mean([len({i for _, i in got[q]} & set(want[q])) / 20 for q in want]) >= 0.9


def test_few_rows_give_all_candidates_and_a_hot_vector_is_no_wall(spark):
    few = spark.createDataFrame([(i, [float(i + 1), 1.0]) for i in range(7)] + [(20, [1.0, 1.0])], "vec_id bigint, embedding array<double>")
    got = [(r.query_id, r.vec_id) for r in ann.search(few, F.col("vec_id") % 20 == 0).collect()]
    assert sorted(got) == sorted([(0, i) for i in (1, 2, 3, 4, 5, 6, 20)] + [(20, i) for i in range(7)])
    rng = np.random.RandomState(1)
    rows = [(i, ([1.0] + [0.0] * 15) if i % 3 == 0 else rng.normal(size=16).tolist()) for i in range(2000)]
    n = ann.search(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), F.col("vec_id") % 20 == 0).groupBy("query_id").count().collect()
    assert len(n) == 100 and all(r["count"] == 20 for r in n)


def test_search_reaches_its_recall_through_several_parts(spark, monkeypatch):
    rng = np.random.RandomState(5)
    centres = rng.normal(size=(40, 16))
    rows = [(i, (centres[i % 40] + 0.3 * rng.normal(size=16)).tolist()) for i in range(3000)]
    parts = []
    monkeypatch.setattr(ann, "fit", lambda x, n, k, fit=ann.fit: parts.append(n) or fit(x, n, k))
    got = {}
    for r in ann.search(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    want = nearest(rows, 20)
    assert parts == [32]
    assert np.mean([len(got[q] & set(want[q])) / 20 for q in want]) >= 0.9


# ---- 4 ---------------------------------------------------------------------------------------


def test_equal_rows_are_split(spark):
    df = spark.createDataFrame([(1, "a")] * 4000 + [(i, f"own {i}") for i in range(2, 4000)], "doc_id bigint, text string").repartition(5)
    got = sharding.op4(df).collect()
    size, slots = Counter(), {}
    for r in got:
        size[r.shard] += r.size
        slots.setdefault(r.shard, []).append(r.slot)
    mean = sum(size.values()) / 16
    assert set(size) == set(range(16)) and max(abs(b - mean) for b in size.values()) <= 20
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(got) == 7998


def test_sharding_with_nulls_and_clashing_columns(spark):
    rows = [(None if i % 5 == 0 else i, None if i % 7 == 0 else f"t {i % 50}", -1, -1, -1) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, shard int, slot int, _size int")
    got = sharding.shard_by_bytes(df, 4).collect()
    assert sum(r._size for r in got) == sum(len(t or "") + 1 for _, t, *_ in rows)
    of = Counter(r.shard for r in got)
    assert sorted((r.shard, r.slot) for r in got) == [(s, i) for s in range(4) for i in range(of[s])]


# ---- 7 ---------------------------------------------------------------------------------------


def test_long_pieces_are_the_librarys(spark):
    from tokenizers import Tokenizer

    rng = np.random.RandomState(0)
    texts = ["".join(map(chr, rng.randint(97, 123, 20_000))), "a" * 3001, "ab" * 1501, "".join(rng.choice(["the", "ing", "é", "日"], 4000)), "".join(map(chr, rng.randint(0x4E00, 0x9FFF, 2000))), "", None]
    lib = Tokenizer.from_file(bpe.default_path())
    for got, x in zip(bpe.Tokenizer(bpe.default_path()).encode_batch(texts), texts, strict=True):
        assert np.frombuffer(got, "<u4").tolist() == lib.encode(x or "", add_special_tokens=False).ids


def test_no_texts_no_tokens(nothing):
    assert bpe.encode(nothing, bpe.default_path()).count() == 0 and bpe.digest(nothing, bpe.default_path()).count() == 0


# ---- all -------------------------------------------------------------------------------------


def test_held_out_rows_are_those_of_the_contract(spark, docs):
    import zlib

    rows = docs.select("doc_id", "text", "lang").dropDuplicates(["doc_id"])
    labels = rows.select("doc_id", F.lit(1).alias("toxic"))
    for got, mod, left in ((lm.op1(rows), 10, 0), (toxicity.op2(rows, labels), 5, 0), (queries.langid.op9(rows), 3, 1)):
        for r in got.collect():
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % mod == left)
