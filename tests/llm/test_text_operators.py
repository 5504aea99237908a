"""Each operator against a plain version of its definition, on a corpus of odd texts."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rarespark.llm import bpe, decontam, jaccard, lm, sharding, store, substring
from rarespark.llm.hashing import Ranges, mix


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def utf8(t):
    return (t or "").encode()


def by_id(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.doc_id, []).append(r)
    return out


def test_hashes_depend_on_the_bytes_only():
    a = np.frombuffer(b"xxabcyyabc", np.uint8)
    h = Ranges(a)(np.array([2, 7, 0]), np.array([5, 10, 3]))
    assert h[0] == h[1] != h[2]
    assert (Ranges(a).grams(3)[[2, 7]] == h[:2]).all()
    x = np.arange(1, 1000, dtype=np.uint64)
    assert (lm.unmix(mix(x)) == x).all()


def test_blocks_keep_what_they_pack():
    v = np.sort(np.random.RandomState(0).randint(0, 1 << 62, 1000).astype(np.uint64))
    c = np.arange(1000, dtype=np.uint32)
    got = store.unpack(store.pack([v, c]))
    assert (got[0] == v).all() and (got[1] == c).all()


def test_a_tally_counts_and_finds(spark, monkeypatch):
    monkeypatch.setattr(store, "FLUSH", 50)
    df = spark.range(1000).repartition(4)

    def values(it):
        for b in it:
            yield mix(np.asarray(b.column(0)).astype(np.uint64) % np.uint64(300))

    s, kept = store.tally(df, values, 3, "t", 4)
    got = s.counts(mix(np.arange(302, dtype=np.uint64)))
    assert got.tolist() == [4] * 100 + [0] * 202 and sum(r.total for r in kept) == 400


# ---- 1 ---------------------------------------------------------------------------------------


def plain_model(texts):
    tok = lambda t: re.findall("[^\x20\x09-\x0d]+", low(t)) + [None]
    c, b = Counter(), Counter()
    for t in texts:
        w = tok(t)
        c.update(w)
        b.update(zip(["<s>", *w[:-1]], w, strict=True))

    def discount(counts):
        n = [sum(v == k for v in counts) for k in (1, 2, 3, 4)]
        if min(n) <= 0:
            return [0, 0.5, 1.0, 1.5]
        y = n[0] / (n[0] + 2 * n[1])
        d = [1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2]]
        return [0, *(x if 0 < x <= i + 1 else (i + 1) / 2 for i, x in enumerate(d))]

    of = Counter(c)
    of["<s>"] = len(texts)
    kinds = Counter(w for _, w in b)
    d, d0 = discount(b.values()), discount(kinds.values())
    rest = Counter()
    for (h, _), v in b.items():
        rest[h] += d[min(v, 3)]
    left = sum(d0[min(v, 3)] for v in kinds.values()) / len(b)
    single = lambda w: max(kinds[w] - d0[min(kinds[w], 3)], 0) / len(b) + left / (len(c) + 1)

    def p(h, w):
        if not of[h]:
            return single(w)
        return max(b[h, w] - d[min(b[h, w], 3)], 0) / of[h] + rest[h] / of[h] * single(w)

    return tok, c, p


def test_kneser_ney(docs, corpus):
    train = docs.where("doc_id % 3 <> 0")
    tok, c, p = plain_model([r.text for r in train.select("text").collect()])
    assert sum(p("the", w) for w in c) + p("the", "never seen") == pytest.approx(1)
    assert sum(p("<s>", w) for w in c) + p("<s>", "never seen") == pytest.approx(1)
    n = sum(c.values())
    got = by_id(lm.score(docs, lm.train(train)))
    for i, t in corpus:
        w, r = tok(t), got[i][0]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(c[x] > 0 for x in w), n)
        assert r.score == pytest.approx(sum(math.log10(p(h, x)) for h, x in zip(["<s>", *w[:-1]], w, strict=True)))
        assert r.base_score == pytest.approx(sum(math.log10((c[x] + 0.1) / (n + 0.1 * (len(c) + 1))) for x in w))
    assert len(got[0]) == 2


def test_kneser_ney_without_training_texts(docs, nothing):
    got = lm.score(docs, lm.train(nothing)).collect()
    assert all(r.n_known == 0 and r.score == pytest.approx(0) for r in got)
    assert lm.score(nothing, lm.train(nothing)).count() == 0


# ---- 4 ---------------------------------------------------------------------------------------


def test_sharding(docs):
    got = sharding.shard_by_bytes(docs, 4, cells=3).collect()
    assert len(got) == docs.count()
    size = Counter()
    slots, of_text = defaultdict(list), defaultdict(set)
    for r in got:
        assert r._size == len(utf8(r.text)) + 1
        size[r.shard] += r._size
        slots[r.shard].append(r.slot)
        of_text[r.text].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in of_text.values())
    largest = max(r._size for r in got)
    assert max(abs(size[s] - sum(size.values()) / 4) for s in range(4)) <= 2 * largest


def test_a_hot_text_is_split(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "hot " * 20).otherwise(F.concat(F.lit("own "), "id")).alias("text"))
    sizes = sharding.shard_by_bytes(df, 8, cells=2).groupBy("shard").agg(F.sum("_size").alias("b")).collect()
    assert len(sizes) == 8 and max(r.b for r in sizes) - min(r.b for r in sizes) <= 200


def test_sharding_of_nothing_and_of_equal_rows(nothing, spark):
    assert sharding.shard_by_bytes(nothing).count() == 0
    df = spark.createDataFrame([(1, "a")] * 50, "doc_id bigint, text string")
    got = sharding.shard_by_bytes(df, 4).collect()
    of = [sorted(r.slot for r in got if r.shard == s) for s in range(4)]
    assert all(s == list(range(len(s))) for s in of) and sorted(map(len, of)) in ([12, 12, 13, 13], [12, 12, 12, 14], [11, 13, 13, 13])


# ---- 5 ---------------------------------------------------------------------------------------


def repeated(texts, depth):
    data = [utf8(t) for t in texts]
    count = Counter(d[i : i + depth] for d in data for i in range(len(d) - depth + 1))
    out = []
    for d in data:
        cut = np.zeros(len(d), bool)
        for i in range(len(d) - depth + 1):
            if count[d[i : i + depth]] > 1:
                cut[i : i + depth] = True
        out.append((d, cut))
    return out


@pytest.mark.parametrize(("depth", "gram"), [(200, 64), (40, 16)])
def test_repeated_substrings(docs, depth, gram):
    rows = docs.select("doc_id", "text").collect()
    want = {r.doc_id: x for r, x in zip(rows, repeated([r.text for r in rows], depth), strict=True)}
    got = by_id(substring.remove_repeats(docs, depth, gram))
    for i, (data, cut) in want.items():
        for r in got[i]:
            assert bytes(r.kept) == np.frombuffer(data, np.uint8)[~cut].tobytes()
            mask = np.zeros(len(data), bool)
            for s in r.removed:
                mask[s.start : s.end] = True
            assert (mask == cut).all() and sum(s.end - s.start for s in r.removed) == cut.sum()
            assert r.kept_text == bytes(r.kept).decode("utf-8", "ignore")
    assert len(got) == len(want)


def test_long_texts_are_read_in_pieces(docs, monkeypatch):
    whole = substring.op5(docs).collect()
    starts = []
    for size in (None, 300):
        if size:
            monkeypatch.setattr(substring, "PIECE", size)
        buf = np.frombuffer(utf8("abc" * 400 + "".join(map(chr, range(40, 120))) * 9), np.uint8)
        offs = np.array([0, len(buf)])
        runs = [(b + r.first.min(), b + r.last.max(), b) for b, p, o in substring.pieces(buf, offs, 200) if len((r := substring.Runs(p, o, 200, 64)).first)]
        covered = [x for b, p, o in substring.pieces(buf, offs, 200) for r in [substring.Runs(p, o, 200, 64)] for x in (b + r.starts(np.arange(len(r.first)))).tolist()]
        assert runs and covered == list(range(len(buf) - 199))
        starts.append(covered)
    assert starts[0] == starts[1] and whole


def test_no_texts_no_repeats(nothing):
    assert substring.remove_repeats(nothing).count() == 0


# ---- 6 ---------------------------------------------------------------------------------------


def hits(text, items):
    tok = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low(t))
    w = tok(text)
    hit, found = np.zeros(len(w), bool), set()
    for i, t in items:
        p = tok(t)
        for j in range(max(1, len(p) - 12) if p else 0):
            q = p[j : j + 13]
            for k in range(len(w) - len(q) + 1):
                if w[k : k + len(q)] == q:
                    hit[k : k + len(q)] = True
                    found.add(str(i))
    return w, hit, found


def test_decontamination(spark, docs, corpus):
    passage = corpus[40][1]
    items = [(1, passage), (10, passage[40:200]), (2, "a"), (3, None), (4, "..."), (5, "x x x x x x x x x x x x x x"), (6, "日本語 日本語"), (6, "A B")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = by_id(decontam.find(docs.withColumn("items", F.lit(1)), bench))
    for i, t in corpus:
        w, hit, found = hits(t, items)
        for r in got[i]:
            assert (r.n_words, r.n_hit, r.items) == (len(w), hit.sum(), sorted(found)), i
            assert r.contaminated == bool(hit.any() and 20 * hit.sum() >= len(w))
            cut = b" ".join(utf8(t)[s.start : s.end] for s in r.removed).decode()
            assert re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low(cut)) == [x for x, h in zip(w, hit, strict=True) if h]


def test_decontamination_with_empty_tables(spark, docs, nothing):
    empty = spark.createDataFrame([], "item_id bigint, text string")
    assert not any(r.contaminated for r in decontam.find(docs, empty).collect())
    assert decontam.find(nothing, empty).count() == 0


def test_suffixes_sort_like_strings():
    rng = np.random.RandomState(2)
    for n in (1, 2, 30, 200):
        text = np.r_[rng.randint(0, 3, n), 0]
        keys = [[(1, int(x)) if x else (0, i + j) for j, x in enumerate(text[i:])] for i in range(len(text))]
        assert decontam.suffix_array(text).tolist() == sorted(range(len(text)), key=lambda i: keys[i])


def test_index_counts_and_locates():
    rng = np.random.RandomState(3)
    text = np.r_[rng.randint(0, 4, 300), 0]
    index = decontam.Index(text, 3)
    p = rng.randint(1, 4, (50, 4))
    low_, high = index.search(p, np.full(50, 4))
    for q, a, b in zip(p, low_, high, strict=True):
        want = [i for i in range(298) if (text[i : i + 4] == q).all()]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


# ---- 7 ---------------------------------------------------------------------------------------


def test_tokens_are_the_librarys(docs, corpus):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_path())
    got, short = by_id(bpe.encode(docs, bpe.default_path())), by_id(bpe.digest(docs, bpe.default_path()))
    for i, text in corpus:
        ids = t.encode(text or "", add_special_tokens=False).ids
        r, s = got[i][0], short[i][0]
        assert list(r.ids) == ids and r.decoded == t.decode(ids, skip_special_tokens=False)
        assert s.n_tokens == len(ids) and s.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert s.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()


def test_clearing_the_cache_changes_nothing(corpus, monkeypatch):
    texts = [t for _, t in corpus]
    want = bpe.Tokenizer(bpe.default_path()).encode_batch(texts)
    monkeypatch.setattr(bpe, "CACHE_PIECES", 1)
    t = bpe.Tokenizer(bpe.default_path())
    assert [t.encode_batch([x])[0] for x in texts] == want


# ---- 8 ---------------------------------------------------------------------------------------


def classes(rows, threshold=0.8):
    sets = {}
    for i, t in rows:
        w = re.findall("[^\x20\x09-\x0d]+", low(t))
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    kinds = defaultdict(list)
    for i, s in sorted(sets.items()):
        kinds[s].append(i)
    full = [s for s in kinds if s]
    links = {s: [o for o in full if o != s and len(s & o) >= threshold * len(s | o) - 1e-12] for s in full}
    least = {s: kinds[s][0] for s in full}
    for _ in full:
        least = {s: min([least[s], *(least[o] for o in links[s])]) for s in full}
    return {i: (least.get(s, i), len(links.get(s, ())), kinds[s][0] if s else i) for i, s in sets.items()}


def many(spark):
    """A class of near copies larger than a block, beside singles."""
    base = [f"w{i}" for i in range(80)]
    rows = [(i, " ".join([*base[:j], f"z{i}", *base[j:]])) for i in range(40) for j in [i * 2 % 80]]
    rows += [(100 + i, " ".join(f"u{i}x{j}" for j in range(30))) for i in range(10)]
    return spark.createDataFrame(rows, "doc_id bigint, text string"), rows


@pytest.mark.parametrize("block", [512, 7])
def test_join_finds_every_link(spark, docs, corpus, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    large, rows = many(spark)
    for df, given in ((docs, corpus), (large, rows)):
        want = classes(given)
        got = by_id(jaccard.join(df))
        assert {i: (r[0].class_id, r[0].n_links, r[0].copy_of) for i, r in got.items()} == want


def test_join_keeps_one_of_each(docs, corpus, nothing, spark):
    kept = [r.doc_id for r in jaccard.one_of_each(docs).collect()]
    assert sorted(kept) == sorted({c for c, _, _ in classes(corpus).values()})
    assert jaccard.join(nothing).count() == 0
    odd = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (1, "a b c d e f"), (2, None)], "doc_id bigint, text string")
    assert sorted(r.class_id for r in jaccard.join(odd).collect()) == [1, 1, 1, 2]
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in jaccard.one_of_each(odd).collect()) == [(False, 0), (False, 0), (True, 1), (True, 2)]


def test_rows_that_share_an_id_are_documents_of_their_own(spark):
    a, b, c = "a b c d e f g", "h i j k l m n", "o p q r s t u"
    odd = spark.createDataFrame([(1, a), (1, b), (1, b), (2, b), (3, c), (3, a), (4, None), (4, "")], "doc_id bigint, text string")
    got = sorted((r.doc_id, str(r.text)) for r in jaccard.one_of_each(odd).collect())
    assert got == sorted([(1, a), (1, b), (3, c), (4, "None"), (4, "")])


def test_bands_that_agree_by_half_are_not_one(monkeypatch):
    sig = np.arange(2 * jaccard.VALUES, dtype=np.uint32).reshape(2, -1) % jaccard.VALUES
    high = np.uint64(7 << 32)
    monkeypatch.setattr(jaccard, "bands", lambda s: np.array([[high | np.uint64(64), 129], [high | np.uint64(128), 129]], np.uint64))
    sets = (np.tile(np.arange(9, dtype=np.uint64), 2), np.array([0, 9, 18]))
    monkeypatch.setattr(jaccard, "verified", lambda x, y, *_: np.ones(len(x), bool))
    held = type("Held", (), {"get": lambda self, keys: (sig[: len(keys)], sets)})()
    batch = pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in ([129, 129], [5, 6], [0, 0], [0, 0], [0, 0])], ["band", "key", "i", "j", "block"])
    got = [r for b in jaccard._links(iter([batch]), held, jaccard.least_matches(), 0.8) for r in b.to_pylist()]
    assert sorted((r["key"], r["links"], r["root"]) for r in got) == [(5, 1, 5), (6, 1, 5)]


def test_found_links():
    u = lambda *x: np.array(x, np.uint64)
    found = jaccard.Found()
    found.add(u(), u())
    assert found.links == {}
    found.add(u(5, 5, 9), u(7, 3, 8))
    found.add(u(8), u(7))
    assert found.links == {3: 1, 5: 2, 7: 2, 8: 2, 9: 1} and {found.root(x) for x in found.links} == {3}


def test_pruning_keeps_what_may_reach_the_threshold():
    least = jaccard.least_matches()
    assert least == sorted(least) and least[-1] < 0.8 * jaccard.VALUES
    # at J = 0.8 a pair is dropped at any step with a chance of about the tolerance
    for i, m in enumerate(least):
        n = (i + 1) * jaccard.STEP
        assert sum(math.comb(n, k) * 0.8**k * 0.2 ** (n - k) for k in range(m)) < 1e-4
