"""Trained operators: gradients, held-out accuracy, recall, and odd inputs."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rarespark.llm import ann, langid, quality, toxicity
from rarespark.llm.common import chunks, text_view, words

from .conftest import prose


def rows(spark, data, ddl):
    return spark.createDataFrame(data, ddl).repartition(3)


def test_views_of_arrow_text():
    a = pa.array(["x", None, "é b", ""])[1:]
    buf, offs = text_view(a)
    assert buf.tobytes().decode() == "é b" and offs.tolist() == [0, 0, 4, 4]
    s, e, r = words(buf, offs, ~np.isin(np.arange(256), [32]))
    assert (s.tolist(), e.tolist(), r.tolist()) == ([0, 3], [2, 4], [1, 1])
    assert list(chunks(np.array([0, 10, 12, 30]), 11)) == [(0, 1), (1, 2), (2, 3)]


# ---- 2 ---------------------------------------------------------------------------------------


def texts_of(seed, n):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        w = prose(rng, rng.randint(5, 150)).split()
        if i % 3 == 0:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(["idiozz", "scumzz", "vilezza", "vilezzb"]))
        out.append((" ".join(w), int(i % 3 == 0)))
    return out


def test_gradients():
    net = toxicity.Network()
    rng = np.random.RandomState(1)
    mask = np.arange(6)[:, None] < np.array([6, 3, 0])
    g = rng.normal(size=(6, 3, 6 * toxicity.HIDDEN)).astype(np.float32)
    w = rng.normal(size=3).astype(np.float32)
    keep = {}
    net.forward(g, mask, keep)
    grad, dg = net.backward(keep, w)
    grad = {k: v for k, v in grad.items() if k in net.p}

    def slope(array, at):
        old, out = array[at], []
        for d in (0.01, -0.01):
            array[at] = old + d
            out.append(float((net.forward(g, mask) * w).sum()))
        array[at] = old
        return (out[0] - out[1]) / 0.02

    for name in ("uf", "ub", "wa", "va", "uo"):
        for _ in range(3):
            at = tuple(rng.randint(n) for n in net.p[name].shape)
            assert grad[name][at] == pytest.approx(slope(net.p[name], at), rel=0.03, abs=1e-3), name
    for at in ((2, 1, 5), (5, 0, 30), (0, 0, 20)):
        assert dg[at] == pytest.approx(slope(g, at), rel=0.03, abs=1e-3)
    assert not dg[:, 2].any() and not dg[3:, 1].any()


def test_windows_reach_every_word():
    row = np.repeat([0, 2], [100, 5])
    first, size, of = toxicity.windows(row, 3)
    covered = {(int(t), int(f + i)) for f, s, t in zip(first, size, of, strict=True) for i in range(s)}
    assert covered == {(0, i) for i in range(100)} | {(2, 100 + i) for i in range(5)}
    assert of.tolist().count(1) == 1


def test_a_passage_of_25_words_lies_whole_in_a_window():
    first, size, _ = toxicity.windows(np.zeros(100, np.int64), 1)
    for at in range(16, 32):
        assert ((first <= at) & (first + size >= at + 25)).any(), at


def test_toxicity_held_out(spark):
    data = [(i, t, y) for i, (t, y) in enumerate(texts_of(1, 450))]
    docs = rows(spark, [(i, t) for i, t, _ in data], "doc_id bigint, text string")
    labels = rows(spark, [(i, y) for i, _, y in data[:300]] + [(None, 1), (5, None)], "doc_id bigint, toxic int")
    net = toxicity.train(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(docs, net).collect()}
    right = [got[i].predicted == y for i, _, y in data[300:]]
    assert np.mean(right) > 0.9 and all(0 <= r.score <= 1 for r in got.values())
    long = "calm words here " * 5000
    odd = rows(spark, [(1, None), (2, ""), (3, long + "idiozz scumzz vilezza " * 2 + long)], "doc_id bigint, text string")
    got = {r.doc_id: r.score for r in toxicity.score(odd, net).collect()}
    assert got[1] == got[2] and got[3] > 0.5


def test_long_runs_are_read_to_their_end():
    text = "".join(chr(0x4E00 + i * 37 % 9000) for i in range(400)) + "idiozz" + "x" * 64 + " " + "y" * 65
    buf, offs = text_view(pa.array([text, "idiozz " + text[:8]]))
    t = toxicity.Tokens(buf, offs)
    want = {g for w in [*text.split(), "idiozz", text[:8]] for b in [f"_{w}_".encode()] for n in toxicity.GRAMS for g in toxicity.Ranges(np.frombuffer(b, np.uint8)).grams(n).tolist()}
    assert set(t.gram.tolist()) == want
    assert np.bincount(t.row)[1] == 2 and (np.diff(t.row) >= 0).all()


@pytest.mark.parametrize("gap", ["\u00a0", "\u3000", "\u2014"])
def test_toxic_passage_late_in_a_run_without_spaces(gap):
    data = texts_of(1, 300)
    net = toxicity.fit([s.join(t.split()) for t, _ in data for s in (" ", gap)], np.repeat([y for _, y in data], 2))
    calm = gap.join(prose(random.Random(3), 600)[:-1].split())
    plain, toxic = net.scores(*text_view(pa.array([calm, gap.join([calm, "idiozz", "scumzz", "vilezza", "idiozz", "vilezzb", calm])])))
    assert plain < 0.5 < toxic


def test_toxicity_of_one_class(spark, nothing):
    docs = rows(spark, [(1, "a"), (2, "b")], "doc_id bigint, text string")
    labels = rows(spark, [(1, 0)], "doc_id bigint, toxic int")
    assert {r.score for r in toxicity.score(docs, toxicity.train(docs, labels)).collect()} == {0.0}
    assert toxicity.score(nothing, None).count() == 0


# ---- 3 ---------------------------------------------------------------------------------------


def vectors(spark, n=1500, d=16):
    rng = np.random.RandomState(0)
    x = rng.normal(size=(n, d)).astype(np.float32)
    odd = [(n, None), (n + 1, [0.0] * d), (n + 2, [float("nan")] * d), (n + 3, [None] * d), (n + 4, [1.0] * (d + 1)), (None, [1.0] * d)]
    return rows(spark, [(i, v.tolist()) for i, v in enumerate(x)] + odd, "vec_id bigint, embedding array<float>"), x.astype(float)


def test_recall_and_exact_scores(spark):
    df, x = vectors(spark)
    got = ann.search(df, F.col("vec_id") % 20 == 0).collect()
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append(r)
    assert sorted(by) == list(range(0, 1500, 20))
    found = 0
    for q, rs in by.items():
        rs.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in rs] == list(range(1, 21))
        assert [(-r.score, r.vec_id) for r in rs] == sorted((-r.score, r.vec_id) for r in rs)
        assert all(r.score == pytest.approx(x[q] @ x[r.vec_id], abs=1e-12) for r in rs)
        s = x @ x[q]
        s[q] = -np.inf
        found += len({r.vec_id for r in rs} & set(np.argsort(-s)[:20].tolist()))
    assert found / (20 * len(by)) >= 0.9


def test_few_vectors_and_ties(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 4)
    df = rows(spark, [(i, [1.0, 0.0]) for i in range(30)], "vec_id bigint, embedding array<float>")
    got = [r.vec_id for r in ann.search(df, F.col("vec_id") == 0).orderBy("rank").collect()]
    assert got == list(range(1, 21))
    three = df.where("vec_id < 3")
    assert [(r.query_id, r.vec_id) for r in ann.search(three, F.col("vec_id") == 1).orderBy("rank").collect()] == [(1, 0), (1, 2)]
    assert ann.search(df.limit(0), F.col("vec_id") == 0).count() == 0


def test_small_parts_are_filled_up_from_the_next(spark, monkeypatch):
    w2 = np.array([[1, 0], [0, 1]], np.float32)
    monkeypatch.setattr(ann, "fit", lambda *_: ann.Router(np.eye(2, dtype=np.float32), np.zeros(2, np.float32), w2, np.zeros(2, np.float32)))
    data = [(i, [1.0, i / 1000]) for i in range(197)] + [(i, [0.1, 1.0]) for i in (197, 198, 199, 199, 199)]
    d = rows(spark, data, "vec_id bigint, embedding array<float>")
    got = ann.search(d, F.col("vec_id").isin(3, 197, 198), k=5).groupBy("query_id").count().collect()
    assert {r.query_id: r["count"] for r in got} == {3: 5, 197: 5, 198: 5}


def test_graph_parts_are_balanced():
    x = np.random.RandomState(0).normal(size=(512, 4))
    label = ann.cut(ann.neighbours(x, 8), 8)
    assert np.bincount(label).tolist() == [64] * 8


# ---- 9 ---------------------------------------------------------------------------------------

OF = {"en": ["the", "and", "ing", "tion", "wh"], "de": ["sch", "ung", "ei", "der", "ü"], "fr": ["eau", "é", "ou", "la", "ç"]}


def spoken(seed, n):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        lang = rng.choice(sorted(OF))
        out.append((" ".join("".join(rng.choice(OF[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(4, 60))), lang))
    return out


def test_language_held_out(spark, docs, nothing):
    train = rows(spark, [*spoken(1, 150), ("no lang", None), (None, "en")], "text string, lang string")
    prototypes = langid.train(train)
    assert sorted(prototypes) == ["de", "en", "fr"]
    test = spoken(2, 100)
    df = rows(spark, [(i, t, x) for i, (t, x) in enumerate(test)], "doc_id bigint, text string, lang string")
    assert np.mean([r.lang_pred == r.lang for r in langid.predict(df, prototypes).collect()]) > 0.97
    odd = langid.predict(rows(spark, [(None,), ("",), ("12 !",), ("THE AND",)], "text string"), prototypes).collect()
    assert sorted((r.lang_pred, r.score > 0) for r in odd) == [("en", True)] + [("und", False)] * 3
    assert {r.lang_pred for r in langid.predict(docs, {}).collect()} == {"und"}
    assert langid.predict(nothing, prototypes).count() == 0 and langid.train(nothing) == {}


def test_a_text_of_all_ideographs_and_syllables(spark):
    letters = [chr(c) for a, b in ((0x3400, 0x4DC0), (0x4E00, 0xA000), (0xAC00, 0xD7A4)) for c in range(a, b)]
    random.Random(2).shuffle(letters)
    text = "".join(letters)
    v, has = langid.profiles([text, "the and", None])
    want = np.zeros(langid.DIMENSIONS)
    codes = [0, *map(ord, letters), 0]
    for gram in zip(codes, codes[1:], codes[2:], strict=False):
        want += np.prod([np.roll(langid.letter_vector(c, langid.DIMENSIONS), 2 - p) for p, c in enumerate(gram)], axis=0)
    assert v[0].tolist() == want.tolist() and has.tolist() == [True, True, False]
    assert v[1].tolist() == langid.profiles(["the and"])[0][0].tolist()
    d = rows(spark, [(1, text, "zh"), (2, "the and other words", "en"), (3, text[::2], None)], "doc_id bigint, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in langid.predict(d, langid.train(d)).collect()}
    assert got[1] == "zh" and got[2] == "en" and len(got) == 3


def test_profiles_bundle_bound_grams():
    v, has = langid.profiles(["ab", "AB!", "", "5"])
    a, b, gap = (langid.letter_vector(c, langid.DIMENSIONS).astype(int) for c in (97, 98, 0))
    want = np.roll(gap, 2) * np.roll(a, 1) * b + np.roll(a, 2) * np.roll(b, 1) * gap
    assert (v[0] == want).all() and (v[1] == want).all() and has.tolist() == [True, True, False, False]


# ---- 10 --------------------------------------------------------------------------------------


def mixed(seed, n):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        t = prose(rng, rng.randint(8, 80)).capitalize()
        if i % 5 == 0:
            w = t.split()
            t = [" | ".join(w), " ".join(x.upper() + "!!" for x in w), " ".join(x + rng.choice(["%%%", "$$$", "&&&"]) for x in w), " ".join([w[0]] * len(w))][i // 5 % 4]
        out.append((i, t, int(i % 5 != 0)))
    return out


def test_quality_without_labels(spark, docs, nothing):
    data = mixed(1, 400)
    df = rows(spark, [(i, t) for i, t, _ in data], "doc_id bigint, text string")
    got = {r.doc_id: r for r in quality.classify(df).collect()}
    assert np.mean([got[i].keep == bool(y) for i, _, y in data]) > 0.97
    out = quality.classify(docs).collect()
    assert len(out) == docs.count() and all(0 <= r.score <= 1 for r in out)
    assert quality.classify(nothing).count() == 0


def test_expectation_maximisation_finds_the_accurate_labeller():
    rng = np.random.RandomState(0)
    truth = rng.random_sample(4000) < 0.8
    vote = lambda right: np.where((rng.random_sample(4000) < right) == truth, 1, 2)
    v = np.stack([vote(0.95), vote(0.7), vote(0.8), np.zeros(4000, int)], 1)
    k, n = np.unique(v @ 3 ** np.arange(4), return_counts=True)
    post, p = quality.estimate(dict(zip(k.tolist(), n.tolist(), strict=True)), 4)
    assert p[0][0][0] == pytest.approx(0.95, abs=0.03) and p[1][0][0] == pytest.approx(0.7, abs=0.05)
    guess = np.array([post[x] for x in (v @ 3 ** np.arange(4)).tolist()]) >= 0.5
    assert (guess == truth).mean() > 0.93
