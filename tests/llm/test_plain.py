"""Trained operators and the pipeline's stages against plain loops."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rarespark.llm import bpe, langid, quality, toxicity
from rarespark.llm.common import text_view

from .test_text_operators import classes, hits, repeated, utf8


def test_network_word_by_word(corpus):
    """Every window of every text by the definition of the gates, one word after the other."""
    net, rng = toxicity.Network(), np.random.RandomState(2)
    for v in net.evidence.values():
        v[:] = rng.normal(size=len(v))
    net.calibration = (0.7, -0.2)
    texts = [t for _, t in corpus if t and "<|" not in t][:25] + [""]
    buf, offs = text_view(pa.array(texts, pa.string()))
    tokens = toxicity.Tokens(buf, offs)
    x = net.inputs(tokens).astype(float)
    p = {k: v.astype(float) for k, v in net.p.items()}
    sigmoid, h = (lambda z: 1 / (1 + np.exp(-z))), toxicity.HIDDEN

    def states(inputs, side):
        u, s, out = p["uf" if side == 0 else "ub"], np.zeros(h), []
        for v in inputs if side == 0 else inputs[::-1]:
            g, a = (v @ p["wx"] + p["b"])[side * 3 * h : (side + 1) * 3 * h], s @ u
            z, r = sigmoid(g[:h] + a[:h]), sigmoid(g[h : 2 * h] + a[h : 2 * h])
            s = (1 - z) * np.tanh(g[2 * h :] + r * a[2 * h :]) + z * s
            out.append(s)
        return out if side == 0 else out[::-1]

    for i, got in enumerate(net.scores(buf, offs)):
        own = x[tokens.at[tokens.row == i]]
        best = -math.inf
        for first in range(0, max(1, len(own) - toxicity.LENGTH + toxicity.STRIDE), toxicity.STRIDE):
            w = own[first : first + toxicity.LENGTH]
            both = [np.r_[a, b] for a, b in zip(states(w, 0), states(w, 1), strict=True)]
            weight = [math.exp(float(np.tanh(s @ p["wa"]) @ p["va"])) for s in both]
            pooled = sum((v * s for v, s in zip(weight, both, strict=True)), np.zeros(2 * h)) / max(sum(weight), 1e-300)
            best = max(best, float(pooled @ p["uo"] + p["bo"][0]))
        assert got == pytest.approx(sigmoid(0.7 * best - 0.2), abs=1e-4)


def plain_profile(text):
    letters = "".join(c if c.isalpha() else " " for c in (text or "").lower())
    code = [0 if c == " " else ord(c) for c in " " + re.sub(" +", " ", letters).strip() + " "]
    total = np.zeros(langid.DIMENSIONS)
    if len(code) > 2:
        for i in range(len(code) - langid.GRAM + 1):
            total += np.prod([np.roll(langid.letter_vector(c, langid.DIMENSIONS), langid.GRAM - 1 - j).astype(int) for j, c in enumerate(code[i : i + langid.GRAM])], axis=0)
    return total


def test_predictions_of_language(docs, corpus):
    rows = docs.select("doc_id", "text", F.when(F.col("doc_id") % 3 > 0, F.when(F.length("text") % 2 == 0, "aa").otherwise("bb")).alias("lang")).dropDuplicates(["doc_id"])
    sums = {}
    for r in rows.collect():
        if r.lang is not None and r.text is not None:
            sums[r.lang] = sums.get(r.lang, 0) + plain_profile(r.text)
    prototypes = {k: sums[k] / np.linalg.norm(sums[k]) for k in sorted(sums)}
    got = {r.doc_id: r for r in langid.predict(rows, langid.train(rows)).collect()}
    for i, t in corpus:
        if not any(c.isalpha() for c in t or ""):
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        v = plain_profile(t)
        cosine = {k: float(v @ u) / max(np.linalg.norm(v), 1e-9) for k, u in prototypes.items()}
        e = {k: math.exp(langid.SHARPNESS * (c - max(cosine.values()))) for k, c in cosine.items()}
        assert got[i].score == pytest.approx(1 / sum(e.values()), abs=1e-4)
        if abs(cosine["aa"] - cosine["bb"]) > 1e-6:
            assert got[i].lang_pred == max(cosine, key=cosine.get)


def test_posteriors_row_by_row():
    """Expectation-maximisation over single documents instead of counted patterns."""
    rng = np.random.RandomState(6)
    good = rng.random_sample(300) < 0.7
    v = np.array([[0 if rng.random_sample() < 0.2 else (1 if (g == (rng.random_sample() < a)) else 2) for a in (0.9, 0.8, 0.6)] for g in good])
    post = [(0.2 if (r == 2).any() else 0.9) + 0.05 * math.tanh((r == 1).sum() - 2.0 * (r == 2).sum()) for r in v]
    for _ in range(100):
        share = (sum(post) + 1) / (len(v) + 2)
        p = {}
        for c in (0, 1):
            for j in range(3):
                n = {x: sum((q if c == 0 else 1 - q) for q, r in zip(post, v, strict=True) if r[j] == x) + 1 for x in (1, 2)}
                for x in (1, 2):
                    p[c, j, x] = n[x] / (n[1] + n[2])
        now = []
        for r in v:
            like = [s * math.prod(p[c, j, x] for j, x in enumerate(r) if x) for c, s in ((0, share), (1, 1 - share))]
            now.append(like[0] / sum(like))
        done = max(abs(a - b) for a, b in zip(now, post, strict=True)) < 1e-6
        if done:
            break
        post = now
    got, _ = quality.estimate(dict(Counter(quality.patterns(v).tolist())), 3)
    for q, k in zip(post, quality.patterns(v).tolist(), strict=True):
        assert got[k] == pytest.approx(q, abs=1e-5)


def test_scores_of_quality_by_shape_trigrams(docs, corpus):
    """The scorer's decision from plain counts of hashed shapes and votes."""
    w, post = quality.train(docs)
    got = {r.doc_id: r for r in quality.classify(docs.drop("score", "keep")).collect()}
    for i, t in corpus:
        data = utf8(t)
        buf = np.frombuffer(data, np.uint8)
        votes = quality.votes(quality.measures(buf, np.array([0, len(buf)])))[0]
        x = np.zeros(quality.FEATURES)
        for j, vote in enumerate(votes.tolist()):
            x[((j * 3 + vote + 1) * 0xD6E8FEB86659FD93 % (1 << 64)) >> 54] += 0.5
        shape = [int(quality._SHAPES[b]) for b in data]
        n = Counter(((a << 16 | b << 8 | c) * 0x9E3779B97F4A7C15 % (1 << 64)) >> 54 for a, b, c in zip(shape, shape[1:], shape[2:], strict=False))
        for k, m in n.items():
            x[k] += math.sqrt(m / max(sum(n.values()), 1))
        z = float(x @ w[:-1] + w[-1])
        assert got[i].score == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, z)))), abs=1e-3)
        assert got[i].weak_posterior == pytest.approx(post[int(quality.patterns(votes[None])[0])])


def test_each_stage_does_what_its_definition_says(spark, docs, corpus, tmp_path):
    """The rows and texts that each stage leaves, by plain versions of the four exact ones."""
    items = [(1, corpus[5][1])]
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    sf, held = str(tmp_path), spark.read.parquet(str(tmp_path / "documents.parquet"))
    stages = dict(corpus_pipeline.STAGES)

    kept = {(r.doc_id, r.text) for r in quality.classify(docs.drop("score", "keep")).where("keep").collect()}
    after = stages["quality_classifier"](spark, held, sf)
    rows = [(r.doc_id, r.text) for r in after.collect()]
    assert set(rows) == kept

    given = held.select(*held.columns)  # the exact stages on all texts, odd ones too
    after = stages["near_duplicate_join"](spark, given, sf)
    rows = sorted(((r.doc_id, r.text) for r in after.collect()), key=lambda r: r[0])
    assert [i for i, _ in rows] == sorted({c for c, _, _ in classes(corpus).values()}) and rows == [corpus[i] for i, _ in rows]

    after = corpus_pipeline.materialize(stages["suffix_array_dedup"](spark, after, sf), "t")
    cut = {i: (t, data, mask) for (i, t), (data, mask) in zip(rows, repeated([t for _, t in rows], 200), strict=True)}
    left = {}
    for r in after.collect():
        t, data, mask = cut[r.doc_id]
        left[r.doc_id] = np.frombuffer(data, np.uint8)[~mask].tobytes().decode("utf-8", "ignore") if mask.any() else t
        assert r.text == left[r.doc_id] and (not mask.any() or r.n_chars == len(r.text))
    assert set(left) == set(cut)

    after = corpus_pipeline.materialize(stages["benchmark_decontamination"](spark, after, sf), "t")
    bad = {i for i, t in left.items() for w, hit, _ in [hits(t, items)] if hit.any() and 20 * hit.sum() >= len(w)}
    assert {r.doc_id for r in after.collect()} == set(left) - bad and 5 in bad

    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(bpe.default_path())
    done = {r.doc_id: r for r in stages["bpe_encoding"](spark, after, sf).collect()}
    assert set(done) == set(left) - bad
    for i, r in done.items():
        ids = lib.encode(left[i] or "", add_special_tokens=False).ids
        assert list(r.ids) == ids and r.n_tokens == len(ids)
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()
