import os
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(__file__))
import fixtures as fx
from pyspark.sql import functions as F

from siftspark.llm import bytes_kernel, common, fit, language, near_vectors, quality, toxicity


def test_language_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = language.op4_language_id(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", "n_chars"), "doc_id").where("n_chars >= 60").collect()
    assert sum(r.lang_pred == r.lang for r in got) >= 0.97 * len(got) and all(0 <= r.score <= 1 for r in got)


def test_language_odd_cases(spark):
    docs = fx.documents(spark, repeat=True)
    model = language.train(docs)
    out = {r.doc_id: r for r in language.identify(fx.clashing(docs), model).collect()}
    assert len(out) == len(fx.rows()) + 1 and all(out[i].lang_pred == "und" and out[i].score == 0 for i in (5, 6, 7)) and out[1].lang_pred == "en"
    assert language.train(fx.empty(spark)) is None
    assert {r.lang_pred for r in language.identify(docs, None).collect()} == {"und"}


def test_language_pieces(monkeypatch):
    data = np.frombuffer(fx.prose(1, 3000).encode(), np.uint8)
    offsets = np.array([0, 100, 100, len(data)])
    whole = language.features(data, offsets)
    monkeypatch.setattr(language, "CHUNK", 256)
    assert np.allclose(whole, language.features(data, offsets), atol=1e-6) and not whole[1].any()


def test_toxicity(spark):
    sf = "/root/testdata/sf0.01"
    r = toxicity.op6_toxicity(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", F.col("toxic").alias("true")), "doc_id").collect()
    hit = [x for x in r if x.true == 1]
    assert sum(x.predicted for x in hit) >= 0.75 * len(hit) and sum(x.predicted for x in r if x.true == 0) <= 0.02 * len(r)


def test_toxicity_odd_cases(spark):
    labels = spark.createDataFrame([(i, i % 2, int(i % 3 == 0)) for i in range(1, 17)] + [(1, 1, 1), (None, 1, 1), (2, None, None)], "doc_id long, quality int, toxic int")
    docs = fx.documents(spark, repeat=True).withColumn("held_out", F.lit(False))
    out = toxicity.score(docs, toxicity.train(docs, labels)).collect()
    assert len(out) == docs.count() and all(0 <= r.score <= 1 for r in out)
    none = toxicity.score(docs, toxicity.train(docs, labels.where("false"))).collect()
    assert {r.predicted for r in none} == {0}


def test_quality(spark):
    sf = "/root/testdata/sf0.01"
    r = quality.op10_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    right = [np.mean([x.predicted == x.quality for x in r if x.quality == q]) for q in (0, 1)]
    assert np.mean(right) >= 0.85


def test_quality_odd_cases(spark):
    docs = fx.documents(spark, repeat=True).withColumn("held_out", F.lit(False))
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 17)], "doc_id long, quality int")
    out = quality.score(docs, quality.train(docs, labels)).collect()
    assert len(out) == docs.count() and all(0 <= r.score <= 1 for r in out) and len({r.score for r in out if r.doc_id in (5, 6)}) == 1
    assert {r.score for r in quality.score(docs, quality.train(docs, labels.where("false"))).collect()} == {0.5}


def test_quality_pieces(monkeypatch):
    """The same values, to the last bit, however texts are cut."""
    net = quality.Network()
    data = np.frombuffer(fx.prose(1, 6000).encode(), np.uint8)
    for offsets in ([0, 0, 5, 700, len(data)], [0, len(data)], [0, 1280, 1281, 2561, 2561 + 1272, 2561 + 1272 + 1400]):
        offsets = np.array(offsets)
        monkeypatch.setattr(quality, "SLICE", 1 << 30)
        whole = quality._gather(net, net.table(), data, offsets)
        for cut in (256, 1280, 4096):
            monkeypatch.setattr(quality, "SLICE", cut)
            assert (whole == quality._gather(net, net.table(), data, offsets)).all()


def test_toxicity_pieces(monkeypatch):
    data = np.frombuffer((fx.prose(1, 900) + "z" * 700 + " " + fx.prose(2, 100)).encode(), np.uint8)
    offsets = np.array([0, 0, 50, len(data)])

    def all_words(chunk):
        monkeypatch.setattr(toxicity, "CHUNK", chunk)
        return sorted((a + int(r), int(x)) for a, _, h, row in toxicity.word_hashes(data, offsets) for x, r in zip(h, row, strict=True))

    assert all_words(64) == all_words(1 << 20)


def test_gradients():
    """Training separates two kinds of bytes."""
    r = np.random.default_rng(1)
    x = r.integers(97, 123, (200, quality.CHUNK_BYTES)).astype(np.uint8)
    y = np.repeat([0.0, 1.0], 100)
    for at in (40, 200):
        x[:100, at : at + 4] = np.frombuffer(b"###!", np.uint8)
    net = quality.Network()
    net.fit([t.tobytes() for t in x], y)
    z = quality._gather(net, net.table(), x.ravel(), np.arange(201) * quality.CHUNK_BYTES)
    assert ((z[:, 0] > 0) == (y > 0)).mean() > 0.95


def test_sample_bounds(spark):
    rows = spark.createDataFrame([(i, "t" * 10, f"l{i % 300}") for i in range(3000)], "doc_id long, text string, label string")
    chosen, counts = fit.sample(rows, "label", 1000, most_rows=1200)
    assert len(counts) == 300 and chosen.count() <= 1200 and chosen.select("label").distinct().count() > 250
    assert fit.sample(rows, "label", 1000, most_bytes=3000)[0].count() <= 600


def sigmoid(z):
    return 1 / (1 + np.exp(-z))


def test_language_against_plain_code(spark, sf):
    """The registered query against counts and votes taken one by one; and neither lang, source nor doc_id matter."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = language.train(docs)

    def told(text):
        x = (text or "").encode()
        code = [int(language._CODE[c]) for c in x]
        v = np.zeros(language.DIMENSIONS)
        for a, b, c in zip(code, code[1:], code[2:], strict=False):
            if b and (a or c):
                v[(a * 24_137_569 + b * 4_913_017 + c * 786_433) * 2_654_435_761 % 2**32 >> 21] += 1
        v = np.sqrt(v / max(v.sum(), 1))

        def vote(m):
            votes, least = dict.fromkeys(m.labels, 0.0), dict.fromkeys(m.labels, 1.0)
            for k, (i, j) in enumerate(m.pairs):
                p = sigmoid(language.SCALE * (v @ m.w[:, k] + m.b[k]))
                for label, q in ((m.labels[i], p), (m.labels[j], 1 - p)):
                    votes[label] += q
                    least[label] = min(least[label], q)
            best = max(m.labels, key=lambda c: votes[c])
            return best, least[best]

        if not any(c.isalpha() for c in text or ""):
            return "und", 0.0
        family, s = vote(model.families)
        lang, t = vote(model.within[model.families.labels.index(family)])
        return lang, min(s, t)

    got = {r.doc_id: r for r in language.op4_language_id(spark, sf).collect()}
    for r in docs.collect():
        lang, score = told(r.text)
        assert got[r.doc_id].lang_pred == lang and got[r.doc_id].score == pytest.approx(score, abs=1e-3), r.doc_id
    other = docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit("s")).withColumn("doc_id", -F.col("doc_id"))
    assert {r.doc_id: (r.lang_pred, r.score) for r in language.identify(other, model).collect()} == {-i: (r.lang_pred, r.score) for i, r in got.items()}


def test_language_ties():
    pairs = language.Pairs(np.zeros((0, 4)), np.array([]))
    pairs.labels, pairs.pairs, pairs.w, pairs.b = ["a", "b"], [(0, 1)], np.zeros((4, 1)), np.zeros(1)
    assert pairs.predict(np.ones((1, 4)))[0][0] == 0


def test_toxicity_against_plain_code(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    chain = toxicity.train(docs, labels)
    at = {int(h): k for k, h in enumerate(chain.words)}

    def hashed(word):
        x = np.frombuffer(word, np.uint8)
        return int(bytes_kernel.string_hashes(x, np.array([0]), np.array([len(x)]))[0])

    def scores(text):
        counts = {}
        word = b""
        for c in (text or "").encode() + b" ":
            if toxicity._LETTER[c]:
                word += bytes([toxicity._FOLD[c]])
            elif word:
                for h in [hashed(word), *[(hashed(word[:k]) + k) % 2**64 for k in toxicity.HEADS if len(word) > k]]:
                    counts[h] = counts.get(h, 0) + 1
                word = b""
        x = np.zeros(len(at))
        for h, n in counts.items():
            for level in toxicity.LEVELS:
                f = int(bytes_kernel.mixed(np.array([(h + level) % 2**64], np.uint64))[0])
                if n >= level and f in at:
                    x[at[f]] = 1
        odds = []
        for w, b in chain.models:
            odds.append(float(np.clip(b + x @ w[: len(x)] + np.array(odds) @ w[len(x) :], -8, 8)))
        return [sigmoid(z) for z in odds]

    names = [f"p_{c}" for c, _ in toxicity.CATEGORIES]
    got = {r.doc_id: r for r in toxicity.op6_toxicity(spark, sf).collect()}
    for r in docs.collect():
        assert [got[r.doc_id][c] for c in names] == pytest.approx(scores(r.text), abs=1e-6)
    other = fx.clashing(docs).select("*", F.lit(True).alias("held_out"), F.lit(0).alias("toxic"), F.lit(1).alias("predicted"))
    assert {r.doc_id: r.score for r in toxicity.score(other, chain).collect()} == {i: r.score for i, r in got.items()}
    assert toxicity.score(fx.empty(spark).withColumn("held_out", F.lit(True)), chain).count() == 0


def test_quality_against_plain_code(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    net = quality.train(docs, labels)
    e, w = net.p["e"], net.p["w"].reshape(quality.WIDTH, quality.EMBED, quality.FILTERS)

    def score(text):
        x = (text or "").encode()
        size = quality.HALF * quality.STRIDE
        halves = -(-(len(x) + quality.WIDTH) // size)
        x = x + bytes(halves * size - len(x))
        conv = [sum(e[x[p + k]] @ w[k] for k in range(quality.WIDTH)) for p in range(0, len(x) - quality.WIDTH + 1, quality.STRIDE)]
        conv.append(conv[-1])  # the last place has too few bytes
        half = [np.max(conv[i * quality.HALF : (i + 1) * quality.HALF], 0) for i in range(halves)]
        chunks = [np.maximum(a, b) for a, b in zip(half, half[1:], strict=False)] or half
        z = np.array([float((np.maximum(c + net.p["b"], 0) @ net.p["v"] + net.p["c"])[0]) for c in chunks])
        v = np.clip([z.mean(), z.max(), z.min(), (z > 0).mean()], -12, 12)
        return sigmoid(v @ net.head[0] + net.head[1])

    got = {r.doc_id: r for r in quality.op10_quality(spark, sf).collect()}
    for r in docs.where("length(text) < 3000 OR text IS NULL").limit(60).collect():
        assert got[r.doc_id].score == pytest.approx(score(r.text), abs=2e-4)
    other = fx.clashing(docs).select("*", F.lit(True).alias("held_out"), F.lit(0).alias("quality"), F.lit(1).alias("predicted"))
    assert {r.doc_id: r.score for r in quality.score(other, net).collect()} == {i: r.score for i, r in got.items()}
    assert quality.score(fx.empty(spark).withColumn("held_out", F.lit(True)), net).count() == 0


def vectors(spark, n=1500, seed=3):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, 32))
    x[100:400] = x[100] + 0.08 * r.normal(size=(300, 32))
    for i in range(500, 560, 2):
        x[i + 1] = x[i] + 0.05 * r.normal(size=32)
    x[600:640] = x[601]
    return [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)]


def test_near_vectors(spark):
    rows = vectors(spark)
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    link = (x @ x.T >= 0.95) & ~np.eye(len(x), dtype=bool)
    label = np.arange(len(x))
    for _ in range(50):
        label = np.array([min(label[i], label[link[i]].min(initial=label[i])) for i in range(len(x))])
    odd = [(2000, None), (2001, [0.0] * 32), (2002, [float("nan")] * 32), (2003, [1.0] * 31), (2004, []), (2005, [None] * 32), (None, [1.0] * 32)]
    d = spark.createDataFrame(rows + odd + [rows[0]], "vec_id long, embedding array<float>").withColumn("label", F.lit(1)).withColumn("x", F.lit(1))
    out = near_vectors.near_vectors(d)
    got = {r.vec_id: r for r in out.collect()}
    assert len(got) == len(rows) + len(odd) and all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in range(2000, 2006))
    assert sum(got[i].n_links for i in range(len(x))) >= 0.98 * link.sum() and all(got[i].n_links <= link[i].sum() for i in range(len(x)))
    assert np.mean([got[i].component_id == label[i] for i in range(len(x))]) >= 0.99
    assert near_vectors.audit(d, out, block=20) >= 0.9
    assert near_vectors.near_vectors(d.where("false")).count() == 0
    assert {got[i].n_links for i in range(600, 640)} == {39} and {got[i].component_id for i in range(600, 640)} == {600}
    other = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.01]), (3, [1.0, 0.0, 0.0]), (4, [2.0, 0.0, 0.0]), (5, [1.0, 0.0])], "vec_id long, embedding array<double>")
    assert {r.vec_id: (r.n_links, r.component_id) for r in near_vectors.near_vectors(other).collect()} == {1: (2, 1), 2: (2, 1), 5: (2, 1), 3: (1, 3), 4: (1, 3)}


def test_near_vectors_over_shards(spark):
    """A noisy group of more than 20 shards: its links mostly have ends that share none."""
    r = np.random.default_rng(5)
    x = np.concatenate([r.normal(size=(1, 64)) / 8 + r.normal(size=(10_500, 64)) * 0.021, r.normal(size=(500, 64))]).astype(np.float32).astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    out = near_vectors.near_vectors(d)
    got = {k: (n, c) for k, n, c, _ in out.collect()}
    want = np.concatenate([(x[a : a + 1024] @ x.T >= 0.95).sum(1) - 1 for a in range(0, len(x), 1024)])
    assert want[:10_500].min() > 9_000 and [got[i][0] for i in range(len(x))] == want.tolist()
    assert all(got[i][1] == (0 if i < 10_500 else i) for i in range(len(x))) and near_vectors.audit(d, out) == 1.0


def test_prune_keeps_near():
    r = np.random.default_rng(1)
    x = r.normal(size=(200, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = near_vectors._prune(x, 1)
    s = x @ x.T - 2 * np.eye(200)
    assert (near[:, 0] == s.argmax(1)).all()
