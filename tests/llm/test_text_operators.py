import os
import re
import sys

import duckdb
import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(__file__))
import fixtures as fx
from pyspark.sql import functions as F

from siftspark.llm import bytes_kernel, common, decontaminate, line_dedup, mixing, ngram_join, pii, queries, suffix_dedup


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_equals_sql(name, spark, sf):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, sf), c.sql(queries.ORACLE_SQL[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    at = [want.columns.index(x) for x in cols]
    assert sorted(tuple(str(r[x]) for x in cols) for r in got.collect()) == sorted(tuple(str(r[i]) for i in at) for r in want.fetchall())


def lines_by_hand(docs):
    seen, out = set(), {}
    for i, t in sorted(docs, key=lambda d: d[0]):
        lines = [] if t is None else t.split("\n")
        full = [(p, x.strip(" \t\r")) for p, x in enumerate(lines) if x.strip(" \t\r")]
        gone = set()
        for k in range(len(full) - 2):
            w = tuple(x for _, x in full[k : k + 3])
            if w in seen:
                gone |= set(range(full[k][0], full[k + 2][0] + 1))
            seen.add(w)
        out[i] = (len(lines), len(gone), "\n".join(x for p, x in enumerate(lines) if p not in gone))
    return out


def test_lines(spark):
    got = {r.doc_id: (r.n_lines, r.n_removed, r.text or "") for r in line_dedup.dedup_lines(fx.documents(spark)).collect()}
    assert got == lines_by_hand([(r[0], r[1]) for r in fx.rows()])
    assert got[11][1] == 0 and got[12][1] == 6 and got[16][1] == 12


def test_lines_odd_cases(spark):
    d = fx.clashing(fx.documents(spark, repeat=True))
    out = line_dedup.dedup_lines(d)
    assert out.count() == d.count() and set(d.columns) <= set(out.columns)
    assert {r.n_removed for r in out.where("doc_id = 1").collect()} == {0}
    assert out.where("text IS NULL").count() == 2 and out.first()["_l"] == "clash"
    assert line_dedup.dedup_lines(fx.empty(spark)).count() == 0


def test_suffixes(spark, monkeypatch):
    docs = [(r[0], r[1]) for r in fx.rows()]
    want = dict(zip([d[0] for d in docs], suffix_dedup.brute_force([d[1] for d in docs]), strict=True))
    for hot in (256, 1):
        monkeypatch.setattr(suffix_dedup, "HOT", hot)
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.h) for r in suffix_dedup.dedup(fx.documents(spark)).withColumn("h", F.sha2("kept", 256)).collect()}
        assert got == want
    assert want[15][1] == 800 and want[1][1] > 0 and want[5][1] == 0


def test_suffixes_in_pieces(spark, monkeypatch):
    """A common passage of 230 bytes in many contexts: one hot token, cut twice; and texts worked on in small pieces."""
    monkeypatch.setattr(suffix_dedup, "HOT", 4)
    monkeypatch.setattr(suffix_dedup, "CHUNK", 700)
    common_text = fx.prose(77, 60)[:230]
    docs = [(100 + i, fx.prose(200 + i, 30 + i) + common_text + fx.prose(300 + i, 20)) for i in range(14)] + [(200, fx.prose(9, 900)), (201, "z" + fx.prose(9, 900))]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    want = dict(zip([x[0] for x in docs], suffix_dedup.brute_force([x[1] for x in docs]), strict=True))
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.h) for r in suffix_dedup.dedup(d).withColumn("h", F.sha2("kept", 256)).collect()} == want


def test_suffixes_odd_cases(spark):
    out = suffix_dedup.dedup(fx.clashing(fx.documents(spark, repeat=True))).collect()
    assert len(out) == len(fx.rows()) + 3 and all(r.n_removed == r.n_bytes for r in out if r.doc_id == 1)
    assert suffix_dedup.dedup(fx.empty(spark)).count() == 0


def pii_by_hand(t):
    out = []
    digits = lambda s: re.sub(r"[^0-9]", "", s)

    def luhn(d):
        return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0

    for k, (kind, pattern, ok) in enumerate((
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(digits(m)) <= 15),
    )):
        out += [(m.start(), k, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, t or "") if ok(m[0])]
    return [x[2] for x in sorted(out)]


PII = [
    "mail a.b+c@ex-a.co.uk, x@y and é@b.co, a@b.c_d@e.f", "1.2.3.4 256.1.1.1 1.2.3.4.5 001.02.3.255 1.2.3.4.5.6.7.8", "card 4785 3805 9239 1139, 4111-1111-1111-1111 and 4111111111111112", "call +1 (706) 555-3138. or +44 20 7946 0958 x +1-2",
    "IBAN DE89 3704 0044 0532 0130 00", "é😀 a@b.co", "", None, "@" * 50, "a" * 5000 + "@b" + ".c" * 5000, "1 " * 9000, "+" + "1-" * 3000 + "1", "a@b.c@d.e 1.1.1.1@x.y",
    'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" and ' + "x" * 40, "é a@b.co " * 3000, "y" * 4080 + " write to a@b.co now",
]


def test_pii(spark):
    d = spark.createDataFrame(list(enumerate(PII)), "doc_id long, text string")
    for r in pii.find(fx.clashing(d)).collect():
        base = [f"{p.kind}:{p.s}:{p.e}" for p in r.pii if p.k < pii.BASE]
        assert base == pii_by_hand(PII[r.doc_id]), PII[r.doc_id]
    spans = {r.doc_id: r.pii for r in pii.find(d).collect()}
    assert [p.kind for p in spans[4]][-1] == "iban" and spans[4][-1].score == 100 and spans[7] == []
    assert pii.find(fx.empty(spark)).count() == 0
    assert [(p.kind, p.s, p.e, p.score) for p in spans[13]] == [("secret", 9, 49, 90)]
    assert spans[15][-1].kind == "email" and spans[15][-1].score == 95
    own = d.withColumn("_pii0", F.lit(1)).withColumn("pii", F.lit("mine")).withColumn("_cuts", F.lit(2))
    out = pii.find(own)
    assert sorted(out.columns) == sorted(own.columns) and out.where("doc_id = 0").first()["_pii0"] == 1 and len(out.where("doc_id = 0").first().pii) == 3
    assert pii.redact(d).where("doc_id = 5").first().text == "é😀 <EMAIL>"


def hits_by_hand(docs, bench):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    wins = {}
    for i, t in bench:
        w = words(t)
        for k in range(max(len(w) - 9, 1) if w else 0):
            wins.setdefault(tuple(w[k : k + 10]), set()).add(str(i))
    out = {}
    for i, t in docs:
        w, hit, items = words(t), set(), set()
        for n in {len(x) for x in wins}:
            for k in range(len(w) - n + 1):
                if (found := wins.get(tuple(w[k : k + n]))):
                    hit |= set(range(k, k + n))
                    items |= found
        out[i] = (len(w), len(hit), sorted(items))
    return out


def test_benchmark(spark, monkeypatch):
    a = fx.rows()[0][1]
    bench = [(1, " ".join(a.split()[5:30])), (2, "Two words"), (3, None), (4, ""), (5, "not there at all " + a[:30]), (6, "x"), (6, "x"), (7, " ".join(a.split()[50:60]).upper())]
    want = hits_by_hand([(r[0], r[1]) for r in fx.rows()], bench)
    b = spark.createDataFrame(bench, "item_id long, text string")
    for inline in (20_000, 7):
        monkeypatch.setattr(decontaminate, "TERMS_INLINE", inline)
        got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in decontaminate.summarize(decontaminate.matches(fx.documents(spark), b)).collect()}
        assert got == want
    kept = decontaminate.decontaminate(fx.clashing(fx.documents(spark, repeat=True)), b)
    assert {r.doc_id for r in kept.collect() if r.doc_id} == {i for i, (_, n, _) in want.items() if not n} and "_l" in kept.columns
    assert decontaminate.decontaminate(fx.documents(spark), b.where("false")).count() == len(fx.rows())
    assert decontaminate.decontaminate(fx.empty(spark), b).count() == 0
    w = a.split()[5:15]
    near = spark.createDataFrame([(1, " ".join([*w[:4], "zzz", *w[4:]])), (2, " ".join(reversed(w))), (3, " ".join(w[:5]) + " q" * 30 + " " + " ".join(w[5:]))], "doc_id long, text string")
    one = spark.createDataFrame([(1, " ".join(w))], "item_id long, text string")
    assert {r.doc_id for r in decontaminate.matches(near, one, slop=2).where("item_id IS NOT NULL").collect()} == {1, 2}
    assert decontaminate.matches(near, one).where("item_id IS NOT NULL").count() == 0


def test_benchmark_keeps_repeated_rows(spark):
    """Six rows for six, a repeated document, a null one and a null id among them."""
    text = fx.prose(8, 40)
    rows = [(1, text), (1, text), (2, "other " + text), (None, text), (3, None), (4, "nothing of it")]
    bench = spark.createDataFrame([("i", " ".join(text.split()[3:20]))], "item_id string, text string")
    each, found = decontaminate.find(spark.createDataFrame(rows, "doc_id long, text string"), bench)
    got = sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in decontaminate.summarize(found, each).collect()), key=str)
    assert got == sorted([(1, 40, 17, ["i"]), (1, 40, 17, ["i"]), (2, 41, 17, ["i"]), (None, 40, 17, ["i"]), (3, 0, 0, []), (4, 3, 0, [])], key=str)


def test_long_texts(spark):
    """Texts of megabytes: what repeats, what leaks and what is personal is found at their ends as well."""
    words = fx.prose(90, 400_000)
    tail = "\n".join(["one line of three", "the next line of three", "the last line of three"])
    long = words.replace(" ", "\n", 5000) + "\n" + tail + "\nmail a.b@example.org and 10.1.2.3"
    docs = spark.createDataFrame([(1, tail, "a"), (2, long, "b"), (3, "z" * 3_000_000, "b")], "doc_id long, text string, source string")
    assert {r.doc_id: r.n_removed for r in line_dedup.dedup_lines(docs).select("doc_id", "n_removed").collect()} == {1: 0, 2: 3, 3: 0}
    bench = spark.createDataFrame([(1, "the next line of three the last line of three")], "item_id long, text string")
    each, found = decontaminate.find(docs, bench)
    assert {r.doc_id: r.n_hit for r in decontaminate.summarize(found, each).collect()} == {1: 10, 2: 10, 3: 0}
    assert {r.doc_id: [p.kind for p in r.pii] for r in pii.find(docs).select("doc_id", "pii").collect()} == {1: [], 2: ["email", "ip"], 3: []}
    mixed = mixing.mix(docs).groupBy("doc_id").agg(F.max("n_tokens").alias("n")).collect()
    assert mixed and all(r.n > 0 for r in mixed)


def test_ngrams(spark, monkeypatch):
    base = fx.prose(50, 150).split()
    r = np.random.default_rng(1)
    more = []
    for k in range(320):  # a family of near copies, several blocks wide
        w = list(base)
        for p in r.integers(0, 150, k % 7):
            w[p] = f"w{k}_{p}"
        more.append((1000 + k, " ".join(w), None, None, None))
    more += [(2000 + i, " ".join(f"t{j}" for j in range(i, i + 30)), None, None, None) for i in range(12)]  # a chain
    want = ngram_join.brute_force([(x[0], x[1]) for x in fx.rows() + more])
    for block, large in ((2048, 1 << 15), (64, 1 << 15), (64, 8)):  # one unit a family, pairs of blocks, partial overlaps first
        monkeypatch.setattr(ngram_join, "BLOCK", block)
        monkeypatch.setattr(ngram_join, "LARGE", large)
        got = {x.doc_id: (x.n_shingles, x.component_id) for x in ngram_join.groups(fx.documents(spark, more)).collect()}
        assert got == want and want[2011][1] == 2000


def near_copies(seed):
    """Families whose links lie around 80 %: changed words, texts cut or lengthened, passages that many of them share."""
    r = np.random.default_rng(seed)
    passages = [fx.prose(600 + k, 25) for k in range(3)]
    out = []
    for f in range(24):
        base = fx.prose(700 + f % 16, int(r.integers(6, 160))).split()
        for _ in range(int(r.choice([2, 5, 14, 30]))):
            w = list(base)
            for p in r.integers(0, len(w), int(r.integers(0, 2 + len(w) // 45))):
                w[p] = f"n{r.integers(1 << 40)}"
            w = w[: len(w) - int(r.integers(0, 1 + len(w) // 6))] + fx.prose(int(r.integers(1 << 30)), int(r.integers(0, 1 + len(w) // 6))).split()
            if r.random() < 0.4:
                at = int(r.integers(0, len(w) + 1))
                w[at:at] = passages[int(r.integers(3))].split()
            out.append((len(out), " ".join(w)))
    return out


@pytest.mark.parametrize(("few", "extra", "percent"), [(8, 5, 80), (2, 5, 80), (2, 20, 70), (3, 0, 90)])
def test_ngram_prefixes(spark, monkeypatch, few, extra, percent):
    """Candidates by prefixes, with frequent shingles by prefixes of their own, lose no link."""
    monkeypatch.setattr(ngram_join, "FEW", few)
    monkeypatch.setattr(ngram_join, "EXTRA", extra)
    docs = near_copies(few + percent)
    want = ngram_join.brute_force(docs, 5, percent)
    got = ngram_join.groups(spark.createDataFrame(docs, "doc_id long, text string"), 5, percent, prefix=True)
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in got.collect()} == want
    assert 24 < len({c for _, c in want.values()}) < len(docs) - 4


def test_ngram_query_contract(spark, sf):
    """op8's own values are 3 words and 90 %."""
    want = ngram_join.brute_force([tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()], 3, 90)
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in ngram_join.op8_ngram_join(spark, sf).collect()} == want


def test_ngram_odd_cases(spark):
    d = fx.clashing(fx.documents(spark, repeat=True))
    g = ngram_join.groups(d).collect()
    assert len(g) == d.count() and {x.component_id for x in g if x.doc_id in (9, 10)} == {9} and {x.component_id for x in g if x.doc_id in (5, 6, 7)} == {5, 6, 7}
    kept = ngram_join.dedup(d)
    assert kept.columns == d.columns and sorted(x.doc_id for x in kept.collect() if x.doc_id) == [i for i, (_, c) in ngram_join.brute_force([(x[0], x[1]) for x in fx.rows()]).items() if i == c]
    assert ngram_join.groups(fx.empty(spark)).count() == 0


def thue_morse():
    """Two different words of 1024 letters whose polynomial hashes modulo 2**64 agree for every odd base."""
    t = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    return t, t.translate(str.maketrans("ab", "ba"))


def sets_of(t, chunk, monkeypatch, size=3):
    monkeypatch.setattr(ngram_join, "CHUNK", chunk)
    x = np.frombuffer(t.encode(), np.uint8)
    return [s.tolist() for _, s, _ in ngram_join.shingle_sets(x, np.array([0, len(x)]), size)]


def test_ngram_long_text(monkeypatch):
    for t in (fx.prose(8, 400), "x" * 5000 + " y " + fx.prose(9, 50)):
        assert sets_of(t, 64, monkeypatch) == sets_of(t, 1 << 21, monkeypatch)


def test_hashes_of_structured_words(spark, monkeypatch):
    a, b = thue_morse()
    docs = [(1, a), (2, b), (3, f"{a} {b} {a}"), (4, f"{b} {a} {b}"), (5, a.upper())]
    want = ngram_join.brute_force(docs)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in ngram_join.groups(d).collect()} == want and want[2][1] == 2 and want[5][1] == 1
    parts = [a[:300], b[:300], "c" + a[512:812], "d" + b[512:812], a[:199]]
    d = spark.createDataFrame(list(enumerate(parts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.h) for r in suffix_dedup.dedup(d).withColumn("h", F.sha2("kept", 256)).collect()}
    assert got == dict(enumerate(suffix_dedup.brute_force(parts)))
    for size in (8, 9, 200, 256, 257, 1024):
        x = np.frombuffer((a[:size] + b[:size]).encode(), np.uint8)
        h = bytes_kernel.string_hashes(x, np.array([0, size, 0]), np.array([size, 2 * size, size]))
        assert h[0] == h[2] != h[1]


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)] + [(500, 500 + i) for i in range(1, 30)]
    got = {r.node: r.comp for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, **{500 + i: 500 for i in range(30)}}


def test_mixing(spark):
    d = spark.createDataFrame([(i, "w " * (1 + i % 7), "big" if i % 3 else f"s{i % 4}", i) for i in range(600)] + [(1000, None, "big", 0), (1001, "", None, 0), (1002, "a b", None, 0)], "doc_id long, text string, source string, epoch long")
    out = mixing.mix(d, entropy=0.98, repeats=None)
    rows = out.collect()
    tokens = {}
    for i, t, s, _ in d.collect():
        tokens[s or ""] = tokens.get(s or "", 0) + len((t or "").split())
    a, w = mixing.exponent([tokens[k] for k in sorted(tokens)], 0.98, None, sum(tokens.values()))
    assert -sum(x * np.log(x) for x in w) == pytest.approx(0.98 * np.log(len(w)), abs=1e-4) and 0 < a < 1
    for s, x in zip(sorted(tokens), w, strict=True):
        got = sum(r.n_tokens for r in rows if (r.source or "") == s)
        assert int(x * sum(tokens.values())) - 7 <= got <= int(x * sum(tokens.values()))
    assert len({(r.doc_id, r.epoch) for r in rows}) == len(rows) and not {1000, 1001} & {r.doc_id for r in rows}
    a, w = mixing.exponent([1000, 10], 1.0, 2.0, 1010)
    assert w[1] * 1010 / 10 <= 2.0 + 1e-6
    assert mixing.mix(fx.empty(spark)).count() == 0


def test_mixing_repeated_rows(spark):
    d = fx.clashing(fx.documents(spark, repeat=True))
    assert mixing.mix(d).where("doc_id IS NULL AND text IS NULL").count() == 0
