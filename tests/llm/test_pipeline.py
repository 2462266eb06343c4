import os
import sys

sys.path.insert(0, os.path.dirname(__file__))
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
import fixtures as fx
from pyspark.sql import functions as F
from test_text_operators import hits_by_hand, lines_by_hand

import corpus_pipeline
from siftspark.llm import mixing, ngram_join


def test_stages_against_brute_force(spark, sf, tmp_path):
    """Each stage on what the one before kept, against its operator's plain version."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(str(tmp_path / str(k)))
        seen.append((docs, docs := spark.read.parquet(str(tmp_path / str(k)))))
    pairs = [[{r.doc_id: r for r in d.collect()} for d in (a, b)] for a, b in seen[:4]]
    assert all(b.columns == a.columns for a, b in seen[:4])
    a, b = pairs[0]
    assert len(b) >= 0.99 * len(a) and all(b[i].text == a[i].text for i in b)
    a, b = pairs[1]
    want = {i: t for i, (_, n, t) in lines_by_hand([(i, r.text) for i, r in a.items()]).items() if n == 0 or t.strip()}
    assert {i: r.text for i, r in b.items()} == want and all(r.n_chars == len(r.text) for r in b.values())
    a, b = pairs[2]
    assert set(b) == {i for i, (_, c) in ngram_join.brute_force([(i, r.text) for i, r in a.items()]).items() if i == c}
    a, b = pairs[3]
    bench = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    assert set(b) == {i for i, (_, n, _) in hits_by_hand([(i, r.text) for i, r in a.items()], bench).items() if not n}
    tokens = {}
    for r in b.values():
        tokens[r.source] = tokens.get(r.source, 0) + len(r.text.split())
    _, w = mixing.exponent([tokens[s] for s in sorted(tokens)], 0.98, 4.0, sum(tokens.values()))
    taken = seen[4][1].collect()
    for s, x in zip(sorted(tokens), w, strict=True):
        quota = int(x * sum(tokens.values()))
        got = sum(r.n_tokens for r in taken if r.source == s)
        assert got <= quota and got >= quota - max(len(r.text.split()) for r in b.values() if r.source == s)


def test_near_copies_from_80_percent(spark, sf):
    """Copies of 5-word Jaccard 0.8 to 0.9, or under 0.9 at three words, go; one under 0.8 stays."""
    w = [f"w{i}" for i in range(200)]
    texts = [w, [f"c{i}" if i in (30, 70, 110, 150) else x for i, x in enumerate(w)], w + [f"d{i}" for i in range(30)], w + [f"e{i}" for i in range(40)], w + [f"f{i}" for i in range(55)]]
    rows = [(i, " ".join(t), "en", "s1", 1) for i, t in enumerate(texts)]
    kept = {r.doc_id for r in corpus_pipeline.ngram_join(spark, spark.createDataFrame(rows, fx.SCHEMA), sf).collect()}
    assert kept == {0, 4} == {i for i, (_, c) in ngram_join.brute_force([r[:2] for r in rows], 5, 80).items() if i == c}


NAMES = ["lang_pred", "score", "n_lines", "n_removed", "n_spans", "n_shingles", "component_id", "set", "first", "n_words", "n_hit", "n_items", "items", "_th", "_row", "_told", "_lines", "_cov", "a", "b"]


def test_clashing_names(spark, sf):
    """Every stage but the last returns columns of any name as they were."""
    docs = fx.documents(spark, repeat=True)
    for c in NAMES:
        docs = docs.withColumn(c, F.concat(F.lit(c), F.col("doc_id").cast("string")))
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert rows and all(r[c] == (None if r.doc_id is None else f"{c}{r.doc_id}") for r in rows for c in NAMES), name


def test_odd_cases(spark, sf):
    docs = fx.documents(spark, repeat=True)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        assert out.columns[: len(docs.columns)] == docs.columns, name
        out.count()
        assert stage(spark, fx.empty(spark), sf).count() == 0


def test_mixing_clashes(spark, sf):
    docs = fx.documents(spark).withColumn("weight", F.lit("mine")).withColumn("_named", F.lit(1))
    out = corpus_pipeline.mixing(spark, docs, sf)
    assert dict(out.dtypes)["weight"] == "double" and {r["_named"] for r in out.collect()} == {1}


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 100
