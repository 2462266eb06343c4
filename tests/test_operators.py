from datetime import date, datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftspark.operators import chunks, clusters, guard, lists, order, ranking, retrieval, state
from siftspark.operators.storage import new_folder
from siftspark.streaming import incremental


def test_percentile(spark):
    d = spark.createDataFrame([("a", 200), ("a", 100), ("b", 1), ("b", 2), ("b", 2)], "s string, v int")
    got = sorted((r.s, r.v, r.p) for r in d.withColumn("p", ranking.mid_rank("v", "s")).collect())
    assert got == [("a", 100, 0.25), ("a", 200, 0.75), ("b", 1, 1 / 6), ("b", 2, 4 / 6), ("b", 2, 4 / 6)]


def test_evaluate(spark):
    d = spark.createDataFrame([("m", 1), ("m", 3), ("m", None), ("m", 10)], "mode string, rank int")
    r = retrieval.evaluate(d).first()
    assert (r.recall_1, r.recall_5, r.recall_10, r.mrr) == (0.25, 0.5, 0.75, round((1 + 1 / 3 + 0.1) / 4, 6))


def test_rrf(spark):
    a = spark.createDataFrame([(1, 1), (2, 2), (3, 3)], "id int, rank int")
    b = spark.createDataFrame([(3, 1), (1, 2)], "id int, rank int")
    rows = retrieval.rrf(a, b, key="id").orderBy(F.desc("score"), "id").collect()
    assert [r.id for r in rows] == [1, 3, 2] and rows[0].score == pytest.approx(1 / 61 + 1 / 62)


def test_knn_blocks(spark, monkeypatch):
    c = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(20)], "chunk_id long, embedding array<float>")
    q = c.select(F.col("chunk_id").alias("query_id"), "embedding")
    whole = sorted(map(tuple, retrieval.knn(q, c, 3, keep="other").collect()))
    monkeypatch.setattr(retrieval, "BLOCK_ROWS", 7)
    assert sorted(map(tuple, retrieval.knn(q, c, 3, keep="other").collect())) == whole and len(whole) == 60
    odd = spark.createDataFrame([(100, None), (101, [0.0, 0.0]), (102, [1.0, None]), (103, [float("nan"), 1.0]), (104, [1.0, 2.0, 3.0]), (105, [1.0, 2.0, 3.5])], "chunk_id long, embedding array<float>")
    more = {}
    for r in retrieval.knn(q.union(odd), c.union(odd), 3, keep="other").collect():
        more.setdefault(r.query_id, []).append(r.chunk_id)
    assert sum(len(more[i]) for i in range(20)) == 60 and more[104] == [105] and more[105] == [104] and not {100, 101, 102, 103} & set(more)


def test_knn_ties():
    s = np.array([[0.5, 0.5, 0.9, 0.5], [0.1, 0.2, 0.3, 0.4]])
    ids = np.array([9, 3, 7, 5])
    assert sorted(ids[retrieval._best(s, ids, 2)[0]]) == [3, 7] and sorted(ids[retrieval._best(s, ids, 2)[1]]) == [5, 7]


def test_search_modes(spark):
    p = spark.createDataFrame([(1, "archive", "a", "article", [1.0, 0.0], "red fox"), (2, "archive", "b", "paper", [0.9, 0.1], "red hen"), (3, "content", "a", "article", [0.0, 1.0], "blue fox")], "chunk_id long, collection string, source_id string, kind string, embedding array<double>, text string").selectExpr("*", "chunk_id AS item_id", "DATE '2024-01-01' AS published_day", "CAST(NULL AS DATE) AS read_day")
    folder = new_folder(spark, "test-index")
    retrieval.write_index(p, "chunk_id", F.col("text"), folder)
    index = retrieval.open_index(spark, folder)
    ids = lambda **k: [r.chunk_id for r in retrieval.search(p, index, "the red fox", **k).orderBy("rank").collect()]
    assert ids(mode="fts")[0] == 1 and set(ids(mode="fts")) == {1, 2, 3} and ids(mode="vector", vector=[1.0, 0.0]) == [1, 2, 3]
    assert ids(mode="fts", f=retrieval.SearchFilter(collections=("content",))) == [3] and ids(vector=[1.0, 0.0], f=retrieval.SearchFilter(exclude=(1,), sources=("a",))) == [3]
    assert ids(mode="vector", vector=[1.0, 0.0], f=retrieval.SearchFilter(read_since=datetime(2024, 1, 1).date())) == [] and ids(mode="vector", vector=p.where("chunk_id = 9")) == []
    for bad in ({"mode": "hybrid"}, {"mode": "vector", "vector": [1.0], "problem": "mixed models"}):
        with pytest.raises(retrieval.VectorsUnavailable):
            ids(**bad)
    with pytest.raises(ValueError):
        ids(mode="other")
    with pytest.raises(ValueError):
        retrieval.enough_pairs(p)


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(50, 51)], "a long, b long")
    n = spark.createDataFrame([(i,) for i in [*range(41), 50, 51, 60]], "node long")
    assert {r.node: r.comp for r in clusters.components(n, e).collect()} == {**{i: 0 for i in range(41)}, 50: 50, 51: 50, 60: 60}


def test_cluster_keeps_old(spark):
    items = spark.createDataFrame([(i,) for i in range(6)], "id long")
    old = spark.createDataFrame([(3, 3), (4, 3)], "id long, cluster_id long")
    edges = spark.createDataFrame([(1, 4)], "a long, b long")
    got = {r.id: r.cluster_id for r in clusters.cluster(items, edges, old).collect()}
    assert got == {0: None, 1: 3, 2: None, 3: 3, 4: 3, 5: None}


def test_number_rows(spark):
    d = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"))
    assert [(r.v, r.position) for r in order.number_rows(d, F.desc("v")).orderBy("position").collect()] == [(999 - i, i + 1) for i in range(1000)]


def test_upsert(spark):
    t = spark.createDataFrame([(1, "old", "sum", None, datetime(2024, 1, 1), datetime(2024, 1, 30), 1)], "key long, title string, summary string, published_at timestamp_ntz, first_seen timestamp_ntz, last_seen timestamp_ntz, times_seen long")
    b = spark.createDataFrame([(1, "new", "", datetime(2023, 1, 1)), (2, "two", "s", None)], "key long, title string, summary string, published_at timestamp_ntz")
    now = F.lit("2024-01-31 10:00:00").cast("timestamp_ntz")
    got = {r.key: r for r in state.upsert_items(t, b, now).collect()}
    assert (got[1].title, got[1].summary, got[1].times_seen, got[1].is_old, got[2].times_seen) == ("new", "sum", 2, True, 1)
    again = {r.key: r for r in state.upsert_items(state.upsert_items(t, b, now), b, now).collect()}
    assert again[1].times_seen == 2


def test_failures(spark):
    log = spark.createDataFrame([("a", 1, True), ("a", 2, False), ("a", 3, False), ("b", 1, False), ("c", 1, False), ("c", 2, True)], "k string, t int, ok boolean")
    got = {r.k: (r.failures, r.last_ok) for r in state.failures(log.withColumn("i", F.col("t")), "k", F.col("ok"), "t", "i").collect()}
    assert got == {"a": (2, 1), "b": (1, None), "c": (0, 2)}


def test_filters(spark):
    d = spark.createDataFrame([(1, "src1", "paper", "Ünder test", datetime(2024, 1, 2), False, False, False, False, ["x"], ["promo"]), (2, "src2", "article", "other", datetime(2024, 1, 1), False, False, False, True, [], [])],
        "id long, source_id string, kind string, title string, first_seen timestamp_ntz, liked boolean, saved boolean, hidden boolean, opened boolean, tags array<string>, flags array<string>")
    ids = lambda **k: [r.id for r in d.where(lists.conditions(lists.ItemFilter(**k))).orderBy("id").collect()]
    assert ids(show="unread") == [] and ids(show="unread", expanded=True) == [1] and ids(show="all") == [2] and ids(show="unread", pinned=2) == [2]
    assert ids(show="all", expanded=True, words=("und", "te")) == [1] and ids(show="new", expanded=True, visit=datetime(2024, 1, 2)) == []


def test_chunks(spark):
    md = "# A\n\n" + "Some sentence here. " * 300 + "\n\n## B\n\n```\n" + "code\n" * 900 + "```\n\n| a |\n| b |\n"
    got = chunks.chunk(md)
    assert all(md[a:b] == t for _, t, a, b in got) and {s for s, *_ in got} == {"A", "A > B"}
    assert all(b - a <= chunks.LIMIT for _, t, a, b in got if not t.startswith("```")) and any(len(t) > 4000 for _, t, *_ in got)
    assert any(x[2] < y[3] and y[2] < x[3] for x, y in zip(got, got[1:], strict=False))
    assert chunks.chunk("") == [] and chunks.chunk("# only\n") == []


def test_hash_vector(spark):
    v = spark.createDataFrame([("a b", 8), ("", 8)], "t string, d int").select(chunks.hash_vector("t", "d").alias("v")).collect()
    assert sum(x * x for x in v[0].v) == pytest.approx(1, abs=1e-6) and v[1].v == [0.0] * 8


def test_citations():
    assert guard.checked("x [1] y [2, 9] z", 2) == ("x [1] y [2] z", [1, 2], ["9"])
    assert guard.checked("a [[7]9] b", 9) == ("a b", [], ["[[7]9]"])
    assert guard.checked("see [note] [2-9] 【 1 】​.", 3) == ("see [note] [1].", [1], ["[2-9]"])
    assert guard.checked(None, 3) == ("", [], [])
    for text, count, want in (
        ("[1[x9]2] [[a] 7] [b [1] c]", 12, ("[12] [[a] 7] [b [1] c]", [12, 1], ["[x9]"])),
        ("[[a9] 5x] [7]", 3, ("", [], ["[a9]", "7", "[ 5x]"])),
        ("open [1 and ] 2] [3", 3, ("open 2] [3", [], ["[1 and ]"])),
        ("[2, 2,1] \ue000 [0001] .", 2, ("[2, 1] \ue000 [1].", [2, 1], [])),
        ("[١] [12345]", 2, ("", [], ["[١]", "[12345]"])),
    ):
        assert guard.checked(text, count) == want
    many = "[1]" * 9000
    assert guard.checked(many, 1) == (many, [1], [])


def test_chunk_sections():
    """Sections of one name stay apart; passages overlap after prose alone, and long sentences are cut at blanks."""
    assert [(s, t) for s, t, *_ in chunks.chunk("# A\none\n# A\ntwo")] == [("A", "one"), ("A", "two")]
    long = "word " * 1000
    got = chunks.chunk(long)
    assert [(a, b) for _, _, a, b in got] == [(0, 1999), (1760, 3994), (3755, 4999)]
    code = "```\n" + "x\n" * 1500 + "```\n"
    got = chunks.chunk("intro here.\n\n" + code + "\nafter.")
    assert [t[:5] for _, t, *_ in got] == ["intro", "intro", "after"] and got[1][1].endswith("```")


def test_summary(spark):
    d = spark.createDataFrame([(["• a", "b", "c ", "d"], ["x", "y", "z"]), (["a"], ["x"])], "t array<string>, k array<string>")
    got = [r[0] for r in d.select(guard.accept_summary(F.col("t"), F.col("k"))).collect()]
    assert got[0].ok and got[0].tldr == ["a", "b", "c"] and not got[1].ok


def test_matched(spark):
    d = spark.createDataFrame([(1, "Agents act", "retrieval-augmented")], "id long, title string, summary string")
    assert ranking.matched_terms(d, ["agents", "agent", "retrieval", "zzz", "act"]).first().matched == ["agents", "retrieval", "act"]


def test_streams(spark, tmp_path):
    rows = [(1, "like", 0.0, datetime(2024, 1, 1)), (1, "open", 0.4, datetime(2024, 1, 1, 1)), (1, "like", 0.0, datetime(2024, 1, 2)), (2, "save", 0.0, datetime(2024, 1, 2))]
    spark.createDataFrame(rows, "item_id long, action string, value double, at timestamp").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("item_id long, action string, value double, at timestamp").parquet(str(tmp_path / "in"))
    out = []
    incremental.run(incremental.item_states(stream), "states", str(tmp_path / "c1"), lambda d, i: out.extend(map(tuple, d.collect())), "update").awaitTermination(120)
    assert sorted(out) == [(1, False, False, False, 1, 0.4), (2, False, True, False, 0, 0.0)]
    kept = []
    incremental.run(incremental.fresh_items(stream, "item_id"), "fresh", str(tmp_path / "c2"), lambda d, i: kept.extend(r.item_id for r in d.collect())).awaitTermination(120)
    assert sorted(kept) == [1, 2]


def test_sessions(spark):
    d = spark.createDataFrame([(1, datetime(2024, 1, 1, 0, 0)), (1, datetime(2024, 1, 1, 0, 20)), (1, datetime(2024, 1, 1, 2, 0))], "u long, t timestamp")
    assert sorted(r.n for r in incremental.sessions(d, "u", "t").collect()) == [1, 2]


def test_index_problem(spark):
    d = spark.createDataFrame([("m", 1), ("m", 2)], "embed_model string, embed_dim int")
    assert chunks.index_problem(d) == "mixed models" and chunks.index_problem(d.where("embed_dim = 1")) is None and chunks.index_problem(d.where("false")) == "no vectors"


def test_latest(spark):
    d = spark.createDataFrame([(1, date(2024, 1, 1), 5), (1, date(2024, 1, 2), None)], "k long, d date, v int")
    assert [tuple(r) for r in lists.latest(d, "k", "d").collect()] == [(1, date(2024, 1, 2), None)]


def test_knn_sifted(spark, monkeypatch):
    """Many candidates, sifted in single precision: the result is that of all pairs, and a row is sent a fixed number of times."""
    x = np.random.default_rng(3).normal(size=(400, 8)).astype(np.float32)
    x[50:90] = x[7]
    c = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "chunk_id long, embedding array<float>")
    q = c.select(F.col("chunk_id").alias("query_id"), "embedding")
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    s = np.round(u @ u.T, 6)
    want = {(i, int(j), n) for i in range(400) for n, j in enumerate([j for j in np.lexsort((np.arange(400), -s[i])) if j != i][:3], 1)}
    monkeypatch.setattr(retrieval, "BLOCK_ROWS", 20)
    monkeypatch.setattr(retrieval, "LANES", 4)
    assert c.agg(retrieval._blocks(retrieval.SIDE_BLOCKS)).first()[0] == 10
    assert {(r.query_id, r.chunk_id, r["rank"]) for r in retrieval.knn(q, c, 3, keep="other").collect()} == want
    sifted = retrieval._compare(3, "other")(*(t.toArrow() for t in (q, c)))
    assert {tuple(r.values())[:2] for r in sifted.to_pylist()} == {p[:2] for p in want}


def test_words_of_many_queries(spark, monkeypatch):
    """Blocks of queries and passages: each query's best are those that it has by itself, its own item left out."""
    r = np.random.default_rng(4)
    p = spark.createDataFrame([(i, i - i % 2, " ".join(f"w{int(n)}" for n in r.zipf(1.4, 12) % 40)) for i in range(120)], "chunk_id long, item_id long, text string")
    folder = new_folder(spark, "test-many")
    retrieval.write_index(p, "chunk_id", F.col("text"), folder)
    index = retrieval.open_index(spark, folder)
    q = p.where("chunk_id % 20 = 0").selectExpr("chunk_id AS query_id", "text")
    for name, n in (("ASKED_ROWS", 7), ("TEXT_ROWS", 16)):
        monkeypatch.setattr(retrieval, name, n)
    got = {}
    for x in retrieval.keyword_best_of(index, q, F.col("text"), p, 5).collect():
        got.setdefault(x.query_id, {})[x["rank"]] = (x.chunk_id, round(x.score, 6))
    for x in q.collect():
        alone = [(h.key, round(h.score, 6)) for h in retrieval.keyword_scores(index, sorted(set(x.text.split()))).collect() if h.key - h.key % 2 != x.query_id]
        assert got[x.query_id] == dict(enumerate(sorted(alone, key=lambda h: (-h[1], h[0]))[:5], 1))


def test_neighbours_of_all_vectors(spark):
    v = spark.createDataFrame([(1, "content", [1.0, 0.0]), (2, "archive", [1.0, 0.1]), (3, "content", [1.0, 0.2])], "chunk_id long, collection string, embedding array<double>").selectExpr("*", "DATE '2024-01-01' AS published_day")
    edges = clusters.neighbour_edges(v, 0.4)
    assert {(r.a, r.b) for r in edges.collect()} == {(a, b) for a in (1, 2, 3) for b in (1, 2, 3) if a != b}
    assert {r.cluster_id for r in clusters.cluster(v.selectExpr("chunk_id AS id"), edges).collect()} == {1}


def test_index_in_more_shards(spark, monkeypatch):
    """What a task holds of the postings doesn't grow with the texts: there are more shards; what is stored is the same."""
    p = spark.createDataFrame([(i, f"red w{i % 7} w{i % 11} red") for i in range(60)], "id long, text string")
    found = []
    for chars in (retrieval.SHARD_CHARS, 8):
        monkeypatch.setattr(retrieval, "SHARD_CHARS", chars)
        folder = new_folder(spark, "test-shards")
        retrieval.write_index(p, "id", F.col("text"), folder)
        found.append(sorted((r.key, r.term, r.tf, r.length) for r in retrieval.open_index(spark, folder).postings.collect()))
    assert found[0] == found[1] and retrieval.shards_of(60 * 16) == 4 and retrieval.shards_of(10**5) > 100
    rows = p.selectExpr("id AS key", "cast(id % 32 AS int) AS bucket")
    assert retrieval.deal(rows, 9).rdd.getNumPartitions() == 9 * retrieval.BUCKETS


def test_chunks_by_slices(spark):
    """Passages leave a worker slice by slice, not with all of a batch's."""
    d = spark.createDataFrame([(i, None if i == 5 else f"# T{i}\n\n" + "Some words here. " * (i % 300)) for i in range(300)], "id long, t string")
    sizes = [b.num_rows for b in chunks._passages(d.toArrow().to_batches())]
    got = [(r.id, r.n, r.section, r.text, r.char_start, r.char_end) for r in chunks.chunk_documents(d, "id", "t").orderBy("id", "n").collect()]
    assert len(sizes) >= 3 and sum(sizes) == len(got) and got == [(r.id, n, *c) for r in d.collect() for n, c in enumerate(chunks.chunk(r.t or ""))]


def test_index_makes_tokens_once(spark, monkeypatch):
    """The postings of texts with and without tokens; before the tokens are dealt, no filter makes them once more."""
    plans = []
    deal = retrieval.deal
    monkeypatch.setattr(retrieval, "deal", lambda rows, shards: plans.append(rows._jdf.queryExecution().optimizedPlan().toString()) or deal(rows, shards))
    folder = new_folder(spark, "once")
    retrieval.write_index(spark.createDataFrame([(1, "a b a"), (2, ""), (3, None)], "id long, text string"), "id", F.col("text"), folder)
    assert sorted((r.term, r.key, r.tf, r.length) for r in retrieval.open_index(spark, folder).postings.collect()) == [("a", 1, 2, 3), ("b", 1, 1, 3)]
    assert plans[0].count("regexp_extract_all") == 1


def test_components_of_a_path(spark, monkeypatch):
    """Rounds grow with the logarithm of a path, whatever its nodes are called, and nothing is broadcast."""
    n, made = 600, []
    ids = [int(x) for x in np.random.default_rng(3).permutation(n)]
    keep = clusters.checkpoint
    monkeypatch.setattr(clusters, "checkpoint", lambda df: made.append(df._jdf.queryExecution().executedPlan().toString()) or keep(df))
    nodes, edges = spark.createDataFrame([(i,) for i in ids], "node long"), spark.createDataFrame(list(zip(ids, ids[1:], strict=False)), "a long, b long")
    assert {r.comp for r in clusters.components(nodes, edges).collect()} == {0}
    assert len(made) <= 2 + 2 * 12 and not any("BroadcastHashJoin" in p for p in made)


def test_components_leave_single_nodes_out(spark, monkeypatch):
    """Rounds move the nodes that have edges only; a node that comes twice, or is null, is one row or none."""
    from siftspark.operators import clusters

    rows, keep = [], clusters.checkpoint
    monkeypatch.setattr(clusters, "checkpoint", lambda df: rows.append((df.columns, (out := keep(df)).count())) or out)
    nodes = spark.range(200).selectExpr("id AS node").union(spark.sql("SELECT 150L UNION ALL SELECT NULL"))
    edges = spark.createDataFrame([(3, 1), (3, 7), (9, 8), (8, 8), (5, 900)], "a long, b long")
    got = sorted(tuple(r) for r in clusters.components(nodes, edges).collect())
    assert got == [(i, {3: 1, 7: 1, 9: 8}.get(i, i)) for i in range(200)]
    assert all(n <= 6 for columns, n in rows if "far" in columns or "next" in columns) and any("next" in columns for columns, _ in rows)
