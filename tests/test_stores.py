"""What is stored and follows its data: versions, the keyword index, clusters, vector cells, cascades."""

import json
import os
import random
import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftspark.operators import cells, chunks, clusters, ingest, manifest, retrieval, segments, state, steps
from siftspark.sources import versioned


def test_manifest(spark, tmp_path):
    folder = str(tmp_path)
    assert manifest.read(spark, folder) == (0, {})
    manifest.commit(spark, folder, 1, {"a": 1})
    with pytest.raises(manifest.Conflict):
        manifest.commit(spark, folder, 1, {"a": 2})
    (tmp_path / "versions" / "2.json").write_text('{"a": ')  # a writer died within its file
    assert manifest.read(spark, folder) == (1, {"a": 1})
    assert manifest.repair(spark, folder) == [2]
    manifest.commit(spark, folder, 2, {"a": 3})
    assert manifest.read(spark, folder) == (2, {"a": 3}) and manifest.read(spark, folder, 1)[1] == {"a": 1}


# The keyword index


def scores(index, terms):
    return sorted((r.key, round(r.score, 9)) for r in retrieval.keyword_scores(index, terms).collect())


def built_anew(spark, docs, folder):
    retrieval.write_index(spark.createDataFrame(sorted(docs.items()), "id long, text string"), "id", F.col("text"), folder)
    return retrieval.open_index(spark, folder)


def test_segments_equal_a_new_index(spark, tmp_path):
    """Random batches of new, changed and deleted documents; after each the scores are those of an index built anew."""
    r = random.Random(3)
    words = [f"w{i}" for i in range(12)]
    folder, docs = str(tmp_path / "index"), {}
    for batch in range(5):
        ids = r.sample(range(30), 9)
        new = {i: None if r.random() < 0.1 else " ".join(r.choice(words) for _ in range(r.randint(0, 9))) for i in ids[:6]}
        gone = ids[4:]  # two of them are in the batch too, and stay
        segments.apply(spark, folder, spark.createDataFrame(sorted(new.items()), "id long, text string"), deleted=spark.createDataFrame([(i,) for i in gone], "key long"))
        docs = {i: t for i, t in docs.items() if i not in gone} | new
        index = segments.open_index(spark, folder)
        if batch not in (1, 4):
            continue
        assert scores(index, words) == scores(built_anew(spark, docs, str(tmp_path / f"anew{batch}")), words)
        assert index.corpus.first()["total"] == len(docs)
    before = scores(segments.open_index(spark, folder), words)
    assert len(manifest.read(spark, folder)[1]["segments"]) < 5  # some were merged
    assert segments.vacuum(spark, folder) > 0 and scores(segments.open_index(spark, folder), words) == before


def test_segments_read_only_what_changes(spark, tmp_path):
    """A batch needs neither the postings of earlier segments nor the lengths in other buckets than its keys'."""
    folder = str(tmp_path)
    frame = lambda rows: spark.createDataFrame(rows, "id long, text string")
    segments.apply(spark, folder, frame([(i, f"a b{i}") for i in range(50)]))
    name = manifest.read(spark, folder)[1]["segments"][0]["name"]
    part = spark.range(7, 8).select(segments._key_bucket("id")).first()[0]
    shutil.rmtree(f"{folder}/segments/{name}/postings")
    for p in os.listdir(f"{folder}/segments/{name}/docs"):
        if p.startswith("part=") and p != f"part={part}":
            shutil.rmtree(f"{folder}/segments/{name}/docs/{p}")
    segments.apply(spark, folder, frame([(7, "c")]), merge=False)
    s = manifest.read(spark, folder)[1]["segments"]
    assert (s[0]["dead_docs"], s[0]["dead_tokens"], s[1]["docs"]) == (1, 2, 1)


def test_segments_one_writer(spark, tmp_path, monkeypatch):
    folder = str(tmp_path)
    frame = lambda rows: spark.createDataFrame(rows, "id long, text string")
    segments.apply(spark, folder, frame([(1, "a")]))
    whole = manifest.read(spark, folder)
    monkeypatch.setattr(manifest, "read", lambda *a: whole)  # both writers have read version 1
    segments.apply(spark, folder, frame([(2, "a")]))
    with pytest.raises(manifest.Conflict):
        segments.apply(spark, folder, frame([(3, "a")]))
    monkeypatch.undo()
    assert [k for k, _ in scores(segments.open_index(spark, folder), ["a"])] == [1, 2]


def test_segments_empty(spark, tmp_path):
    folder = str(tmp_path)
    assert scores(segments.open_index(spark, folder), ["a"]) == []
    segments.apply(spark, folder, spark.createDataFrame([(1, "a")], "id long, text string"))
    segments.apply(spark, folder, deleted=spark.createDataFrame([(1,), (9,)], "key long"))
    assert scores(segments.open_index(spark, folder), ["a"]) == [] and manifest.read(spark, folder)[1]["segments"] == []


# Neighbours within days


def test_band_blocks(spark, monkeypatch):
    """Block pairs grow with the days; the result is that of all pairs."""
    monkeypatch.setattr(retrieval, "BLOCK_ROWS", 8)
    r = np.random.default_rng(5)
    rows = [(i, [float(x) for x in r.normal(size=6)], None if i % 17 == 0 else int(r.integers(0, 120))) for i in range(160)]
    v = spark.createDataFrame(rows, "chunk_id long, embedding array<double>, n int").selectExpr("chunk_id", "embedding", "date_add(date'1969-11-20', n) AS day")
    q = v.select(F.col("chunk_id").alias("query_id"), "embedding", F.col("day").alias("qday"))
    got = {(x.query_id, x.chunk_id, x["rank"]) for x in retrieval.knn(q, v, 3, keep="band").collect()}
    want = set()
    for i, e, d in rows:
        near = sorted((-round(float(np.dot(e, f) / np.linalg.norm(e) / np.linalg.norm(f)), 6), j) for j, f, g in rows if j != i and None not in (d, g) and abs(d - g) <= 14)
        want |= {(i, j, n) for n, (_, j) in enumerate(near[:3], 1)}
    assert got == want
    left, _, unit = retrieval._band_blocks(q, v)
    pairs = left.select(*unit).distinct().collect()
    assert all(abs(p.r - p.s) <= 1 for p in pairs) and len(pairs) < len({p.r for p in pairs}) * 3 * 9


# Clusters


def test_updated_clusters_equal_a_full_run(spark, tmp_path):
    r = random.Random(1)
    folder, known, every = str(tmp_path), spark.createDataFrame([], "id long, cluster_id long"), []
    clusters.write_membership(known, folder)
    for batch in range(3):
        ids = list(range(batch * 25, batch * 25 + 25))
        edges = [(i, r.randrange(0, batch * 25 + 25)) for i in ids if r.random() < 0.55]
        e = spark.createDataFrame(edges, "a long, b long")
        every += ids
        full = clusters.cluster(spark.createDataFrame([(i,) for i in every], "id long"), e.where("a <> b"), known)
        want = sorted(map(tuple, full.collect()), key=str)
        changes = clusters.update(clusters.open_membership(spark, folder), spark.createDataFrame([(i,) for i in ids], "id long"), e)
        before = dict(map(tuple, known.collect()))
        assert all(i not in before or before[i] != c for i, c in map(tuple, changes.collect()))  # nothing but changes
        clusters.store_update(spark, folder, changes)
        after = clusters.open_membership(spark, folder)
        assert sorted(((x.id, x.cluster_id) for x in after.by_id.collect()), key=str) == want
        assert sorted((x.id, x.cluster_id) for x in after.by_cluster.collect()) == sorted(w for w in want if w[1] is not None)
        known = spark.createDataFrame(want, "id long, cluster_id long")


def test_untouched_clusters_are_not_read(spark, tmp_path):
    folder = str(tmp_path)
    clusters.write_membership(spark.createDataFrame([(i, i - i % 2) for i in range(40)], "id long, cluster_id long"), folder)
    part = lambda i: spark.range(i, i + 1).select(clusters._part("id")).first()[0]
    ids, names = {part(i) for i in (3, 6, 100)}, {part(2), part(6)}
    for t, kept in (("by_id", ids), ("by_cluster", names)):
        for p in os.listdir(f"{folder}/{t}"):
            if p.startswith("part=") and int(p[5:]) not in kept:
                for f in os.listdir(f"{folder}/{t}/{p}"):
                    os.remove(f"{folder}/{t}/{p}/{f}")
                (tmp_path / t / p / "broken.parquet").write_text("unreadable")
    changes = clusters.update(clusters.open_membership(spark, folder), spark.createDataFrame([(100,)], "id long"), spark.createDataFrame([(100, 3), (100, 6)], "a long, b long"))
    assert sorted(map(tuple, changes.collect())) == [(6, 2), (7, 2), (100, 2)]


# The archive


def test_ingest(spark, tmp_path):
    """New, changed and removed items, a run without anything to do, one without an embedder and one with another model."""
    folder = str(tmp_path)
    none = "cast(NULL AS timestamp_ntz)"
    sources = spark.createDataFrame([("s", "Source", "publisher")], "id string, name string, trust string")
    triage = spark.createDataFrame([(1, ["a", "b"])], "item_id long, tags array<string>")
    embed = lambda text: chunks.hash_vector(text, F.lit(16))

    def items(*rows):
        return spark.createDataFrame([(i, t, "same words in all of them", "paper" if i % 2 else "article", k) for i, t, k in rows], "id long, title string, summary string, kind string, paper_key long").withColumns({"source_id": F.lit("s"), "first_seen": F.lit("2024-01-05 10:00:00").cast("timestamp_ntz"), "published_at": F.expr(none)})

    run = lambda rows, **o: ingest.ingest_archive(spark, folder, rows, sources, triage, **({"embed": embed, "model": "m", "dim": 16, "threshold": 0.99} | o))
    first = run(items((1, "one", 7), (2, "two", 7), (3, "three", None)), embed=None)
    assert first == ingest.Ingested(3, 0, 0, 2, "no embedder")
    second = run(items((1, "one", 7), (2, "two", 7), (3, "three", None)))
    assert (second.archived, second.embedded, second.removed) == (3, 3, 0)  # the same texts, now with vectors
    assert run(items((1, "one", 7), (2, "two", 7), (3, "three", None))) == ingest.Ingested(0, 0, 0, 0)
    third = run(items((1, "one", 7), (3, "else", None), (4, "else", None), (5, "five", None)))
    assert (third.archived, third.removed) == (3, 1)
    got = {r.item_id: r for r in ingest.passages(spark, folder).collect()}
    assert set(got) == {1, 3, 4, 5} and got[1].batch == 2 and got[3].batch == 3 and "Tags: a, b" in got[1].text and got[4].header == "Source · else"
    assert scores(segments.open_index(spark, f"{folder}/index"), ["else"])[0][0] == 3 and scores(segments.open_index(spark, f"{folder}/index"), ["two"]) == []
    of = {r.id: r.cluster_id for r in clusters.open_membership(spark, f"{folder}/clusters").by_id.collect()}
    assert of[1] == of[2] == 1 and of[3] == of[4] == 3 and of[5] is None
    other = run(items((1, "one", 7), (6, "six", None)), model="n")
    assert other.archived == 1 and other.embedded == 0 and "another model" in other.problem and other.removed == 3


# Vector cells


@pytest.fixture(scope="module")
def vectors(spark):
    r = np.random.default_rng(4)
    middle = r.normal(size=(12, 16))
    rows = [(i, [float(x) for x in middle[i % 12] + 0.5 * r.normal(size=16)], i % 3) for i in range(900)]
    rows += [(1000 + i, rows[5][1], 1) for i in range(40)] + [(2000, [0.0] * 16, 1), (2001, None, 1), (2002, [1.0, 2.0], 1), (2003, [float("nan")] * 16, 1)]
    return spark.createDataFrame(rows, "chunk_id long, embedding array<double>, kind int")


def nearest_by_hand(rows, q, k, keep=lambda r: True):
    same = lambda e: e is not None and len(e) == len(q) and np.isfinite(e).all() and np.any(e)
    s = [(-round(float(np.dot(r.embedding, q) / np.linalg.norm(r.embedding) / np.linalg.norm(q)), 6), r.chunk_id) for r in rows if same(r.embedding) and keep(r)]
    return [i for _, i in sorted(s)[:k]]


def test_cells(spark, vectors, tmp_path):
    folder = str(tmp_path)
    cells.write_cells(vectors, folder)
    index, rows = cells.open_cells(spark, folder), vectors.collect()
    for at in (0, 5, 777):
        q = rows[at].embedding
        for k, f, keep in ((10, None, lambda r: True), (7, F.col("kind") == 2, lambda r: r.kind == 2), (5, F.lit(False), lambda r: False)):
            got = cells.search(index, q, f, k, exact=True).orderBy("rank").collect()
            assert [r.chunk_id for r in got] == nearest_by_hand(rows, q, k, keep)
    assert cells.search(index, [0.0] * 16).count() == 0 and cells.search(index, [1.0, 2.0], k=3, exact=True).count() == 1 and cells.search(index, [1.0] * 5).count() == 0
    seen = cells.tune(spark, folder, vectors.where("chunk_id % 20 = 0").select(F.col("chunk_id").alias("query_id"), "embedding"))
    assert seen[-1][1] >= 0.95 and seen[-1][2] < 0.7 and cells.open_cells(spark, folder).effort == seen[-1][0]


def test_cells_left_unread(spark, vectors, tmp_path):
    """The exact mode doesn't read cells that are too far; a filter is met within the cells, however few pass."""
    folder = str(tmp_path)
    cells.write_cells(vectors.where("chunk_id % 12 < 2 AND chunk_id < 900"), folder, cells=2)
    rows = vectors.where("chunk_id % 12 < 2 AND chunk_id < 900").collect()
    index = cells.open_cells(spark, folder)
    q = rows[0].embedding
    order = cells._order(index, np.array(q) / np.linalg.norm(q))
    assert order[1][2] < 0.9
    shutil.rmtree(f"{folder}/rows/dims=16/cell={order[1][0]}")
    got = cells.search(cells.open_cells(spark, folder), q, k=3, effort=0.01, exact=True).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == nearest_by_hand(rows, q, 3)


# Cascades


def test_cascade(spark):
    """Seven levels, two ways down to one table, null keys, and a table that nothing reaches."""
    names = [f"t{i}" for i in range(7)]
    tables = {n: spark.createDataFrame([(i * 10 + j, None if j == 3 else (i - 1) * 10 + j) for j in range(4)], "id long, parent long") for i, n in enumerate(names)}
    tables["log"] = spark.createDataFrame([(1, 0)], "id long, parent long")
    tables["both"] = spark.createDataFrame([(1, 1, 50), (2, 2, 51), (3, 2, 52), (4, None, None)], "id long, a long, b long")
    refs = [state.Reference(names[i], "parent", names[i - 1], "id") for i in range(1, 7)] + [state.Reference("both", "a", "t0", "id"), state.Reference("both", "b", "t5", "id")]
    left = state.cascade(tables, refs, {"t0": ("id", spark.createDataFrame([(0,), (1,), (3,)], "id long"))})
    assert [sorted(r.id for r in left[n].collect()) for n in names] == [[2]] + [[i * 10 + 2, i * 10 + 3] for i in range(1, 7)]
    assert left["log"].count() == 1 and sorted(r.id for r in left["both"].collect()) == [3, 4]
    with pytest.raises(ValueError, match="ring"):
        state.cascade(tables, [*refs, state.Reference("t0", "id", "t6", "id")], {})


# Versions of a table


def test_versions(spark, tmp_path):
    versioned.register(spark)
    folder = str(tmp_path / "t")
    load = lambda **o: spark.read.format("versioned").options(**o).load(folder)
    save = lambda df, mode: df.write.format("versioned").mode(mode).save(folder)
    rows = spark.range(100).selectExpr("id", "concat('x', id) AS name", "array(id) AS a").repartition(3)
    save(rows, "append")
    save(spark.range(100, 110).selectExpr("id", "'y' AS name", "array(id) AS a"), "append")
    save(spark.range(5).selectExpr("id", "'z' AS name", "array(id) AS a"), "overwrite")
    assert [load(version=n).count() for n in (1, 2, 3)] == [100, 110, 5] and load().count() == 5
    assert sorted(load(version=1).select("name", "a").collect()) == sorted((f"x{i}", [i]) for i in range(100))
    assert versioned.vacuum(folder, keep=1) > 0 and load().count() == 5


def test_a_failing_task_leaves_the_old_version(spark, tmp_path):
    versioned.register(spark)
    folder = str(tmp_path / "t")
    spark.range(10).write.format("versioned").mode("append").save(folder)
    bad = spark.range(40).repartition(4).selectExpr("CASE WHEN id = 33 THEN raise_error('no') ELSE id END AS id")
    with pytest.raises(Exception, match="no"):
        bad.write.format("versioned").mode("overwrite").save(folder)
    assert spark.read.format("versioned").load(folder).count() == 10 and versioned._numbers(folder) == [1]


def test_two_writers(spark, tmp_path):
    folder = str(tmp_path / "t")
    schema = spark.range(1).schema
    one, two = versioned._Writer(folder, schema, False), versioned._Writer(folder, schema, False)
    batch = spark.range(3).toArrow().to_batches()
    a, b = one.write(iter(batch)), two.write(iter(batch))
    one.commit([a, None])
    with pytest.raises(versioned.Conflict):
        two.commit([b])
    two.abort([b])
    assert os.listdir(f"{folder}/data") == [a.name] and versioned._numbers(folder) == [1]


def test_files_left_out(spark, tmp_path):
    versioned.register(spark)
    folder = str(tmp_path / "t")
    for i in range(4):
        spark.range(i * 10, i * 10 + 10).selectExpr("id", "concat('k', id div 10) AS k").coalesce(1).write.format("versioned").mode("append").save(folder)
    load = spark.read.format("versioned").load(folder)
    parts = lambda df: df.rdd.getNumPartitions()
    assert parts(load) == 4 and parts(load.where("id >= 25")) == 2 and parts(load.where("k = 'k1'")) == 1 and parts(load.where("id IN (3, 33)")) == 2
    assert sorted(r.id for r in load.where("id >= 35").collect()) == [35, 36, 37, 38, 39] and load.where("id > 5 AND k = 'k0'").count() == 4
    state_file = json.load(open(f"{folder}/versions/4.json"))
    assert [f["rows"] for f in state_file["files"]] == [10] * 4


# Smaller tables


def test_contents_asks_and_runs(spark):
    when = F.lit("2024-01-02 00:00:00").cast("timestamp_ntz")
    kept = spark.createDataFrame([(1, "ok", "old", "html", 1, None, 1), (2, "ok", "two", "html", 1, None, 1), (9, "ok", "nine", "html", 1, None, 1)], "item_id long, status string, body string, extractor string, words long, error string, extractor_version int").withColumn("fetched_at", when)
    tried = spark.createDataFrame([(1, 1, 200, "new text", "html", None), (1, 2, 403, None, None, None), (2, 1, 200, "a b c", "pdf", None), (3, 1, 500, None, None, None), (4, 1, None, None, None, "timed out"), (5, 1, 404, "error page", "html", None)], "item_id long, at int, http int, body string, extractor string, error string")
    got = {r.item_id: (r.status, r.body, r.words, r.error) for r in steps.store_contents(kept, tried, when, 2).collect()}
    assert got == {1: ("paywalled", None, None, "HTTP 403"), 2: ("ok", "a b c", 3, None), 3: ("failed", None, None, "HTTP 500"), 4: ("failed", None, None, "timed out"), 5: ("failed", None, None, "HTTP 404"), 9: ("ok", "nine", 1, None)}
    due = steps.extraction_due(spark.createDataFrame([(i,) for i in (1, 2, 9, 10)], "id long"), steps.store_contents(kept, tried, when, 2), F.lit("2024-01-02 02:00:00").cast("timestamp_ntz"), 2)
    assert {r.id: r.reason for r in due.collect()} == {1: "retry", 9: "old", 10: "new"}
    asks = spark.createDataFrame([(4, "q")], "id long, question string").withColumn("created_at", when)
    new = spark.createDataFrame([(0, "first"), (1, "second")], "pos int, question string").withColumn("created_at", when)
    saved = steps.save_ask(asks, new)
    assert [(r.id, r.question) for r in steps.recent_asks(saved, 2).collect()] == [(6, "second"), (5, "first")]
    runs = spark.createDataFrame([(1, "scout", "ok", 1), (2, "scout", "failed", 3), (3, "scout", "partial", 2), (4, "ask", "ok", 3), (5, "scout", "ok", 30)], "id long, kind string, status string, hour int").withColumn("started_at", when + F.make_dt_interval(F.lit(0), F.col("hour")))
    assert [r.id for r in steps.last_run_of_day(runs, "scout", when, when + F.expr("INTERVAL 1 DAY")).collect()] == [3]


def test_segments_write_postings_once(spark, tmp_path, monkeypatch):
    """Postings go straight to their buckets; a document without tokens leaves none, and counts."""
    folder, removed = str(tmp_path / "index"), []
    remove = segments.manifest.remove
    monkeypatch.setattr(segments.manifest, "remove", lambda spark, path: removed.append(path) or remove(spark, path))
    segments.apply(spark, folder, spark.createDataFrame([(1, "a b a"), (2, ""), (3, None)], "id long, text string"))
    index = segments.open_index(spark, folder)
    assert [p.rsplit("/", 1)[1] for p in removed] == ["bucket=-1"]
    assert sorted((r.term, r.key, r.tf) for r in index.postings.collect()) == [("a", 1, 2), ("b", 1, 1)] and index.corpus.first().total == 3


def test_segments_deal_postings(spark, tmp_path, monkeypatch):
    """Tokens are counted where their text is, in pieces whose number follows the texts; only postings are dealt."""
    docs, dealt, deal = spark.createDataFrame([(i, "a b " * 50) for i in range(20)], "id long, text string"), [], retrieval.deal
    monkeypatch.setattr(segments, "deal", lambda rows, shards: dealt.append(rows.count()) or deal(rows, shards))
    segments.apply(spark, str(tmp_path / "index"), docs.union(docs))
    assert dealt == [40]
    assert {(r.tf, r.length) for r in segments.open_index(spark, str(tmp_path / "index")).postings.collect()} == {(50, 100)}
    monkeypatch.setattr(retrieval, "PIECE_CHARS", 400)
    texts, chars = retrieval.pieces(docs, "id", F.col("text"))
    assert chars == 4000 and texts.rdd.getNumPartitions() == 10
    plan = retrieval.count_tokens(texts.dropDuplicates(["key"]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1  # that of the pieces


def test_ingest_shuffles_texts_by_id(spark, monkeypatch):
    """Texts are shuffled once, by their item; edges below the threshold stay where they are compared."""
    rows = spark.createDataFrame([(i, "s", "a", f"t{i}", "x", None) for i in range(4)], "id long, source_id string, kind string, title string, summary string, paper_key long").withColumns({"published_at": F.lit(None).cast("timestamp"), "first_seen": F.lit("2024-01-02").cast("timestamp")})
    sources, triage = spark.createDataFrame([("s", "S", "publisher")], "id string, name string, trust string"), spark.createDataFrame([(1, ["t"])], "item_id long, tags array<string>")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        texts = ingest.archive_texts(rows, sources, triage)
        plan = texts._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(source_id" not in plan and "hashpartitioning(id" in plan and texts.count() == 4
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    c = spark.createDataFrame([(i, [1.0, i / 4]) for i in range(9)], "chunk_id long, embedding array<double>")
    q = c.select(F.col("chunk_id").alias("query_id"), "embedding")
    few = retrieval._compare(5, "other", 0.99)(*(t.toArrow() for t in (q, c))).column("similarity").to_pylist()
    assert few and min(few) >= 0.99
    near = {tuple(r) for r in retrieval.knn(q, c, 5, keep="other").where("similarity >= 0.99").collect()}
    assert near == {tuple(r) for r in retrieval.knn(q, c, 5, keep="other", least=0.99).collect()}
    # However many rows a range of days has, each is sent to two blocks of a range near it.
    monkeypatch.setattr(retrieval, "BLOCK_ROWS", 1)
    day = F.lit("2024-01-15").cast("date")
    left, right, _ = retrieval._band_blocks(q.withColumn("qday", day), c.withColumn("day", day))
    assert left.count() == right.count() == 18


# Neighbours that are near enough


@pytest.mark.parametrize("keep,least", [("other", 0.9), ("true", 0.9), ("group", 0.9), ("other", 0.2), ("other", -0.5), ("band", 0.9)])
def test_near_rows(monkeypatch, keep, least):
    """With a least similarity the result is that of all pairs, over tiles, copies, one narrow cone and many near pairs; most pairs that lie far apart aren't compared."""
    import pyarrow as pa

    monkeypatch.setattr(retrieval, "TILE_ROWS", 16)
    monkeypatch.setattr(retrieval, "TILE_COLUMNS", 96)
    r = np.random.default_rng(8)
    middle = r.normal(size=(10, 8)) + 3 * np.sign(np.arange(10) - 4.5)[:, None]
    x = np.concatenate([middle[np.arange(500) % 10] + 0.3 * r.normal(size=(500, 8)), np.repeat(middle[:2], 60, 0), np.ones((80, 8)) + 1e-4 * r.normal(size=(80, 8))])
    ids = r.permutation(len(x))
    day, group = r.integers(0, 40, len(x)), ids // 3
    table = lambda key, a, b: pa.table({key: ids, "embedding": pa.array(list(x)), a: pa.array(day, pa.int32()).cast(pa.date32()), b: group})
    cells, matmul = [], np.matmul
    monkeypatch.setattr(retrieval.np, "matmul", lambda a, b, **o: cells.append(a.shape[0] * b.shape[1]) or matmul(a, b, **o))
    got = retrieval._compare(4, keep, least)(table("query_id", "qday", "qgroup"), table("chunk_id", "day", "group"))
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    s = (unit @ unit.T).round(6)
    out = {"true": np.zeros(s.shape, bool), "group": group[:, None] == group}.get(keep, ids[:, None] == ids) | (s < least)
    if keep == "band":
        out |= np.abs(day[:, None] - day) > retrieval.BAND_DAYS
    want = {(ids[i], ids[j]) for i in range(len(x)) for j in sorted(np.flatnonzero(~out[i]), key=lambda j: (-s[i, j], ids[j]))[:4]}
    assert set(zip(got.column("query_id").to_pylist(), got.column("chunk_id").to_pylist(), strict=True)) == want
    assert 0 < sum(cells) and (least < 0.9 or sum(cells) < 0.7 * len(x) ** 2)


def test_band_tasks(spark, monkeypatch):
    """Tasks are as many as the pairs ask for, one for each pair of blocks at most; before, small rows with many pairs came together in few."""
    monkeypatch.setattr(retrieval, "BLOCK_ROWS", 8)
    monkeypatch.setattr(retrieval, "TASK_PAIRS", 100)
    v = spark.range(120).selectExpr("id AS chunk_id", "array(1D, double(id)) AS embedding", "date_add(date'2024-01-01', int(id % 60)) AS day")
    left, right, unit = retrieval._band_blocks(v.selectExpr("chunk_id AS query_id", "embedding", "day AS qday"), v)
    units = left.select(*unit).distinct().count()
    assert left.rdd.getNumPartitions() == right.rdd.getNumPartitions() == units > 4


def test_hash_vector_hashes_a_word_once(monkeypatch):
    import hashlib

    import pandas as pd

    met, blake2b = [], hashlib.blake2b
    monkeypatch.setattr(hashlib, "blake2b", lambda w, **o: met.append(w) or blake2b(w, **o))
    got = chunks.hash_vector.func(pd.Series(["One two one", None, "two, one", "one"]), pd.Series([16, 16, 16, 8]))
    assert sorted(met) == [b"one", b"two"]

    def by_hand(words, d):
        v = [0.0] * d
        for w in words:
            h = blake2b(w.encode(), digest_size=8).digest()
            v[int.from_bytes(h[:4], "big") % d] += 1.0 if h[4] & 1 else -1.0
        norm = sum(x * x for x in v) ** 0.5
        return [x / norm for x in v] if norm else v

    assert [list(v) for v in got] == [by_hand(["one", "two", "one"], 16), by_hand([], 16), by_hand(["two", "one"], 16), by_hand(["one"], 8)]
