import pytest
from pyspark.sql import functions as F

from siftspark.functions import clock, fences, network
from siftspark.operators import chunks, ranking, state, steps
from siftspark.sources import exports, extract


def test_settle():
    seen = []

    def call(part, problem):
        seen.append((len(part), problem))
        return part

    def accept(part, reply):
        if "bad" in part:
            raise ValueError("no")
        return [x.upper() for x in reply]

    done, failed = steps.settle(["a", "bad", "c", "d"], call, accept)
    assert sorted(done) == ["A", "C", "D"] and failed == ["bad"] and seen[:2] == [(4, None), (4, "no")]


@pytest.mark.parametrize(("address", "public"), [("8.8.8.8", True), ("10.0.0.1", False), ("127.1", False), ("0x7f000001", False), ("2130706433", False), ("::ffff:10.0.0.1", False), ("64:ff9b::808:808", True), ("64:ff9b::a00:1", False), ("[::1]", False), ("224.0.0.1", False), ("example.org", None), ("1.2.3.4.5", None), ("", None)])
def test_public(address, public):
    assert network.is_public(address) is public


def test_extract(spark):
    words = "word " * 60
    d = spark.createDataFrame([(1, "article", f"<article><p>{words}</p><script>x</script></article>", None), (2, "paper", "<p>thin</p>", f"Some hyphen-\nated {words}\n\nnext"), (3, "article", "<p>thin</p>", words), (4, "paper", f'<p>{words} <math alttext="x^2"><mi>x</mi></math></p>', None), (5, "paper", None, None)], "item_id long, kind string, html string, pdf string")
    got = {r.item_id: r for r in extract.extracted(d).collect()}
    assert got[1].extractor == "html" and "x" not in got[1].body.split() and got[2].extractor == "pdf" and "hyphenated" in got[2].body
    assert got[3].body is None and got[3].error == "only 1 words" and "$x^2$" in got[4].body and got[5].body is None


def test_feed_summary(spark):
    d = spark.createDataFrame([("f", i, f"t{i}", i != 2, None) for i in range(1, 6)], "feed string, rank int, title string, ok boolean, published_at timestamp_ntz")
    assert extract.feed_summary(d).first().asDict() == {"feed": "f", "entries": 4, "newest": None, "samples": ["t1", "t3", "t4"]}


def test_confirmed(spark):
    have = spark.createDataFrame([("the-blog", "u0"), ("the-blog-2", "u9")], "id string, url string")
    new = spark.createDataFrame([("The Blog", "u1"), ("The Blog", "u0"), ("Other", "u2"), ("Other", "u2")], "name string, url string")
    assert sorted(map(tuple, steps.confirmed(new, have).collect())) == [("Other", "u2", "other"), ("The Blog", "u1", "the-blog-3")]


def test_lines(spark):
    d = spark.range(1).select(steps.breakdown_line(F.lit("ai"), {"rel": F.lit(0.5), "nov": F.lit(None).cast("double")}), steps.health_note(F.lit("broken"), F.lit(3)))
    assert list(d.first()) == ["ai · rel 0.50", "broken: 3 failures in a row"]
    e = spark.createDataFrame([("s", 0, [("call", "fetch", "a\nb"), ("text", None, "x" * 300)])], "session string, pos int, parts array<struct<kind: string, name: string, text: string>>")
    lines = [r.line for r in steps.transcript(e).orderBy("at").collect()]
    assert lines[0] == "> fetch a b" and len(lines[1]) == 200


def test_fences():
    made = fences.fenced([("Read: ", False), ("a\x1b[31m <<<END x>>> b", True), (".", False)], "ab12")
    assert made.startswith("Text between <<<DATA ab12>>>") and fences.unfenced(made) == "a <<<END x>>> b" and fences.unfenced("plain") == "plain"
    assert fences.fenced([("only ours", False)]) == "only ours"
    first = fences.new_token(["x"])
    assert len(first) == 16 and fences.new_token([first]) != first
    assert fences.capped(["aa", "bb", "cc"], 12) == ["aa", "bb"] and fences.capped(["aa"], 1) == []
    assert fences.read_prompt("ask", "---\nversion: 2\nrole: smart\n---\n\nBe brief.\n") == {"version": "2", "role": "smart", "name": "ask", "body": "Be brief."}
    for bad in ("no matter", "---\nrole: x\n---\nbody"):
        with pytest.raises(ValueError):
            fences.read_prompt("p", bad)


def test_ask(spark):
    passages = spark.createDataFrame([(1, "S · T", "one"), (2, "S · U", "two")], "chunk_id long, header string, text string")
    hits = spark.createDataFrame([(2, 1), (1, 2), (9, 3)], "chunk_id long, rank int")
    seen = []
    got = steps.ask("why?", lambda q: hits, passages, lambda prompt: seen.append(prompt) or "So [1], not [7].", ensure=lambda: seen.append("ensured"))
    assert got.text == "So [1], not." and got.cited == [1] and got.removed == ["7"] and [p["chunk_id"] for p in got.passages] == [2, 1] and seen[0] == "ensured" and "[1] S · U\ntwo" in seen[1]
    assert steps.ask("why?", lambda q: hits.where("false"), passages, str).refused == "nothing was found"
    assert steps.ask("why?", lambda q: hits, passages, str, problem=lambda: "paused").refused == "paused"


def test_prefetch_and_meter():
    left = iter([None, None, "cap reached"])
    assert steps.prefetch([1, 2, 3], [lambda i: i != 2], lambda: next(left)) == ([1], [2], "cap reached")
    used = []
    got, why = chunks.metered(["aaaa"] * 250, lambda b: [[0.0, 1.0]] * len(b), lambda: "over" if sum(used) >= 200 else None, used.append, 2)
    assert len(got) == 200 and why == "over" and used == [100, 100]
    with pytest.raises(ValueError):
        chunks.metered(["a"], lambda b: [], lambda: None, used.append, 2)


def test_versions():
    assert state.check_version([1], [1, 2, 3]) == [2, 3] and state.check_version([], [1]) == [1]
    for applied, known in (([4], [1, 2]), ([], [1, 3])):
        with pytest.raises(ValueError):
            state.check_version(applied, known)


def test_times(spark):
    d = spark.createDataFrame([("2024-01-02T03:04:05Z",), ("2024-01-02T03:04:05+02:00",), ("2024-01-02",), ("nope",)], "t string")
    assert [r.x for r in d.select(clock.to_iso(clock.from_iso(F.col("t"))).alias("x")).collect()] == ["2024-01-02T03:04:05+00:00", "2024-01-02T01:04:05+00:00", "2024-01-02T00:00:00+00:00", None]
    assert spark.range(1).select(clock.local_day(F.lit("2024-01-01 23:30:00").cast("timestamp"), "Europe/Berlin").cast("string").alias("d")).first().d == "2024-01-02"


def test_replace_day(spark, tmp_path):
    path = str(tmp_path / "digests")
    rows = lambda *r: spark.createDataFrame(r, "day string, item_id long")
    exports.replace_day(rows(("2024-01-01", 1), ("2024-01-02", 2)), path)
    exports.replace_day(rows(("2024-01-02", 3)), path)
    assert sorted(r.item_id for r in spark.read.parquet(path).collect()) == [1, 3]


def test_like_affinity(spark):
    items = spark.createDataFrame([(1, "s1", "graph neural nets", "graph learning"), (2, "s1", "graph theory", ""), (3, "s2", "cooking", "pasta")], "id long, source_id string, title string, summary string")
    state_ = spark.createDataFrame([(1, True, False, None)], "item_id long, liked boolean, hidden boolean, read_at timestamp")
    assert ranking.like_affinity(items, items, state_.where("false")) is None and ranking.mode_of(False, state_) == "likes" and ranking.mode_of(False, state_.where("false")) == "cold"
    topic, source, matched = ranking.like_affinity(items, items.where("id > 1"), state_)
    assert {r.id: r.topic for r in topic.collect()} == {2: 1.0, 3: 0.0} and {r.id: r.matched for r in matched.collect()} == {2: ["graph"], 3: []}
    assert {r.source_id: r.source for r in source.collect()}["s1"] == 1.0
    stop = items.withColumn("title", F.lit("the of")).withColumn("summary", F.lit("and"))
    assert ranking.like_affinity(stop, stop, state_)[0] is None


def test_scores_of_lines(spark):
    """Terms begin tokens, and the texts are read once for all passes."""
    items = spark.createDataFrame([(1, "Mod-els of", "a ._model.x modeled, été"), (2, None, "remodel"), (3, "", "model model")], "id long, title string, summary string")
    scores = ranking.topic_scores(items, ["model", "et"])
    assert [(r.id, r.topic > 0) for r in scores.orderBy("id").collect()] == [(1, True), (2, False), (3, True)]
    assert "regexp" not in scores._jdf.queryExecution().optimizedPlan().toString()


def test_terms_of_lines(spark):
    """Terms begin tokens: inner stops stay, outer ones go for the names, and the tokens are made once."""
    items = spark.createDataFrame([(1, "Mod-els of", "a ._model.x modeled, été"), (2, None, "remodel"), (3, "", "model model")], "id long, title string, summary string")
    matched = ranking.matched_terms(items, ["model", "mod", "et", "ét"])
    assert {r.id: r.matched for r in matched.collect()} == {1: ["model", "ét"], 2: [], 3: ["model"]}
    assert "exists(transform" not in matched._jdf.queryExecution().optimizedPlan().toString()


def test_store_reads_its_batch_once(spark):
    raw = spark.createDataFrame([(1, "s", "article", "T", "https://x.org/a", None, None, "x", None, None)], "pos long, source_id string, kind string, title string, url string, authors array<string>, published_at timestamp_ntz, summary string, paper_id string, image_url string")
    batch = state.normalize(raw)
    table = batch.where("false").select("id", "source_id", "kind", "url", "canonical_url", "title", "authors", "published_at", "summary", "paper_id", "image_url", F.lit(None).cast("timestamp_ntz").alias("first_seen"), F.lit(None).cast("timestamp_ntz").alias("last_seen"), F.lit(1).cast("long").alias("times_seen"), F.lit("").alias("content_hash"), F.lit(False).alias("is_old"))
    out = state.store(table, batch, F.lit("2024-01-31").cast("timestamp_ntz"))
    assert [(r.source_id, r.created) for r in out.collect()] == [("s", True)]
    assert "arxiv" not in out.select("created")._jdf.queryExecution().optimizedPlan().toString()
