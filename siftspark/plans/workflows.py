"""More of the catalogue: stored items, sources, runs, summaries and indexes as they change, and days."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import address, clock, score
from ..operators import chunks, clusters, ranking, state, steps
from .catalogue import _DAY, _DAY_VIEWS, _TOP_TERMS, TOKENS, _pop, _weighted, query
from .views import NOW, now

_WEB = "'web:' || substr(sha1(url), 1, 16)"
_BATCH = """b AS (SELECT id AS n, id AS pos, source_id, kind, 'new ' || title AS title, url, CASE WHEN id % 2 = 0 THEN '' ELSE 'fresh ' || id END AS summary, CASE WHEN id % 3 = 0 THEN ['A', 'B'] ELSE [] END AS authors, CASE WHEN id % 5 = 0 THEN TIMESTAMP '2023-06-01' END AS published_at, CASE WHEN id % 6 = 0 THEN 'img' || id END AS image_url FROM items WHERE id % 2 = 0 OR id % 5 = 0
  UNION ALL SELECT id, 1000000000 + id, 'other', kind, CASE WHEN id % 8 = 0 THEN ' ' ELSE 'again ' || title END, url, '', ['C'], TIMESTAMP '2023-07-01', NULL FROM items WHERE id % 4 = 0)"""


def _stored(v):
    web = F.concat(F.lit("web:"), F.substring(F.sha1("url"), 1, 16))
    t = v.items.where("id % 3 <> 0").select(
        web.alias("id"), "source_id", "kind", "url", F.col("url").alias("canonical_url"), "title", F.expr("CASE WHEN id % 7 = 0 THEN array('Z') ELSE cast(array() AS array<string>) END").alias("authors"), "published_at", "summary", F.lit(None).cast("string").alias("paper_id"), F.lit(None).cast("string").alias("image_url"),
        "first_seen", F.when(F.col("id") % 2 == 0, F.col("first_seen")).alias("last_seen"), F.lit(1).cast("long").alias("times_seen"), F.lit("").alias("content_hash"), F.lit(False).alias("is_old"))
    t = t.withColumn("last_seen", F.coalesce("last_seen", now()))
    return t, state.normalize(_batch(v))


def _batch(v):
    i = v.items
    none = F.lit(None).cast("string")
    empty = F.array().cast("array<string>")
    ts = lambda x: F.lit(x).cast("timestamp_ntz")
    tracked = F.concat("url", F.lit("/?utm_source=feed&ref=x#top"))
    a = i.where("id % 2 = 0 OR id % 5 = 0").select(
        F.col("id").alias("pos"), "source_id", "kind", F.concat(F.lit("  new "), "title").alias("title"), tracked.alias("url"), F.when(F.col("id") % 2 == 0, "").otherwise(F.concat(F.lit("fresh "), F.col("id").cast("string"))).alias("summary"), F.when(F.col("id") % 3 == 0, F.array(F.lit("A"), F.lit(" B "), F.lit(""))).otherwise(empty).alias("authors"),
        F.when(F.col("id") % 5 == 0, ts("2023-06-01")).alias("published_at"), none.alias("paper_id"), F.when(F.col("id") % 6 == 0, F.concat(F.lit("img"), F.col("id").cast("string"))).alias("image_url"))
    b = i.where("id % 4 = 0").select(
        (F.col("id") + 1000000000).alias("pos"), F.lit("other").alias("source_id"), "kind", F.when(F.col("id") % 8 == 0, " ").otherwise(F.concat(F.lit("again "), "title")).alias("title"), F.col("url"), F.lit("").alias("summary"), F.array(F.lit("C")).alias("authors"), ts("2023-07-01").alias("published_at"), none.alias("paper_id"), none.alias("image_url"))
    return a.unionByName(b)


_STORE = f"""WITH t AS (SELECT {_WEB} AS id, source_id, title, summary, published_at, CASE WHEN id % 7 = 0 THEN ['Z'] ELSE [] END AS authors, first_seen, CASE WHEN id % 2 = 0 THEN first_seen ELSE TIMESTAMP '2024-01-31' END AS last_seen FROM items WHERE id % 3 <> 0), {_BATCH},
k AS (SELECT *, {_WEB} AS id, regexp_replace(trim(regexp_replace(title, '\\s+', ' ', 'g')), '^ +', '') AS clean FROM b),
m AS (SELECT id, arg_max(clean, pos) AS title, arg_max(summary, pos) FILTER (WHERE summary <> '') AS summary, arg_min(published_at, pos) FILTER (WHERE published_at IS NOT NULL) AS published_at, arg_min(authors, pos) FILTER (WHERE len(authors) > 0) AS authors, arg_max(image_url, pos) FILTER (WHERE image_url IS NOT NULL) AS image_url, arg_min(source_id, pos) AS source_id FROM k WHERE clean <> '' GROUP BY id),
r AS (SELECT coalesce(t.id, m.id) AS id, coalesce(t.source_id, m.source_id) AS source_id, coalesce(m.title, t.title) AS title, coalesce(m.summary, t.summary, '') AS summary, coalesce(t.published_at, m.published_at) AS published_at, CASE WHEN len(t.authors) > 0 THEN t.authors ELSE coalesce(m.authors, t.authors, []) END AS authors, m.image_url,
  coalesce(t.first_seen, TIMESTAMP '2024-01-31') AS first_seen, CASE WHEN m.id IS NULL THEN t.last_seen ELSE TIMESTAMP '2024-01-31' END AS last_seen, CASE WHEN t.id IS NULL THEN 1 ELSE 1 + (m.id IS NOT NULL AND t.last_seen::DATE <> DATE '2024-01-31')::INT END AS times_seen, t.id IS NULL AS created, m.id IS NOT NULL AS met FROM t FULL JOIN m ON t.id = m.id) """


@query(_STORE + "SELECT id, source_id, md5(title) AS title_md5, sha1(summary) AS summary_sha1, published_at, array_to_string(authors, ',') AS authors, image_url, first_seen, last_seen, times_seen, created, CASE WHEN met THEN sha1(title || chr(10) || summary) ELSE '' END AS content_hash, coalesce(first_seen - published_at > INTERVAL 90 DAYS, false) AS is_old FROM r", "items")
def store_items(v):
    t, b = _stored(v)
    out = state.store(t, b, now())
    return out.select("id", "source_id", F.md5("title").alias("title_md5"), F.sha1("summary").alias("summary_sha1"), "published_at", F.array_join("authors", ",").alias("authors"), "image_url", "first_seen", "last_seen", F.col("times_seen").cast("int").alias("times_seen"), "created", "content_hash", "is_old")


@query(_STORE + "SELECT (SELECT count(*) FROM k WHERE clean <> '') AS seen, (SELECT count(*) FROM k WHERE clean = '') AS skipped, (SELECT count(*) FROM r WHERE created) AS new", "items")
def store_statistics(v):
    t, b = _stored(v)
    return state.store_statistics(b, state.store(t, b, now()))


@query("""WITH b AS (SELECT item_id, observed_on, upvotes, upvotes7d, comments FROM signals WHERE item_id % 3 = 0 AND NOT (item_id % 2 = 0)) SELECT s.item_id, s.observed_on::VARCHAR AS observed_on, CASE WHEN b.item_id IS NULL THEN s.upvotes ELSE coalesce(b.upvotes, 0) + 1 END AS upvotes, CASE WHEN b.item_id IS NULL THEN s.upvotes7d END AS upvotes7d, CASE WHEN b.item_id IS NULL THEN s.comments END AS comments FROM signals s LEFT JOIN b ON b.item_id = s.item_id AND b.observed_on = s.observed_on""", "signals")
def record_signals(v):
    none = F.lit(None).cast("long")
    t = v.signals.select("item_id", "observed_on", none.alias("rank"), "upvotes", "upvotes7d", none.alias("github_stars"), "comments")
    # every third item is seen again; of those, the even ones without any value
    b = t.where("item_id % 3 = 0").select("item_id", "observed_on", none.alias("rank"), F.when(F.col("item_id") % 2 != 0, F.coalesce("upvotes", F.lit(0)) + 1).alias("upvotes"), none.alias("upvotes7d"), none.alias("github_stars"), none.alias("comments"), F.lit(1).alias("pos"))
    return state.record_signals(t, b).select("item_id", F.col("observed_on").cast("string").alias("observed_on"), "upvotes", "upvotes7d", "comments")


@query("SELECT id, CASE WHEN id % 5 = 0 AND id % 2 = 0 THEN 'found ' || id ELSE md5(summary) END AS summary, CASE WHEN id % 5 = 0 THEN sha1(title || chr(10) || CASE WHEN id % 2 = 0 THEN 'found ' || id ELSE summary END) ELSE '' END AS content_hash, id % 5 = 0 AS tried FROM items", "items")
def enrich_items(v):
    t = v.items.select("id", "title", "summary", F.lit("").alias("content_hash"), F.lit(None).cast("timestamp_ntz").alias("enriched_at"))
    found = v.items.where("id % 5 = 0").select(F.col("id").alias("item_id"), F.when(F.col("id") % 2 == 0, F.concat(F.lit("found "), F.col("id").cast("string"))).otherwise("").alias("summary"))
    out = state.enrich(t, found, now())
    kept = F.when(F.startswith("summary", F.lit("found ")) & (F.col("id") % 10 == 0), F.col("summary")).otherwise(F.md5("summary"))
    return out.select("id", kept.alias("summary"), "content_hash", F.col("enriched_at").isNotNull().alias("tried"))


@query("WITH s AS (SELECT id, origin, enabled FROM sources) SELECT id, origin, CASE WHEN id = 'src1' THEN false WHEN id = 'src5' THEN true ELSE enabled END AS enabled, CASE WHEN id = 'src2' THEN 'new' ELSE 'old' END AS recipe, CASE WHEN id = 'src2' THEN 0 ELSE 4 END AS failures FROM s WHERE NOT (id IN ('src3', 'src4') AND origin <> 'builtin')", "sources")
def source_changes(v):
    t = v.sources.select("id", "origin", "enabled", F.lit("old").alias("recipe"), F.lit(4).alias("failures"), now().alias("last_ok"), F.lit("{}").alias("fetch_state"))
    changes = v.spark.createDataFrame([("src1", "disable", None), ("src5", "enable", None), ("src3", "remove", None), ("src4", "remove", None), ("src2", "replace", "new")], "id string, action string, value string")
    return state.change_sources(t, changes).select("id", "origin", "enabled", "recipe", "failures")


@query("SELECT id, origin FROM sources UNION ALL SELECT 'seed', 'builtin'", "sources")
def seeded_sources(v):
    seeds = v.spark.createDataFrame([("seed", "builtin"), ("src0", "seeded twice"), ("seed", "builtin")], "id string, origin string")
    return state.insert_missing(v.sources.select("id", "origin"), seeds, "id")


@query("SELECT min(id) AS id FROM (SELECT id, CASE substr(id, 4)::INT % 3 WHEN 0 THEN 'https://a.org/' WHEN 1 THEN 'https://b.org/' ELSE 'https://c.org/' END AS u FROM sources) WHERE u = 'https://b.org/' HAVING min(id) IS NOT NULL", "sources")
def source_of_url(v):
    n = F.expr("int(substring(id, 4)) % 3")
    recipe = F.when(n == 0, '{"url": "https://a.org/"}').when(n == 1, '{"type": "rss", "feed_url": "https://b.org/"}').otherwise('{"sitemap_url": "https://c.org/"}')
    return steps.find_by_recipe_url(v.sources.withColumn("recipe", recipe), F.col("recipe"), "https://b.org/")


@query("SELECT id, origin = 'user' AS can, CASE WHEN origin = 'user' THEN 'https://' || id || '.org/' ELSE name END AS target FROM sources", "sources")
def rediscover_targets(v):
    url = F.when(F.col("origin") == "user", F.concat(F.lit("https://"), "id", F.lit(".org/feed.xml?a=1")))
    return v.sources.select("id", steps.can_rediscover(F.col("origin")).alias("can"), steps.rediscover_target(F.lit(""), url, F.col("name")).alias("target"))


@query("SELECT id AS item_id, CASE WHEN id % 2 = 0 THEN 'v2' ELSE 'v1' END || '/' || CASE WHEN id % 3 = 0 THEN 'big' ELSE 'small' END AS made_by FROM items WHERE id % 5 = 0 AND id % 2 = 0 AND id % 3 = 0", "items")
def cached_summaries(v):
    made = v.items.select(F.col("id").alias("item_id"), F.expr("CASE WHEN id % 2 = 0 THEN 'v2' ELSE 'v1' END").alias("prompt_version"), F.expr("CASE WHEN id % 3 = 0 THEN 'big' ELSE 'small' END").alias("model"))
    hit = steps.cached_summaries(made, v.items.where("id % 5 = 0").select(F.col("id").alias("item_id")), "v2", "big")
    return hit.select("item_id", F.concat_ws("/", "prompt_version", "model").alias("made_by"))


@query("SELECT i.id, coalesce(s.name, i.source_id) AS source FROM items i LEFT JOIN sources s ON s.id = i.source_id AND enabled", "items", "sources")
def source_names(v):
    return steps.names_of(v.items.select("id", "source_id"), v.sources.where("enabled"), "source_id", "source").select("id", "source")


@query("SELECT count(*) AS n FROM items LEFT JOIN item_state ON item_id = id WHERE first_seen > TIMESTAMP '2024-01-20' AND read_at IS NULL AND NOT coalesce(hidden, false)", "items", "item_state")
def new_count(v):
    return steps.count_new(v.items, v.item_state, F.lit("2024-01-20").cast("timestamp_ntz"))


_LOG = "SELECT item_id % 50 AS run_id, CASE action WHEN 'open' THEN 'start' WHEN 'like' THEN 'finish' WHEN 'save' THEN 'usage' WHEN 'hide' THEN 'alive' ELSE 'step' END AS event, ts, id, k FROM interactions WHERE item_id % 50 < 40 AND (action <> 'like' OR item_id % 50 < 20) AND (action <> 'hide' OR item_id % 50 < 30)"


def _runs(v):
    event = F.expr("CASE action WHEN 'open' THEN 'start' WHEN 'like' THEN 'finish' WHEN 'save' THEN 'usage' WHEN 'hide' THEN 'alive' ELSE 'step' END")
    some = v.interactions.where("item_id % 50 < 40 AND (action <> 'like' OR item_id % 50 < 20) AND (action <> 'hide' OR item_id % 50 < 30)")
    used = F.when(event == "usage", F.col("k").cast("long"))
    return state.runs_of(some.select((F.col("item_id") % 50).alias("run_id"), event.alias("event"), F.col("ts").alias("at"), F.lit("ok").alias("status"), used.alias("tokens_in"), (used * 2).alias("tokens_out"), used.alias("cost")), F.lit(NOW).cast("timestamp_ntz"))


_RUNS = f"""l AS ({_LOG}), u AS (SELECT run_id, min(ts) FILTER (WHERE event = 'start') AS started_at, max(ts) FILTER (WHERE event = 'finish') AS f, bool_or(event = 'alive') AS alive, coalesce(sum(k) FILTER (WHERE event = 'usage'), 0)::BIGINT AS tokens_in FROM l GROUP BY run_id),
runs AS (SELECT run_id, started_at, CASE WHEN f IS NOT NULL THEN f WHEN NOT alive THEN TIMESTAMP '2024-01-31' END AS finished_at, CASE WHEN f IS NOT NULL THEN 'ok' WHEN alive THEN 'running' ELSE 'interrupted' END AS status, tokens_in, 2 * tokens_in AS tokens_out FROM u)"""


@query(f"WITH {_RUNS} SELECT run_id, started_at::TIMESTAMP AS started_at, finished_at::TIMESTAMP AS finished_at, status, tokens_in, tokens_out FROM runs", "interactions")
def run_lifecycle(v):
    ntz = lambda c: F.col(c).cast("timestamp_ntz").alias(c)
    return _runs(v).select("run_id", ntz("started_at"), ntz("finished_at"), "status", "tokens_in", "tokens_out")


@query(f"WITH {_RUNS}, d AS (SELECT DISTINCT id % 60 AS id FROM items) SELECT d.id, CASE WHEN d.id % 2 = 0 THEN 'done' ELSE 'running' END AS status, CASE WHEN d.id % 2 = 0 THEN coalesce(tokens_in, 0) ELSE 7 END AS tokens_in, CASE WHEN d.id % 2 = 0 THEN coalesce(tokens_out, 0) ELSE 7 END AS tokens_out, d.id % 2 = 0 AS ended, CASE WHEN d.id % 4 = 0 THEN 'h' || d.id END AS chosen FROM d LEFT JOIN runs ON run_id = d.id", "items", "interactions")
def discovery_lifecycle(v):
    d = v.items.select((F.col("id") % 60).alias("id")).distinct()
    seven = F.lit(7).cast("long")
    open_ = d.select("id", F.lit("q").alias("query"), F.lit("running").alias("status"), F.lit(None).cast("timestamp_ntz").alias("finished_at"), seven.alias("tokens_in"), seven.alias("tokens_out"), F.lit(None).cast("string").alias("chosen"))
    ended = d.where("id % 2 = 0").select("id", F.lit("done").alias("status"), F.when(F.col("id") % 4 == 0, F.concat(F.lit("h"), F.col("id").cast("string"))).alias("chosen"))
    out = state.finish_discoveries(open_, ended, _runs(v), now())
    return out.select("id", "status", "tokens_in", "tokens_out", F.col("finished_at").isNotNull().alias("ended"), "chosen")


@query("WITH f AS (SELECT id // 40 AS run, id AS rank, title, CASE WHEN id // 40 % 2 = 0 OR id % 3 <> 0 THEN first_seen - CASE WHEN id // 40 % 3 = 0 THEN INTERVAL 400 DAYS ELSE INTERVAL 0 DAYS END END AS d FROM items) SELECT run, count(*) AS found, CASE WHEN count(d) = count(*) AND max(d) < TIMESTAMP '2024-01-31' - INTERVAL 365 DAYS THEN 'its newest item is of ' || strftime(max(d), '%Y-%m-%d') END AS refused, array_to_string((list(title ORDER BY rank))[1:3], '|') AS samples FROM f GROUP BY run", "items")
def recipe_tests(v):
    run = F.expr("id div 40")
    dated = F.when((run % 2 == 0) | (F.col("id") % 3 != 0), F.when(run % 3 == 0, F.col("first_seen") - F.expr("INTERVAL 400 DAYS")).otherwise(F.col("first_seen")))
    out = steps.recipe_test(v.items.select(run.alias("run"), F.col("id").alias("rank"), "title", dated.alias("published_at")), now())
    return out.select("run", "found", "refused", F.array_join("samples", "|").alias("samples"))


# Passages and vectors

@query("SELECT chunk_id, published_day::VARCHAR AS published_day, chunk_id % 6 = 2 AS fresh FROM vectors WHERE NOT (chunk_id % 6 = 2 AND chunk_id % 4 = 0)", "vectors")
def replaced_passages(v):
    """Some items are ingested again: those of their passages that are gone go."""
    of = v.vectors.select("chunk_id", F.col("chunk_id").alias("item_id"), "collection", "published_day", F.lit(False).alias("fresh"))
    old = of.unionByName(of.where("chunk_id % 6 = 2").withColumn("chunk_id", F.col("chunk_id") + 1000000))
    fresh = of.where("chunk_id % 6 = 2 AND NOT chunk_id % 4 = 0").withColumn("fresh", F.lit(True))
    emptied = old.where("NOT (item_id % 6 = 2 AND item_id % 4 = 0)")
    return chunks.replace_passages(emptied, fresh).select("chunk_id", F.col("published_day").cast("string").alias("published_day"), "fresh")


@query("SELECT chunk_id FROM vectors WHERE chunk_id % 3 = 0 OR chunk_id % 5 = 0", "vectors")
def reindex_work(v):
    """Passages to embed: those without a vector, or with one of another model; vectors without a passage go first."""
    have = v.vectors.select("chunk_id", "embedding")
    passages = v.vectors.select("chunk_id", F.when(F.col("chunk_id") % 5 == 0, "old").otherwise("new").alias("embed_model"), F.lit(64).alias("embed_dim"))
    _, todo = chunks.reindex_plan(passages, have.where("chunk_id % 3 <> 0"), "new", 64)
    return todo


@query("SELECT chunk_id, read_at::DATE::VARCHAR AS read_day FROM vectors LEFT JOIN item_state ON item_id = chunk_id", "vectors", "item_state")
def vectors_read_day(v):
    out = chunks.read_since(v.vectors.select("chunk_id", F.col("chunk_id").alias("item_id"), "read_day"), v.item_state)
    return out.select("chunk_id", F.col("read_day").cast("string").alias("read_day"))


@query("SELECT a.id, b.id AS sibling, row_number() OVER (PARTITION BY a.id ORDER BY b.first_seen DESC, b.id DESC) AS n FROM items a JOIN items b ON a.id <> b.id AND a.id // 9 = b.id // 9", "items")
def ordered_siblings(v):
    made = v.items.select("id", F.expr("id div 9").alias("cluster_id"))
    return clusters.ordered_siblings(made, v.items).withColumn("n", F.col("n").cast("long"))


# The digest of a day with likes

_TOPIC = f""", topic AS (SELECT i.id, least(1.0, length(title) / 100.0) AS topic FROM items i)"""


@query(_DAY + f"{_TOPIC}, cc AS (SELECT c.*, coalesce(topic, 0) AS topic FROM c LEFT JOIN topic USING (id)) SELECT id, {_weighted(ranking.WEIGHTS['likes'])} AS final, row_number() OVER (ORDER BY {_weighted(ranking.WEIGHTS['likes'])} DESC, first_seen DESC, id) AS position FROM cc", *_DAY_VIEWS)
def digest_likes_topic(v):
    """Topic, source and freshness together; the topics here are given ones."""
    cands = ranking.candidates(v.items, v.digests, F.lit("2024-01-30").cast("date"))
    topic = v.items.select("id", F.least(F.lit(1.0), F.length("title") / 100.0).alias("topic"))
    out = ranking.digest(cands, v.triage, _pop(v), now(), "likes", topic=topic, source=ranking.source_affinity(v.items, v.item_state))
    return out.select("id", "final", F.col("position").cast("long").alias("position"))


@query("SELECT day::VARCHAR AS day, item_id, round(final_score, 6) AS final_score FROM digests WHERE day <> DATE '2024-01-26' UNION ALL SELECT '2024-01-26', id, 0.5 FROM items WHERE first_seen::DATE = DATE '2024-01-26' AND id NOT IN (SELECT item_id FROM digests WHERE day < DATE '2024-01-26')", "items", "digests")
def replaced_digest(v):
    day = F.lit("2024-01-26").cast("date")
    built = ranking.candidates(v.items, v.digests, day).select(F.col("id").alias("item_id"), day.alias("day"), F.lit(0.5).cast("double").alias("final_score"))
    out = ranking.replaced_day(v.digests, built, day)
    return out.select(F.col("day").cast("string").alias("day"), "item_id", F.round("final_score", 6).alias("final_score"))


_LIKED_TERMS = _TOP_TERMS.removeprefix("WITH ").replace(", c AS (", ", counted AS (").replace("FROM c ORDER", "FROM counted ORDER")
_BUILT = f"""{_DAY}, {_LIKED_TERMS}, k AS (SELECT id, regexp_extract_all(strip_accents(lower(concat_ws(' ', title, summary))), '{TOKENS}') AS tok FROM items),
m AS (SELECT id, len(tok) AS length, i, len(list_filter(tok, lambda x: starts_with(x, term))) AS tf FROM k, tt), st AS (SELECT i, count(*) FILTER (WHERE tf > 0) AS n, count(*) AS total, avg(length) AS mean FROM m GROUP BY i),
w AS (SELECT id, sum(CASE WHEN tf > 0 THEN greatest(1e-6, ln((total - n + 0.5) / (n + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean)) ELSE 0 END) AS raw FROM m JOIN st USING (i) GROUP BY id),
topic AS (SELECT c.id, CASE WHEN max(raw) OVER () > 0 THEN raw / max(raw) OVER () ELSE 0.0 END AS topic FROM c JOIN w USING (id)), cc AS (SELECT c.* EXCLUDE (source), coalesce(topic, 0) AS topic, coalesce(source, 0) AS source FROM c LEFT JOIN topic USING (id)),
f AS (SELECT *, {_weighted(ranking.WEIGHTS['likes'])} AS final FROM cc)
SELECT DATE '2024-01-30' AS day, id AS item_id, row_number() OVER (ORDER BY final DESC, first_seen DESC, id) AS position, final AS final_score, hidden, round(topic, 6) AS t_topic, round(source, 6) AS t_source, round(rec, 6) AS t_rec FROM f"""


@query(_BUILT, *_DAY_VIEWS)
def built_digest(v):
    """A day's digest by the mode that the likes call for, with topics."""
    _, out = ranking.build_digest(v.items, v.digests, v.triage, v.item_state, _pop(v), F.lit("2024-01-30").cast("date"), now(), ai=False)
    return out


# Days and figures

@query("WITH d AS (SELECT DISTINCT (TIMESTAMP '2024-03-01' + to_days((id % 60)::INT))::DATE AS day FROM items) SELECT day::VARCHAR AS day, year(day) * 10000 + month(day) * 100 + day(day) AS number, CASE WHEN day = DATE '2024-03-10' THEN 23 ELSE 24 END AS hours, CASE WHEN day <= DATE '2024-03-10' THEN 5 ELSE 4 END AS start_utc FROM d", "items")
def local_days(v):
    day = F.to_date(F.lit("2024-03-01").cast("timestamp_ntz") + F.expr("make_dt_interval(int(doc_id % 60))"))
    d = v.raw("documents").select(day.alias("day")).distinct()
    start, end = clock.day_bounds(F.col("day"), "America/New_York")
    return d.select(F.col("day").cast("string").alias("day"), clock.day_number(F.col("day")).alias("number"), ((F.unix_seconds(end.cast("timestamp")) - F.unix_seconds(start.cast("timestamp"))) / 3600).cast("int").alias("hours"), F.hour(start).alias("start_utc"))


@query("SELECT id, CASE WHEN id % 3 = 0 THEN 'https://e.org:8080/about?x=1' WHEN id % 3 = 1 THEN 'https://e.org:8080/' ELSE 'http://e.org:8080/' END AS homepage FROM items", "items")
def homepages(v):
    claimed = F.expr("CASE WHEN id % 3 = 0 THEN ' https://user@E.org:99/about?x=1#y ' WHEN id % 3 = 1 THEN 'https://other.org/x' ELSE 'http://e.org' END")
    return v.items.select("id", address.homepage(F.lit("https://e.org:8080/feed.xml"), claimed).alias("homepage"))


@query("SELECT id, CASE WHEN id * 97 >= 604800 THEN id * 97 // 604800 || 'w' WHEN id * 97 >= 86400 THEN id * 97 // 86400 || 'd' WHEN id * 97 >= 3600 THEN id * 97 // 3600 || 'h' WHEN id * 97 >= 60 THEN id * 97 // 60 || 'm' ELSE 'just now' END AS ago, round_even((id % 64) / 64.0, 4)::DOUBLE AS shown FROM items", "items")
def ages_and_terms(v):
    return v.items.select("id", score.ago(F.col("id") * 97).alias("ago"), score.shown((F.col("id") % 64) / 64.0).alias("shown"))
