"""More of the catalogue: what is stored and follows its data — the keyword index, clusters, vector cells, cascades — and captures."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from ..operators import cells, chunks, clusters, ingest, lists, retrieval, segments, state, steps
from ..operators.storage import fingerprint, new_folder
from ..sources import feeds, markup
from . import catalogue
from .catalogue import _ARCHIVE_EDGES, _BM25, WORDS, query
from .views import NOW, now

_FOLDERS: dict[tuple, str] = {}


def _once(v, name: str, table: str, make) -> str:
    """A folder that make(folder) fills, once for each state of a table."""
    what = (v.spark.sparkContext.applicationId, name, fingerprint(v.spark, f"{v.path}/{table}.parquet"))
    if what not in _FOLDERS:
        folder = new_folder(v.spark, name)
        make(folder)
        _FOLDERS[what] = folder
    return _FOLDERS[what]


# The keyword index, kept in step

_KEPT = "documents WHERE doc_id % 7 <> 0"


def _followed(v) -> str:
    """An index after four batches: two thirds of the documents, some of them with more text than they have; the rest; those with theirs; and a seventh deleted."""

    def make(folder: str) -> None:
        d = v.raw("documents").select(F.col("doc_id").alias("id"), "text")
        longer = d.withColumn("text", F.when(F.col("id") % 5 == 0, F.concat(F.coalesce("text", F.lit("")), F.lit(f" {catalogue.SEARCH}"))).otherwise(F.col("text")))
        segments.apply(v.spark, folder, longer.where("id % 3 <> 0"))
        segments.apply(v.spark, folder, d.where("id % 3 = 0"))
        segments.apply(v.spark, folder, d.where("id % 5 = 0 AND id % 14 <> 7"), deleted=d.where("id % 14 = 7").select(F.col("id").alias("key")))
        segments.apply(v.spark, folder, deleted=d.where("id % 14 = 0").select(F.col("id").alias("key")))

    return _once(v, "segments", "documents", make)


@query(_BM25.replace("FROM documents", f"FROM {_KEPT}") + "SELECT doc_id, round(s, 6) AS score, row_number() OVER (ORDER BY round(s, 6) DESC, doc_id) AS rank FROM sc ORDER BY rank LIMIT 50")
def bm25_followed(v):
    """The keyword search over an index that followed its documents."""
    scored = retrieval.keyword_scores(segments.open_index(v.spark, _followed(v)), WORDS)
    best = retrieval.top(scored.select(F.col("key").alias("doc_id"), F.round("score", 6).alias("score")), 50, F.desc("score"), F.asc("doc_id"))
    return best.withColumn("rank", F.col("rank").cast("long"))


@query(f"""
WITH p AS (SELECT doc_id, unnest(t) AS term FROM (SELECT doc_id, regexp_extract_all(strip_accents(lower(text)), '[\\pL\\pM\\pN_.\\-]+') AS t FROM {_KEPT}))
SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf, (SELECT count(*) FROM {_KEPT}) AS docs, round((SELECT count(*) FROM p) / (SELECT count(*) FROM {_KEPT}), 6) AS mean_length FROM p GROUP BY term""")
def terms_followed(v):
    """The statistics of every term in that index."""
    index = segments.open_index(v.spark, _followed(v))
    each = index.postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
    return each.crossJoin(F.broadcast(index.corpus)).select("term", "df", "cf", F.col("total").alias("docs"), F.round("mean", 6).alias("mean_length"))  # the corpus is one row


# Clusters, batch by batch

_BATCHES = 3


def _cluster_batches_sql() -> str:
    parts = ["i AS (SELECT chunk_id AS id, (chunk_id // 3) % 3 AS batch FROM vectors WHERE collection = 'archive')", "g AS (SELECT a, b FROM e UNION SELECT b, a FROM e)", "c0 AS (SELECT id, NULL::BIGINT AS name FROM i)"]
    for t in range(1, _BATCHES + 1):
        here = f"(SELECT id FROM i WHERE batch < {t})"
        parts.append(f"w{t} AS (SELECT id AS node, id AS seen FROM i WHERE batch < {t} UNION SELECT w{t}.node, g.b FROM w{t} JOIN g ON g.a = w{t}.seen WHERE g.b IN {here})")
        parts.append(f"m{t} AS (SELECT node, min(seen) AS comp FROM w{t} GROUP BY node)")
        parts.append(f"c{t} AS (SELECT node AS id, CASE WHEN count(*) OVER (PARTITION BY comp) > 1 THEN coalesce(min(name) OVER (PARTITION BY comp), comp) END AS name FROM m{t} LEFT JOIN c{t - 1} ON c{t - 1}.id = node)")
    return _ARCHIVE_EDGES + ", " + ", ".join(parts) + f" SELECT id, name AS cluster_id FROM c{_BATCHES}"


@query(_cluster_batches_sql(), "vectors", recursive=True)
def cluster_batches(v):
    """Clusters after three batches of archive vectors, each linked to what is there: only what it touches is read and written."""
    from ..operators.storage import checkpoint

    edges = checkpoint(clusters.neighbour_edges(v.vectors.where("collection = 'archive'"), 0.4).select("a", "b"))
    batch = lambda c: F.expr(f"({c} div 3) % 3")
    items = v.vectors.where("collection = 'archive'").select(F.col("chunk_id").alias("id"))
    folder = new_folder(v.spark, "clusters")
    clusters.write_membership(v.spark.createDataFrame([], "id long, cluster_id long"), folder)
    for t in range(_BATCHES):
        near = edges.where((F.greatest(batch("a"), batch("b")) == t))
        changes = clusters.update(clusters.open_membership(v.spark, folder), items.where(batch("id") == t), near)
        clusters.store_update(v.spark, folder, changes)
    return clusters.open_membership(v.spark, folder).by_id.select("id", "cluster_id")


_LINE1 = "trim(regexp_replace({}, '\\s+', ' ', 'g'))"
_PASSAGE = f"""SELECT i.id, {_LINE1.format('s.name')} || CASE WHEN {_LINE1.format('title')} = '' THEN '' ELSE ' · ' || {_LINE1.format('title')} END AS header,
  array_to_string(list_filter([{_LINE1.format('title')}, trim(summary), 'Source: ' || s.name, CASE WHEN len(tags) > 0 THEN 'Tags: ' || array_to_string(tags, ', ') END], lambda x: x IS NOT NULL AND x <> ''), chr(10)) AS text
  FROM items i JOIN sources s ON s.id = i.source_id LEFT JOIN triage t ON t.item_id = i.id"""


def _waves(v) -> str:
    """An archive after three runs: two thirds of the items, some with a title that changes; all of them; and again, with nothing new."""

    def make(folder: str) -> None:
        named, embed = v.sources.withColumn("trust", F.lit("publisher")), lambda text: chunks.hash_vector(text, F.lit(32))
        early = v.items.where("id % 3 <> 0").withColumn("title", F.when(F.col("id") % 5 == 0, F.concat(F.lit("old "), F.col("title"))).otherwise(F.col("title")))
        for rows in (early, v.items, v.items):
            ingest.ingest_archive(v.spark, folder, rows, named, v.triage, embed, "hash", 32, 0.9)

    return _once(v, "archive", "documents", make)


@query(f"SELECT id AS item_id, sha1('1' || chr(10) || header || chr(10) || text) AS hash, CASE WHEN id % 3 = 0 OR id % 5 = 0 THEN 2 ELSE 1 END AS batch, 'hash' AS embed_model FROM ({_PASSAGE})", "items", "sources", "triage")
def ingest_batches(v):
    """The archive's passages after successive runs, with the run that wrote each: what hasn't changed isn't written again."""
    return ingest.passages(v.spark, _waves(v), "hash", "embed_model")


@query(f"""WITH p AS ({_PASSAGE}), tok AS (SELECT id, regexp_extract_all(strip_accents(lower(header || chr(10) || text)), '{catalogue.TOKENS}') AS t FROM p),
n AS (SELECT id, len(t) AS length, q.w AS term, len(list_filter(t, lambda x: x = q.w)) AS tf FROM tok, (SELECT unnest({WORDS}) AS w) q), st AS (SELECT term, count(*) FILTER (WHERE tf > 0) AS n, count(*) AS total, avg(length) AS mean FROM n GROUP BY term)
SELECT id AS item_id, round(sum(greatest(1e-6, ln((total - st.n + 0.5) / (st.n + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 6) AS score FROM n JOIN st USING (term) WHERE tf > 0 GROUP BY id""", "items", "sources", "triage")
def ingest_search(v):
    """A keyword search over the archive that these runs kept."""
    scored = retrieval.keyword_scores(segments.open_index(v.spark, f"{_waves(v)}/index"), WORDS)
    return scored.select(F.col("key").alias("item_id"), F.round("score", 6).alias("score"))


# The list under a search, and by item


@query("""WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS position FROM documents ORDER BY position LIMIT 40),
k AS (SELECT l.*, position, (position IS NOT NULL AND NOT hidden AND NOT list_has_any(flags, ['promo', 'thin'])) OR id = 11 AS keep FROM listed l LEFT JOIN r ON doc_id = id)
SELECT id, row_number() OVER (ORDER BY position NULLS LAST, first_seen DESC, coalesce(published_at, first_seen) DESC, id DESC) AS position_no, (SELECT count(*) FROM listed) AS total FROM k WHERE keep""", "listed")
def list_ranked(v):
    """A search's items in its order, under the view's conditions, a pinned one after them; and how many items there are at all."""
    found = retrieval.top(v.raw("documents"), 40, F.desc("n_chars"), F.asc("doc_id"), rank="position").select(F.col("doc_id").alias("id"), "position")
    rows, total = lists.listing(catalogue._listed(v), lists.conditions(lists.ItemFilter(show="all")), "newest", ranked=found, pinned=11)
    return rows.select("id", F.col("position_no").cast("long").alias("position_no"), F.lit(total).cast("long").alias("total"))


@query("SELECT id, source_id, kind, title, popularity, liked, minutes, tags FROM listed WHERE id = (SELECT max(id) FROM items)", "listed", "items")
def item_row(v):
    """One item as the list shows it."""
    last = v.items.agg(F.max("id")).first()[0]
    return lists.item_row(catalogue._listed(v), -1 if last is None else last).select("id", "source_id", "kind", "title", "popularity", "liked", "minutes", "tags")


@query("""WITH t AS (SELECT user_id AS item_id, event_id, ts, CASE event_type WHEN 'error' THEN CASE WHEN event_id % 2 = 0 THEN 402 ELSE 500 END WHEN 'signup' THEN NULL ELSE 200 END AS http, CASE WHEN event_type IN ('view', 'click') THEN props END AS body FROM events),
l AS (SELECT item_id, arg_max(struct_pack(http := http, body := body), (ts, event_id)) AS t FROM t GROUP BY item_id), f AS (SELECT item_id, t.body IS NOT NULL AND coalesce(t.http < 400, true) AS ok, t FROM l)
SELECT item_id, CASE WHEN ok THEN 'ok' WHEN t.http IN (401, 402, 403) THEN 'paywalled' ELSE 'failed' END AS status, CASE WHEN ok THEN t.body END AS body, CASE WHEN NOT ok THEN coalesce('HTTP ' || t.http, 'no text') END AS error, 2 AS version FROM f
UNION ALL SELECT item_id, status, CASE WHEN status = 'ok' THEN body END, NULL, 1 FROM contents WHERE item_id NOT IN (SELECT item_id FROM l)""", "contents")
def stored_contents(v):
    """The texts that are kept after every item's last try: a paywall or a failure takes a text's place as well."""
    none = F.lit(None).cast("string")
    kept = v.contents.select("item_id", "status", F.when(F.col("status") == "ok", F.col("body")).alias("body"), none.alias("extractor"), F.col("words").cast("long").alias("words"), none.alias("error"), F.lit(1).alias("extractor_version"), now().alias("fetched_at"))
    e, kind = v.raw("events"), F.col("event_type")
    http = F.when(kind == "error", F.when(F.col("event_id") % 2 == 0, 402).otherwise(500)).when(kind != "signup", 200)
    tried = e.select(F.col("user_id").alias("item_id"), F.struct("ts", "event_id").alias("at"), http.alias("http"), F.when(kind.isin("view", "click"), F.col("props")).alias("body"), F.lit("html").alias("extractor"), none.alias("error"))
    return steps.store_contents(kept, tried, now(), 2).select("item_id", "status", "body", "error", F.col("extractor_version").alias("version"))


# Vectors by cell

_SOME = retrieval.SearchFilter(collections=("archive",), day_from=date(2023, 12, 10), read_since=date(2023, 11, 20))


def _cells(v) -> cells.Cells:
    return cells.open_cells(v.spark, _once(v, "cells", "embeddings", lambda folder: cells.write_cells(v.passages, folder)))


def _probe_vector(v) -> list[float]:
    row = v.raw("embeddings").where("vec_id = 7").select("embedding").first()
    return list(row.embedding) if row else []


@query("""WITH s AS (SELECT chunk_id, round(list_cosine_similarity(p.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS similarity FROM passages p, (SELECT embedding FROM embeddings WHERE vec_id = 7) q)
SELECT chunk_id, similarity, row_number() OVER (ORDER BY similarity DESC, chunk_id) AS rank FROM s ORDER BY rank LIMIT 20""", "passages")
def cells_exact(v):
    """The nearest passages by the cell index, in its exact mode: cells that can't hold a nearer one are never read."""
    return cells.search(_cells(v), _probe_vector(v), k=20, exact=True).withColumn("rank", F.col("rank").cast("long"))


@query("""WITH s AS (SELECT chunk_id, round(list_cosine_similarity(p.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS similarity FROM passages p, (SELECT embedding FROM embeddings WHERE vec_id = 7) q WHERE collection = 'archive' AND published_day >= DATE '2023-12-10' AND read_day >= DATE '2023-11-20')
SELECT chunk_id, similarity, row_number() OVER (ORDER BY similarity DESC, chunk_id) AS rank FROM s ORDER BY rank LIMIT 10""", "passages")
def cells_filtered(v):
    """The same under a search filter, which holds inside the cells."""
    return cells.search(_cells(v), _probe_vector(v), _SOME, 10, exact=True).withColumn("rank", F.col("rank").cast("long"))


@query()
def cells_recall(v):
    """Recall at 10 of the cell index and the share of vectors read, by effort; every twentieth passage asks."""
    index, asked = _cells(v), v.passages.where("chunk_id % 20 = 0").select(F.col("chunk_id").alias("query_id"), "embedding")
    return cells.mean_recalls(index, asked, 10, cells.EFFORTS)


# Deletions

_LEVELS = ("sources", "items", "signals", "contents", "item_state", "triage", "digests", "passages", "chunk_vectors", "interactions")
_REFERENCES = [state.Reference("items", "source_id", "sources", "id"), *[state.Reference(t, "item_id", "items", "id") for t in ("signals", "contents", "item_state", "triage", "digests", "passages")], state.Reference("chunk_vectors", "chunk_id", "passages", "chunk_id")]
_GONE = "('src3', 'src7')"


@query(f"""WITH gone AS (SELECT id FROM items WHERE source_id IN {_GONE}), chunk_gone AS (SELECT chunk_id FROM passages WHERE item_id IN (SELECT id FROM gone))
SELECT 'sources' AS name, count(*) AS n, sum(length(id))::BIGINT AS total FROM sources WHERE id NOT IN {_GONE} UNION ALL SELECT 'items', count(*), sum(id)::BIGINT FROM items WHERE id NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'signals', count(*), sum(item_id)::BIGINT FROM signals WHERE item_id NOT IN (SELECT id FROM gone) UNION ALL SELECT 'contents', count(*), sum(item_id)::BIGINT FROM contents WHERE item_id NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'item_state', count(*), sum(item_id)::BIGINT FROM item_state WHERE item_id NOT IN (SELECT id FROM gone) UNION ALL SELECT 'triage', count(*), sum(item_id)::BIGINT FROM triage WHERE item_id NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'digests', count(*), sum(item_id)::BIGINT FROM digests WHERE item_id NOT IN (SELECT id FROM gone) UNION ALL SELECT 'passages', count(*), sum(chunk_id)::BIGINT FROM passages WHERE item_id NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'chunk_vectors', count(*), sum(chunk_id)::BIGINT FROM vectors WHERE chunk_id NOT IN (SELECT chunk_id FROM chunk_gone) UNION ALL SELECT 'interactions', count(*), sum(id)::BIGINT FROM interactions""",
    "sources", "items", "signals", "contents", "item_state", "triage", "digests", "passages", "interactions")
def cascade_sources(v):
    """What is left of every table when two sources go; interactions stay, as history."""
    tables = {t: getattr(v, t) for t in _LEVELS if t != "chunk_vectors"} | {"chunk_vectors": v.vectors}
    left = state.cascade(tables, _REFERENCES, {"sources": ("id", v.sources.where(f"id IN {_GONE}").select("id"))})
    sums = {"sources": F.length("id"), "items": F.col("id"), "interactions": F.col("id"), "passages": F.col("chunk_id"), "chunk_vectors": F.col("chunk_id")}
    out = None
    for t in _LEVELS:
        one = left[t].agg(F.lit(t).alias("name"), F.count("*").alias("n"), F.sum(sums.get(t, F.col("item_id"))).cast("long").alias("total"))
        out = one if out is None else out.unionByName(one)
    return out


# Captures

_LINE = "trim(regexp_replace(regexp_replace(x, '[\\x00-\\x08\\x0b-\\x1f\\x7f-\\x9f]', '', 'g'), '\\s+', ' ', 'g'))"


@query(f"""WITH l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS rank FROM documents)
SELECT doc_id, rank::INT AS rank, 'https://' || source || '.example.org/p/' || doc_id || '/' || rank AS url, {_LINE} AS title, TIMESTAMP '2024-01-31' - to_hours((doc_id * 3 + rank)::INT % 2000) AS published_at, {_LINE} <> '' AS ok FROM l""")
def feed_items(v):
    """Every document as a feed of its lines, RSS or Atom, read by Spark's XML functions."""
    escaped = lambda x: F.replace(F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    clean = F.regexp_replace("text", F.lit("[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]"), F.lit(""))
    at = lambda i: F.timestamp_add("HOUR", (-((F.col("doc_id") * 3 + i + 1) % 2000)).cast("int"), now())
    link = lambda i: F.concat(F.lit("../p/"), F.col("doc_id").cast("string"), F.lit("/"), (i + 1).cast("string"))
    rss = F.transform(F.split(clean, "\n"), lambda x, i: F.concat(F.lit("<item><title><![CDATA["), F.replace(x, F.lit("]]>"), F.lit("]] >")), F.lit("]]></title><link>"), link(i), F.lit("</link><pubDate>"), F.date_format(at(i), "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT</pubDate></item>")))
    atom = F.transform(F.split(clean, "\n"), lambda x, i: F.concat(F.lit("<entry><title>"), escaped(x), F.lit('</title><link rel="self" href="x"/><link href="'), link(i), F.lit('"/><published>'), F.date_format(at(i), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z</published></entry>")))
    body = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit('<?xml version="1.0"?><rss version="2.0"><channel><title>t</title>'), F.array_join(rss, ""), F.lit("</channel></rss>"))).otherwise(F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom"><title>t</title>'), F.array_join(atom, ""), F.lit("</feed>")))
    rows = v.raw("documents").select("doc_id", body.alias("body"), F.concat(F.lit("https://"), F.col("source"), F.lit(".example.org/feeds/all.xml")).alias("url"))
    return feeds.each_entry(feeds.feed_entries(rows), "doc_id").select("doc_id", "rank", "url", "title", "published_at", "ok")


_LINKS = "SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]+', 0) AS origin, unnest(regexp_extract_all(html, 'href=\"(/[^\"]*)\"', 1)) AS path, generate_subscripts(regexp_extract_all(html, 'href=\"(/[^\"]*)\"', 1), 1) - 1 AS pos FROM pages"


@query(f"SELECT page_id, pos::INT AS pos, origin || path AS url, TIMESTAMP '2024-01-31' - to_days((page_id + pos)::INT % 400) AS lastmod FROM ({_LINKS}) WHERE page_id % 10 <> 0 UNION ALL SELECT page_id, 0, url, NULL FROM pages WHERE page_id % 10 = 0")
def sitemap_all(v):
    """The entries of sitemaps and of those that an index points to: every tenth page lists itself, for the others a sitemap of their links is pointed to."""
    p = v.raw("pages").select("page_id", "url", F.regexp_extract_all("html", F.lit('href="(/[^"]*)"'), F.lit(1)).alias("links"))
    day = lambda i: F.date_format(F.date_sub(F.lit(NOW[:10]).cast("date"), ((F.col("page_id") + i) % 400).cast("int")), "yyyy-MM-dd")
    urls = F.transform("links", lambda x, i: F.concat(F.lit("<url><loc>"), F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("</loc><lastmod>"), day(i), F.lit("</lastmod></url>")))
    below = F.concat(F.lit('<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'), F.array_join(urls, ""), F.lit("</urlset>"))
    own = F.concat(F.lit("<urlset><url><loc>"), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("</loc></url></urlset>"))
    top = p.select("page_id", "url", F.when(F.col("page_id") % 10 == 0, own).otherwise(F.lit("<sitemapindex><sitemap><loc>/below.xml</loc></sitemap></sitemapindex>")).alias("body"))
    read = lambda rows: feeds.each_entry(feeds.sitemap_entries(rows), "page_id")
    return markup.all_entries(read(top), read(p.where("page_id % 10 <> 0").select("page_id", "url", below.alias("body")))).select("page_id", "pos", "url", "lastmod")


_POLL = """WITH p AS (SELECT split_part(split_part(url, '://', 2), '/', 1) AS site, url, min(page_id) AS pos_no FROM pages GROUP BY 1, 2),
a AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY pos_no) AS n FROM p WHERE pos_no % 3 <> 0), b AS (SELECT * FROM p WHERE pos_no % 3 <> 1),
lost AS (SELECT site, url FROM a WHERE n <= 2 AND pos_no % 5 = 0), seen AS (SELECT site, url, pos_no FROM a WHERE (site, url) NOT IN (SELECT (site, url) FROM lost)),
t AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY pos_no) AS n FROM b WHERE NOT EXISTS (SELECT 1 FROM seen s WHERE s.site = b.site AND s.url = b.url)), todo AS (SELECT * FROM t WHERE n <= 2),
after AS (SELECT site, url FROM b WHERE NOT EXISTS (SELECT 1 FROM todo d WHERE d.site = b.site AND d.url = b.url AND d.pos_no % 5 = 0) UNION ALL SELECT site, url FROM seen WHERE site NOT IN (SELECT site FROM b))
SELECT site, url, 'fetch' AS what FROM todo UNION ALL SELECT site, url, 'seen' FROM after"""


@query(_POLL)
def poll_rounds(v):
    """Two polls of every site's pages: what the second reads, and what counts as seen after it."""
    p = v.raw("pages").select(F.split_part(F.split_part("url", F.lit("://"), F.lit(2)), F.lit("/"), F.lit(1)).alias("site"), "url", F.col("page_id").alias("pos_no")).groupBy("site", "url").agg(F.min("pos_no").alias("pos_no"))
    seen = p.where("false").select("site", "url", "pos_no")
    tried = lambda rows: rows.select("site", "url", F.when(F.col("pos_no") % 5 == 0, "network").otherwise("ok").alias("outcome"))
    one, two = p.where("pos_no % 3 <> 0"), p.where("pos_no % 3 <> 1")
    seen = markup.handled(one, tried(markup.to_fetch(one, seen, 2)), seen)
    todo = markup.to_fetch(two, seen, 2)
    after = markup.handled(two, tried(todo), seen)
    return todo.select("site", "url", F.lit("fetch").alias("what")).unionByName(after.select("site", "url", F.lit("seen").alias("what")))


_HTML = "replace(replace(replace(replace(regexp_replace({}, '<[^>]*>', ' ', 'g'), '&quot;', '\"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')"
_BLOCKS = f"""list_filter(list_transform(string_split(replace(replace(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '<h1>', chr(1) || '# '), '<p>', chr(1)), chr(1)), lambda x: trim(regexp_replace({_HTML.format('x')}, '\\s+', ' ', 'g'))), lambda x: x NOT IN ('', '#'))"""
catalogue.SQL["page_articles"] = f"""WITH b AS (SELECT page_id, array_to_string({_BLOCKS}, chr(10) || chr(10)) AS body FROM pages), n AS (SELECT *, len(regexp_extract_all(body, '[\\pL\\pN_]+')) AS n FROM b)
SELECT page_id, CASE WHEN n >= 50 THEN body END AS body, CASE WHEN n < 50 THEN 'only ' || n || ' words' END AS error FROM n"""
