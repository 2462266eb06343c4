"""The catalogue: every query by name, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import address, score, text
from ..operators import chunks, clusters, guard, lists, ranking, retrieval, state, steps
from ..sources import exports, markup
from ..streaming import incremental
from .views import NOW, Views, now, with_views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
SEARCH = "the thand of ertion"
WORDS = text.query_terms(SEARCH + " onthe thnt")
DAY = "2024-01-30"
TOKENS = r"[\pL\pM\pN_.\-]+"
NOW_TS = datetime.fromisoformat(NOW)


def query(sql: str | None = None, *views: str, recursive: bool = False):
    def keep(f: Callable[[Views], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if sql is not None:
            SQL[f.__name__] = with_views(sql, *views, recursive=recursive) if views else sql
        return f

    return keep


def _listed(v: Views) -> DataFrame:
    return lists.listed(v.items, v.item_state, v.contents, v.signals, v.digests, v.triage)


# Retrieval

_FOLD = "strip_accents(lower(text))"
_BM25 = f"""
WITH tok AS (SELECT doc_id, regexp_extract_all({_FOLD}, '{TOKENS}') AS t FROM documents),
n AS (SELECT doc_id, len(t) AS length, q.w AS term, len(list_filter(t, lambda x: x = q.w)) AS tf FROM tok, (SELECT unnest({WORDS}) AS w) q),
st AS (SELECT term, count(*) FILTER (WHERE tf > 0) AS n, count(*) AS total, avg(length) AS mean FROM n GROUP BY term),
sc AS (SELECT doc_id, sum(greatest(1e-6, ln((total - st.n + 0.5) / (st.n + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))) AS s FROM n JOIN st USING (term) WHERE tf > 0 GROUP BY doc_id)
"""


def _bm25(v: Views) -> DataFrame:
    scored = retrieval.keyword_scores(v.index, WORDS)
    return retrieval.top(scored.select(F.col("key").alias("doc_id"), F.round("score", 6).alias("score")), 50, F.desc("score"), F.asc("doc_id"))


@query(_BM25 + "SELECT doc_id, round(s, 6) AS score, row_number() OVER (ORDER BY round(s, 6) DESC, doc_id) AS rank FROM sc ORDER BY rank LIMIT 50")
def bm25_topk(v):
    return _bm25(v).withColumn("rank", F.col("rank").cast("long"))


@query(f"""
WITH tok AS (SELECT doc_id, regexp_extract_all({_FOLD}, '{TOKENS}') AS t FROM documents),
n AS (SELECT doc_id, len(t) AS length, q.w AS term, len(list_filter(t, lambda x: starts_with(x, q.w))) AS tf FROM tok, (SELECT unnest({WORDS[:3]}) AS w) q),
st AS (SELECT term, count(*) FILTER (WHERE tf > 0) AS n, count(*) AS total, avg(length) AS mean FROM n GROUP BY term),
sc AS (SELECT doc_id, sum(greatest(1e-6, ln((total - st.n + 0.5) / (st.n + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))) AS s FROM n JOIN st USING (term) WHERE tf > 0 GROUP BY doc_id)
SELECT doc_id, round(s / max(s) OVER (), 6) AS topic FROM sc""")
def bm25_prefix_topic(v):
    s = retrieval.bm25(retrieval.postings(v.raw("documents"), "doc_id", F.col("text"), WORDS[:3], prefix=True), "doc_id")
    return s.crossJoin(F.broadcast(s.agg(F.max("score").alias("best")))).select("doc_id", F.round(F.col("score") / F.col("best"), 6).alias("topic"))


@query(f"WITH t AS (SELECT doc_id, regexp_extract_all({_FOLD}, '{TOKENS}') AS t FROM documents) SELECT doc_id FROM t WHERE len(list_filter(t, lambda x: starts_with(x, 'tion'))) > 0 AND len(list_filter(t, lambda x: starts_with(x, 'ered'))) > 0")
def keyword_and_prefix(v):
    return v.raw("documents").where(lists.prefix_match(F.col("text"), ["tion", "ered"])).select("doc_id")


@query("""
WITH p AS (SELECT doc_id, unnest(t) AS term FROM (SELECT doc_id, regexp_extract_all(strip_accents(lower(text)), '[\\pL\\pM\\pN_.\\-]+') AS t FROM documents))
SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf, (SELECT count(*) FROM documents) AS docs, round((SELECT count(*) FROM p) / (SELECT count(*) FROM documents), 6) AS mean_length FROM p GROUP BY term""")
def term_statistics(v):
    each = v.index.postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
    return each.crossJoin(F.broadcast(v.index.corpus)).select("term", "df", "cf", F.col("total").alias("docs"), F.round("mean", 6).alias("mean_length"))  # the corpus is one row


def _probe(v: Views) -> DataFrame:
    return v.raw("embeddings").where("vec_id = 7")


_KNN = "WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 7), s AS (SELECT vec_id, label, round(list_cosine_similarity(embedding::DOUBLE[], e::DOUBLE[]), 6) AS similarity FROM embeddings, q) "


def _knn(v: Views, keep, k: int = 50) -> DataFrame:
    rows = v.vectors.where(keep)
    return retrieval.nearest(rows, _probe(v), k).select(F.col("chunk_id").alias("vec_id"), "similarity", F.col("rank").cast("long").alias("rank"))


@query(_KNN + "SELECT vec_id, similarity, row_number() OVER (ORDER BY similarity DESC, vec_id) AS rank FROM s ORDER BY rank LIMIT 50")
def knn_topk(v):
    return _knn(v, F.lit(True))


@query(_KNN + "SELECT vec_id, similarity, row_number() OVER (ORDER BY similarity DESC, vec_id) AS rank FROM s WHERE label IN (1, 2) ORDER BY rank LIMIT 10")
def knn_filtered(v):
    return _knn(v, F.col("label").isin(1, 2), 10)


@query(_KNN + "SELECT vec_id, similarity, row_number() OVER (ORDER BY similarity DESC, vec_id) AS rank FROM s WHERE vec_id NOT IN (7, 15, 23, 31) ORDER BY rank LIMIT 5")
def knn_exclude(v):
    return _knn(v, ~F.col("chunk_id").isin(7, 15, 23, 31), 5)


_ALL = """WITH s AS (SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id) AS rank FROM s) """


@query(_ALL + "SELECT query_id, chunk_id, similarity, rank FROM r WHERE rank <= 5")
def knn_all_pairs(v):
    c = v.vectors.select("chunk_id", "embedding")
    return retrieval.knn(c.select(F.col("chunk_id").alias("query_id"), "embedding"), c, 5, keep="other").withColumn("rank", F.col("rank").cast("long"))


_HYBRID = _BM25 + f""", f AS (SELECT doc_id, row_number() OVER (ORDER BY round(s, 6) DESC, doc_id) AS rank FROM sc ORDER BY rank LIMIT 50),
v AS (SELECT e.vec_id AS doc_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS similarity FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 7) q WHERE e.vec_id IN (SELECT doc_id FROM documents)),
w AS (SELECT *, row_number() OVER (ORDER BY similarity DESC, doc_id) AS rank FROM v ORDER BY rank LIMIT 50),
h AS (SELECT coalesce(f.doc_id, w.doc_id) AS doc_id, f.rank AS fts_rank, w.rank AS vec_rank, similarity, round(coalesce(1.0 / (60 + f.rank), 0) + coalesce(1.0 / (60 + w.rank), 0), 9) AS score FROM f FULL JOIN w ON f.doc_id = w.doc_id) """


def _hybrid(v: Views, k: int) -> DataFrame:
    docs = v.raw("documents").select("doc_id")
    vecs = v.vectors.join(docs.select(F.col("doc_id").alias("chunk_id")), "chunk_id", "left_semi")
    near = retrieval.nearest(vecs, _probe(v)).select(F.col("chunk_id").alias("doc_id"), "similarity", "rank")
    out = retrieval.fuse(_bm25(v), near, "doc_id", k)
    return out.select("doc_id", F.col("fts_rank").cast("long").alias("fts_rank"), F.col("vec_rank").cast("long").alias("vec_rank"), "similarity", F.round("score", 9).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(_HYBRID + "SELECT doc_id, fts_rank, vec_rank, similarity, score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM h ORDER BY rank LIMIT 20")
def hybrid_search(v):
    return _hybrid(v, 20)


@query("""
WITH a AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents ORDER BY rank LIMIT 50), b AS (SELECT doc_id, row_number() OVER (ORDER BY text, doc_id) AS rank FROM documents ORDER BY rank LIMIT 50),
u AS (SELECT * FROM a UNION ALL SELECT * FROM b), s AS (SELECT doc_id, round(sum(1.0 / (60 + rank)), 9) AS score FROM u GROUP BY doc_id)
SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM s ORDER BY rank LIMIT 20""")
def rrf_hybrid(v):
    d = v.raw("documents")
    a, b = retrieval.top(d, 50, F.desc("n_chars"), F.asc("doc_id")), retrieval.top(d, 50, F.asc("text"), F.asc("doc_id"))
    s = retrieval.rrf(a, b, key="doc_id").select("doc_id", F.round("score", 9).alias("score"))
    return retrieval.top(s, 20, F.desc("score"), F.asc("doc_id")).withColumn("rank", F.col("rank").cast("long"))


@query("""
WITH g AS (SELECT i.id, coalesce(min(least(i.id, b.id)), -1 - i.id) AS g FROM items i LEFT JOIN items b ON i.paper_key = b.paper_key AND i.id <> b.id AND i.kind <> b.kind GROUP BY i.id),
a AS (SELECT chunk_id, embedding, g FROM vectors JOIN g ON g.id = chunk_id WHERE collection = 'archive'),
s AS (SELECT x.chunk_id AS query_id, y.chunk_id, round(list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]), 6) AS similarity FROM a x, a y WHERE x.g <> y.g)
SELECT query_id, chunk_id, similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id) AS rank FROM s QUALIFY rank <= 5""", "items", "vectors")
def related_items(v):
    """Nearest archive passages that are neither the item's own nor of its cluster."""
    group = clusters.groups(clusters.cluster(v.items.select("id"), clusters.partner_edges(v.items)))
    c = v.vectors.where("collection = 'archive'").join(group.withColumnRenamed("id", "chunk_id"), "chunk_id").select("chunk_id", "embedding", "group")
    near = retrieval.knn(c.select(F.col("chunk_id").alias("query_id"), "embedding", F.col("group").alias("qgroup")), c, 5, keep="group")
    return near.withColumn("rank", F.col("rank").cast("long"))


@query("""
WITH s AS (SELECT a.chunk_id AS id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS sim FROM vectors a, vectors b
  WHERE a.collection = 'archive' AND b.collection = 'archive' AND a.chunk_id <> b.chunk_id AND b.read_day >= DATE '2024-01-31' - 60 AND b.read_day <= DATE '2024-01-31')
SELECT id, round(least(1.0, greatest(0.0, 1 - max(sim))), 6) AS nov FROM s GROUP BY id""", "vectors")
def novelty(v):
    return clusters.novelty(v.vectors, F.lit(NOW[:10]).cast("date")).select("id", F.round("nov", 6).alias("nov"))


_TERMS = "list_distinct(list_filter(list_transform(regexp_extract_all(strip_accents(lower(title)), '" + TOKENS + "'), lambda x: trim(x, '.-')), lambda x: length(x) >= 2 AND x NOT IN (" + ", ".join(f"'{w}'" for w in text.SEARCH_STOPWORDS) + ")))"
_PAIRS = f"""pairs AS (SELECT b.id AS query_id, p.id AS target, {_TERMS.replace("title", "b.title")} AS terms, e.embedding FROM items b JOIN items p ON p.paper_key = b.paper_key AND p.kind = 'paper' AND b.kind = 'article' JOIN vectors c ON c.chunk_id = p.id AND c.collection = 'archive' JOIN embeddings e ON e.vec_id = b.id)"""


def _pairs(v: Views) -> DataFrame:
    pairs = lists.eval_pairs(v.items, v.vectors.where("collection = 'archive'"))
    return pairs.join(v.raw("embeddings").select(F.col("vec_id").alias("query_id"), "embedding"), "query_id")


@query("WITH " + _PAIRS + " SELECT query_id, target, len(terms) AS terms FROM pairs", "items", "vectors")
def eval_pairs(v):
    return _pairs(v).select("query_id", "target", F.size(text.search_terms(F.col("title"))).cast("long").alias("terms"))


@query(f"""
WITH {_PAIRS}, tok AS (SELECT doc_id, regexp_extract_all({_FOLD}, '{TOKENS}') AS t FROM documents), len_ AS (SELECT count(*) AS total, avg(len(t)) AS mean FROM tok),
post AS (SELECT doc_id, term, count(*) AS tf, any_value(n) AS length FROM (SELECT doc_id, unnest(t) AS term, len(t) AS n FROM tok) GROUP BY doc_id, term), df AS (SELECT term, count(*) AS n FROM post GROUP BY term),
arch AS (SELECT chunk_id, embedding FROM vectors JOIN documents ON doc_id = chunk_id WHERE collection = 'archive'), asked AS (SELECT query_id, unnest(terms) AS term FROM pairs),
sc AS (SELECT query_id, doc_id AS chunk_id, round(sum(greatest(1e-6, ln((total - n + 0.5) / (n + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 6) AS score FROM asked JOIN post USING (term) JOIN df USING (term), len_ GROUP BY 1, 2),
f AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM sc SEMI JOIN arch USING (chunk_id) WHERE chunk_id <> query_id QUALIFY rank <= 50),
w AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY round(list_cosine_similarity(p.embedding::DOUBLE[], a.embedding::DOUBLE[]), 6) DESC, chunk_id) AS rank FROM pairs p, arch a WHERE chunk_id <> query_id QUALIFY rank <= 50),
h AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY round(sum(1.0 / (60 + rank)), 9) DESC, chunk_id) AS rank FROM (SELECT * FROM f UNION ALL SELECT * FROM w) GROUP BY 1, 2),
m AS (SELECT 'fts' AS mode, * FROM f UNION ALL SELECT 'vector', * FROM w UNION ALL SELECT 'hybrid', * FROM h),
r AS (SELECT modes.mode, p.query_id, m.rank FROM pairs p CROSS JOIN (SELECT unnest(['fts', 'vector', 'hybrid']) AS mode) modes LEFT JOIN m ON m.mode = modes.mode AND m.query_id = p.query_id AND m.chunk_id = p.target AND m.rank <= 10)
SELECT mode, round(avg(coalesce((rank <= 1)::INT, 0)), 6) AS recall_1, round(avg(coalesce((rank <= 5)::INT, 0)), 6) AS recall_5, round(avg(coalesce((rank <= 10)::INT, 0)), 6) AS recall_10, round(avg(coalesce(1.0 / rank, 0)), 6) AS mrr FROM r GROUP BY mode""", "items", "vectors")
def retrieval_eval(v):
    """An article asks with its title and vector for the paper that it is about: keyword, vector and hybrid search over the archive, the article left out."""
    archive = v.passages.where("collection = 'archive'").withColumn("item_id", F.col("chunk_id"))
    return retrieval.evaluate(retrieval.search_ranks(_pairs(v).withColumn("text", F.col("title")), v.index, archive))


_WITHIN = "collection = 'archive' AND kind = 'article' AND source_id IN ('src1', 'src2', 'src3', 'src4') AND published_day >= DATE '2023-12-10' AND published_day <= DATE '2024-01-25' AND item_id NOT IN (6, 30)"
_FILTER = retrieval.SearchFilter(collections=("archive",), kinds=("article",), sources=("src1", "src2", "src3", "src4"), day_from=date(2023, 12, 10), day_to=date(2024, 1, 25), read_since=date(2023, 11, 20), exclude=(6, 30))
_FOUND = _BM25 + f""", f AS (SELECT chunk_id, row_number() OVER (ORDER BY round(s, 6) DESC, chunk_id) AS rank FROM sc JOIN passages ON chunk_id = doc_id WHERE {_WITHIN} ORDER BY rank LIMIT 50),
w AS (SELECT *, row_number() OVER (ORDER BY similarity DESC, chunk_id) AS rank FROM (SELECT chunk_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS similarity FROM passages e, (SELECT embedding FROM embeddings WHERE vec_id = 7) q WHERE {_WITHIN} AND read_day >= DATE '2023-11-20') ORDER BY rank LIMIT 50) """
_SIDES = {"fts": "SELECT chunk_id, rank AS fts_rank, NULL::BIGINT AS vec_rank, NULL::DOUBLE AS similarity FROM f", "vector": "SELECT chunk_id, NULL::BIGINT AS fts_rank, rank AS vec_rank, similarity FROM w", "hybrid": "SELECT coalesce(f.chunk_id, w.chunk_id) AS chunk_id, f.rank AS fts_rank, w.rank AS vec_rank, similarity FROM f FULL JOIN w ON f.chunk_id = w.chunk_id"}


def _search_sql(mode: str) -> str:
    return _FOUND + f", h AS (SELECT *, round(coalesce(1.0 / (60 + fts_rank), 0) + coalesce(1.0 / (60 + vec_rank), 0), 9) AS score FROM ({_SIDES[mode]})), r AS (SELECT chunk_id, chunk_id - chunk_id % 2 AS item_id, fts_rank, vec_rank, similarity, score, row_number() OVER (ORDER BY score DESC, chunk_id) AS rank FROM h ORDER BY rank LIMIT 20) "


def _search(v: Views, mode: str) -> DataFrame:
    found = retrieval.search(v.passages, None if mode == "vector" else v.index, " ".join(WORDS), None if mode == "fts" else _probe(v), _FILTER, mode, 20)
    ranks = [F.col(c).cast("long").alias(c) for c in ("fts_rank", "vec_rank", "rank")]
    return found.select("chunk_id", "item_id", *ranks, "similarity", F.round("score", 9).alias("score"))


def _search_query(mode: str) -> None:
    def run(v: Views) -> DataFrame:
        return _search(v, mode)

    run.__name__ = f"search_{mode}"
    query(_search_sql(mode) + "SELECT * FROM r", "passages")(run)


for _mode in _SIDES:
    _search_query(_mode)


@query(_search_sql("hybrid") + "SELECT item_id, row_number() OVER (ORDER BY min(rank)) AS place FROM r GROUP BY item_id", "passages")
def item_order(v):
    return retrieval.item_order(_search(v, "hybrid")).withColumn("place", F.col("place").cast("long"))


# Clusters

_EDGES = """WITH s AS (SELECT a.chunk_id AS a, b.chunk_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity FROM vectors a, vectors b WHERE a.chunk_id <> b.chunk_id AND abs(a.published_day - b.published_day) <= 14),
k AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY similarity DESC, b) AS r FROM s), e AS (SELECT a, b, similarity FROM k WHERE r <= 5 AND similarity >= 0.4) """
_ARCHIVE_EDGES = _EDGES.replace("WHERE a.chunk_id", "WHERE a.collection = 'archive' AND b.collection = 'archive' AND a.chunk_id")


@query(_EDGES + "SELECT a, b, similarity FROM e", "vectors")
def neighbour_edges(v):
    return clusters.neighbour_edges(v.vectors, 0.4)


@query(_EDGES + ", d AS (SELECT a, b FROM e UNION SELECT b, a FROM e), walk AS (SELECT chunk_id AS node, chunk_id AS seen FROM vectors UNION SELECT walk.node, d.b FROM walk JOIN d ON d.a = walk.seen), c AS (SELECT node, min(seen) AS comp FROM walk GROUP BY node) SELECT node AS id, CASE WHEN count(*) OVER (PARTITION BY comp) > 1 THEN comp END AS cluster_id FROM c", "vectors", recursive=True)
def cluster_components(v):
    return clusters.cluster(v.vectors.select(F.col("chunk_id").alias("id")), clusters.neighbour_edges(v.vectors, 0.4))


@query("SELECT a.id AS a, b.id AS b FROM items a JOIN items b ON a.paper_key = b.paper_key AND a.id < b.id AND a.kind <> b.kind", "items")
def arxiv_partners(v):
    return clusters.partner_edges(v.items)


@query("SELECT a.id, b.id AS sibling FROM items a JOIN items b ON a.paper_key = b.paper_key AND a.id <> b.id AND a.kind <> b.kind", "items")
def cluster_siblings(v):
    return clusters.siblings(clusters.cluster(v.items, clusters.partner_edges(v.items)))


@query("""WITH e AS (SELECT least(a.id, b.id) AS a, greatest(a.id, b.id) AS b FROM items a JOIN items b ON a.paper_key = b.paper_key AND a.id < b.id AND a.kind <> b.kind)
SELECT i.id, coalesce(x.a, y.a) AS cluster_id FROM items i LEFT JOIN e x ON x.a = i.id LEFT JOIN e y ON y.b = i.id""", "items")
def cluster_incremental(v):
    """Items of the second half join clusters of the first, which stay whole."""
    edges = clusters.partner_edges(v.items)
    old = clusters.cluster(v.items.where("id % 8 < 4"), edges.where("a % 8 < 4 AND b % 8 < 4"))
    return clusters.cluster(v.items, edges, old)


# The list

_SHOWN = {
    "unread": "NOT opened AND NOT hidden AND NOT list_has_any(flags, ['promo', 'thin'])", "all": "NOT hidden AND NOT list_has_any(flags, ['promo', 'thin'])",
    "saved": "saved", "liked": "liked", "hidden": "hidden", "new": "NOT opened AND NOT hidden AND first_seen > TIMESTAMP '2024-01-10' AND NOT list_has_any(flags, ['promo', 'thin'])",
}
_COLS = ["id", "source_id", "kind", "popularity", "liked", "saved", "hidden", "opened", "minutes", "score", "relevance"]
_COLS_SQL = "id, source_id, kind, popularity, liked, saved, hidden, opened, minutes, round(score, 6) AS score, relevance"


def _list_query(show: str):
    def run(v: Views) -> DataFrame:
        f = lists.ItemFilter(show=show, visit=datetime(2024, 1, 10) if show == "new" else None)
        return _listed(v).where(lists.conditions(f)).select(*_COLS).withColumn("score", F.round("score", 6))

    run.__name__ = f"list_{show}"
    query(f"SELECT {_COLS_SQL} FROM listed WHERE {_SHOWN[show]}", "listed")(run)


for _show in _SHOWN:
    _list_query(_show)


@query(f"SELECT {_COLS_SQL} FROM listed WHERE (NOT opened AND NOT hidden AND first_seen >= TIMESTAMP '2024-01-24' AND source_id IN ('src1', 'src2', 'src3') AND kind = 'article' AND list_has_any(tags, ['en', 'src2']) AND NOT list_has_any(flags, ['promo', 'thin'])) OR id = 3", "listed")
def list_filtered(v):
    f = lists.ItemFilter(show="unread", since=datetime(2024, 1, 24), sources=("src1", "src2", "src3"), kinds=("article",), tags=("en", "src2"), pinned=3)
    return _listed(v).where(lists.conditions(f)).select(*_COLS).withColumn("score", F.round("score", 6))


@query("SELECT i.id, CASE WHEN opened THEN CASE WHEN read_progress >= 0.9 THEN 'read' ELSE 'partial' END ELSE 'unread' END AS state, coalesce(published_at IS NOT NULL AND first_seen - published_at > INTERVAL 90 DAYS, false) AS is_old FROM listed i", "listed")
def read_state_and_age(v):
    rows = _listed(v)
    return rows.select("id", score.read_state(F.when(F.col("opened"), F.lit(1)), F.col("read_progress")).alias("state"), score.is_old(F.col("published_at"), F.col("first_seen")).alias("is_old"))


_NEWEST_SQL = "first_seen DESC, coalesce(published_at, first_seen) DESC, id DESC"
_ORDERS = {
    "newest": _NEWEST_SQL, "score": f"score DESC NULLS LAST, {_NEWEST_SQL}", "popular": "popularity DESC NULLS LAST, first_seen DESC, id DESC", "reading_time": "words ASC NULLS LAST, first_seen DESC, id DESC",
}


def _sort_query(name: str):
    def run(v: Views) -> DataFrame:
        return lists.page(_listed(v), name).select("id", F.col("position_no").cast("long").alias("position_no"))

    run.__name__ = f"sort_{name}"
    query(f"SELECT id, row_number() OVER (ORDER BY {_ORDERS[name]}) AS position_no FROM listed ORDER BY position_no LIMIT 500", "listed")(run)


for _order in _ORDERS:
    _sort_query(_order)


@query("WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS position FROM documents ORDER BY position LIMIT 40) SELECT id, row_number() OVER (ORDER BY position NULLS LAST, first_seen DESC, coalesce(published_at, first_seen) DESC, id DESC) AS position_no FROM items LEFT JOIN r ON r.doc_id = id ORDER BY position_no LIMIT 500", "items")
def sort_ranked_position(v):
    r = retrieval.top(v.raw("documents"), 40, F.desc("n_chars"), F.asc("doc_id"), rank="position").select(F.col("doc_id").alias("id"), "position")
    return lists.page(v.items.join(r, "id", "left"), "ranked").select("id", F.col("position_no").cast("long").alias("position_no"))


@query("SELECT tag, count(DISTINCT id) AS n FROM (SELECT id, unnest(tags) AS tag FROM listed WHERE NOT hidden) GROUP BY tag", "listed")
def tag_facet(v):
    return lists.tag_facet(_listed(v).where("NOT hidden"))


@query("WITH f AS (SELECT id, unnest(flags) AS flag FROM listed WHERE NOT hidden) SELECT flag, count(DISTINCT id) AS n FROM f WHERE flag IN ('promo', 'thin') GROUP BY flag UNION ALL SELECT '(total)', count(DISTINCT id) FROM f WHERE flag IN ('promo', 'thin')", "listed")
def hidden_facet(v):
    return lists.hidden_facet(_listed(v).where("NOT hidden"))


@query("SELECT source_id, count(*) AS n, count(*) FILTER (WHERE kind = 'paper') AS papers FROM items GROUP BY source_id", "items")
def items_per_source(v):
    return v.items.groupBy("source_id").agg(F.count("*").alias("n"), F.count_if(F.col("kind") == "paper").alias("papers"))


@query("SELECT DISTINCT source_id FROM items i JOIN item_state s ON s.item_id = i.id WHERE liked AND NOT hidden", "items", "item_state")
def liked_sources(v):
    return v.items.join(v.item_state.where("liked AND NOT hidden").select(F.col("item_id").alias("id")), "id", "left_semi").select("source_id").distinct()


@query("SELECT id, origin, enabled, row_number() OVER (ORDER BY origin, id) AS n FROM sources WHERE enabled", "sources")
def enabled_sources(v):
    return v.sources.where("enabled").select("id", "origin", "enabled", F.row_number().over(Window.orderBy("origin", "id")).cast("long").alias("n"))


@query("SELECT id FROM items WHERE first_seen >= TIMESTAMP '2024-01-20' AND first_seen < TIMESTAMP '2024-01-31' AND id NOT IN (SELECT item_id FROM triage)", "items", "triage")
def untriaged_range(v):
    recent = v.items.where((F.col("first_seen") >= F.lit("2024-01-20").cast("timestamp_ntz")) & (F.col("first_seen") < now()))
    return recent.join(v.triage.select(F.col("item_id").alias("id")), "id", "left_anti").select("id")


@query(f"SELECT id FROM items WHERE first_seen::DATE = DATE '{DAY}' AND id NOT IN (SELECT item_id FROM digests WHERE day < DATE '{DAY}')", "items", "digests")
def not_in_earlier_digest(v):
    return ranking.candidates(v.items, v.digests, F.lit(DAY).cast("date")).select("id")


@query("SELECT item_id, observed_on::VARCHAR AS observed_on, s.u AS upvotes, s.u7 AS upvotes7d, s.c AS comments FROM latest_signals", "latest_signals")
def latest_signals(v):
    return lists.latest(v.signals, "item_id", "observed_on").withColumn("observed_on", F.col("observed_on").cast("string"))


@query("SELECT i.id, i.title FROM items i WHERE kind = 'article' AND length(summary) < 200 AND published_at IS NOT NULL ORDER BY first_seen DESC, id DESC LIMIT 40", "items")
def needs_enrichment(v):
    rows = v.items.where("kind = 'article' AND length(summary) < 200 AND published_at IS NOT NULL")
    return rows.orderBy(F.desc("first_seen"), F.desc("id")).limit(40).select("id", "title")


@query("SELECT d.item_id, row_number() OVER (ORDER BY final_score DESC, d.item_id) AS n FROM digests d LEFT JOIN triage t ON t.item_id = d.item_id WHERE day = DATE '2024-01-26' AND NOT coalesce(list_has_any(flags, ['promo', 'thin']), false) ORDER BY n LIMIT 10", "digests", "triage")
def top_digest_items(v):
    rows = v.digests.where(F.col("day") == F.lit("2024-01-26").cast("date")).join(v.triage.select("item_id", "flags"), "item_id", "left").where(~F.coalesce(lists.hidden_by_triage(), F.lit(False)))
    return retrieval.top(rows, 10, F.desc("final_score"), F.asc("item_id"), rank="n").select("item_id", F.col("n").cast("long").alias("n"))


# Ranking

_POP = """, have AS (SELECT i.id, i.source_id, CASE recipe_type WHEN 'hf_papers' THEN ls.s.u WHEN 'hf_blog' THEN ls.s.u7 WHEN 'hf_community' THEN ls.s.u7 END AS value FROM items i JOIN sources src ON src.id = i.source_id JOIN latest_signals ls ON ls.item_id = i.id WHERE first_seen >= TIMESTAMP '2024-01-31' - INTERVAL 30 DAYS),
pop AS (SELECT id AS item_id, (rank() OVER (PARTITION BY source_id ORDER BY value) - 1 + 0.5 * count(*) OVER (PARTITION BY source_id, value)) / count(*) OVER (PARTITION BY source_id) AS pop FROM have WHERE value IS NOT NULL)"""


def _pop(v: Views) -> DataFrame:
    return ranking.popularity(v.items, v.sources, v.signals, now())


@query("WITH x AS (SELECT 1)" + _POP + " SELECT item_id, round(pop, 6) AS pop FROM pop", "items", "sources", "latest_signals")
def popularity_percentile(v):
    return _pop(v).select("item_id", F.round("pop", 6).alias("pop"))


@query("SELECT event_id, round((rank() OVER (PARTITION BY event_type ORDER BY value) - 1 + 0.5 * count(*) OVER (PARTITION BY event_type, value)) / count(*) OVER (PARTITION BY event_type), 6) AS p FROM events")
def mid_rank_percentile(v):
    return ranking.mid_ranks(v.raw("events").select("event_id", "event_type", "value"), "value", "event_type", "p").select("event_id", F.round("p", 6).alias("p"))


_AFFINITY = """SELECT source_id, count(*) FILTER (WHERE liked AND NOT hidden) AS likes, count(*) FILTER (WHERE read_at IS NOT NULL OR liked) AS seen FROM items i LEFT JOIN item_state s ON s.item_id = i.id GROUP BY source_id"""


@query(f"WITH a AS ({_AFFINITY}) SELECT source_id, likes, seen, round(((likes + 1) / (seen + 10)) / max((likes + 1) / (seen + 10)) OVER (), 6) AS source FROM a", "items", "item_state")
def source_affinity(v):
    return ranking.source_affinity(v.items, v.item_state).withColumn("source", F.round("source", 6))


_STOP = "[" + ", ".join(f"'{w}'" for w in text.TOPIC_STOPWORDS) + "]"


def _topics(column: str) -> str:
    return f"list_distinct(list_filter(list_transform(regexp_extract_all(lower({column}), '{TOKENS}'), lambda t: regexp_replace(t, '^[._-]+|[._-]+$', '', 'g')), lambda t: length(t) BETWEEN 2 AND 40 AND NOT list_contains({_STOP}, t) AND regexp_matches(t, '\\pL')))"


_LIKED = f"""WITH l AS (SELECT {_topics('title')} AS a, {_topics('summary')} AS b FROM items WHERE id IN (SELECT item_id FROM item_state WHERE liked AND NOT hidden)),
t AS (SELECT a, unnest(list_distinct(list_concat(a, b))) AS term FROM l), c AS (SELECT term, count(*) AS n, count(*) FILTER (WHERE list_contains(a, term)) AS n_title FROM t GROUP BY term)"""


@query(_LIKED + " SELECT term, n, n_title FROM c ORDER BY n DESC, n_title DESC, term LIMIT 30", "items", "item_state")
def liked_terms(v):
    return ranking.liked_terms(v.items, v.item_state)


def _terms(v: Views) -> list[str]:
    rows = ranking.liked_terms(v.items, v.item_state).collect()  # thirty rows at most
    return [r["term"] for r in sorted(rows, key=lambda r: (-r["n"], -r["n_title"], r["term"]))]


_TOP_TERMS = _LIKED + ", tt AS (SELECT term, row_number() OVER (ORDER BY n DESC, n_title DESC, term) AS i FROM c ORDER BY i LIMIT 30)"


@query(_TOP_TERMS + f""", k AS (SELECT id, list_transform(regexp_extract_all(lower(concat_ws(' ', title, summary)), '{TOKENS}'), lambda t: regexp_replace(t, '^[._-]+|[._-]+$', '', 'g')) AS t FROM items),
f AS (SELECT id, list([term] ORDER BY i) FILTER (WHERE len(list_filter(t, lambda x: starts_with(x, term))) > 0) AS w FROM k, tt GROUP BY id),
p AS (SELECT id, list_reduce(list_prepend([], coalesce(w, [])), lambda a, b: CASE WHEN len(list_filter(a, lambda h: starts_with(h, b[1]) OR starts_with(b[1], h))) > 0 THEN a ELSE list_concat(a, b) END) AS w FROM f)
SELECT id, coalesce(w[1:3], []) AS matched FROM k LEFT JOIN p USING (id)""", "items", "item_state")
def matched_terms(v):
    return ranking.matched_terms(v.items, _terms(v))


@query(_TOP_TERMS + f""", k AS (SELECT id, regexp_extract_all(strip_accents(lower(concat_ws(' ', title, summary))), '{TOKENS}') AS t FROM items),
n AS (SELECT id, len(t) AS length, i, len(list_filter(t, lambda x: starts_with(x, term))) AS tf FROM k, tt), st AS (SELECT i, count(*) FILTER (WHERE tf > 0) AS n, count(*) AS total, avg(length) AS mean FROM n GROUP BY i),
s AS (SELECT id, sum(CASE WHEN tf > 0 THEN greatest(1e-6, ln((total - n + 0.5) / (n + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean)) ELSE 0 END) AS raw FROM n JOIN st USING (i) GROUP BY id)
SELECT id, round(CASE WHEN max(raw) OVER () > 0 THEN raw / max(raw) OVER () ELSE 0.0 END, 6) AS topic FROM s""", "items", "item_state")
def topic_scores(v):
    return ranking.topic_scores(v.items, _terms(v)).withColumn("topic", F.round("topic", 6))


_DAY = "WITH x AS (SELECT 1)" + _POP + f""", nv AS (SELECT a.chunk_id AS id, round(least(1.0, greatest(0.0, 1 - max(round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6)))), 6) AS nov FROM vectors a, vectors b WHERE a.collection = 'archive' AND b.collection = 'archive' AND a.chunk_id <> b.chunk_id AND b.read_day >= DATE '2024-01-31' - 60 AND b.read_day <= DATE '2024-01-31' GROUP BY a.chunk_id),
aff AS (SELECT source_id, ((likes + 1) / (seen + 10)) / max((likes + 1) / (seen + 10)) OVER () AS source FROM ({_AFFINITY})),
c AS (SELECT i.id, i.source_id, first_seen, t.relevance / 10.0 AS rel, pop.pop, exp(-greatest(0.0, epoch(TIMESTAMP '2024-01-31' - coalesce(published_at, first_seen)) / 86400.0) / 3) AS rec, nv.nov, aff.source, coalesce(list_has_any(flags, ['promo', 'thin']), false) AS hidden
  FROM items i LEFT JOIN triage t ON t.item_id = i.id LEFT JOIN pop ON pop.item_id = i.id LEFT JOIN nv ON nv.id = i.id LEFT JOIN aff ON aff.source_id = i.source_id WHERE first_seen::DATE = DATE '{DAY}' AND i.id NOT IN (SELECT item_id FROM digests WHERE day < DATE '{DAY}'))"""
_DAY_VIEWS = ("items", "sources", "latest_signals", "item_state", "vectors", "triage", "digests")


def _weighted(weights: dict[str, float]) -> str:
    top = " + ".join(f"coalesce({k}, 0) * {w}" for k, w in weights.items())
    base = " + ".join(f"CASE WHEN {k} IS NULL THEN 0 ELSE {w} END" for k, w in weights.items())
    return f"round(CASE WHEN {base} > 0 THEN ({top})::DOUBLE / ({base})::DOUBLE ELSE 0 END, 6)"


def _digest(v: Views, mode: str) -> DataFrame:
    cands = ranking.candidates(v.items, v.digests, F.lit(DAY).cast("date"))
    more = {}
    if mode == "ai":
        more["novelty"] = clusters.novelty(v.vectors, F.lit(NOW[:10]).cast("date")).withColumn("nov", F.round("nov", 6))
    if mode == "likes":
        more["source"] = ranking.source_affinity(v.items, v.item_state)
    return ranking.digest(cands, v.triage, _pop(v), now(), mode, **more).select("id", "final", "hidden", F.col("position").cast("long").alias("position"))


def _digest_query(name: str, mode: str, weights: dict[str, float]):
    def run(v: Views) -> DataFrame:
        return _digest(v, mode)

    run.__name__ = name
    query(_DAY + f" SELECT id, {_weighted(weights)} AS final, hidden, row_number() OVER (ORDER BY {_weighted(weights)} DESC, first_seen DESC, id) AS position FROM c", *_DAY_VIEWS)(run)


_digest_query("digest_day", "ai", ranking.WEIGHTS["ai"])
_digest_query("combine_scores_cold", "cold", ranking.WEIGHTS["cold"])


@query(_DAY + f" SELECT id, {_weighted({'source': 0.2, 'rec': 0.3})} AS final FROM c", *_DAY_VIEWS)
def combine_scores_likes(v):
    """Liked sources and freshness alone: the topic is missing, and its weight goes to the others."""
    cands = ranking.candidates(v.items, v.digests, F.lit(DAY).cast("date"))
    return ranking.digest(cands, v.triage, _pop(v), now(), "likes", source=ranking.source_affinity(v.items, v.item_state)).select("id", "final")


# Spending

@query("SELECT day::VARCHAR AS day, sum(tokens_in)::BIGINT AS tokens_in, sum(tokens_out)::BIGINT AS tokens_out, round(sum(cost_usd), 6) AS cost_usd, count(*) AS calls FROM usage GROUP BY day", "usage")
def spend_by_day(v):
    return v.usage.groupBy(F.col("day").cast("string").alias("day")).agg(F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.round(F.sum("cost_usd"), 6).alias("cost_usd"), F.count("*").alias("calls"))


@query("SELECT id, coalesce(sum(round(cost_usd, 9)::DECIMAL(18, 9)) OVER (PARTITION BY day ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 5 AS allowed FROM usage", "usage")
def budget_gate(v):
    exact = v.usage.withColumn("cost_usd", F.round("cost_usd", 9).cast("decimal(18,9)"))
    return state.budget(exact, 5.0).select("id", "allowed")


@query("WITH p AS (SELECT * FROM (VALUES ('view', 1.0, 2.0), ('open', 3.0, 15.0), ('like', 0.5, 1.5)) AS t(model, i, o)) SELECT action AS model, count(*) AS calls, round(sum((k * 100 * i + k * 10 * o) / 1e6), 6) AS cost, sum(CASE WHEN i IS NULL THEN k * 110 ELSE 0 END)::BIGINT AS unpriced_tokens FROM interactions LEFT JOIN p ON p.model = action GROUP BY action", "interactions")
def price_cost(v):
    table = v.spark.createDataFrame([("view", 1.0, 2.0), ("open", 3.0, 15.0), ("like", 0.5, 1.5)], "action string, i double, o double")
    calls = v.interactions.join(F.broadcast(table), "action", "left")
    return calls.groupBy(F.col("action").alias("model")).agg(F.count("*").alias("calls"), F.round(F.sum(score.price(F.col("k") * 100, F.col("k") * 10, F.col("i"), F.col("o"))), 6).alias("cost"), F.sum(F.when(F.col("i").isNull(), F.col("k") * 110).otherwise(0)).cast("long").alias("unpriced_tokens"))


# State

@query("SELECT item_id, count(*) FILTER (WHERE action = 'like') % 2 = 1 AS like, count(*) FILTER (WHERE action = 'save') % 2 = 1 AS save, count(*) FILTER (WHERE action = 'hide') % 2 = 1 AS hide FROM interactions GROUP BY item_id", "interactions")
def toggle_state(v):
    return state.toggles(v.interactions, "item_id", ["like", "save", "hide"])


@query("SELECT item_id, min(ts) AS read_at, count(*) AS opens FROM interactions WHERE action = 'open' GROUP BY item_id", "interactions")
def first_open(v):
    return v.interactions.where("action = 'open'").groupBy("item_id").agg(F.min("ts").alias("read_at"), F.count("*").alias("opens"))


@query("SELECT item_id, round(max(least(1.0, greatest(0.0, value / 100))), 6) AS read_progress FROM interactions GROUP BY item_id", "interactions")
def progress_max(v):
    return state.progress(v.interactions, "item_id", F.col("value") / 100).withColumn("read_progress", F.round("read_progress", 6))


@query("""WITH a AS (SELECT item_id, action <> 'hide' AS ok, ts, id, max(CASE WHEN action <> 'hide' THEN ts END) OVER (PARTITION BY item_id) AS last_ok, sum((action <> 'hide')::INT) OVER (PARTITION BY item_id ORDER BY ts DESC, id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS later FROM interactions),
f AS (SELECT item_id, count(*) FILTER (WHERE NOT ok AND later = 0) AS failures, any_value(last_ok) AS last_ok FROM a GROUP BY item_id)
SELECT item_id, failures, CASE WHEN failures >= 3 THEN 'broken' WHEN failures >= 1 THEN 'degraded' WHEN last_ok IS NOT NULL THEN 'ok' ELSE 'never' END AS health FROM f""", "interactions")
def source_health(v):
    f = state.failures(v.interactions, "item_id", F.col("action") != "hide", "ts", "id")
    return f.select("item_id", "failures", score.health(F.col("failures"), F.col("last_ok")).alias("health"))


@query("""WITH t AS (SELECT doc_id AS key, title, summary, CASE WHEN doc_id % 7 <> 0 THEN published_at END AS published_at, first_seen, first_seen AS last_seen FROM (SELECT *, id AS doc_id FROM items) WHERE id % 3 <> 0),
b AS (SELECT id AS key, 'new ' || title AS n_title, CASE WHEN id % 2 = 0 THEN '' ELSE 'fresh' END AS n_summary, TIMESTAMP '2024-01-01' AS n_published FROM items WHERE id % 2 = 0 OR id % 5 = 0)
SELECT coalesce(t.key, b.key) AS key, coalesce(n_title, title) AS title, sha1(coalesce(nullif(n_summary, ''), summary, n_summary)) AS summary_sha1, coalesce(published_at, n_published) AS published_at, coalesce(first_seen, TIMESTAMP '2024-01-31') AS first_seen,
  CASE WHEN n_title IS NOT NULL THEN TIMESTAMP '2024-01-31' ELSE last_seen END AS last_seen, CASE WHEN first_seen IS NULL THEN 1 ELSE 1 + (n_title IS NOT NULL AND last_seen::DATE < DATE '2024-01-31')::INT END AS times_seen,
  coalesce(coalesce(published_at, n_published) IS NOT NULL AND coalesce(first_seen, TIMESTAMP '2024-01-31') - coalesce(published_at, n_published) > INTERVAL 90 DAYS, false) AS is_old FROM t FULL JOIN b ON t.key = b.key""", "items")
def item_upsert_merge(v):
    t = v.items.where("id % 3 <> 0").select(F.col("id").alias("key"), "title", "summary", "published_at", "first_seen", F.col("first_seen").alias("last_seen"), F.lit(1).cast("long").alias("times_seen"))
    b = v.items.where("id % 2 = 0 OR id % 5 = 0").select(F.col("id").alias("key"), F.concat(F.lit("new "), "title").alias("title"), F.expr("CASE WHEN id % 2 = 0 THEN '' ELSE 'fresh' END").alias("summary"), F.lit("2024-01-01").cast("timestamp_ntz").alias("published_at"))
    out = state.upsert_items(t, b, now())
    return out.select("key", "title", F.sha1("summary").alias("summary_sha1"), "published_at", "first_seen", "last_seen", F.col("times_seen").cast("int").alias("times_seen"), "is_old")


@query("WITH u AS (SELECT item_id, action, ts, id, value FROM interactions) SELECT item_id, action, arg_max(value, (ts, id)) AS value, max(ts) AS ts FROM u GROUP BY item_id, action", "interactions")
def signals_upsert(v):
    rows = v.interactions.select("item_id", "action", F.struct("ts", "id").alias("w"), "value")
    out = state.upsert_last(rows.where("item_id % 2 = 0"), rows.where("item_id % 2 <> 0"), ["item_id", "action"], "w")
    return out.select("item_id", "action", "value", F.col("w.ts").alias("ts"))


_TRACKED = "'fbclid', 'gclid', 'dclid', 'msclkid', 'mc_cid', 'mc_eid', 'ref', 'ref_src', 'igshid'"
_VARIANT = "CASE page_id % 5 WHEN 0 THEN url WHEN 1 THEN url || '/?utm_source=x&b=2&a=1#top' WHEN 2 THEN upper(split_part(url, '://', 1)) || '://' || upper(split_part(split_part(url, '://', 2), '/', 1)) || substr(url, length(split_part(url, '://', 1)) + 4 + length(split_part(split_part(url, '://', 2), '/', 1))) WHEN 3 THEN url || '?ref=feed&Q=z' ELSE url || '?fbclid=1' END"


def _variants(v: Views) -> DataFrame:
    u = F.col("url")
    host = F.split_part(F.split_part(u, F.lit("://"), F.lit(2)), F.lit("/"), F.lit(1))
    scheme = F.split_part(u, F.lit("://"), F.lit(1))
    shout = F.concat(F.upper(scheme), F.lit("://"), F.upper(host), F.substr(u, F.length(scheme) + 4 + F.length(host)))
    m = F.col("page_id") % 5
    return v.raw("pages").select("page_id", F.when(m == 0, u).when(m == 1, F.concat(u, F.lit("/?utm_source=x&b=2&a=1#top"))).when(m == 2, shout).when(m == 3, F.concat(u, F.lit("?ref=feed&Q=z"))).otherwise(F.concat(u, F.lit("?fbclid=1"))).alias("u"))


_CANON = f"""WITH v AS (SELECT page_id, {_VARIANT} AS u FROM pages), p AS (SELECT page_id, u, lower(regexp_extract(u, '^([A-Za-z]+)://', 1)) AS scheme, regexp_replace(regexp_replace(u, '^[A-Za-z]+://', ''), '#.*$', '') AS rest FROM v),
h AS (SELECT *, lower(regexp_extract(rest, '^([^/?]*)', 1)) AS host, regexp_replace(regexp_extract(rest, '^[^/?]*(/[^?]*)', 1), '/+$', '') AS path,
  list_sort(list_transform(list_filter(string_split(regexp_extract(rest, '\\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT starts_with(lower(split_part(x, '=', 1)), 'utm_') AND lower(split_part(x, '=', 1)) NOT IN ({_TRACKED})), lambda x: CASE WHEN contains(x, '=') THEN x ELSE x || '=' END)) AS q FROM p),
c AS (SELECT page_id, u, scheme || '://' || host || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN len(q) = 0 THEN '' ELSE '?' || array_to_string(q, '&') END AS canonical FROM h)"""


@query(_CANON + " SELECT page_id, canonical, 'web:' || substr(sha1(canonical), 1, 16) AS item_id FROM c")
def canonical_url(v):
    c = _variants(v)
    return c.select("page_id", address.canonical_url(F.col("u")).alias("canonical"), address.item_id(F.lit("article"), F.col("u"), F.lit(None).cast("string")).alias("item_id"))


@query(_CANON + " SELECT canonical, min(page_id) AS first_page, count(*) AS copies FROM c GROUP BY canonical")
def dedupe_by_canonical(v):
    return _variants(v).groupBy(address.canonical_url(F.col("u")).alias("canonical")).agg(F.min("page_id").alias("first_page"), F.count("*").alias("copies"))


@query("SELECT id, CASE WHEN kind = 'paper' THEN 'arxiv:' || printf('%04d.%05d', (2000 + id % 100)::INT, (id % 100000)::INT) ELSE NULL END AS item_id, sha1(title || chr(10) || summary) AS content_hash FROM items", "items")
def item_id(v):
    mention = F.format_string("see https://arxiv.org/abs/%04d.%05dv2 for more", (2000 + F.col("id") % 100).cast("int"), (F.col("id") % 100000).cast("int"))
    paper = address.paper_id(mention)
    return v.items.select("id", F.when(F.col("kind") == "paper", address.item_id(F.col("kind"), F.col("url"), paper)).alias("item_id"), address.content_hash(F.col("title"), F.col("summary")).alias("content_hash"))


# Text

@query("SELECT page_id, md5(trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '\\s+', ' ', 'g'))) AS text_md5 FROM pages")
def strip_html(v):
    return v.raw("pages").select("page_id", F.md5(text.plain_text(F.col("html"))).alias("text_md5"))


_UNESCAPED = "regexp_extract(html, '(?s)<title>(.*?)</title>', 1)"
for _entity, _char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "''"), ("&amp;", "&")):
    _UNESCAPED = f"replace({_UNESCAPED}, '{_entity}', '{_char}')"


@query(f"SELECT page_id, trim(regexp_replace({_UNESCAPED}, '\\s+', ' ', 'g')) AS title FROM pages")
def page_title(v):
    return v.raw("pages").select("page_id", markup.page_meta("html", "url")["title"].alias("title"))


@query()
def page_articles(v):
    return v.raw("pages").select("page_id", markup.extract_article("html").alias("a")).select("page_id", "a.*")


@query("SELECT page_id, len(regexp_extract_all(html, '<a\\s')) AS n_links, len(regexp_extract_all(html, '<p[\\s>]')) AS n_paragraphs FROM pages")
def page_links(v):
    return v.raw("pages").select("page_id", F.regexp_count("html", F.lit(r"<a\s")).cast("long").alias("n_links"), F.regexp_count("html", F.lit(r"<p[\s>]")).cast("long").alias("n_paragraphs"))


@query("SELECT item_id, words, CASE WHEN words > 0 THEN greatest(1, round_even(words / 230.0, 0)::INT) END AS minutes FROM contents", "contents")
def word_count(v):
    return v.contents.select("item_id", "words", score.reading_minutes(F.col("words")).alias("minutes"))


@query("SELECT doc_id, CASE WHEN length(t) <= 140 THEN t ELSE rtrim(substr(t, 1, 139)) || '…' END AS clipped FROM (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents)")
def clip_text(v):
    return v.raw("documents").select("doc_id", text.clip(F.col("text"), 140).alias("clipped"))


@query("SELECT doc_id, md5(regexp_replace(text, '[\\x00-\\x08\\x0b-\\x1f\\x7f-\\x9f]', '', 'g')) AS text_md5 FROM documents")
def control_strip(v):
    noisy = F.concat(F.lit("\x1b[31m"), F.replace("text", F.lit("\n"), F.lit("\r\n")), F.lit("\x07\x1b[0m"))
    return v.raw("documents").select("doc_id", F.md5(text.strip_controls(noisy)).alias("text_md5"))


@query(r"""WITH b AS (SELECT doc_id, list_filter(list_transform(list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '' AND NOT regexp_matches(x, '^(#|>|\||```|- |\* |\[image:|!)')),
  lambda x: trim(regexp_replace(replace(regexp_replace(regexp_replace(x, '\[([^\]]*)\]\([^)]*\)', '\1', 'g'), '\\([\\`*_{}\[\]()#+\-.!|>])', '\1', 'g'), '**', ''), '\s+', ' ', 'g'))), lambda x: length(x) >= 80) AS p FROM documents),
n AS (SELECT doc_id, p, list_transform(range(1, len(p) + 1), lambda i: list_sum(list_prepend(0, list_transform(p[1:i - 1], lambda x: length(x))))) AS before FROM b),
t AS (SELECT doc_id, coalesce(array_to_string(list_filter(p, lambda x, i: before[i] < 300), ' '), '') AS t FROM n)
SELECT doc_id, CASE WHEN length(t) <= 600 THEN t ELSE regexp_replace(substr(t, 1, 599), ' [^ ]*$', '') || '…' END AS lead FROM t""")
def lead_paragraph(v):
    return v.raw("documents").select("doc_id", text.lead_paragraph(F.replace("text", F.lit("\n"), F.lit("\n\n"))).alias("lead"))


@query("SELECT doc_id, ceil(length(text) / 4.0)::BIGINT AS tokens FROM documents")
def estimate_tokens(v):
    return v.raw("documents").select("doc_id", text.estimate_tokens(F.col("text")).alias("tokens"))


@query("SELECT page_id, CASE WHEN s = '' THEN 'source' ELSE s END AS slug FROM (SELECT page_id, rtrim(substr(trim(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '-'), 1, 63), '-') AS s FROM pages)")
def slugs(v):
    return v.raw("pages").select("page_id", address.slug(F.col("url")).alias("slug"))


# Passages

@query()
def chunk_documents(v):
    return chunks.chunk_documents(v.raw("documents"), "doc_id", "text")


@query("SELECT doc_id, true AS ok FROM documents")
def chunk_offsets_ok(v):
    """Whether every passage is what its offsets say and no longer than the limit."""
    c = chunks.chunk_documents(v.raw("documents"), "doc_id", "text").join(v.raw("documents").select("doc_id", F.col("text").alias("md")), "doc_id")
    good = (F.substr("md", F.col("char_start") + 1, F.col("char_end") - F.col("char_start")) == F.col("text")) & ((F.col("char_end") - F.col("char_start") <= chunks.LIMIT) | F.startswith("text", F.lit("|")))
    by = c.groupBy("doc_id").agg(F.min(good).alias("ok"))
    return v.raw("documents").select("doc_id").join(by, "doc_id", "left").select("doc_id", F.coalesce("ok", F.lit(True)).alias("ok"))


_ARCHIVE = "SELECT id, sha1('1' || chr(10) || array_to_string(list_filter([trim(regexp_replace(title, '\\s+', ' ', 'g')), trim(summary), 'Source: ' || source_id, CASE WHEN len(tags) > 0 THEN 'Tags: ' || array_to_string(tags, ', ') END], lambda x: x IS NOT NULL AND x <> ''), chr(10))) AS hash FROM items LEFT JOIN triage ON item_id = id"


def _archive(v: Views) -> DataFrame:
    rows = v.items.join(v.triage.select(F.col("item_id").alias("id"), "tags"), "id", "left")
    return rows.select("id", chunks.passage_hash(chunks.archive_text(F.col("title"), F.col("summary"), F.col("source_id"), F.coalesce("tags", F.array().cast("array<string>")))).alias("hash"))


@query(_ARCHIVE, "items", "triage")
def archive_text_hash(v):
    return _archive(v)


@query("SELECT id, CASE WHEN id % 6 = 0 THEN 'missing' ELSE 'changed' END AS reason FROM items WHERE id % 6 = 0 OR id % 5 = 0", "items")
def stale_archive(v):
    texts = _archive(v)
    return chunks.stale(texts, texts.where("id % 6 <> 0").withColumn("hash", F.when(F.col("id") % 5 == 0, F.lit("old")).otherwise(F.col("hash"))), "id")


@query("SELECT vec_id AS chunk_id FROM embeddings WHERE vec_id % 3 = 0 OR vec_id % 7 = 0 OR vec_id % 5 = 0")
def needs_vectors(v):
    c = v.vectors.select("chunk_id", F.when(F.col("chunk_id") % 3 != 0, F.lit("m")).alias("embed_model"), F.when(F.col("chunk_id") % 7 != 0, F.lit(64)).alias("embed_dim"))
    return chunks.needs_vectors(c, v.vectors.where("chunk_id % 5 <> 0"), "m", 64)


@query("SELECT vec_id AS chunk_id FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 2 = 0)")
def orphan_vectors(v):
    return v.vectors.join(v.raw("documents").where("doc_id % 2 = 0").select(F.col("doc_id").alias("chunk_id")), "chunk_id", "left_anti").select("chunk_id")


@query("WITH m AS (SELECT page_id, url, DATE '2024-01-31' - (page_id % 40)::INT AS lastmod, split_part(split_part(url, '://', 2), '/', 1) AS site FROM pages WHERE page_id % 9 <> 0 UNION ALL SELECT page_id, url, NULL, split_part(split_part(url, '://', 2), '/', 1) FROM pages WHERE page_id % 9 = 0), o AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY lastmod DESC NULLS LAST, CASE WHEN lastmod IS NULL THEN page_id ELSE -page_id END) AS n FROM m), k AS (SELECT site, url, min(n) AS pos_no FROM o WHERE n <= 2000 AND regexp_matches(substr(coalesce(nullif(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), ''), '/'), 1, 512), '[02468]$') GROUP BY site, url) SELECT site, url, pos_no FROM k")
def sitemap_match_newest(v):
    m = v.raw("pages").select(F.col("page_id").alias("pos"), "url", F.when(F.col("page_id") % 9 != 0, F.date_sub(F.lit(NOW[:10]).cast("date"), (F.col("page_id") % 40).cast("int"))).alias("lastmod"), F.split_part(F.split_part("url", F.lit("://"), F.lit(2)), F.lit("/"), F.lit(1)).alias("site"))
    return markup.matching(m, r"[02468]$").select("site", "url", F.col("pos_no").cast("long").alias("pos_no"))


# Guards, exports, constraints

@query("""WITH e AS (SELECT (event_id // 50)::INT AS batch, (event_id % 50)::INT AS idx FROM events), r AS (SELECT batch, CASE WHEN idx = 7 AND batch % 3 = 0 THEN 8 WHEN idx = 9 AND batch % 4 = 0 THEN 60 ELSE idx END AS idx FROM e),
w AS (SELECT batch, list_sort(list(DISTINCT idx)) AS want FROM e GROUP BY batch), g AS (SELECT batch, list_sort(list(DISTINCT idx)) AS got, list_sort(list(DISTINCT idx) FILTER (WHERE n > 1)) AS rep FROM (SELECT batch, idx, count(*) OVER (PARTITION BY batch, idx) AS n FROM r) GROUP BY batch)
SELECT batch, array_to_string(coalesce(rep, []), ',') AS repeated, array_to_string(list_filter(want, lambda x: NOT list_contains(got, x)), ',') AS missing, array_to_string(list_filter(got, lambda x: NOT list_contains(want, x)), ',') AS unknown,
  coalesce(len(rep), 0) = 0 AND len(list_filter(want, lambda x: NOT list_contains(got, x))) = 0 AND len(list_filter(got, lambda x: NOT list_contains(want, x))) = 0 AS accepted FROM w JOIN g USING (batch)""")
def reply_acceptance(v):
    e = v.raw("events").select(F.expr("int(event_id div 50)").alias("batch"), F.expr("int(event_id % 50)").alias("idx"))
    r = e.select("batch", F.expr("CASE WHEN idx = 7 AND batch % 3 = 0 THEN 8 WHEN idx = 9 AND batch % 4 = 0 THEN 60 ELSE idx END").alias("idx"))
    out = guard.accept_replies(e, r)
    return out.select("batch", *[F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("repeated", "missing", "unknown")], "accepted")


@query()
def citation_check(v):
    marked = F.concat("text", F.lit(" [1] [2, 9] [[3]4] [p7] [note]"))
    return v.raw("conversations").select("conv_id", "turn", guard.check_citations(marked, F.lit(3)).alias("c")).select("conv_id", "turn", "c.*")


@query()
def daily_export(v):
    d = v.digests.withColumn("position", F.row_number().over(Window.partitionBy("day").orderBy(F.desc("final_score"), "item_id")))
    rows = d.join(v.items.select(F.col("id").alias("item_id"), "title", "url", F.col("source_id").alias("source"), "kind"), "item_id").join(v.triage.select("item_id", "tags", "flags"), "item_id", "left")
    none = F.array().cast("array<string>")
    flags = F.array_intersect(F.coalesce("flags", none), F.array(F.lit("promo"), F.lit("thin")))
    return exports.daily_lines(rows.select("day", "position", "title", "url", "source", "kind", F.col("final_score").alias("score"), F.lit("").alias("why_read"), F.coalesce("tags", none).alias("tags"), (F.size(flags) > 0).alias("hidden"), flags.alias("flags")))


@query("SELECT 'kind' AS rule, count(*) FILTER (WHERE kind NOT IN ('paper', 'article')) AS n FROM items UNION ALL SELECT 'title', count(*) FILTER (WHERE NOT coalesce(title <> '', false)) FROM items UNION ALL SELECT 'dates', count(*) FILTER (WHERE coalesce(published_at, first_seen) > first_seen) FROM items", "items")
def constraint_violations(v):
    return state.violations(v.items, {"kind": F.col("kind").isin("paper", "article"), "title": F.col("title") != "", "dates": F.coalesce("published_at", "first_seen") <= F.col("first_seen")})


@query("SELECT day::VARCHAR AS day, CASE WHEN bad = 0 THEN 'ok' WHEN bad = n THEN 'failed' ELSE 'partial' END AS status, n, bad FROM (SELECT ts::DATE AS day, count(*) AS n, count(*) FILTER (WHERE action = 'hide') AS bad FROM interactions GROUP BY 1)", "interactions")
def run_status(v):
    by = v.interactions.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.count_if(F.col("action") == "hide").alias("bad"))
    return by.select(F.col("day").cast("string").alias("day"), F.when(F.col("bad") == 0, "ok").when(F.col("bad") == F.col("n"), "failed").otherwise("partial").alias("status"), "n", "bad")


@query("SELECT s.item_id FROM item_state s WHERE s.item_id IN (SELECT id FROM items WHERE source_id NOT IN ('src0', 'src1'))", "items", "item_state")
def cascade_delete(v):
    items = v.items.where(~F.col("source_id").isin("src0", "src1"))
    return state.survivors(v.item_state, items, "item_id", "id").select("item_id")


# Steps and runs

@query("WITH o AS (SELECT id, row_number() OVER (ORDER BY md5('7:' || id), id) - 1 AS n FROM items) SELECT id, n // 50 AS batch, n % 50 AS idx FROM o", "items")
def triage_batches(v):
    return steps.shuffled_batches(v.items.select("id"), 7)


_ONE_LINE = "trim(regexp_replace({}, '\\s+', ' ', 'g'))"


def _clipped(column: str, most: int) -> str:
    line = _ONE_LINE.format(column)
    return f"CASE WHEN length({line}) <= {most} THEN {line} ELSE rtrim(substr({line}, 1, {most - 1})) || '…' END"


@query(f"""WITH o AS (SELECT id, title, summary, row_number() OVER (ORDER BY md5('7:' || id), id) - 1 AS n FROM items)
SELECT n // 50 AS batch, string_agg(n % 50 || chr(9) || {_clipped("title", 200)} || chr(9) || {_clipped("summary", 600)}, chr(10) ORDER BY n) AS entries FROM o GROUP BY n // 50""", "items")
def triage_payloads(v):
    """The payloads, read back from their JSON."""
    made = steps.payloads(steps.shuffled_batches(v.items.select("id", "title", "summary"), 7))
    entries = F.from_json("payload", "array<struct<idx: long, title: string, summary: string>>")
    return made.select("batch", F.array_join(F.transform(entries, lambda e: F.concat_ws("\t", e["idx"].cast("string"), e["title"], e["summary"])), "\n").alias("entries"))


@query("SELECT count(*) AS attempted, count(relevance) AS triaged, count(*) - count(relevance) AS failed, count(*) FILTER (WHERE list_has_any(flags, ['promo', 'thin'])) AS hidden FROM items LEFT JOIN triage ON item_id = id", "items", "triage")
def triage_statistics(v):
    return steps.triage_statistics(v.items, v.triage)


@query("SELECT day::VARCHAR AS day, count(*) AS items, count(*) FILTER (WHERE list_has_any(flags, ['promo', 'thin'])) AS hidden, count(*) FILTER (WHERE relevance IS NULL) AS without_relevance FROM digests d LEFT JOIN triage t ON t.item_id = d.item_id GROUP BY day", "digests", "triage")
def digest_statistics(v):
    return steps.digest_statistics(v.digests, v.triage).withColumn("day", F.col("day").cast("string"))


@query("SELECT action AS kind, max(id) AS id FROM (SELECT *, row_number() OVER (PARTITION BY action ORDER BY ts DESC, id DESC) AS n FROM interactions WHERE k % 4 < 2) WHERE n = 1 GROUP BY action", "interactions")
def last_runs(v):
    status = F.expr("CASE k % 4 WHEN 0 THEN 'ok' WHEN 1 THEN 'partial' ELSE 'failed' END")
    runs = v.interactions.select("id", F.col("action").alias("kind"), F.col("ts").alias("started_at"), status.alias("status"))
    return steps.last_runs(runs, ["ok", "partial"]).select("kind", "id")


@query("SELECT health, count(*) AS n FROM (SELECT CASE WHEN f >= 3 THEN 'broken' WHEN f >= 1 THEN 'degraded' ELSE 'ok' END AS health FROM (SELECT item_id, count(*) FILTER (WHERE action = 'hide') AS f FROM interactions GROUP BY item_id)) GROUP BY health", "interactions")
def health_counts(v):
    by = v.interactions.groupBy("item_id").agg(F.count_if(F.col("action") == "hide").alias("f"))
    return by.groupBy(score.health(F.col("f"), F.lit(1)).alias("health")).agg(F.count("*").alias("n"))


@query("SELECT id, CASE WHEN id % 11 = 0 THEN 'retry' WHEN id % 13 = 0 THEN 'new' ELSE 'old' END AS reason FROM items WHERE (id % 13 = 0 AND id % 11 <> 0) OR (id % 11 = 0 AND id % 2 = 0) OR (id % 11 <> 0 AND id % 13 <> 0 AND id % 5 = 0)", "items")
def extraction_due(v):
    c = v.contents.where("item_id % 13 <> 0 OR item_id % 11 = 0").select("item_id", "status", F.expr("CASE WHEN item_id % 5 = 0 THEN 1 ELSE 2 END").alias("extractor_version"), F.when(F.col("item_id") % 2 == 0, now() - F.expr("INTERVAL 2 HOURS")).otherwise(now()).alias("fetched_at"))
    return steps.extraction_due(v.items, c, now(), 2)


@query("SELECT item_id, CASE WHEN item_id % 4 = 0 THEN 'missing' WHEN item_id % 6 = 1 THEN 'changed' ELSE 'no vector' END AS reason FROM contents WHERE status = 'ok' AND trim(body) <> '' AND (item_id % 4 = 0 OR item_id % 6 = 1 OR item_id % 10 = 3)", "contents")
def content_due(v):
    stored = v.contents.where("item_id % 4 <> 0").select("item_id", F.when(F.col("item_id") % 6 == 1, F.lit("x")).otherwise(F.sha1("body")).alias("hash"), (F.col("item_id") % 10 != 3).alias("has_vector"))
    return steps.content_due(v.contents, stored, True)


@query("""WITH p AS (SELECT event_id // 40 AS run, event_id % 40 AS pos, md5((event_id % 17)::VARCHAR) AS hash, event_id % 17 AS h FROM events), o AS (SELECT run, hash, h, min(pos) AS pos FROM p WHERE h % 3 <> 0 GROUP BY run, hash, h),
k AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY pos, hash) AS n FROM o) SELECT run, pos, hash, h % 5 = 1 AS duplicate FROM k WHERE n <= 5""")
def accepted_recipes(v):
    h = F.col("event_id") % 17
    p = v.raw("events").select(F.expr("event_id div 40").alias("run"), (F.col("event_id") % 40).alias("pos"), F.md5(h.cast("string")).alias("hash"), h.alias("h"))
    known = p.select("hash", "h").distinct()
    return steps.accepted_recipes(p, known.where("h % 3 <> 0"), known.where("h % 5 = 1"))


@query("SELECT conv_id, turn, row_number() OVER (ORDER BY conv_id DESC, turn DESC) AS n FROM conversations WHERE role = 'user' ORDER BY n LIMIT 20")
def recent_asks(v):
    rows = v.raw("conversations").where("role = 'user'")
    return retrieval.top(rows, 20, F.desc("conv_id"), F.desc("turn"), rank="n").select("conv_id", "turn", F.col("n").cast("long").alias("n"))


# Extensions: forms that the engine adds, with event time and grouping sets

@query("SELECT source_id, kind, count(*) AS n FROM items GROUP BY ROLLUP (source_id, kind)", "items")
def facet_rollup(v):
    return v.items.rollup("source_id", "kind").agg(F.count("*").alias("n"))


@query("SELECT lang, kind, count(*) AS n FROM items GROUP BY CUBE (lang, kind)", "items")
def facet_cube(v):
    return v.items.cube("lang", "kind").agg(F.count("*").alias("n"))


@query("SELECT item_id FROM item_state WHERE saved UNION SELECT item_id FROM item_state WHERE liked INTERSECT SELECT item_id FROM item_state WHERE read_at IS NOT NULL EXCEPT SELECT item_id FROM item_state WHERE hidden", "item_state")
def union_intersect_except_views(v):
    s = v.item_state
    ids = lambda c: s.where(c).select("item_id")
    return ids("saved").union(ids("liked").intersect(ids("read_at IS NOT NULL"))).distinct().subtract(ids("hidden"))


@query("WITH a AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS fresh FROM events), b AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS g FROM a) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTES AS stop, count(*) AS n FROM b GROUP BY user_id, g")
def activity_sessions(v):
    return incremental.sessions(v.raw("events"), "user_id", "ts")


@query("SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def activity_tumbling(v):
    return v.raw("events").groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("day"), "event_type", "n", "total")


@query("SELECT o.event_id, arg_max(s.value, (s.ts, s.event_id)) AS signal FROM events o LEFT JOIN events s ON s.user_id = o.user_id AND s.event_type = 'view' AND s.ts < o.ts WHERE o.event_type = 'click' GROUP BY o.event_id")
def asof_signal(v):
    """The value of the last view before each open: one window over both, no range join."""
    e = v.raw("events").where("event_type IN ('view', 'click')")
    w = Window.partitionBy("user_id").orderBy("ts", F.asc("event_type"), "event_id")
    before = F.last(F.when(F.col("event_type") == "view", F.struct("ts", "value")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return e.select("event_id", "event_type", before["value"].alias("signal")).where("event_type = 'click'").select("event_id", "signal")


@query()
def approx_readers(v):
    return v.interactions.groupBy("action").agg(F.approx_count_distinct("item_id", 0.02).alias("readers"))
