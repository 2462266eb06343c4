"""Keyword, vector and hybrid retrieval.

Keyword scores are BM25 over postings (document, term, count), which are stored by
term once (write_index) and then read by the terms of a query only. Vector scores
are exact cosines. Filters apply before ranking, never after a top-k. Many queries
are ranked at once by partitioning on the query; all-pairs search joins blocks of
queries with blocks of candidates on the executors.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.score import cosine
from ..functions.text import index_tokens, query_terms, search_terms
from .storage import checkpoint

K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6
SIDE_K, RRF_K = 50, 60
BLOCK_ROWS, BLOCK_BYTES = 2048, 32 << 20
SIDE_BLOCKS, RANGE_BLOCKS = 10, 2
BUCKETS, SHARDS, SHARD_CHARS, PIECE_CHARS = 32, 4, 1 << 20, 8 << 20


def postings(docs: DataFrame, key: str, text: Column, terms: Sequence[str], prefix: bool = False) -> DataFrame:
    """key, length (tokens of the document) and, for each term (exact, or as a prefix), its count: one row for each document and term, without an index."""

    def is_(t: Column, w: str) -> Column:
        return F.startswith(t, F.lit(w)) if prefix else t == F.lit(w)

    def any_term(t: Column) -> Column:
        found = F.lit(False)
        for w in terms:
            found |= is_(t, w)
        return found

    def count(w: str) -> Column:
        return F.size(F.filter("h", lambda t: is_(t, w)))

    # The few tokens that matter are picked once, and only they are counted term by term.
    tokens = docs.select(key, index_tokens(text).alias("t")).select(key, "t", F.filter("t", any_term).alias("h"))
    counts = F.array(*[F.struct(F.lit(w).alias("term"), count(w).alias("tf")) for w in terms])
    return tokens.select(key, F.size("t").alias("length"), F.inline(counts))


def bm25(posts: DataFrame, key: str) -> DataFrame:
    """key and score (higher is better) of documents with a term; posts has a row for each document and query term."""
    stats = posts.groupBy("term").agg(F.count_if(F.col("tf") > 0).alias("n"), F.count("*").alias("total"), F.avg("length").alias("mean"))
    idf = F.greatest(F.lit(IDF_FLOOR), F.log((F.col("total") - F.col("n") + 0.5) / (F.col("n") + 0.5)))
    hits = posts.where("tf > 0").join(F.broadcast(stats), "term")  # a row for each query term, 32 at most
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    return hits.groupBy(key).agg(F.sum(part).alias("score"))


@dataclass(frozen=True)
class Index:
    """postings: term, key, tf, length; terms: term, n (documents); corpus: total, mean (one row)."""

    postings: DataFrame
    terms: DataFrame
    corpus: DataFrame


def bucket(term) -> Column:
    """Where a term's postings are."""
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def shards_of(chars: int) -> int:
    """In how many shards the postings of a bucket are dealt: SHARDS, or more of about SHARD_CHARS of text."""
    return max(SHARDS, -(-chars // (BUCKETS * SHARD_CHARS)))


def deal(rows: DataFrame, shards: int) -> DataFrame:
    """rows (key, bucket) with their shard, one partition for each bucket and shard where there are many: what a task holds doesn't grow with the texts. Spark may put few and small ones together."""
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)))
    return dealt.repartition("bucket", "shard") if shards == SHARDS else dealt.repartition(BUCKETS * shards, "bucket", "shard")


def pieces(docs: DataFrame, key: str, text: Column) -> tuple[DataFrame, int]:
    """The texts (key, text) in pieces of about PIECE_CHARS by key, and how many characters they have: a task's share doesn't grow with the texts."""
    texts = docs.select(F.col(key).alias("key"), text.alias("text"))
    chars = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    return texts.repartition(max(1, -(-chars // PIECE_CHARS)), "key"), chars


def count_tokens(texts: DataFrame) -> DataFrame:
    """key, length, term, tf of texts in pieces by key: tokens are counted where their text is, so none is shuffled. A text without tokens has one row, of no term."""
    tokens = texts.select("key", index_tokens(F.col("text")).alias("t"))
    # For explode() Spark asks first whether there are tokens, and makes them once more to know.
    each = tokens.select("key", F.size("t").cast("long").alias("length"), F.explode_outer("t").alias("term"))
    return each.groupBy("key", "length", "term").agg(F.count("*").alias("tf"))


def write_index(docs: DataFrame, key: str, text: Column, folder: str) -> None:
    """The postings of docs under folder, in BUCKETS by term and sorted by it; a bucket's postings are dealt to shards, so no task holds a hot term's whole list."""
    texts, chars = pieces(docs, key, text)
    dealt = deal(count_tokens(texts).where("term IS NOT NULL").withColumn("bucket", bucket("term")), shards_of(chars))
    counted = dealt.select("bucket", "term", "key", F.col("length").cast("int").alias("length"), "tf")
    counted.sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{folder}/postings")
    stored = docs.sparkSession.read.parquet(f"{folder}/postings")
    stored.groupBy("bucket", "term").agg(F.count("*").alias("n")).repartition("bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{folder}/terms")
    lengths = stored.agg(F.sum("tf").alias("tokens")).crossJoin(docs.agg(F.count("*").alias("total")))  # one row each
    lengths.select("total", (F.coalesce("tokens", F.lit(0)) / F.col("total")).alias("mean")).write.parquet(f"{folder}/corpus")


def open_index(spark: SparkSession, folder: str) -> Index:
    return Index(*[spark.read.parquet(f"{folder}/{t}") for t in ("postings", "terms", "corpus")])


def _part(n: str = "n") -> Column:
    """What a posting adds to a BM25 score."""
    idf = F.greatest(F.lit(IDF_FLOOR), F.log((F.col("total") - F.col(n) + 0.5) / (F.col(n) + 0.5)))
    return idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))


def keyword_scores(index: Index, terms: Sequence[str]) -> DataFrame:
    """key, score of documents with one of the terms; only the terms' buckets are read."""
    some = F.col("term").isin(list(terms)) & F.col("bucket").isin(_buckets(index, terms))
    hits = index.postings.where(some).join(index.terms.where(some).select("term", "n"), "term").crossJoin(F.broadcast(index.corpus))  # one row
    return hits.groupBy("key").agg(F.sum(_part()).alias("score"))


def _buckets(index: Index, terms: Sequence[str]) -> list[int]:
    rows = index.corpus.sparkSession.createDataFrame([(t,) for t in terms] or [("",)], "term string")
    return [r[0] for r in rows.select(bucket("term")).distinct().collect()]


ASKED_ROWS, TEXT_ROWS, TEXT_BLOCKS = 1 << 20, 8192, 24


def keyword_best_of(index: Index, queries: DataFrame, text: Column, passages: DataFrame, k: int) -> DataFrame:
    """query_id, chunk_id, score, rank: the k best passages (chunk_id, item_id) by words for every query (query_id and a text), those of the item that asks left out.

    The queries' terms, in blocks of about ASKED_ROWS, meet the passages' postings, TEXT_BLOCKS blocks of them or
    more of TEXT_ROWS passages; a task holds the two, sums up one query at a time and returns the k best of each."""
    asked = queries.select("query_id", F.explode(search_terms(text)).alias("term")).withColumn("bucket", bucket("term"))
    known = checkpoint(asked.join(index.terms, ["bucket", "term"]).select("query_id", "bucket", "term", "n"))
    terms = known.select("bucket", "term", "n").distinct()
    hits = index.postings.join(terms, ["bucket", "term"]).join(passages.select(F.col("chunk_id").alias("key"), "item_id"), "key").crossJoin(F.broadcast(index.corpus))  # one row
    parts = hits.select(F.col("key").alias("chunk_id"), "item_id", "term", _part().alias("part"))
    nq, n = max(1, -(-known.count() // ASKED_ROWS)), passages.count()
    nc = max(-(-n // TEXT_ROWS), min(TEXT_BLOCKS, -(-n // 256)), 1)
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = known.select("query_id", "term", F.pmod(F.xxhash64("query_id"), F.lit(nq)).cast("int").alias("i"), each(nc).alias("j"))
    right = parts.select("*", each(nq).alias("i"), F.pmod(F.xxhash64("chunk_id"), F.lit(nc)).cast("int").alias("j"))
    found = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(_best_by_words(k), "query_id long, chunk_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _best_by_words(k: int):
    def run(asked: pa.Table, hits: pa.Table) -> pa.Table:
        import pyarrow.compute as pc

        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if asked.num_rows and hits.num_rows:
            terms = hits.column("term").combine_chunks().dictionary_encode()
            code, words = terms.indices.to_numpy(), len(terms.dictionary)
            chunks, at = np.unique(hits.column("chunk_id").to_numpy(), return_inverse=True)
            items = np.zeros(len(chunks), np.int64)
            items[at] = hits.column("item_id").to_numpy()
            o = np.argsort(code, kind="stable")  # the postings of a term lie together
            at, part, start = at[o], hits.column("part").to_numpy()[o], np.searchsorted(code[o], np.arange(words + 1))
            word = pc.fill_null(pc.index_in(asked.column("term").combine_chunks(), value_set=terms.dictionary), -1).to_numpy()
            query = asked.column("query_id").to_numpy()
            o = np.argsort(query, kind="stable")
            for mine in np.split(o, np.flatnonzero(np.diff(query[o])) + 1):
                runs = [slice(start[w], start[w + 1]) for w in word[mine] if w >= 0]
                if not runs:
                    continue
                places = np.concatenate([at[r] for r in runs])
                s = np.round(np.bincount(places, np.concatenate([part[r] for r in runs]), len(chunks)), 6)
                hit = np.zeros(len(chunks), bool)
                hit[places] = True
                p = np.flatnonzero(hit & (items != query[mine[0]]))
                if len(p) > k:
                    p = p[s[p] >= np.partition(s[p], len(p) - k)[len(p) - k]]
                p = p[np.lexsort((chunks[p], -s[p]))[:k]]
                out.append((np.full(len(p), query[mine[0]]), chunks[p], s[p]))
        return pa.table(dict(zip(("query_id", "chunk_id", "score"), map(pa.array, map(np.concatenate, zip(*out, strict=True))), strict=True)))

    return run


class VectorsUnavailable(ValueError):
    """Why the vector side of a search can't run."""


@dataclass(frozen=True)
class SearchFilter:
    """What passages a search may return; an empty sequence or None is no condition."""

    collections: Sequence[str] = ("archive", "content")
    item: int | None = None
    sources: Sequence[str] = ()
    kinds: Sequence[str] = ()
    day_from: date | None = None
    day_to: date | None = None
    read_since: date | None = None
    exclude: Sequence[int] = ()


def allowed(f: SearchFilter, vector: bool) -> Column:
    """The condition on passages, the same on both sides; only vectors know the day of reading."""
    keep = F.col("collection").isin(*f.collections)
    if f.item is not None:
        keep &= F.col("item_id") == f.item
    if f.sources:
        keep &= F.col("source_id").isin(*f.sources)
    if f.kinds:
        keep &= F.col("kind").isin(*f.kinds)
    if f.day_from is not None:
        keep &= F.col("published_day") >= F.lit(f.day_from)
    if f.day_to is not None:
        keep &= F.col("published_day") <= F.lit(f.day_to)
    if f.read_since is not None and vector:
        keep &= F.col("read_day") >= F.lit(f.read_since)
    return keep & ~F.col("item_id").isin(*f.exclude) if f.exclude else keep


def search(passages: DataFrame, index: Index | None, query: str, vector: Sequence[float] | DataFrame | None = None, f: SearchFilter = SearchFilter(), mode: str = "hybrid", k: int = 10, problem: str | None = None) -> DataFrame:
    """chunk_id, item_id, fts_rank, vec_rank, similarity, score, rank of the k best passages.

    A search by vector alone needs no index. mode is 'hybrid', 'fts' or 'vector'. Without a vector, or where the caller names a problem
    with the vectors, any mode but 'fts' is refused."""
    if mode not in ("hybrid", "fts", "vector"):
        raise ValueError(f"no such mode: {mode}")
    if mode != "fts" and (problem or vector is None):
        raise VectorsUnavailable(problem or "the query has no vector")
    spark = passages.sparkSession
    terms = query_terms(query)
    if mode == "vector" or not terms:
        fts = spark.createDataFrame([], "chunk_id long, rank int")
    else:
        scored = keyword_scores(index, terms).select(F.col("key").alias("chunk_id"), F.round("score", 6).alias("score"))
        fts = top(scored.join(passages.where(allowed(f, False)).select("chunk_id"), "chunk_id", "left_semi"), SIDE_K, F.desc("score"), F.asc("chunk_id"))
    if mode == "fts":
        near = spark.createDataFrame([], "chunk_id long, similarity double, rank int")
    else:
        near = nearest(passages.where(allowed(f, True)), vector)
    out = fuse(fts, near, "chunk_id", k)
    return out.join(passages.select("chunk_id", "item_id"), "chunk_id")


def item_order(hits: DataFrame) -> DataFrame:
    """item_id, place: each item once, in the order of its best passage; hits are a search's few rows."""
    best = hits.groupBy("item_id").agg(F.min("rank").alias("best"))
    return best.select("item_id", F.row_number().over(Window.orderBy("best")).alias("place"))


def top(rows: DataFrame, k: int, *by: Column, rank: str = "rank") -> DataFrame:
    """The first k rows with their rank: a distributed top-k, then numbers on k rows."""
    return rows.orderBy(*by).limit(k).withColumn(rank, F.row_number().over(Window.orderBy(*by)))


def nearest(vectors: DataFrame, query: Sequence[float] | DataFrame, k: int = SIDE_K) -> DataFrame:
    """chunk_id, similarity, rank of the k nearest to one vector: numbers, or the embedding of a table's only row (none: no result)."""
    if isinstance(query, DataFrame):
        both = vectors.crossJoin(F.broadcast(query.select(F.col("embedding").alias("_q")).limit(1)))  # one row
    else:
        both = vectors.withColumn("_q", F.array(*[F.lit(float(x)) for x in query]))
    same = both.where(comparable(F.col("embedding")) & comparable(F.col("_q")) & (F.size("embedding") == F.size("_q")))
    return top(same.select("chunk_id", F.round(cosine(F.col("embedding"), F.col("_q")), 6).alias("similarity")), k, F.desc("similarity"), F.asc("chunk_id"))


def comparable(v: Column) -> Column:
    """Whether a vector has a direction: not null, no component null or not finite, not all zero."""
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(fine & F.exists(v, lambda x: x != 0), F.lit(False))


def rrf(*ranked: DataFrame, key: str) -> DataFrame:
    """Reciprocal rank fusion of lists (key, rank)."""
    both = ranked[0].select(key, "rank")
    for r in ranked[1:]:
        both = both.unionByName(r.select(key, "rank"))
    return both.groupBy(key).agg(F.sum(1.0 / (RRF_K + F.col("rank"))).alias("score"))


def fuse(fts: DataFrame, vec: DataFrame, key: str, k: int) -> DataFrame:
    """Fused rows with the rank on either side and the similarity, null where a side lacks the row."""
    sides = fts.select(key, F.col("rank").alias("fts_rank")).join(vec.select(key, F.col("rank").alias("vec_rank"), "similarity"), key, "full")
    score = F.coalesce(1.0 / (RRF_K + F.col("fts_rank")), F.lit(0.0)) + F.coalesce(1.0 / (RRF_K + F.col("vec_rank")), F.lit(0.0))
    return top(sides.withColumn("score", score), k, F.desc(F.round("score", 9)), F.asc(key))


def knn(queries: DataFrame, candidates: DataFrame, k: int, keep: str = "true", least: float | None = None) -> DataFrame:
    """query_id, chunk_id, similarity, rank: the k nearest candidates of every query, where least is given those of them that are as similar at least.

    queries has query_id and embedding (and qday, qgroup), candidates chunk_id and embedding (and day, group);
    keep is a condition among 'true', 'other' (another id), 'band' (another id, at most 14 days apart) and
    'group' (another group): what it leaves out never shrinks k. Vectors that have no direction have no
    neighbours, and only vectors of one length are compared.
    Both sides are cut into blocks: SIDE_BLOCKS of each, more where a block would pass BLOCK_BYTES, fewer
    where it would be less than BLOCK_ROWS. So every row is sent a fixed number of times up to that size, and
    beyond it as many times as the other side has blocks. Each pair of blocks is compared in one task, which
    holds the two, and returns the k best of each query; a window merges those of a query. For 'band' the
    blocks are cut by day first, and only those of near days meet: their number grows with the days, not
    with its square.
    """
    more = {"band": ["day"], "group": ["group"]}.get(keep, [])
    floats = all(dict(x.dtypes)["embedding"] == "array<float>" for x in (queries, candidates))
    vector = F.col("embedding").cast("array<float>" if floats else "array<double>").alias("embedding")  # sent as it is, compared in double precision
    q = queries.where(comparable(F.col("embedding"))).select("query_id", vector, *[f"q{c}" for c in more])
    c = candidates.where(comparable(F.col("embedding"))).select("chunk_id", vector, *more)
    if keep == "band":
        left, right, unit = _band_blocks(q, c)
    else:
        nq, nc = (x.agg(_blocks(SIDE_BLOCKS)).first()[0] for x in (q, c))
        dims = F.size("embedding").alias("dims")
        left = q.select("*", dims, F.pmod(F.xxhash64("query_id"), F.lit(nq)).alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(nc - 1).cast("long"))).alias("j"))
        right = c.select("*", dims, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(nq - 1).cast("long"))).alias("i"), F.pmod(F.xxhash64("chunk_id"), F.lit(nc)).alias("j"))
        unit = ["dims", "i", "j"]
    found = left.groupBy(*unit).cogroup(right.groupBy(*unit)).applyInArrow(_compare(k, keep, least), "query_id long, chunk_id long, similarity double")
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "chunk_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _blocks(most: int) -> Column:
    """How many blocks a side is cut into: `most` at most, unless they would pass BLOCK_BYTES, and one at least."""
    by_bytes = F.ceil(F.coalesce(F.sum(F.size("embedding").cast("long")), F.lit(0)) * 8 / BLOCK_BYTES)
    return F.greatest(F.lit(1), by_bytes, F.least(F.lit(most), F.ceil(F.count("*") / BLOCK_ROWS))).cast("long")


BAND_DAYS = 14


def _band_blocks(q: DataFrame, c: DataFrame) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides dealt to pairs of blocks of ranges of BAND_DAYS + 1 days: a range meets itself and the two beside it, whatever else there is. Rows without a day meet none."""
    range_of = lambda day: F.floor(F.unix_date(day) / (BAND_DAYS + 1)).cast("long")
    q, c = q.where("qday IS NOT NULL").withColumn("r", range_of("qday")), c.where("day IS NOT NULL").withColumn("s", range_of("day"))
    blocks = lambda rows, by, name: rows.groupBy(by).agg(_blocks(RANGE_BLOCKS).alias(f"n{name}"), F.count("*").alias(name))
    near = blocks(q, "r", "q").select("r", "nq", "q", F.explode(F.sequence(F.col("r") - 1, F.col("r") + 1)).alias("s")).join(blocks(c, "s", "c"), "s")
    near = checkpoint(near.select("r", "s", "nq", "nc", F.col("q").cast("double"), F.col("c").cast("double")))  # three rows for each 15 days of the calendar
    size = near.agg(F.sum(F.col("nq") * F.col("nc")).alias("units"), F.sum(F.col("q") * F.col("c")).alias("pairs")).first()
    # Tasks by what they compare: their bytes are few, and Spark would put many units into one.
    tasks = int(min(size.units or 1, max(q.sparkSession.sparkContext.defaultParallelism, (size.pairs or 0) // TASK_PAIRS)))
    near = near.drop("q", "c")
    zero, dims = F.lit(0).cast("long"), F.size("embedding").alias("dims")
    left = q.join(F.broadcast(near), "r").select("query_id", "embedding", "qday", dims, "r", "s", F.pmod(F.xxhash64("query_id"), F.col("nq")).alias("i"), F.explode(F.sequence(zero, F.col("nc") - 1)).alias("j"))
    right = c.join(F.broadcast(near), "s").select("chunk_id", "embedding", "day", dims, "r", "s", F.explode(F.sequence(zero, F.col("nq") - 1)).alias("i"), F.pmod(F.xxhash64("chunk_id"), F.col("nc")).alias("j"))
    unit = ["dims", "r", "s", "i", "j"]
    return left.repartition(tasks, *unit), right.repartition(tasks, *unit), unit


def _unit_rows(t: pa.Table) -> np.ndarray:
    x = t.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(t.num_rows, -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _best(s: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest of each row, ties by the smaller id; only rows with ties at the edge are sorted whole."""
    k = min(k, s.shape[1])
    at = np.argpartition(-s, k - 1, axis=1)[:, :k]
    edge = np.take_along_axis(s, at, 1).min(1)
    for r in np.flatnonzero((s >= edge[:, None]).sum(1) > k):
        some = np.flatnonzero(s[r] >= edge[r])
        at[r] = some[np.lexsort((ids[some], -s[r, some]))[:k]]
    return at


LANES, CELLS, PAIRS = 64, 1 << 22, 1 << 18  # columns of a maximum, cells of a matrix, pairs compared at once


def _same(own: np.ndarray, other: np.ndarray):
    """A function of (a, b): the pairs (row, place) of equal keys among the rows a to b."""
    o = np.argsort(other, kind="stable")
    low, high = (np.searchsorted(other[o], own, side) for side in ("left", "right"))

    def run(a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        n = (high - low)[a:b]
        return np.repeat(np.arange(b - a), n), o[np.arange(n.sum()) + np.repeat(low[a:b] - np.cumsum(n) + n, n)]

    return run


def _nearest_rows(q: np.ndarray, c: np.ndarray, ids: np.ndarray, k: int, left_out=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, similarity) of the k nearest of c for each row of q; left_out(a, b) gives the pairs of the rows a to b that don't count.

    Many columns are sifted in single precision first: the k-th largest of the maxima of LANES columns is no more than
    the k-th largest of all, so what is below it by more than single precision can err is none of the k."""
    rows, places, near = [], [], []
    sift = len(c) >= 2 * k * LANES
    q32, c32 = (q.astype(np.float32), c.astype(np.float32).T.copy()) if sift else (None, None)
    slack = 2e-6 + 4e-7 * (q.shape[1] + 8)
    step = max(1, CELLS // max(1, len(c)))
    for a in range(0, len(q), step):
        b = min(a + step, len(q))
        skip = left_out(a, b) if left_out else None
        if sift:
            s = q32[a:b] @ c32
            if skip is not None:
                s[skip] = -2
            edge = np.maximum.reduceat(s, np.arange(0, len(c), LANES), axis=1)
            edge = np.partition(edge, edge.shape[1] - k, axis=1)[:, edge.shape[1] - k]
            r, p = np.nonzero((s >= (edge - np.float32(slack))[:, None]) & (s > -1.5))
            x = np.concatenate([np.einsum("ij,ij->i", q[a + r[i : i + PAIRS]], c[p[i : i + PAIRS]]) for i in range(0, len(r), PAIRS)] or [np.zeros(0)]).round(6)
            o = np.lexsort((ids[p], -x, r))
            r, p, x = r[o], p[o], x[o]
            first = np.arange(len(r)) - np.searchsorted(r, r) < k
            r, p, x = r[first], p[first], x[first]
        else:
            s = np.round(q[a:b] @ c.T, 6)
            if skip is not None:
                s[skip] = -2
            at = _best(s, ids, k)
            best = np.take_along_axis(s, at, 1)
            r, col = np.nonzero(best > -1.5)
            p, x = at[r, col], best[r, col]
        rows.append(a + r), places.append(p), near.append(x)
    return np.concatenate(rows), np.concatenate(places), np.concatenate(near)


TILE_ROWS, TILE_COLUMNS, TASK_PAIRS = 256, 768, 1 << 28  # a tile's matrix (0.8 MB) stays in a core's cache; pairs for a task of its own


def _first(r: np.ndarray, p: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k first of each row, by similarity and then by id."""
    o = np.lexsort((ids[p], -x, r))
    r, p, x = r[o], p[o], x[o]
    some = np.arange(len(r)) - np.searchsorted(r, r) < k
    return r[some], p[some], x[some]


def _axis(c: np.ndarray) -> np.ndarray:
    """A direction along which vectors differ much: their first principal axis, about."""
    middle = c.mean(0)
    spread = c.T @ c / len(c) - np.outer(middle, middle)
    w = spread[np.argmax(np.diag(spread))]
    for _ in range(8):
        norm = np.linalg.norm(w)
        if not norm > 1e-9:
            return np.eye(1, c.shape[1])[0]
        w = spread @ (w / norm)
    return w / max(np.linalg.norm(w), 1e-300)


def _near_rows(q: np.ndarray, c: np.ndarray, ids: np.ndarray, k: int, least: float, axis: np.ndarray, own: np.ndarray | None, other: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, similarity) like _nearest_rows', of pairs that are as similar as least; equal keys in own and other don't count.

    Both sides lie in the order of one axis, along which pairs that are as similar differ by no more than they do at all.
    A tile of the matrix is made in single precision and looked through once for what may reach least, with room for its
    error; only that is compared in double precision. Where there is far more of it than k a row, the k best so far, and
    in a tile its lanes' maxima, raise a row's bound: as many as there are equal keys may not count, and k more do."""
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    slack = 2e-6 + 4e-7 * (q.shape[1] + 8)
    reach = np.sqrt(max(0.0, 2 - 2 * (least - 1e-6))) + 1e-6
    at, to = q @ axis, c @ axis
    rows, places = np.argsort(at, kind="stable"), np.argsort(to, kind="stable")
    at, to, q, c, ids, other = at[rows], to[places], q[rows], c[places], ids[places], other[places]
    own = None if own is None else own[rows]
    q32, c32 = q.astype(np.float32), c.astype(np.float32)
    enough = k + (0 if own is None else int(np.unique(other, return_counts=True)[1].max()))
    room, over = np.empty(TILE_ROWS * TILE_COLUMNS, np.float32), np.zeros((TILE_ROWS, -(-min(TILE_COLUMNS, len(c)) // 8) * 8), bool)
    for a in range(0, len(q), TILE_ROWS):
        n = min(TILE_ROWS, len(q) - a)
        bound, found, kept = np.float32(least - slack), [out[0]], 0
        low, high = np.searchsorted(to, [at[a] - reach, at[a + n - 1] + reach])
        for u in range(low, high, TILE_COLUMNS):
            m = min(TILE_COLUMNS, high - u)
            s = np.matmul(q32[a : a + n], c32[u : u + m].T, out=room[: n * m].reshape(n, m))
            over[:, m:] = False
            for again in (False, True):
                np.greater_equal(s, bound, out=over[:n, :m])
                eights = np.flatnonzero(over[:n].reshape(-1).view(np.uint64))  # few pairs are near: eight are passed over at once
                lane = m // (2 * enough)
                if again or lane < 2 or len(eights) <= 4 * k * n:
                    break
                lanes = np.maximum.reduceat(s, np.arange(0, m, lane), axis=1)
                bound = np.maximum(bound, np.partition(lanes, lanes.shape[1] - enough, axis=1)[:, lanes.shape[1] - enough, None] - np.float32(slack))
            e, bit = np.nonzero(over[:n].reshape(-1, 8)[eights])
            r, p = np.divmod(8 * eights[e] + bit, over.shape[1])
            r, p = a + r, u + p
            if own is not None:
                fine = own[r] != other[p]
                r, p = r[fine], p[fine]
            x = np.concatenate([np.einsum("ij,ij->i", q[r[i : i + PAIRS]], c[p[i : i + PAIRS]]) for i in range(0, len(r), PAIRS)] or [np.zeros(0)]).round(6)
            found.append((r, p, x))
            kept += len(r)
            if kept > 8 * k * n:
                r, p, x = _first(*map(np.concatenate, zip(*found, strict=True)), ids, k)
                found, kept = [(r, p, x)], len(r)
                full, worst = np.bincount(r - a, minlength=n) == k, np.full(n, np.inf)
                np.minimum.at(worst, r - a, x)
                bound = np.maximum(bound, np.where(full, worst - slack, -np.inf).astype(np.float32)[:, None])
        r, p, x = _first(*map(np.concatenate, zip(*found, strict=True)), ids, k)
        near = x >= least
        out.append((rows[r[near]], places[p[near]], x[near]))
    return tuple(map(np.concatenate, zip(*out, strict=True)))


def _compare(k: int, keep: str, least: float | None = None):
    def run(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if queries.num_rows and candidates.num_rows:
            ids, c_ids, q, c = queries.column("query_id").to_numpy(), candidates.column("chunk_id").to_numpy(), _unit_rows(queries), _unit_rows(candidates)
            pieces = [(slice(None), slice(None))]
            if keep == "band":
                # Candidates by day: the days near a query's are one run of them.
                days, theirs = (t.column(n).cast(pa.int32()).to_numpy(zero_copy_only=False) for t, n in ((queries, "qday"), (candidates, "day")))
                o = np.argsort(theirs, kind="stable")
                theirs, c_ids, c = theirs[o], c_ids[o], c[o]
                pieces = [(np.flatnonzero(days == d), slice(*np.searchsorted(theirs, [d - BAND_DAYS, d + BAND_DAYS + 1]))) for d in np.unique(days)]
            own, other = (queries.column("qgroup").to_numpy(), candidates.column("group").to_numpy()) if keep == "group" else (ids, c_ids)
            axis = None if least is None else _axis(c)
            for mine, theirs in pieces:
                m, t = ids[mine], c_ids[theirs]
                if not len(t):
                    continue
                if least is None:
                    r, p, x = _nearest_rows(q[mine], c[theirs], t, k, None if keep == "true" else _same(own[mine], other[theirs]))
                else:  # the nearest come first, so what is below least never has a place among the k
                    r, p, x = _near_rows(q[mine], c[theirs], t, k, least, axis, None if keep == "true" else own[mine], other[theirs])
                out.append((m[r], t[p], x))
        return pa.table(dict(zip(("query_id", "chunk_id", "similarity"), map(pa.array, map(np.concatenate, zip(*out, strict=True))), strict=True)))

    return run


def search_ranks(pairs: DataFrame, index: Index, passages: DataFrame, k: int = 10) -> DataFrame:
    """query_id, mode, rank: where each pair's target stands in keyword, vector and hybrid search, null beyond the first k.

    pairs: query_id (the item asking, left out of its own results), target (item_id), text, embedding. All queries are ranked at once."""
    archive = checkpoint(passages.where("collection = 'archive'").select("chunk_id", "item_id", "embedding"))
    pairs = checkpoint(pairs.select("query_id", "target", "text", "embedding"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    fts = checkpoint(keyword_best_of(index, pairs, F.col("text"), archive, SIDE_K))
    near = checkpoint(knn(pairs.select("query_id", "embedding", F.col("query_id").alias("qgroup")), archive.select("chunk_id", "embedding", F.col("item_id").alias("group")), SIDE_K, keep="group"))
    sides = fts.select("query_id", "chunk_id", "rank").unionByName(near.select("query_id", "chunk_id", "rank"))
    fused = sides.groupBy("query_id", "chunk_id").agg(F.round(F.sum(1.0 / (RRF_K + F.col("rank"))), 9).alias("score")).withColumn("rank", F.row_number().over(best))
    out = None
    for mode, hits in (("fts", fts), ("vector", near), ("hybrid", fused)):
        items = hits.where(F.col("rank") <= k).select("query_id", "chunk_id", "rank").join(archive.select("chunk_id", "item_id"), "chunk_id").groupBy("query_id", "item_id").agg(F.min("rank").alias("rank"))
        place = items.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
        one = pairs.select("query_id", F.col("target").alias("item_id")).join(place, ["query_id", "item_id"], "left").select("query_id", F.lit(mode).alias("mode"), "rank")
        out = one if out is None else out.unionByName(one)
    return out


def enough_pairs(pairs: DataFrame, least: int = 30) -> int:
    """How many pairs there are; fewer than `least` are no basis for an evaluation."""
    n = pairs.count()
    if n < least:
        raise ValueError(f"{n} pairs, {least} are needed")
    return n


def evaluate(ranks: DataFrame) -> DataFrame:
    """Recall at 1, 5 and 10 and the mean reciprocal rank by mode; ranks has mode and rank, null for a miss."""
    at = lambda k: F.round(F.avg(F.coalesce((F.col("rank") <= k).cast("double"), F.lit(0.0))), 6)
    return ranks.groupBy("mode").agg(at(1).alias("recall_1"), at(5).alias("recall_5"), at(10).alias("recall_10"), F.round(F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))), 6).alias("mrr"))
