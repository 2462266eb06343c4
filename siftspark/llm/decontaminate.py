"""Benchmark decontamination with a positional inverted index.

Test texts are cut into windows of ten consecutive words (shorter texts are one
window). One pass over the corpus counts how often each test term occurs, and one
stores the index: for the two rarest terms of each window, postings (document,
position) with the words around them. A window's list of the rarest term and that
of the next, each adjusted by the term's offset in the window, are intersected;
where both lists have a document and start, the terms at the window's other
offsets are compared with the words kept beside the posting (exact phrase), or
looked for within a few words of it (proximity). Only DataFrame functions are used.

Index terms go into the pass as a set of literals where they are TERMS_INLINE at
most. More are joined with the corpus' words, and each document gets its own list:
the same result, and the number of passes doesn't depend on the benchmark. Lists
are joined by a shuffle, whose hot terms Spark may split.

Defined cases: null and wordless texts have no words, match nothing and are
returned with zeros; rows that repeat doc_id and text are one document while
matching and keep their number in the result; repeated test items count once by item_id;
extra columns are never read.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, on_key, packed, table, text_hash, unpacked

WINDOW = 10
TERMS_INLINE = 20_000
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Runs of ASCII digits, letters and all characters beyond ASCII; A to Z in lower case."""
    return F.filter(F.split(F.translate(text, string.ascii_uppercase, string.ascii_lowercase), _GAP), lambda x: x != "")


def windows(bench: DataFrame) -> DataFrame:
    """item_id, window (array of words), for all windows of all items."""
    w = bench.select("item_id", words(F.coalesce("text", F.lit(""))).alias("w")).where("size(w) > 0")
    return w.select("item_id", F.explode(F.expr(f"transform(sequence(0, greatest(size(w) - {WINDOW}, 0)), i -> slice(w, i + 1, {WINDOW}))")).alias("window")).distinct()


def _few(terms: DataFrame) -> list[str] | None:
    """All terms, if they are TERMS_INLINE at most."""
    got = [r[0] for r in terms.limit(TERMS_INLINE + 1).collect()]
    return got if len(got) <= TERMS_INLINE else None


def index_terms(docs: DataFrame, wins: DataFrame) -> DataFrame:
    """The windows as w (a number), with their rarest term and the next (t1, t2) and their offsets (o1, o2); t2 is null where there is one term only.

    Windows with a term that the corpus lacks are left out."""
    terms = checkpoint(wins.select(F.explode("window").alias("term")).distinct())
    some = _few(terms)
    each = words(F.col("text")) if some is None else F.filter(words(F.col("text")), lambda x: x.isin(some))
    counts = docs.select(F.explode(each).alias("term")).groupBy("term").count()
    counts = checkpoint(counts if some is not None else counts.join(terms, "term", "left_semi"))
    places = wins.select("item_id", "window", F.posexplode("window").alias("off", "term"))
    ranked = places.join(counts, "term", "left").groupBy("item_id", "window").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("count", F.lit(0)).alias("n"), "term", "off"))).alias("r"))
    ranked = ranked.where("r[0].n > 0").select("item_id", "window", F.col("r")[0].alias("a"), F.expr("get(filter(r, x -> x.term <> r[0].term), 0)").alias("b"))
    return ranked.select(F.xxhash64("item_id", "window").alias("w"), "item_id", "window", F.col("a.term").alias("t1"), F.col("a.off").alias("o1"), F.col("b.term").alias("t2"), F.col("b.off").alias("o2"))


def postings(docs: DataFrame, terms: DataFrame, around: int = WINDOW - 1) -> DataFrame:
    """The index: doc_id, _th, n_words and, for each place of a term, term, pos, ctx (the words around) and lead (how many of them stand before).

    Every document has one row more, with pos -1 and no term."""
    base = docs.select("doc_id", text_hash(), words(F.coalesce("text", F.lit(""))).alias("w"))
    some = _few(terms)
    if some is None:
        held = base.select("doc_id", "_th", F.explode(F.array_distinct("w")).alias("term")).join(terms, "term")
        base = on_key(base, held.groupBy("doc_id", "_th").agg(F.collect_set("term").alias("_t")), "left")
        wanted = lambda p: F.array_contains("_t", p["term"])
    else:
        wanted = lambda p: p["term"].isin(some)
    place = F.filter(F.transform("w", lambda x, i: F.struct(i.alias("pos"), x.alias("term"))), wanted)
    hits = base.select("doc_id", "_th", F.size("w").alias("n_words"), "w", F.coalesce(place, F.expr("cast(array() AS array<struct<pos: int, term: string>>)")).alias("p"))
    rows = f"""concat(array(struct(-1 AS pos, cast(NULL AS string) AS term, cast(NULL AS array<string>) AS ctx, 0 AS lead)),
        transform(p, x -> struct(x.pos AS pos, x.term AS term, slice(w, greatest(x.pos - {around}, 0) + 1, least(x.pos, {around}) + 1 + {around}) AS ctx, least(x.pos, {around}) AS lead)))"""
    return hits.select("doc_id", "_th", "n_words", F.expr(rows).alias("p")).select("doc_id", "_th", "n_words", F.inline_outer("p"))  # inline() would infer a filter that repeats all of p


def find(docs: DataFrame, bench: DataFrame, slop: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, matches): doc_id, _th, n_words for each row of docs; doc_id, _th, n_words, item_id, start, len for each match.

    With slop, a match is a place of the rarest term that has all terms of the
    window, in any order, among len + slop consecutive words around it; start is then the place itself and len 1."""
    near = WINDOW - 1 + (slop or 0)
    wins = checkpoint(index_terms(docs, checkpoint(windows(bench))))
    posts = checkpoint(postings(docs, wins.select(F.explode(F.array("t1", "t2")).alias("term")).where("term IS NOT NULL").distinct(), near))
    each = posts.where("pos = -1").select("doc_id", "_th", "n_words")
    lists = posts.where("pos >= 0")
    first = lists.join(wins.withColumnRenamed("t1", "term"), "term")
    if slop is None:
        first = first.withColumn("start", F.expr("pos - o1")).where("start >= 0")
        key = [F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_d"), F.col("_th").alias("_t"), F.col("w").alias("_w")]
        second = lists.join(wins.withColumnRenamed("t2", "term"), "term").select(*key, F.expr("pos - o2").alias("_s"))
        same = (F.coalesce(F.col("doc_id").cast("string"), F.lit("")) == F.col("_d")) & (F.col("_th") == F.col("_t")) & (F.col("w") == F.col("_w")) & (F.col("start") == F.col("_s"))
        both = first.where("t2 IS NOT NULL").join(second, same, "left_semi").unionByName(first.where("t2 IS NULL"))
        first = both.where("slice(ctx, greatest(lead - o1, 0) + 1, size(window)) = window")
        start, size = F.col("start"), F.expr("size(window)")
    else:
        first = first.where(f"exists(sequence(1, greatest(size(ctx) - size(window) - {slop} + 1, 1)), a -> a <= lead + 1 AND a + size(window) + {slop} > lead + 1 AND size(array_except(window, slice(ctx, a, size(window) + {slop}))) = 0)")
        start, size = F.col("pos"), F.lit(1)
    return each, first.select("doc_id", "_th", "n_words", "item_id", start.alias("start"), size.alias("len"))


def matches(docs: DataFrame, bench: DataFrame, slop: int | None = None) -> DataFrame:
    """find() in one: one row for each document, with null item_id, and one for each match."""
    each, found = find(docs, bench, slop)
    nulls = [F.lit(None).cast(found.schema[c].dataType).alias(c) for c in ("item_id", "start", "len")]
    return each.select("doc_id", "_th", "n_words", *nulls).unionByName(found)


def summarize(found: DataFrame, each: DataFrame | None = None) -> DataFrame:
    """Documents, row by row, with n_words, n_hit, n_items, items (their ids as sorted strings), covered (positions of hit words): of what find() gives, or of matches()."""
    if each is None:
        each, found = found.where("start IS NULL"), found.where("start IS NOT NULL")
    agg = found.groupBy("doc_id", "_th").agg(F.collect_set(F.struct("start", "len")).alias("_s"), F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    cov = "array_sort(array_distinct(flatten(transform(_s, s -> sequence(s.start, s.start + s.len - 1)))))"
    hit = agg.select("doc_id", "_th", F.expr(cov).alias("covered"), "items")
    out = on_key(each, hit, "left").select("doc_id", "_th", F.col("n_words").cast("long").alias("n_words"), F.coalesce("covered", F.array().cast("array<int>")).alias("covered"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    return out.withColumn("n_hit", F.size("covered").cast("long")).withColumn("n_items", F.size("items").cast("long"))


def decontaminate(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """docs without the documents that hold a window of the benchmark; all columns as they were."""
    bad = find(docs, bench)[1].select("doc_id", "_th").distinct()
    left = docs.select("doc_id", text_hash(), packed(docs))
    return on_key(left, bad, "left_anti").select(*unpacked(docs))


def op7_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    each, found = find(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))
    out = summarize(found, each)
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


SQL = r"""
WITH t AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
wins AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda i: w[i:i + 9])) AS win FROM b WHERE len(w) > 0),
sizes AS (SELECT DISTINCT len(win) AS n FROM wins),
grams AS (SELECT doc_id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: w[i:i + n - 1])) AS win, unnest(range(1, len(w) - n + 2)) AS i FROM t, sizes WHERE len(w) >= n),
m AS (SELECT doc_id, i, n, item_id FROM grams JOIN wins USING (win)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM m) GROUP BY doc_id)
SELECT t.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM t LEFT JOIN h ON t.doc_id = h.doc_id LEFT JOIN it ON t.doc_id = it.doc_id
"""
