"""Daily ranking: popularity percentiles, affinity to likes, novelty, the digest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.score import age_hours, combine, recency
from ..functions.text import fold_latin, token_lines, topic_tokens
from .lists import HIDING, latest
from .order import number_rows
from .retrieval import K1, B, IDF_FLOOR
from .storage import checkpoint

# The signal that counts as popularity by kind of source, and weights by mode.
POPULARITY = {"hf_papers": "upvotes", "hf_blog": "upvotes7d", "hf_community": "upvotes7d"}
WEIGHTS = {
    "ai": {"rel": 0.5, "pop": 0.25, "rec": 0.15, "nov": 0.1},
    "likes": {"topic": 0.5, "source": 0.2, "rec": 0.3},
    "cold": {"pop": 0.25, "rec": 0.15},
}
LIKED_TERMS, MATCHED = 30, 3
ALPHA, BETA = 1.0, 10.0


def mid_rank(value: str, *by: str) -> Column:
    """Share of the partition strictly below, plus half of the ties (the row itself included). One task holds a partition: see mid_ranks."""
    part = Window.partitionBy(*by)
    return (F.rank().over(part.orderBy(value)) - 1 + 0.5 * F.count("*").over(Window.partitionBy(*by, value))) / F.count("*").over(part)


def mid_ranks(rows: DataFrame, value: str, by: str, name: str) -> DataFrame:
    """rows with mid_rank() of value by a key. The windows run over ranges of distinct values, then over the sums of the ranges: no task holds the rows of a key, nor all its values."""
    counts = rows.where(F.col(value).isNotNull() & F.col(by).isNotNull()).groupBy(by, value).agg(F.count("*").alias("_n"))
    parts = counts.repartitionByRange(by, value).withColumn("_part", F.spark_partition_id())
    parts = checkpoint(parts.withColumn("_in", F.sum("_n").over(Window.partitionBy("_part", by).orderBy(value)) - F.col("_n")))
    sums = parts.groupBy(by, "_part").agg(F.sum("_n").alias("_s"))
    before = sums.select(by, "_part", (F.sum("_s").over(Window.partitionBy(by).orderBy("_part")) - F.col("_s")).alias("_before"), F.sum("_s").over(Window.partitionBy(by)).alias("_all"))
    at = parts.join(before, [by, "_part"]).select(by, value, ((F.col("_before") + F.col("_in") + 0.5 * F.col("_n")) / F.col("_all")).alias(name))
    return rows.join(at, [by, value])


def popularity(items: DataFrame, sources: DataFrame, signals: DataFrame, now: Column) -> DataFrame:
    """item_id, pop: percentile within the source among items of the last 30 days."""
    pick = F.lit(None).cast("long")
    for kind, signal in POPULARITY.items():
        pick = F.when(F.col("recipe_type") == kind, F.col(signal)).otherwise(pick)
    recent = items.where(F.col("first_seen") >= now - F.expr("INTERVAL 30 DAYS"))
    have = recent.join(sources.select(F.col("id").alias("source_id"), "recipe_type"), "source_id").join(latest(signals, "item_id", "observed_on"), F.col("id") == F.col("item_id")).select("id", "source_id", pick.alias("value")).where("value IS NOT NULL")
    return mid_ranks(have, "value", "source_id", "pop").select(F.col("id").alias("item_id"), "pop")


def liked_terms(items: DataFrame, state: DataFrame, limit: int = LIKED_TERMS) -> DataFrame:
    """term, n, n_title of the most common topics of liked items that aren't hidden."""
    liked = items.join(state.where("liked AND NOT hidden").select(F.col("item_id").alias("id")), "id", "left_semi")
    t = liked.select(topic_tokens(F.col("title")).alias("title"), topic_tokens(F.col("summary")).alias("summary"))
    each = t.select("title", F.explode(F.array_union("title", "summary")).alias("term"))
    counts = each.groupBy("term").agg(F.count("*").alias("n"), F.count_if(F.array_contains("title", F.col("term"))).alias("n_title"))
    return counts.orderBy(F.desc("n"), F.desc("n_title"), "term").limit(limit)


def topic_scores(items: DataFrame, terms: list[str]) -> DataFrame:
    """id, topic: BM25 of the terms as prefixes (each one pseudo-term), scaled by the best; 0 without a match."""
    lines = items.select("id", token_lines(fold_latin(F.lower(F.concat_ws(" ", "title", "summary")))).alias("t"))

    def count(w: str) -> Column:
        return ((F.octet_length("t") - F.octet_length(F.replace("t", F.lit(f"\n{w}"), F.lit("")))) / (len(w.encode()) + 1)).cast("int")

    # Three passes read the counts: they are made once.
    counted = checkpoint(lines.select("id", F.regexp_count("t", F.lit("\n[^\n]")).alias("length"), *[count(w).alias(f"f{i}") for i, w in enumerate(terms)]))
    stats = counted.agg(F.count("*").alias("total"), F.avg("length").alias("mean"), *[F.count_if(F.col(f"f{i}") > 0).alias(f"n{i}") for i in range(len(terms))])
    score = F.lit(0.0)
    for i in range(len(terms)):
        idf = F.greatest(F.lit(IDF_FLOOR), F.log((F.col("total") - F.col(f"n{i}") + 0.5) / (F.col(f"n{i}") + 0.5)))
        f = F.col(f"f{i}")
        score = score + F.when(f > 0, idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("length") / F.col("mean")))).otherwise(F.lit(0.0))
    raw = counted.crossJoin(F.broadcast(stats)).select("id", score.alias("raw"))  # stats is one row
    best = raw.agg(F.max("raw").alias("best"))
    return raw.crossJoin(F.broadcast(best)).select("id", F.when(F.col("best") > 0, F.col("raw") / F.col("best")).otherwise(F.lit(0.0)).alias("topic"))


def matched_terms(items: DataFrame, terms: list[str]) -> DataFrame:
    """id, matched: the terms that begin a token, in order, none overlapping one before it; the first three."""
    lines = items.select("id", F.regexp_replace(token_lines(F.lower(F.concat_ws(" ", "title", "summary"))), F.lit("(?<=\n)[._-]+|[._-]+(?=\n|$)"), F.lit("")).alias("t"))
    # A column for each term, so that the lines are made once: within a lambda they would be made for every term.
    found = F.array_compact(F.array(*[F.when(F.contains("t", F.lit(f"\n{t}")), F.lit(t)) for t in terms]))
    pick = F.aggregate(found, F.array().cast("array<string>"), lambda a, w: F.when(F.exists(a, lambda h: F.startswith(h, w) | F.startswith(w, h)), a).otherwise(F.concat(a, F.array(w))))
    return lines.select("id", F.slice(pick, 1, MATCHED).alias("matched"))


def source_affinity(items: DataFrame, state: DataFrame) -> DataFrame:
    """source_id, likes, seen, source: the smoothed rate of likes, scaled by the best."""
    no = F.lit(False)
    both = items.select("id", "source_id").join(state, F.col("id") == F.col("item_id"), "left")
    liked = F.coalesce("liked", no)
    rates = both.groupBy("source_id").agg(F.count_if(liked & ~F.coalesce("hidden", no)).alias("likes"), F.count_if(F.col("read_at").isNotNull() | liked).alias("seen")).withColumn("rate", (F.col("likes") + ALPHA) / (F.col("seen") + BETA))
    return rates.crossJoin(F.broadcast(rates.agg(F.max("rate").alias("best")))).select("source_id", "likes", "seen", (F.col("rate") / F.col("best")).alias("source"))


def mode_of(ai: bool, state: DataFrame) -> str:
    """'ai' where there are relevances, 'likes' where something is liked and not hidden, else 'cold'."""
    return "ai" if ai else "cold" if state.where("liked AND NOT hidden").isEmpty() else "likes"


def like_affinity(items: DataFrame, cands: DataFrame, state: DataFrame, limit: int = LIKED_TERMS) -> tuple[DataFrame | None, DataFrame, DataFrame] | None:
    """(topic, source, matched) of a day's candidates, or None where nothing is liked; topic is None where no liked term is useful.

    Terms are `limit` at most. BM25 counts all items; the best of the candidates is 1; terms are named only where the topic isn't 0."""
    if state.where("liked AND NOT hidden").isEmpty():
        return None
    terms = [r.term for r in liked_terms(items, state, limit).collect()]
    if not terms:
        return None, source_affinity(items, state), cands.select("id", F.array().cast("array<string>").alias("matched"))
    mine = topic_scores(items, terms).join(cands.select("id"), "id", "left_semi")
    best = mine.agg(F.max("topic").alias("best"))
    topic = mine.crossJoin(F.broadcast(best)).select("id", F.when(F.col("best") > 0, F.col("topic") / F.col("best")).otherwise(F.lit(0.0)).alias("topic"))  # best is one row
    named = matched_terms(cands, terms).join(topic, "id").select("id", F.when(F.col("topic") > 0, F.col("matched")).otherwise(F.array().cast("array<string>")).alias("matched"))
    return topic, source_affinity(items, state), named


def build_digest(items: DataFrame, digests: DataFrame, triage: DataFrame, state: DataFrame, pop: DataFrame, day: Column, now: Column, ai: bool, novelty: DataFrame | None = None) -> tuple[str, DataFrame]:
    """(mode, the day's rows): day, item_id, position, final_score, hidden and the terms; see exports.replace_day for the write."""
    cands = candidates(items, digests, day)
    mode, more = mode_of(ai, state), {}
    if mode == "ai":
        more["novelty"] = novelty
    elif mode == "likes":
        more["topic"], more["source"], _ = like_affinity(items, cands, state)
    ranked = digest(cands, triage, pop, now, mode, **more)
    return mode, ranked.select(day.alias("day"), F.col("id").alias("item_id"), "position", F.col("final").alias("final_score"), "hidden", *[c for c in ranked.columns if c.startswith("t_")])


def replaced_day(digests: DataFrame, built: DataFrame, day: Column) -> DataFrame:
    """The digests after a day's was built: its rows in place of what that day had."""
    return digests.where(~F.col("day").eqNullSafe(day)).unionByName(built.select(*digests.columns))


def candidates(items: DataFrame, digests: DataFrame, day: Column) -> DataFrame:
    """Items first seen on a day that no earlier digest shows."""
    start = day.cast("timestamp_ntz")
    today = items.where((F.col("first_seen") >= start) & (F.col("first_seen") < start + F.expr("INTERVAL 1 DAY")))
    return today.join(digests.where(F.col("day") < day).select(F.col("item_id").alias("id")), "id", "left_anti")


def digest(cands: DataFrame, triage: DataFrame, pop: DataFrame, now: Column, mode: str, novelty: DataFrame | None = None, topic: DataFrame | None = None, source: DataFrame | None = None) -> DataFrame:
    """The day's digest: id, final, position, hidden, age_hours and the terms."""
    out = cands.join(triage.select(F.col("item_id").alias("id"), "relevance", "flags"), "id", "left").join(pop.select(F.col("item_id").alias("id"), "pop"), "id", "left")
    age = (F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(F.coalesce("published_at", "first_seen").cast("timestamp"))) / 86400.0
    none = F.lit(None).cast("double")
    terms = {"rel": F.col("relevance") / 10.0, "pop": F.col("pop"), "rec": recency(age), "nov": none, "topic": none, "source": none}
    if novelty is not None:
        out, terms["nov"] = out.join(novelty.select("id", "nov"), "id", "left"), F.col("nov")
    if topic is not None:
        out, terms["topic"] = out.join(topic.select("id", "topic"), "id", "left"), F.coalesce("topic", F.lit(0.0))
    if source is not None:
        out, terms["source"] = out.join(source.select("source_id", "source"), "source_id", "left"), F.coalesce("source", F.lit(0.0))
    weights = WEIGHTS[mode]
    hidden = F.coalesce(F.exists("flags", lambda f: f.isin(*HIDING)), F.lit(False))
    ranked = out.select("id", "first_seen", F.round(combine(terms, weights), 6).alias("final"), hidden.alias("hidden"), age_hours(age).alias("age_hours"), *[F.round(terms[k], 6).alias(f"t_{k}") for k in weights])
    return number_rows(ranked, F.desc("final"), F.desc("first_seen"), F.asc("id"))
