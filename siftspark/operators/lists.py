"""The item list: its wide projection, filters, orders and facets."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.score import reading_minutes
from ..functions.text import TOKEN, fold_latin

HIDING = ("promo", "thin")
PAGE = 500


def latest(rows: DataFrame, key: str, when: str) -> DataFrame:
    """The last row of each key: one aggregation, no window."""
    rest = [c for c in rows.columns if c not in (key, when)]
    return rows.groupBy(key).agg(F.max(when).alias(when), F.max_by(F.struct(*rest), when).alias("_r")).select(key, when, "_r.*")


def listed(items: DataFrame, state: DataFrame, contents: DataFrame, signals: DataFrame, digests: DataFrame, triage: DataFrame) -> DataFrame:
    """One wide row for each item, with defaults for what it lacks."""
    sig = latest(signals, "item_id", "observed_on").select("item_id", F.coalesce("upvotes7d", "upvotes").alias("popularity"), "comments")
    dig = latest(digests, "item_id", "day").select("item_id", F.col("final_score").alias("score"))
    out = items.withColumnRenamed("id", "item_id")
    for side in (state, contents.where("status = 'ok'").select("item_id", "words"), sig, dig, triage):
        out = out.join(side, "item_id", "left")
    no = F.lit(False)
    return out.select(
        F.col("item_id").alias("id"), "source_id", "kind", "title", "first_seen", "published_at", "popularity", "comments", F.coalesce("liked", no).alias("liked"), F.coalesce("saved", no).alias("saved"), F.coalesce("hidden", no).alias("hidden"),
        F.col("read_at").isNotNull().alias("opened"), F.coalesce("read_progress", F.lit(0.0)).alias("read_progress"), "words", reading_minutes(F.col("words")).alias("minutes"), "score", "relevance",
        F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), F.coalesce("flags", F.array().cast("array<string>")).alias("flags"))


@dataclass(frozen=True)
class ItemFilter:
    show: str = "unread"
    since: datetime | None = None
    visit: datetime | None = None
    sources: Sequence[str] = ()
    kinds: Sequence[str] = ()
    tags: Sequence[str] = ()
    words: Sequence[str] = ()
    expanded: bool = False
    pinned: int | None = None


def eval_pairs(items: DataFrame, archive: DataFrame) -> DataFrame:
    """query_id, target, title, summary: articles and the paper that they are about, where the archive holds the paper."""
    asks = items.where("kind = 'article'").select(F.col("id").alias("query_id"), "paper_key", "title", "summary")
    papers = items.where("kind = 'paper'").select(F.col("id").alias("target"), "paper_key")
    return asks.join(papers, "paper_key").join(archive.select(F.col("chunk_id").alias("target")), "target", "left_semi").select("query_id", "target", "title", "summary")


def shown(show: str) -> Column:
    """Unread, new and all leave hidden items out; the other views are what they are called."""
    return {
        "unread": ~F.col("opened") & ~F.col("hidden"), "new": ~F.col("opened") & ~F.col("hidden"), "all": ~F.col("hidden"),
        "saved": F.col("saved"), "liked": F.col("liked"), "hidden": F.col("hidden"),
    }[show]


def hidden_by_triage() -> Column:
    return F.exists("flags", lambda f: f.isin(*HIDING))


def prefix_match(text: Column, words: Sequence[str]) -> Column:
    """Every word begins some token of the text."""
    tokens = F.regexp_extract_all(fold_latin(F.lower(text)), F.lit(TOKEN), F.lit(0))

    def begins(w: str) -> Column:
        return F.exists(tokens, lambda t: F.startswith(t, F.lit(w.lower())))

    out = F.lit(True)
    for w in words:
        out &= begins(w)
    return out


def conditions(f: ItemFilter) -> Column:
    keep = shown(f.show)
    if f.show == "new":
        keep &= F.lit(f.visit is None) if f.visit is None else F.col("first_seen") > F.lit(f.visit.replace(microsecond=0)).cast("timestamp_ntz")
    elif f.since is not None:
        keep &= F.col("first_seen") >= F.lit(f.since).cast("timestamp_ntz")
    if f.sources:
        keep &= F.col("source_id").isin(*f.sources)
    if f.kinds:
        keep &= F.col("kind").isin(*f.kinds)
    if f.tags:
        keep &= F.arrays_overlap("tags", F.array(*[F.lit(t) for t in f.tags]))
    if f.words:
        keep &= prefix_match(F.col("title"), f.words)
    if f.show in ("unread", "new", "all") and not f.expanded:
        keep &= ~hidden_by_triage()
    return keep | (F.col("id") == f.pinned) if f.pinned is not None else keep


def order(name: str) -> list[Column]:
    newest = [F.desc("first_seen"), F.desc(F.coalesce("published_at", "first_seen")), F.desc("id")]
    return {
        "newest": newest, "score": [F.desc_nulls_last("score"), *newest], "popular": [F.desc_nulls_last("popularity"), F.desc("first_seen"), F.desc("id")],
        "reading_time": [F.asc_nulls_last("words"), F.desc("first_seen"), F.desc("id")], "ranked": [F.asc_nulls_last("position"), *newest],
    }[name]


def page(rows: DataFrame, name: str, limit: int = PAGE) -> DataFrame:
    """The first rows in an order, with their position: a top-k, then a window over at most `limit` rows."""
    top = rows.orderBy(*order(name)).limit(limit)
    return top.withColumn("position_no", F.row_number().over(Window.orderBy(*order(name))))


def listing(rows: DataFrame, keep: Column, by: str, limit: int = PAGE, ranked: DataFrame | None = None, pinned: int | None = None) -> tuple[DataFrame, int]:
    """(the page, how many items there are without any condition). ranked (id, position) are a search's results, best first: only they are listed, in their order, under the other conditions; a pinned item stays, after them if they lack it."""
    total = rows.count()
    if ranked is not None:
        rows = rows.join(F.broadcast(ranked.select("id", "position").limit(limit)), "id", "left")  # a search's few rows
        keep, by = keep & F.col("position").isNotNull(), "ranked"
    if pinned is not None:
        keep = F.coalesce(keep, F.lit(False)) | (F.col("id") == pinned)
    return page(rows.where(keep), by, limit), total


def item_row(rows: DataFrame, item: int) -> DataFrame:
    """The one row of an item, as the list shows it; none if there is no such item."""
    return rows.where(F.col("id") == item)


def tag_facet(rows: DataFrame) -> DataFrame:
    return rows.select("id", F.explode("tags").alias("tag")).groupBy("tag").agg(F.countDistinct("id").alias("n"))


def hidden_facet(rows: DataFrame) -> DataFrame:
    """How many items each hiding flag leaves out, and how many they leave out together."""
    hit = rows.select("id", F.array_intersect("flags", F.array(*[F.lit(x) for x in HIDING])).alias("f")).where("size(f) > 0")
    each = hit.select("id", F.explode("f").alias("flag")).groupBy("flag").agg(F.countDistinct("id").alias("n"))
    return each.unionByName(hit.agg(F.countDistinct("id").alias("n")).select(F.lit("(total)").alias("flag"), "n"))
