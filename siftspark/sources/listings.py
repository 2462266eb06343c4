"""Captured JSON listings as items. Malformed entries are counted and left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.address import paper_id

PAPERS = "array<struct<paper: struct<id: string, title: string, summary: string, publishedAt: string, upvotes: int, githubStars: int, authors: array<struct<name: string, hidden: boolean>>>, title: string, summary: string, publishedAt: string, numComments: int, thumbnail: string>>"
POST = "struct<slug: string, title: string, url: string, publishedAt: string, upvotes: int, upvotes7d: int, thumbnail: string, authorsData: array<struct<name: string, fullname: string>>>"


def _when(text: Column) -> Column:
    return F.try_to_timestamp(F.regexp_replace(text, F.lit("Z$"), F.lit("+00:00"))).cast("timestamp")


def _entries(payloads: DataFrame, array: Column, bad: Column) -> DataFrame:
    """source_id, rank (from 1), e and ok for each entry of each payload."""
    return payloads.select("source_id", F.posexplode(array).alias("pos", "e")).select("source_id", (F.col("pos") + 1).alias("rank"), "e").withColumn("ok", ~F.coalesce(bad, F.lit(True)))


def papers(payloads: DataFrame, base: str = "https://papers.example.org/") -> DataFrame:
    """payloads: source_id, body (JSON list)."""
    rows = _entries(payloads, F.from_json("body", PAPERS), F.col("e.paper.id").isNull() | F.coalesce("e.paper.title", "e.title").isNull())
    p = F.col("e.paper")
    names = F.transform(F.filter(F.coalesce(p["authors"], F.array().cast("array<struct<name: string, hidden: boolean>>")), lambda a: ~F.coalesce(a["hidden"], F.lit(False))), lambda a: a["name"])
    return rows.select("source_id", "rank", "ok", F.concat(F.lit(base), p["id"]).alias("url"), F.coalesce(p["title"], F.col("e.title")).alias("title"), F.lit("paper").alias("kind"), _when(F.coalesce("e.publishedAt", p["publishedAt"])).alias("published_at"), F.substring(F.coalesce(F.nullif(p["summary"], F.lit("")), "e.summary", F.lit("")), 1, 1000).alias("summary"), names.alias("authors"), p["upvotes"].alias("upvotes"), F.lit(None).cast("int").alias("upvotes7d"), p["githubStars"].alias("stars"), F.col("e.numComments").alias("comments"), p["id"].alias("paper_id"))


def posts(payloads: DataFrame, field: str, base: str, limit: int | None = None) -> DataFrame:
    """payloads: source_id, body (JSON object with the list in `field`); with limit, the first entries only."""
    body = F.from_json("body", f"struct<{field}: array<{POST}>>")[field]
    rows = _entries(payloads, body if limit is None else F.slice(body, 1, limit), F.col("e.title").isNull() | F.coalesce("e.url", "e.slug").isNull())
    e = F.col("e")
    path = F.coalesce(e["url"], F.concat(F.lit("/blog/"), e["slug"]))
    url = F.when(F.startswith(path, F.lit("/")), F.concat(F.lit(base), path)).otherwise(path)
    names = F.transform(F.coalesce(e["authorsData"], F.array().cast("array<struct<name: string, fullname: string>>")), lambda a: F.coalesce(F.nullif(a["fullname"], F.lit("")), a["name"]))
    return rows.select("source_id", "rank", "ok", url.alias("url"), e["title"].alias("title"), F.lit("article").alias("kind"), _when(e["publishedAt"]).alias("published_at"), F.lit("").alias("summary"), names.alias("authors"), e["upvotes"].alias("upvotes"), e["upvotes7d"].alias("upvotes7d"), F.lit(None).cast("int").alias("stars"), F.lit(None).cast("int").alias("comments"), paper_id(url).alias("paper_id"))


def scan_report(rows: DataFrame) -> DataFrame:
    """source_id, fetched, skipped, failed (nothing usable)."""
    by = rows.groupBy("source_id").agg(F.count_if("ok").alias("fetched"), F.count_if(~F.col("ok")).alias("skipped"))
    return by.withColumn("failed", F.col("fetched") == 0)
