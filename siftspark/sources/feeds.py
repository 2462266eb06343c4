"""Feeds and sitemaps read by Spark's own XML functions, conditional fetches, and the search for a page's feed.

Everything here runs in the JVM: from_xml takes RSS, RDF and Atom by one schema,
and the rest are expressions. Documents that declare a document type or entities
are refused, as markup's parser does; what isn't XML is null. Zipped sitemaps
are markup's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.address import feed_candidates
from ..functions.text import plain_text, strip_controls
from ..operators.storage import checkpoint
from .markup import rejection

MOST_SUMMARY, MOST_ALTERNATES = 1000, 5

_LINK = "array<struct<_VALUE: string, _href: string, _rel: string>>"
_FIELDS = f"title: string, link: {_LINK}, pubDate: string, published: string, date: string, updated: string, summary: string, description: string, content: string, author: array<string>, creator: array<string>"
FEED_SCHEMA = f"channel struct<title: string, link: {_LINK}, item: array<struct<{_FIELDS}>>>, title string, link {_LINK}, item array<struct<{_FIELDS}>>, entry array<struct<{_FIELDS}>>"
MAP_SCHEMA = "url array<struct<loc: string, lastmod: string>>, sitemap array<struct<loc: string, lastmod: string>>"
_OPTIONS = {"ignoreNamespace": "true", "attributePrefix": "_", "valueTag": "_VALUE", "mode": "PERMISSIVE", "ignoreSurroundingSpaces": "true"}

# Zones by name in mail dates.
ZONES = {"GMT": "+0000", "UTC": "+0000", "UT": "+0000", "Z": "+0000", "EST": "-0500", "EDT": "-0400", "CST": "-0600", "CDT": "-0500", "MST": "-0700", "MDT": "-0600", "PST": "-0800", "PDT": "-0700"}


def text_of(body: Column) -> Column:
    """A document as text: in the encoding that its prolog names (Latin-1 or UTF-16), else UTF-8; without a byte order mark."""
    name = F.lower(F.regexp_extract(F.decode(F.substring(body, 1, 200), "ISO-8859-1"), r"^[^<]*<\?xml[^>]*encoding=[\"']([A-Za-z0-9_-]+)", 1))
    text = F.when(name.isin("iso-8859-1", "latin-1", "windows-1252"), F.decode(body, "ISO-8859-1")).otherwise(F.decode(body, "UTF-8"))
    return F.regexp_replace(text, F.lit("^﻿"), F.lit(""))


def _once(value: Column, then) -> Column:
    """then(value), with the value made once, however often it is used: within a lambda Spark makes an expression as often as it is written."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def moment(text: Column) -> Column:
    """A time without a zone, in UTC, from a mail date or ISO 8601; a moment that names no zone is UTC, and null if it is neither."""
    names = F.create_map(*[F.lit(x) for kv in ZONES.items() for x in kv])
    numbered = lambda mail, zone: F.when(zone != "", F.concat(F.regexp_replace(mail, F.lit(r"[A-Za-z]+$"), F.lit("")), F.coalesce(F.element_at(names, F.upper(zone)), F.lit("+0000")))).otherwise(mail)
    zoned = lambda mail: F.when(F.rlike(mail, F.lit(r"\d$")) & ~F.rlike(mail, F.lit(r"[+-]\d{4}$")), F.concat(mail, F.lit(" +0000"))).otherwise(mail)
    by_mail = lambda one: F.when(F.rlike(one, F.lit(r"^\d{1,2} [A-Za-z]{3} \d{4} \d{1,2}:\d{2}:\d{2} [+-]\d{4}$")), F.try_to_timestamp(one, F.lit("d MMM yyyy H:mm:ss xx")))

    def at(t: Column) -> Column:
        mail = _once(_once(F.regexp_replace(t, F.lit(r"^[A-Za-z]+,\s*"), F.lit("")), lambda m: _once(F.regexp_extract(m, r"([A-Za-z]+)$", 1), lambda z: numbered(m, z))), zoned)
        seconds = F.regexp_replace(mail, F.lit(r"(\s\d{1,2}:\d{2})(\s+[+-])"), F.lit("$1:00$2"))
        iso = F.when(F.rlike(t, F.lit(r"^\d{4}-\d{2}-\d{2}$")), F.concat(t, F.lit("T00:00:00Z"))).when(F.rlike(t, F.lit(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}$")), F.concat(t, F.lit(":00Z"))).when(F.rlike(t, F.lit(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d+)?$")), F.concat(t, F.lit("Z"))).when(F.rlike(t, F.lit(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}")), t)
        return F.when(t != "", F.coalesce(_once(F.regexp_replace(seconds, F.lit(r"\s+"), F.lit(" ")), by_mail), iso.try_cast("timestamp")))

    return F.timestamp_add("SECOND", F.unix_seconds(_once(F.trim(text), at)).cast("int"), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def base_parts(base: Column) -> Column:
    """What resolved() needs of a page's address."""
    path = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.struct(
        F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1).alias("scheme"), F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1).alias("origin"), path.alias("path"),
        F.regexp_extract(base, r"^[^?#]*(\?[^#]*)", 1).alias("asked"), F.when(path == "", F.lit("/")).otherwise(F.regexp_extract(path, r"^(.*/)", 1)).alias("folder"))


def resolved(href: Column, base: Column) -> Column:
    """An address as a browser reads it on a page: absolute ones stay, others complete it; dots in paths are walked."""
    return _once(base_parts(base), lambda b: resolved_on(href, b))


def resolved_on(href: Column, b: Column) -> Column:
    """resolved() on a page whose base_parts() are known."""

    def walked(joined: Column) -> Column:
        kept = F.aggregate(F.split(joined, "/"), F.array().cast("array<string>"), lambda a, s: F.when(s == "..", F.when(F.size(a) > 1, F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(a)).when(s == ".", a).otherwise(F.concat(a, F.array(s))))
        path = F.concat(F.array_join(kept, "/"), F.when(F.rlike(joined, F.lit(r"/\.{1,2}$")), F.lit("/")).otherwise(F.lit("")))
        return F.when(F.rlike(joined, F.lit(r"(^|/)\.{1,2}(/|$)")), path).otherwise(joined)

    def completed(h: Column) -> Column:
        asked = F.when(F.startswith(h, F.lit("?")), F.lit("")).otherwise(b["asked"])
        plain = lambda own: F.when(own == "", F.concat(b["origin"], b["path"], asked)).otherwise(F.concat(b["origin"], _once(F.when(F.startswith(own, F.lit("/")), own).otherwise(F.concat(b["folder"], own)), walked)))
        whole = F.concat(_once(F.regexp_extract(h, r"^([^?#]*)", 1), plain), F.regexp_extract(h, r"^[^?#]*(.*)$", 1))
        return F.when(F.rlike(h, F.lit(r"^[A-Za-z][A-Za-z0-9+.-]*:")), h).when(F.startswith(h, F.lit("//")), F.concat(b["scheme"], F.lit(":"), h)).otherwise(whole)

    return _once(F.trim(href), completed)


def _whole(text: Column) -> Column:
    """The text, unless it declares a document type or entities."""
    return F.when(~F.rlike(text, F.lit(r"(?i)<!(DOCTYPE|ENTITY)")), text)


def _words(c: Column) -> Column:
    """A fragment as one line of text: markup goes where there is any."""
    return F.trim(F.regexp_replace(strip_controls(F.when(F.contains(c, F.lit("<")), plain_text(c)).otherwise(c)), F.lit(r"\s+"), F.lit(" ")))


def _first(*texts: Column) -> Column:
    """The first that isn't empty; '' if all are."""
    return F.coalesce(*[F.nullif(F.trim(t), F.lit("")) for t in texts], F.lit(""))


def parsed(body: Column) -> Column:
    """A feed as a struct of FEED_SCHEMA."""
    return F.from_xml(_whole(body), FEED_SCHEMA, _OPTIONS)


def entries_of(feed: Column, base: Column) -> Column:
    """rank, url, title, published_at, summary, authors, ok of a parsed feed's entries, whichever kind it is of."""
    none = F.lit(None)

    def entry(e: Column, at: Column, b: Column) -> Column:
        links = F.filter(e["link"], lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate")
        link = F.get(F.transform(links, lambda x: _first(x["_href"], x["_VALUE"])), F.lit(0))
        names = F.transform(F.concat(F.coalesce(e["author"], F.array().cast("array<string>")), F.coalesce(e["creator"], F.array().cast("array<string>"))), lambda a: F.when(F.contains(a, F.lit("<name>")), _words(F.regexp_extract(a, r"(?s)<name>(.*?)</name>", 1))).otherwise(_words(a)))
        day = F.coalesce(moment(_first(e["pubDate"])), moment(_first(e["published"])), moment(_first(e["date"])), moment(_first(e["updated"])))
        summary = F.substring(_once(_first(e["summary"], e["description"], e["content"]), _words), 1, MOST_SUMMARY)
        known = F.struct(_once(link, lambda x: F.when(F.coalesce(x, F.lit("")) != "", resolved_on(x, b))).alias("url"), _once(_first(e["title"]), _words).alias("title"))
        row = lambda k: F.struct((at + 1).alias("rank"), k["url"].alias("url"), k["title"].alias("title"), day.alias("published_at"), summary.alias("summary"), F.filter(names, lambda n: F.coalesce(n, F.lit("")) != "").alias("authors"), (k["url"].isNotNull() & (k["title"] != "")).alias("ok"))
        return _once(known, row)

    every = F.coalesce(feed["channel"]["item"], feed["entry"], feed["item"], none)
    return F.when(feed.isNotNull(), _once(base_parts(base), lambda b: F.transform(every, lambda e, at: entry(e, at, b))))


def feed_entries(rows: DataFrame, body: str = "body", base: str = "url") -> DataFrame:
    """rows with feed (of FEED_SCHEMA) and entries; body is text, base the address that it came from."""
    return rows.withColumn("feed", parsed(F.col(body))).withColumn("entries", entries_of(F.col("feed"), F.col(base)))


def sitemap_entries(rows: DataFrame, body: str = "body", base: str = "url") -> DataFrame:
    """rows with entries: pos, kind ('page' or 'sitemap'), url, lastmod; other addresses than http(s) are left out, null if it isn't a sitemap."""
    text = _whole(F.col(body))
    root = F.regexp_extract(text, r"<(?:[A-Za-z_][\w.-]*:)?(urlset|sitemapindex)[\s>/]", 1)

    def entry(e: Column, kind: str) -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.when(_first(e["loc"]) != "", resolved(e["loc"], F.col(base))).alias("url"), moment(e["lastmod"]).alias("lastmod"))

    none = "array<struct<kind: string, url: string, lastmod: timestamp_ntz>>"
    read = rows.withColumn("_map", F.when(root != "", F.from_xml(text, MAP_SCHEMA, _OPTIONS)))
    kinds = F.when(root == "urlset", F.coalesce(F.transform("_map.url", lambda e: entry(e, "page")), F.array().cast(none))).when(root == "sitemapindex", F.coalesce(F.transform("_map.sitemap", lambda e: entry(e, "sitemap")), F.array().cast(none)))
    web = F.filter(kinds, lambda e: F.rlike(F.coalesce(e["url"], F.lit("")), F.lit("(?i)^https?://")))
    return read.withColumn("entries", F.transform(web, lambda e, at: F.struct(at.alias("pos"), e["kind"].alias("kind"), e["url"].alias("url"), e["lastmod"].alias("lastmod")))).drop("_map")


def each_entry(rows: DataFrame, *keep: str) -> DataFrame:
    """A row for each of the entries, with the columns to keep. For inline() Spark asks first whether there are entries, and parses everything once more to know; inline_outer() doesn't."""
    always = rows.schema["entries"].dataType.elementType.names[0]  # rank or pos, which every entry has
    return rows.select(*keep, F.inline_outer("entries")).where(F.col(always).isNotNull())


# Conditional fetches


def due_fetches(sources: DataFrame, state: DataFrame) -> DataFrame:
    """source_id, url and what to ask with (etag, last_modified: null at first); state is what merged_state() keeps."""
    return sources.select("source_id", "url").join(state.select("source_id", "etag", "last_modified"), "source_id", "left")


def changed(fetches: DataFrame) -> DataFrame:
    """Answers that hold something new: not those that say that nothing was modified."""
    return fetches.where(F.col("status") != 304)


def merged_state(state: DataFrame, fetches: DataFrame) -> DataFrame:
    """source_id, etag, last_modified after fetches (source_id, at, status, etag, last_modified): the last answer with a body replaces both; 304 and errors leave them."""
    good = fetches.where(F.col("status").between(200, 299))
    last = good.groupBy("source_id").agg(F.max_by(F.struct("etag", "last_modified"), "at").alias("_n"))
    both = state.select("source_id", F.struct("etag", "last_modified").alias("_o")).join(last, "source_id", "full")
    return both.select("source_id", F.coalesce("_n", "_o").alias("_s")).select("source_id", "_s.etag", "_s.last_modified")


# The search for a page's feed

# What says that an answer is a feed, and its root elements.
FEED_TYPES = ("application/rss+xml", "application/atom+xml")
XML_TYPES = (*FEED_TYPES, "application/xml", "text/xml")
ROOTS = ("<rss", "<feed", "<rdf:rdf")


def looks_like_feed(body: Column, content_type: Column) -> Column:
    """By its content type, or by its root element behind a byte order mark, blanks, the prolog and comments."""
    head = F.lower(F.regexp_replace(F.substring(body, 1, 4096), F.lit(r"(?is)^﻿?\s*(?:(?:<\?xml.*?\?>|<!--.*?-->)\s*){0,10}"), F.lit("")))
    return F.coalesce(F.lower(F.trim(F.substring_index(content_type, ";", 1))).isin(*XML_TYPES), F.lit(False)) | F.coalesce(F.rlike(head, F.lit("^(" + "|".join(ROOTS) + ")")), F.lit(False))


def alternates(html: Column, base: Column) -> Column:
    """The addresses of a page's <link rel=alternate> feeds, in order, each once."""
    tags = F.regexp_extract_all(F.regexp_replace(html, F.lit(r"(?s)<!--.*?-->"), F.lit("")), F.lit(r"(?is)<link\s[^>]*>"), F.lit(0))
    value = lambda tag, name: F.coalesce(*[F.nullif(F.regexp_extract(tag, rf"(?is)\s{name}\s*=\s*{q}", 1), F.lit("")) for q in ('"([^"]*)"', "'([^']*)'", r"([^\s\"'>]+)")], F.lit(""))
    feeds = F.filter(tags, lambda t: F.array_contains(F.split(F.lower(value(t, "rel")), r"\s+"), "alternate") & F.lower(value(t, "type")).isin(*FEED_TYPES) & (value(t, "href") != ""))
    return F.array_distinct(F.transform(feeds, lambda t: resolved(F.replace(value(t, "href"), F.lit("&amp;"), F.lit("&")), base)))


def inspected(fetches: DataFrame, now: Column) -> DataFrame:
    """fetches (url, final_url, status, body) with title, homepage, entries, newest and samples of the feed, and outcome: 'valid feed' or why it isn't."""
    read = feed_entries(fetches, "body", "final_url").withColumn("usable", F.filter(F.coalesce("entries", F.array().cast("array<struct<rank: int, url: string, title: string, published_at: timestamp_ntz, summary: string, authors: array<string>, ok: boolean>>")), lambda e: e["ok"]))
    n, newest = F.size("usable"), F.array_max(F.transform("usable", lambda e: e["published_at"]))
    host = F.regexp_extract("final_url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1)
    links = F.coalesce(F.col("feed.channel.link"), F.col("feed.link"))
    home = F.get(F.transform(F.filter(links, lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate"), lambda x: _first(x["_href"], x["_VALUE"])), F.lit(0))
    refused = F.when(~F.col("status").between(200, 299), F.concat(F.lit("HTTP "), F.col("status").cast("string"))).when(n == 0, "no feed with entries").otherwise(rejection(n, newest, now))
    outcome = F.when(F.col("status").isNull(), "not fetched").otherwise(F.coalesce(refused, F.lit("valid feed")))
    return read.select("url", "final_url", _words(_first(F.col("feed.channel.title"), F.col("feed.title"), host)).alias("title"), F.coalesce(F.nullif(home, F.lit("")), F.concat(F.regexp_extract("final_url", r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1), F.lit("/"))).alias("homepage"), n.alias("entries"), newest.alias("newest"), F.transform(F.slice("usable", 1, 3), lambda e: e["title"]).alias("samples"), outcome.alias("outcome"))


def probe(asked: DataFrame, fetches: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(attempts, candidates) for pages (page, an address): what was tried in order, and the valid feeds.

    fetches (url, final_url, status, content_type, body) are what was captured, one for each address. A page that is
    a feed is tried itself; else the first five alternates that it names, all of them; and only if none is valid the
    usual paths in order, up to the first valid one. An address is tried once; a feed that two addresses lead to is
    one candidate, and its second attempt isn't told."""
    page = asked.select("page").distinct().join(fetches.select(F.col("url").alias("page"), "final_url", "content_type", "body"), "page")
    itself = looks_like_feed(F.col("body"), F.col("content_type"))
    named = F.slice(alternates(F.col("body"), F.col("final_url")), 1, MOST_ALTERNATES)
    stages = page.select("page", F.when(itself, F.array("final_url")).otherwise(named).alias("first"), F.when(itself, F.array().cast("array<string>")).otherwise(feed_candidates(F.col("final_url"))).alias("guesses"))
    listed = stages.select("page", F.concat(F.transform("first", lambda u: F.struct(F.lit(1).alias("stage"), u.alias("url"))), F.transform(F.array_except("guesses", "first"), lambda u: F.struct(F.lit(2).alias("stage"), u.alias("url")))).alias("t"))
    tries = listed.select("page", F.posexplode("t").alias("n", "t")).select("page", "n", "t.stage", "t.url")
    wanted = tries.select("url").distinct().join(fetches.select("url", "final_url", "status", "body"), "url", "left").withColumn("final_url", F.coalesce("final_url", "url"))
    told = checkpoint(tries.join(inspected(wanted, now), "url"))  # read for the attempts and for the candidates
    valid = F.col("outcome") == "valid feed"
    ends = told.where(valid).groupBy("page").agg(F.min(F.struct("stage", "n")).alias("end"))
    done = told.join(ends, "page", "left").where(F.col("end").isNull() | (F.col("stage") < F.col("end.stage")) | (F.col("stage") == F.col("end.stage")) & ((F.col("stage") == 1) | (F.col("n") <= F.col("end.n"))))
    first = done.withColumn("again", valid & (F.row_number().over(Window.partitionBy("page", "final_url", "outcome").orderBy("n")) > 1)).where(~F.col("again"))
    place = F.row_number().over(Window.partitionBy("page").orderBy("n")).alias("n")  # a page has some twenty tries
    return first.select("page", place, "url", "outcome"), first.where(valid).select("page", place, F.col("final_url").alias("feed_url"), "title", "homepage", "entries", "newest", "samples")
