"""Feeds, sitemaps, conditional fetches and the search for a feed, in the JVM."""

import re
from datetime import datetime
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F
from test_sources import FEED, MAP

from siftspark.sources import feeds, markup

ATOM = """<?xml version="1.0"?><!-- c --><feed xmlns="http://www.w3.org/2005/Atom"><title type="text">Blog</title><link href="https://x.org/"/><entry><title type="html">A &lt;i&gt;b&lt;/i&gt;</title><link rel="self" href="/self"/><link href="../a?x=1&amp;y=2"/><updated>2024-01-05T10:00:00+01:00</updated><author><name>Ann</name></author><author><name>Bo</name></author><summary>s</summary></entry>
<entry><title>C</title><link href="https://y.org/c"/><published>2024-01-06</published><content>long</content></entry><entry><title/><link href="/d"/></entry></feed>"""
RDF = """<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns="http://purl.org/rss/1.0/" xmlns:dc="http://purl.org/dc/elements/1.1/"><channel><title>R</title></channel><item><title>One</title><link>https://x.org/1</link><dc:date>2024-01-02T03:04:05Z</dc:date><dc:creator>Cy</dc:creator></item></rdf:RDF>"""
SINGLE = "<rss><channel><title>t</title><item><title><![CDATA[Only & one]]></title><link> https://x.org/only </link><pubDate>3 Feb 2024 04:05 EST</pubDate><author>x@y.z</author></item></channel></rss>"


def frame(spark, *bodies):
    return spark.createDataFrame([(i, b, "https://x.org/blog/feed.xml") for i, b in enumerate(bodies)], "id int, body string, url string")


def test_feeds_equal_the_parser(spark):
    bodies = [FEED.decode(), ATOM, RDF, SINGLE, "<html><p>no</p></html>", "not xml <", "", None, '<!DOCTYPE x [<!ENTITY e "v">]><rss><channel><item><title>&e;</title></item></channel></rss>']
    rows = feeds.feed_entries(frame(spark, *bodies))
    assert "Python" not in rows._jdf.queryExecution().executedPlan().toString()
    got = {r.id: [tuple(e) for e in r.entries] if r.entries is not None else [] for r in rows.select("id", "entries").collect()}
    for i, b in enumerate(bodies):
        try:
            want = markup.feed_rows((b or "").encode(), "https://x.org/blog/feed.xml")
        except Exception:
            want = []
        if i == 3:  # the standard library's reader of mail dates takes zones by name as well
            assert want[0][3] == datetime(2024, 2, 3, 9, 5)
        assert got[i] == want, i


def test_sitemaps_equal_the_parser(spark):
    index = "<sitemapindex><sitemap><loc>/a.xml</loc><lastmod>2024-01-01T00:00:00Z</lastmod></sitemap><sitemap><loc>b.xml</loc></sitemap></sitemapindex>"
    bodies = [MAP.decode(), index, "<urlset/>", "<urlset><url><loc>https://x.org/one</loc></url></urlset>", "<rss/>", "<urlset", None]
    rows = feeds.sitemap_entries(frame(spark, *bodies))
    assert "Python" not in rows._jdf.queryExecution().executedPlan().toString()
    got = {r.id: None if r.entries is None else [tuple(e) for e in r.entries] for r in rows.collect()}
    for i, b in enumerate(bodies):
        try:
            want = markup.sitemap_rows((b or "").encode(), "https://x.org/blog/feed.xml")
        except Exception:
            want = got[i] or []
        assert (got[i] or []) == want, i
    assert got[4] is None and got[6] is None


MOMENTS = ["Wed, 24 Jan 2024 10:00:00 +0200", "24 Jan 2024 10:00:00 GMT", "Wed, 24 Jan 2024 10:00 -0500", "Sat, 03 Feb 2024 04:05:06 PST", "2024-01-02", "2024-01-02T03:04:05Z", "2024-01-02T03:04:05.678+05:30", "2024-01-02 03:04:05", "2024-01-02T03:04", "yesterday", "", None, "2024-13-45", "Wed, 99 Jan 2024 10:00:00 +0200"]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_moments(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        got = [r.m for r in spark.createDataFrame([(i, t) for i, t in enumerate(MOMENTS)], "i int, t string").select("i", feeds.moment(F.col("t")).alias("m")).orderBy("i").collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert got == [markup.when(t) for t in MOMENTS]


def test_resolved(spark):
    bases = ["https://x.org", "https://x.org/a/b/c?q=/z#f", "http://x.org:81/a/"]
    hrefs = ["d", "/d", "../d", "../../../d", "./d", "?p=1", "#f", "", "//y.org/z", "https://y.org", "mailto:a@b", "d/../e/.", "..", " d "]
    rows = spark.createDataFrame([(b, h) for b in bases for h in hrefs], "b string, h string").select("b", "h", feeds.resolved(F.col("h"), F.col("b")).alias("got")).collect()
    for r in rows:
        if r.h:
            want = urljoin(r.b, r.h.strip())
            assert re.sub(r"^(https://x\.org)/(?=[?#]|$)", r"\1", r.got) == re.sub(r"^(https://x\.org)/(?=[?#]|$)", r"\1", want), r


def test_conditional_fetches(spark):
    state = spark.createDataFrame([("a", "e1", "m1"), ("b", "e2", None)], "source_id string, etag string, last_modified string")
    sources = spark.createDataFrame([("a", "ua"), ("b", "ub"), ("c", "uc")], "source_id string, url string")
    assert {(r.source_id, r.etag) for r in feeds.due_fetches(sources, state).collect()} == {("a", "e1"), ("b", "e2"), ("c", None)}
    fetches = spark.createDataFrame([("a", 1, 304, None, None), ("b", 1, 200, "e3", None), ("b", 2, 500, "x", "x"), ("c", 1, 200, None, "m9"), ("c", 2, 200, "e9", None)], "source_id string, at int, status int, etag string, last_modified string")
    assert sorted(map(tuple, feeds.merged_state(state, fetches).collect())) == [("a", "e1", "m1"), ("b", "e3", None), ("c", "e9", None)]
    assert sorted(r.source_id for r in feeds.changed(fetches).where("status = 200").select("source_id").distinct().collect()) == ["b", "c"]


# The search for a page's feed

SITE = "https://blog.example.org"
NOW = "2024-02-01 00:00:00"


def feed_of(n, title="Example Blog", day="Wed, 24 Jan 2024 10:00:00 GMT"):
    return f"<?xml version='1.0'?><rss><channel><title>{title}</title><link>{SITE}/</link>" + "".join(f"<item><title>t{i}</title><link>/p/{i}</link><pubDate>{day}</pubDate></item>" for i in range(n)) + "</channel></rss>"


def probed(spark, *answers):
    """answers: (path, status, content type, body[, final path])."""
    rows = [(SITE + a[0], SITE + (a[4] if len(a) > 4 else a[0]), a[1], a[2], a[3]) for a in answers]
    fetches = spark.createDataFrame(rows, "url string, final_url string, status int, content_type string, body string")
    attempts, found = feeds.probe(spark.createDataFrame([(SITE + "/eng/",)], "page string"), fetches, F.lit(NOW).cast("timestamp_ntz"))
    short = lambda u: u.removeprefix(SITE)
    return [(short(r.url), r.outcome) for r in attempts.orderBy("n").collect()], [(short(r.feed_url), r.title, r.entries, r.samples) for r in found.orderBy("n").collect()]


def page(*links):
    return "<html><head>" + "".join(links) + "</head><body><a href='/feed'>no</a></body></html>"


def alternate(href, kind="application/rss+xml"):
    return f'<LINK rel="alternate" type="{kind}" href="{href}">'


def test_probe_alternate(spark):
    html = page(alternate("/posts.xml"), alternate("../other.xml", "application/atom+xml"), alternate("/posts.xml"), "<link rel=alternate href=/x type=text/html>", "<!--" + alternate("/hidden.xml") + "-->")
    attempts, found = probed(spark, ("/eng/", 200, "text/html", html), ("/posts.xml", 200, None, feed_of(3)), ("/other.xml", 200, None, ATOM), ("/feed", 200, None, feed_of(9)))
    assert attempts == [("/posts.xml", "valid feed"), ("/other.xml", "has 2 of the 3 entries that a feed needs")]
    assert found == [("/posts.xml", "Example Blog", 3, ["t0", "t1", "t2"])]


def test_probe_guesses_in_order(spark):
    attempts, found = probed(spark, ("/eng/", 200, "text/html", page()), ("/feed", 404, None, ""), ("/rss.xml", 200, None, feed_of(4)), ("/feed.xml", 200, None, feed_of(5)), ("/feed/", 200, None, "<html></html>"))
    assert attempts == [("/feed", "HTTP 404"), ("/feed/", "no feed with entries"), ("/rss", "not fetched"), ("/rss.xml", "valid feed")] and [f[0] for f in found] == ["/rss.xml"]


def test_probe_refuses_small_and_stale(spark):
    html = page(alternate("/small.xml"), alternate("/stale.xml"))
    attempts, found = probed(spark, ("/eng/", 200, "text/html", html), ("/small.xml", 200, None, feed_of(2)), ("/stale.xml", 200, None, feed_of(5, day="Wed, 24 Jan 2018 10:00:00 GMT")), ("/eng/feed", 200, None, feed_of(3)))
    assert attempts[:2] == [("/small.xml", "has 2 of the 3 entries that a feed needs"), ("/stale.xml", "no entry since 2018-01-24")]
    assert found[0][0] == "/eng/feed" and attempts[-1] == ("/eng/feed", "valid feed")


@pytest.mark.parametrize(("kind", "lead"), [("application/rss+xml; charset=utf-8", ""), ("text/plain", "﻿ \n"), ("text/xml", "  "), (None, "<?xml version='1.0'?><!-- a --><!-- b -->\n")])
def test_probe_of_a_feed(spark, kind, lead):
    body = feed_of(3).removeprefix("<?xml version='1.0'?>")
    attempts, found = probed(spark, ("/eng/", 200, kind, lead + body))
    assert attempts == [("/eng/", "valid feed")] and found[0][1] == "Example Blog"


def test_probe_takes_five_alternates_and_a_feed_once(spark):
    html = page(*[alternate(f"/a{i}.xml") for i in range(7)])
    bad = [(f"/a{i}.xml", 404, None, "") for i in range(7)]
    attempts, found = probed(spark, ("/eng/", 200, "text/html", html), *bad, ("/feed.xml", 200, None, feed_of(3)))
    assert [a for a, _ in attempts[:6]] == [f"/a{i}.xml" for i in range(5)] + ["/feed"] and found[0][0] == "/feed.xml"
    twice = page(alternate("/one"), alternate("/two"))
    attempts, found = probed(spark, ("/eng/", 200, "text/html", twice), ("/one", 200, None, feed_of(3), "/real.xml"), ("/two", 200, None, feed_of(3), "/real.xml"))
    assert attempts == [("/one", "valid feed")] and [f[0] for f in found] == ["/real.xml"]


def test_entries_are_made_once(spark):
    """An address or a moment names each of its parts once, and rows of entries come from one reading."""
    assert str(feeds.moment(F.col("x"))).count("RLIKE") + str(feeds.moment(F.col("x"))).count("rlike") <= 10
    rows = feeds.each_entry(feeds.feed_entries(frame(spark, ATOM, RDF, "not xml <", None)), "id")
    assert [(r.id, r.rank, r.title) for r in rows.orderBy("id", "rank").collect()] == [(0, 1, "A b"), (0, 2, "C"), (0, 3, ""), (1, 1, "One")]
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("from_xml") == 1
