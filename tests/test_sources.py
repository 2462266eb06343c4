import gzip
import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from siftspark.sources import exports, extract, listings, markup, readers

FEED = b"""<?xml version="1.0"?><rss><channel><title>t</title>
<item><title>One &lt;b&gt;bold&lt;/b&gt;</title><link>/a</link><pubDate>Wed, 24 Jan 2024 10:00:00 +0200</pubDate><description>&lt;p&gt;text  here&lt;/p&gt;</description></item>
<item><title>Two</title><link>https://x.org/b</link></item><item><title>No link</title></item></channel></rss>"""
MAP = b"""<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc>/2024/a</loc><lastmod>2024-01-02</lastmod></url>
<url><loc>https://x.org/2024/b</loc></url><url><loc>mailto:x@y.z</loc></url><url><loc>/tags/c</loc><lastmod>2024-01-03T10:00:00Z</lastmod></url></urlset>"""
PAGE = '<ul><li class="card"><h2><a href="/p/1">First</a></h2><time datetime="2024-01-05">x</time></li><li class="card"><h2>No link</h2></li><li class="card"><h2><a href="javascript:1">Bad</a></h2></li></ul>'


def test_feed():
    rows = markup.feed_rows(FEED, "https://x.org/")
    assert [r[1:4] for r in rows] == [("https://x.org/a", "One bold", datetime(2024, 1, 24, 8)), ("https://x.org/b", "Two", None), (None, "No link", None)]
    assert [r[-1] for r in rows] == [True, True, False] and rows[0][4] == "text here"


def test_sitemap():
    rows = markup.sitemap_rows(gzip.compress(MAP), "https://x.org/")
    assert [(r[2], r[3]) for r in rows] == [("https://x.org/2024/a", datetime(2024, 1, 2)), ("https://x.org/2024/b", None), ("https://x.org/tags/c", datetime(2024, 1, 3, 10))]
    with pytest.raises(markup.DoctypeFound):
        markup.sitemap_rows(b'<!DOCTYPE x [<!ENTITY e "v">]><urlset/>', "https://x.org/")


def test_listing_and_selectors():
    rows = markup.listing_rows(PAGE, "https://x.org/", "li.card", "h2 a", "h2", "time")
    assert rows[0] == (1, "https://x.org/p/1", "First", datetime(2024, 1, 5), True) and [r[-1] for r in rows] == [True, False, False]
    with pytest.raises(ValueError):
        markup.selector("a > b:has(c)")


def test_page_meta():
    html = '<head><title>T</title><meta property="og:title" content="A &amp; B"><meta name="description" content="d"><meta property="og:image" content="/i.png"></head>'
    assert markup.page_meta_of(html, "https://x.org/p") == ("A & B", "d", None, "https://x.org/i.png")


def test_title_references():
    html = "<title>A &amp&amp; B &ampx; &lt;c> &#65;&#x42; &nope; &am</title>"
    assert markup.page_meta_of(html, "https://x.org/p")[0] == "A &amp& B &ampx; <c> AB &nope; &am"


def test_article_references():
    words = "word " * 60
    assert markup.article_text(f"<article><h1>a &amp&amp; b &ampx; &am</h1><p>{words}</article>")[0].startswith("# a &amp& b &ampx; &am\n\nword")


def test_udfs_and_matching(spark):
    d = spark.createDataFrame([("x", bytearray(MAP), "https://x.org/"), ("y", bytearray(b"<nope"), "https://y.org/")], "site string, body binary, base string")
    e = d.select("site", F.inline(markup.parse_sitemap("body", "base")))
    got = markup.matching(e, r"^/2024/").orderBy("pos_no").collect()
    assert [(r.url, r.pos_no) for r in got] == [("https://x.org/2024/a", 2), ("https://x.org/2024/b", 3)]
    seen = spark.createDataFrame([("x", "https://x.org/2024/a")], "site string, url string")
    assert [r.url for r in markup.to_fetch(markup.matching(e, r"^/2024/"), seen).collect()] == ["https://x.org/2024/b"]


@pytest.mark.parametrize("bad", ["(a+)+", "(a|b)*", "((x|y)z)+", "(?:ab|c){2,}", "(a(?:b|c)?){3}", "x" * 201, "(", ".*.*.*x"])
def test_unsafe_patterns(bad):
    with pytest.raises(ValueError):
        markup.safe_pattern(bad)


def test_safe_pattern():
    for fine in (r"^/blog/\d{4}/[^/]+$", r"^/(blog|news)/[a-z0-9-]+$", r"\(a|b\)*", r"(a|b)?c", r"[(|)]+"):
        assert markup.safe_pattern(fine) == fine


def test_listings(spark):
    papers = json.dumps([{"paper": {"id": "2401.1", "title": "P", "authors": [{"name": "A", "hidden": False}, {"name": "B", "hidden": True}]}, "numComments": 2}, {"paper": {"id": "x"}}])
    rows = listings.papers(spark.createDataFrame([("s", papers)], "source_id string, body string"))
    assert [(r.rank, r.ok, r.authors, r.comments) for r in rows.orderBy("rank").collect()] == [(1, True, ["A"], 2), (2, False, [], None)]
    assert listings.scan_report(rows).first().asDict() == {"source_id": "s", "fetched": 1, "skipped": 1, "failed": False}
    posts = json.dumps({"posts": [{"slug": "a", "title": "A", "url": "/blog/a", "publishedAt": "2024-01-01T00:00:00.000Z", "authorsData": [{"name": "n", "fullname": ""}]}, {"slug": "b", "title": "B", "url": "/blog/b"}]})
    rows = listings.posts(spark.createDataFrame([("s", posts)], "source_id string, body string"), "posts", "https://x.org", 1).collect()
    assert len(rows) == 1 and rows[0].url == "https://x.org/blog/a" and rows[0].authors == ["n"] and rows[0].published_at is not None


def test_captured_source(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text(json.dumps({"source_id": "s", "recipe": "rss", "url": "u", "body": "b"}) + "\nnot json\n")
    readers.register(spark)
    d = spark.read.format("captured").option("path", str(tmp_path)).load()
    assert sorted(r.recipe for r in d.collect()) == ["malformed", "rss"]
    rows, bad = readers.captures(spark, str(tmp_path))
    assert [tuple(r) for r in rows.collect()] == [("s", "rss", "u", "b")] and [r.malformed for r in bad.collect()] == [1]


def test_adapters(spark):
    feed = b"<rss><channel><item><title>T</title><link>https://x.org/1</link></item><item><title></title></item></channel></rss>".decode()
    rows = spark.createDataFrame([("a", "rss", "https://x.org/feed", feed), ("b", "hf_papers", "https://p.org", json.dumps([{"paper": {"id": "2401.1", "title": "P"}}])), ("c", "hf_papers", "https://p.org", "[]")], readers.SCHEMA)
    assert [(r.source_id, r.title) for r in readers.scan(rows, "rss").where("ok").collect()] == [("a", "T")]
    with pytest.raises(readers.NothingUsable, match="c"):
        readers.checked_scan(rows, "hf_papers")
    with pytest.raises(ValueError):
        readers.scan(rows, "gopher")


def test_polled(spark):
    """The first poll takes the newest and counts all it lists as handled; network failures come again; what isn't listed is forgotten."""
    listing = lambda *urls: spark.createDataFrame([("x", u, i) for i, u in enumerate(urls)], "site string, url string, pos_no int")
    outcomes = lambda **o: spark.createDataFrame([("x", u, v) for u, v in o.items()] or [("-", "-", "ok")], "site string, url string, outcome string")
    seen = spark.createDataFrame([("y", "kept", 0)], "site string, url string, pos_no int")
    first = listing("u0", "u1", "u2", "u3")
    assert [r.url for r in markup.to_fetch(first, seen, 2).orderBy("pos_no").collect()] == ["u0", "u1"]
    seen = markup.handled(first, outcomes(u0="network", u1="http"), seen)
    assert sorted((r.site, r.url) for r in seen.collect()) == [("x", "u1"), ("x", "u2"), ("x", "u3"), ("y", "kept")]
    second = listing("new", "u0", "u1", "u3")
    assert [r.url for r in markup.to_fetch(second, seen, 2).orderBy("pos_no").collect()] == ["new", "u0"]
    seen = markup.handled(second, outcomes(new="ok", u0="ok"), seen, most_seen=3)
    assert sorted(r.url for r in seen.where("site = 'x'").collect()) == ["new", "u0", "u1"]  # u2 isn't listed any more, u3 is past the bound
    assert [r.url for r in markup.to_fetch(listing("u2", "u3"), seen).orderBy("pos_no").collect()] == ["u2", "u3"]


def test_all_entries_and_reports(spark):
    index = b"<sitemapindex><sitemap><loc>https://x.org/old.xml</loc><lastmod>2023-01-01</lastmod></sitemap><sitemap><loc>https://x.org/new.xml</loc><lastmod>2024-01-01</lastmod></sitemap></sitemapindex>"
    d = spark.createDataFrame([("x", bytearray(index), "https://x.org/sitemap.xml"), ("y", bytearray(MAP), "https://y.org/")], "site string, body binary, base string")
    top = d.select("site", F.inline(markup.parse_sitemap("body", "base")))
    assert [r.url for r in markup.children(top, 1).collect()] == ["https://x.org/new.xml"]
    below = spark.createDataFrame([("x", bytearray(MAP), "https://x.org/new.xml")], "site string, body binary, base string").select("site", F.inline(markup.parse_sitemap("body", "base")))
    every = markup.all_entries(top, below)
    assert sorted(r.site for r in every.collect()) == ["x"] * 3 + ["y"] * 3
    report = {r.site: r for r in markup.match_report(every, markup.matching(every.where("site = 'x'"), "^/2024/"), "^/2024/").collect()}
    assert (report["x"].matched, report["x"].error) == (2, None) and report["y"].matched == 0 and "no address matches" in report["y"].error


@pytest.mark.parametrize(("html", "want"), [
    ("<article><blockquote><p>x</p></blockquote><ul><li><p>y<li>z</ul></article>", ["x", "- y", "- z"]),
    ("<body><p>one<p>two<div>not</div><p>three<h2>four</h2>", ["one", "two", "three", "## four"]),
    ("<main><table><tr><td><p>a<td><p>b</table><p>c<ul><li>d<ul><li>e</ul><li>f</ul></main>", ["a", "b", "c", "- d e", "- f"]),
])
def test_article_blocks(html, want):
    assert markup.article_text(html, 1)[0].split("\n\n") == want


def test_feed_summary(spark):
    rows = spark.createDataFrame([("f", i, f"t{i}", i > 11, None) for i in range(1, 17)], "feed string, rank int, title string, ok boolean, published_at timestamp")
    assert extract.feed_summary(rows).first().samples == ["t12", "t13", "t14"]


def test_export(spark, tmp_path):
    d = spark.createDataFrame([("2024-01-01", 1, "A*", "https://x", "src", "paper", 0.5, "w", ["t"], False, []), ("2024-01-01", 2, "B", "javascript:1", "src", "paper", 0.4, "", [], True, ["promo"])],
        "day string, position int, title string, url string, source string, kind string, score double, why_read string, tags array<string>, hidden boolean, flags array<string>")
    out = exports.daily_lines(d)
    body = out.first().body
    assert "## 1. A\\*" in body and "score 5.0" in body and "[Open](https://x)" in body and "## Hidden by triage (1)" in body and "- B (promo)" in body and "javascript" not in body
    exports.write_daily(out, str(tmp_path / "daily"))
    assert [p.name for p in (tmp_path / "daily").iterdir() if p.is_dir()] == ["day=2024-01-01"]


def test_article_of_no_page(spark):
    rows = spark.createDataFrame([(1, None), (2, "<article><p>a</article>")], "id int, html string").select("id", markup.extract_article("html").alias("a"))
    assert [tuple(r) for r in rows.select("id", "a.*").orderBy("id").collect()] == [(1, None, None), (2, None, "only 1 words")]
