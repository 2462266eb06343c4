from pyspark.sql import functions as F

from siftspark.functions import address, score, text


def one(spark, expr, *rows):
    names = "t string"
    return [r[0] for r in spark.createDataFrame([(r,) for r in rows], names).select(expr).collect()]


def test_controls(spark):
    assert one(spark, text.strip_controls(F.col("t")), "a\r\nb\rc", "\x1b[31mred\x1b[0m", "x\x1b]0;title\x07y\tz\x00") == ["a\nbc", "red", "xy\tz"]


def test_clip(spark):
    assert one(spark, text.clip(F.col("t"), 6), "abc", "  a\n b ", "abcdefgh", None) == ["abc", "a b", "abcde…", None]


def test_tokens(spark):
    assert one(spark, text.index_tokens(F.col("t")), "État naïve end. x*y v1.2-b") == [["etat", "naive", "end.", "x", "y", "v1.2-b"]]
    assert text.query_terms("What is the end. of .RAG- a b RAG?") == ["end", "rag"]
    assert one(spark, text.topic_tokens(F.col("t")), "The -agents agents_ 2026 v2 a about") == [["agents", "v2"]]


def test_fold_agrees(spark):
    rows = ["état ÀÉÎÕÜ çñ", "plain", None]
    assert one(spark, text.fold_marks(F.col("t")), *rows) == one(spark, text.fold_latin(F.col("t")), *rows)


def test_markdown(spark):
    assert one(spark, text.images_to_placeholders(F.col("t")), "![a b](u)", "[![x](u)](v)", "![](u)", "![[Un] x](u)") == ["[image: a b](u)", "[image: x](u)", "[image: figure](u)", "[image: Un x](u)"]
    assert one(spark, text.tidy(F.col("t")), "a  \n\n\n\nb \n") == ["a\n\nb"]
    assert one(spark, text.word_count(F.col("t")), "don't stop [the link](http://x y) well-known", "", None) == [5, 0, None]
    assert one(spark, text.inert_markdown(F.col("t")), "a*b [c]{{d}}\n#e") == [r"a\*b \[c\]\{\{d\}\} \#e"]
    assert one(spark, text.inert_url(F.col("t")), "https://a/b c(d)", "javascript:x") == ["https://a/b%20c%28d%29", None]
    lead = "# Head\n\nshort\n\n" + "word " * 40 + "\n\n> quote\n\n" + "more " * 40
    got = one(spark, text.lead_paragraph(F.col("t")), lead, "")
    assert got[0].startswith("word word") and "more" in got[0] and "Head" not in got[0] and got[1] == ""
    assert one(spark, text.cap_words(F.col("t"), 2), "a b", "a b c") == ["a b", "a b…"]


def test_addresses(spark):
    c = one(spark, address.canonical_url(F.col("t")), "HTTP://Ex.org:80/a/?b=2&a=1&utm_x=1#f", "ex.org", "https://ex.org/?ref=z", "ex.org/?next=https://y")
    assert c == ["http://ex.org/a?a=1&b=2", "https://ex.org/", "https://ex.org/", "https://ex.org/?next=https%3A%2F%2Fy"]
    same = {  # what it is -> its canonical form
        "https://e.org/?a=1&a-b=1": "https://e.org/?a=1&a-b=1", "//e.org/x": "https://e.org/x", "https://e.org/?q=a+b": "https://e.org/?q=a+b", "https://e.org/?q=a%20b": "https://e.org/?q=a+b",
        "https://e.org:8080/x//": "https://e.org:8080/x", "https://e.org:443": "https://e.org/", "http://user:p@H.org/a?x&y=": "http://h.org/a?x=&y=", "http://[::1": "http://[::1", "https://e.org:ab/x ": "https://e.org:ab/x",
        "https://e.org:99999/x": "https://e.org:99999/x", "mailto:a@b.c": "mailto:a@b.c", "/x/y/": "https:///x/y", "https://e.org/?k=%7E*%zz&é=ü": "https://e.org/?k=~%2A%25zz&%C3%A9=%C3%BC", "https://e.org/a?b=c=d&&a==1": "https://e.org/a?a=%3D1&b=c%3Dd",
        "host:8080/x": "https://host:8080/x", "https://e.org/a#b?c": "https://e.org/a", "https://e.org/?B=1&a=2&UTM_Q=3&Ref=4": "https://e.org/?B=1&a=2",
    }
    assert one(spark, address.canonical_url(F.col("t")), *same) == list(same.values())
    assert one(spark, text.inert_url(F.col("t")), "https://a/x\ny\tz", "https://a/\u200b\u2028é", "HTTPS://a/^`|<>", "http://[::1]/x", "http://[::1", "java\nscript:x") == ["https://a/x%0Ay%09z", "https://a/%E2%80%8B%E2%80%A8é", "HTTPS://a/%5E%60%7C%3C%3E", "http://[::1]/x", None, None]
    assert one(spark, address.paper_id(F.col("t")), "see arXiv: 2401.01234v2", "https://arxiv.org/pdf/2401.1234", "none") == ["2401.01234", "2401.1234", None]
    assert one(spark, address.slug(F.col("t")), "A  b!C", "--") == ["a-b-c", "source"]
    assert one(spark, address.page_url(F.col("t")), "ex.org", "https://ex.org/a", "mailto:x@y") == ["https://ex.org/", "https://ex.org/a", None]
    paths = one(spark, address.feed_candidates(F.col("t")), "https://ex.org/blog/")[0]
    assert paths[0] == "https://ex.org/feed" and "https://ex.org/blog/feed" in paths and len(paths) == len(set(paths)) == 12
    assert one(spark, address.is_address(F.col("t")), "ex.org/x", "https://a", "A Name", "v1. no") == [True, True, False, False]


def test_scores(spark):
    d = spark.createDataFrame([(None, 0.5, 1.0), (1.0, None, None), (None, None, None)], "a double, b double, c double")
    got = [round(r[0], 6) for r in d.select(score.combine({k: F.col(k) for k in "abc"}, {"a": 0.5, "b": 0.25, "c": 0.25})).collect()]
    assert got == [0.75, 1.0, 0.0]
    m = spark.range(1).select(score.humanize_age(F.lit(59)), score.humanize_age(F.lit(61)), score.humanize_age(F.lit(3000)), score.compact(F.lit(1234)), score.signal_notes(F.lit(3), F.lit(None).cast("int"), F.lit(0), F.lit(2))).first()
    assert list(m) == ["59m", "1h", "2d", "1.2k", "3 upvotes · 2 comments"]
    v = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<double>").select(score.unit(F.col("v"))).collect()
    assert v[0][0] == [0.6, 0.8] and v[1][0] == [0.0, 0.0]
