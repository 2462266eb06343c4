"""Addresses and identities as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that only track, besides utm_*; identifiers of papers in addresses and text.
TRACKING = ("fbclid", "gclid", "dclid", "msclkid", "mc_cid", "mc_eid", "ref", "ref_src", "igshid")
PAPER = r"(?i)(?:arxiv\.org/(?:abs|pdf|html)/|huggingface\.co/papers/|\barxiv:\s*)(\d{4}\.\d{4,5})(?:v\d+)?"
# Where feeds usually are, at the root and below a page's path.
FEED_PATHS = ("/feed", "/feed/", "/rss", "/rss.xml", "/atom.xml", "/feed.xml", "/index.xml", "/blog/feed", "/blog/rss.xml")
PREFIXED_FEED_PATHS = ("/feed", "/rss.xml", "/atom.xml", "/feed.xml", "/index.xml")


def with_scheme(url: Column) -> Column:
    """A bare address gets https://; one that starts with /, or has a scheme before any path, query or fragment, stays."""
    u = F.trim(url)
    return F.when(F.rlike(u, F.lit(r"(?i)^[^/?#]*://|^/|^[a-z][a-z0-9+.-]*:(?!\d)")), u).otherwise(F.concat(F.lit("https://"), u))


def _decoded(part: Column) -> Column:
    """A part of a query as it reads: + is a blank, %XX a byte; a % that starts no byte stands for itself."""
    return F.try_url_decode(F.regexp_replace(part, F.lit("%(?![0-9A-Fa-f]{2})"), F.lit("%25")))


def _encoded(part: Column) -> Column:
    """Percent-encoded but for letters, digits and _.-~; a blank is +."""
    return F.replace(F.replace(F.url_encode(part), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def canonical_url(url: Column) -> Column:
    """Lower-case scheme and host, no default port, final slash, fragment, user or tracking parameter; query pairs decoded, sorted and encoded again.

    What has a port that is none, or a bracket that doesn't pair, is only trimmed."""
    bare = F.regexp_replace(F.regexp_replace(with_scheme(url), F.lit(r"[\t\r\n]"), F.lit("")), F.lit(r"^[\x00-\x20]+"), F.lit(""))
    scheme = F.lower(F.regexp_extract(bare, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    scheme = F.when(scheme == "", F.lit("https")).otherwise(scheme)
    rest = F.regexp_replace(F.regexp_replace(bare, F.lit(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit("")), F.lit(r"(?s)#.*$"), F.lit(""))
    netloc = F.regexp_replace(F.regexp_extract(rest, r"^//([^/?]*)", 1), F.lit(r"^.*@"), F.lit(""))
    host = F.lower(F.regexp_extract(netloc, r"^(?:\[([^\]]*)\]|([^:]*))", 0))
    host = F.regexp_replace(host, F.lit(r"^\[|\]$"), F.lit(""))
    port = F.regexp_extract(netloc, r"^(?:\[[^\]]*\]|[^:\[\]]*):(.*)$", 1)
    number = port.try_cast("int")
    fine = ((port == "") | (F.rlike(port, F.lit(r"^\d+$")) & (number <= 65535))) & (F.contains(netloc, F.lit("[")) == F.contains(netloc, F.lit("]")))
    default = ((scheme == "http") & (number == 80)) | ((scheme == "https") & (number == 443))
    shown = F.when((port == "") | default, host).otherwise(F.concat(host, F.lit(":"), number.cast("string")))
    path = F.regexp_extract(F.regexp_replace(rest, F.lit(r"^//[^/?]*"), F.lit("")), r"^([^?]*)", 1)
    cut = F.regexp_replace(path, F.lit("/+$"), F.lit(""))
    path = F.when(cut == "", F.lit("/")).otherwise(cut)
    pairs = F.transform(F.filter(F.split(F.regexp_extract(rest, r"(?s)^[^?]*\?(.*)$", 1), "&"), lambda p: p != ""), lambda p: F.struct(_decoded(F.substring_index(p, "=", 1)).alias("k"), _decoded(F.when(F.contains(p, F.lit("=")), F.regexp_replace(p, F.lit("(?s)^[^=]*="), F.lit(""))).otherwise(F.lit(""))).alias("v")))
    kept = F.array_sort(F.filter(pairs, lambda p: ~F.startswith(F.lower(p["k"]), F.lit("utm_")) & ~F.lower(p["k"]).isin(*TRACKING)))
    query = F.array_join(F.transform(kept, lambda p: F.concat(_encoded(p["k"]), F.lit("="), _encoded(p["v"]))), "&")
    rooted = F.startswith(path, F.lit("/"))
    site = F.when(shown != "", F.concat(F.lit("://"), shown, F.when(rooted, path).otherwise(F.concat(F.lit("/"), path)))).when(rooted & scheme.isin("http", "https", "ftp"), F.concat(F.lit("://"), path)).otherwise(F.concat(F.lit(":"), path))
    return F.when(~fine, F.trim(url)).otherwise(F.concat(scheme, site, F.when(query == "", F.lit("")).otherwise(F.concat(F.lit("?"), query))))


def paper_id(*texts: Column) -> Column:
    return F.coalesce(*[F.nullif(F.regexp_extract(t, PAPER, 1), F.lit("")) for t in texts])


def item_id(kind: Column, url: Column, paper: Column, canonical: Column | None = None) -> Column:
    """arxiv:<id> for a paper that has one, else web: and 16 digits of the SHA-1 of the canonical address, which is made here if it isn't given."""
    web = F.concat(F.lit("web:"), F.substring(F.sha1(canonical_url(url) if canonical is None else canonical), 1, 16))
    return F.when((kind == "paper") & paper.isNotNull(), F.concat(F.lit("arxiv:"), paper)).otherwise(web)


def content_hash(title: Column, summary: Column) -> Column:
    return F.sha1(F.concat(title, F.lit("\n"), summary))


def slug(name: Column, most: int = 63) -> Column:
    dashed = F.regexp_replace(F.regexp_replace(F.lower(name), F.lit(r"[^a-z0-9]+"), F.lit("-")), F.lit(r"^-+|-+$"), F.lit(""))
    cut = F.regexp_replace(F.substring(dashed, 1, most), F.lit(r"-+$"), F.lit(""))
    return F.when(cut == "", F.lit("source")).otherwise(cut)


def is_address(text: Column) -> Column:
    """Whether what someone typed is an address rather than a name."""
    t = F.trim(text)
    return F.rlike(t, F.lit(r"(?i)^[a-z][a-z0-9+.-]*://|^[^\s/]+\.[a-z]{2,}(?:[/:?#]|$)"))


def page_url(url: Column) -> Column:
    """An http(s) address with at least / as its path; null if it is none."""
    u = with_scheme(url)
    ok = F.rlike(u, F.lit(r"(?i)^https?://[^/?#]+"))
    return F.when(ok & F.rlike(u, F.lit(r"^[^/]*//[^/?#]+$")), F.concat(u, F.lit("/"))).when(ok, u)


def feed_candidates(url: Column) -> Column:
    """Where a page's feed may be, in order, each once."""
    origin = F.regexp_extract(url, r"^([a-z]+://[^/?#]+)", 1)
    prefix = F.regexp_replace(F.regexp_extract(url, r"^[a-z]+://[^/?#]+([^?#]*)", 1), F.lit(r"/+$"), F.lit(""))
    root = F.array(*[F.concat(origin, F.lit(p)) for p in FEED_PATHS])
    below = F.array(*[F.concat(origin, prefix, F.lit(p)) for p in PREFIXED_FEED_PATHS])
    return F.array_distinct(F.when(prefix == "", root).otherwise(F.concat(root, below)))


def homepage(recipe_url: Column, claimed: Column) -> Column:
    """The homepage that is kept with a recipe: the path and query of the claimed one if it is http(s) on the recipe's own host, else the host's root.

    Scheme aside, the site is always the recipe's: a claimed port or user never gets in."""
    site = F.regexp_extract(recipe_url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    host = lambda netloc: F.lower(F.regexp_replace(F.regexp_replace(netloc, F.lit(r"^.*@"), F.lit("")), F.lit(r":\d*$"), F.lit("")))
    c = F.trim(claimed)
    scheme = F.lower(F.regexp_extract(c, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    theirs = F.regexp_extract(c, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    path = F.regexp_extract(c, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(c, r"^[^?#]*(\?[^#]+)", 1)
    root = F.concat(F.regexp_extract(recipe_url, r"^([A-Za-z][A-Za-z0-9+.-]*://)", 1), site, F.lit("/"))
    ours = scheme.isin("http", "https") & (host(theirs) == host(site)) & (site != "")
    return F.when(ours, F.concat(scheme, F.lit("://"), site, F.when(path == "", "/").otherwise(path), query)).otherwise(root)
