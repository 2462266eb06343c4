"""Secrets in text, told apart by who else has them.

Patterns propose candidates. The hash of each candidate's value is counted over
the whole corpus, by distinct owners and by distinct repositories: a value that
many owners have is an example that was copied, one that a single owner has may
be live. So every span gets a standing:

- example: WIDE_OWNERS owners or more, or several owners and WIDE_REPOS
  repositories or more;
- shared: several owners, but fewer than that;
- live: one owner, and it looks like a credential (8 to 512 characters, letters
  and digits, no placeholder's word);
- weak: one owner, and it doesn't.

Kinds assign, access and hex are the base, whatever their standing. opaque (long
runs of letters and digits with several of both) and pem (private keys) are added
where their standing is live: what alone would be too loose a pattern, the
ownership makes specific.

Only DataFrame functions are used. The text is read once and goes no further:
the candidates, with hashes instead of values, are a table in the shared folder.
Counting aggregates before each shuffle, and the standings reach the candidates
by a join in which a value that a third of all rows have can be split.

Defined cases: null and empty text have no spans; places count code points, ends
are exclusive; spans of different kinds may overlap; a null owner or repository
is one of its own; repeated rows keep their number, and as their repository is
the same, it counts once; an empty table gives no rows; other columns pass
through, but for the text and one called secrets, whose place the result takes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, join_hot, packed, table, unpacked
from .spans import matches

WIDE_OWNERS, WIDE_REPOS = 3, 8
BASE = 3
_WORDS = "[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
_MIXED = "length(regexp_replace(h, '[^0-9]', '')) >= 5 AND length(regexp_replace(h, '[^A-Za-z]', '')) >= 5"

#: Kind, pattern (in Java's and in RE2's form), a test that any text with a match passes, what of a match is the secret, its confirmation.
KINDS = (
    ("assign", rf"(?=[PpSsTtAa])(?:{_WORDS})[\x22\x27]?+\x20*+[:=]\x20*+[\x22\x27]?+[A-Za-z0-9+/_.=-]++", rf"({_WORDS})[\x22\x27]?\x20*[:=]\x20*[\x22\x27]?([A-Za-z0-9+/_.=-]+)", r"rlike(text, '[:=]') AND rlike(lower(text), '[dtny][\\x22\\x27]?+ *+[:=]')", r"regexp_extract(h, r'^[A-Za-z_]+[\x22\x27]?\x20*[:=]\x20*[\x22\x27]?(.*)$', 1)", "length(v) >= 6"),
    ("access", r"AKIA[A-Z0-9]++", r"AKIA[A-Z0-9]+", "contains(text, 'AKIA')", "h", "length(h) >= 20"),
    ("hex", r"[0-9a-f]{24,}+", r"[0-9a-f]{24,}", "rlike(text, '[0-9a-f]{24}')", "h", "true"),
    ("opaque", r"[A-Za-z0-9_-]{20,}+", r"[A-Za-z0-9_-]{20,}", "rlike(text, '[A-Za-z0-9_-]{20}')", "h", f"length(h) <= 256 AND {_MIXED}"),
    ("pem", r"-----BEGIN [A-Z ]{0,32}PRIVATE KEY-----[A-Za-z0-9+/= \t\r\n]*+", r"-----BEGIN [A-Z ]{0,32}PRIVATE KEY-----[A-Za-z0-9+/= \t\r\n]*", "contains(text, 'PRIVATE KEY-----')", "h", "true"),
)
PLACEHOLDERS = "example|sample|changeme|placeholder|your|dummy|xxxx|1234567"
_LOOKS = f"length(v) BETWEEN 8 AND 512 AND {{rlike}}(v, '[0-9]') AND {{rlike}}(v, '[A-Za-z]') AND NOT {{rlike}}(lower(v), '{PLACEHOLDERS}')"


def _candidates(at: int) -> Column:
    """Confirmed spans of one kind: structs (s, k, e, a, b, looks), a and b being the hash of the secret."""
    kind, pattern, _, gate, value, confirm = KINDS[at]
    of = lambda expr, name: __import__("re").sub(r"(?<![\w.'])([hv])(?![\w'])", rf"{name}.\1", expr)
    valued = f"transform({matches(pattern)}, x -> struct(x.s AS s, x.h AS h, {of(value, 'x')} AS v))"
    good = f"filter({valued}, x -> {of(confirm, 'x')})"
    part = lambda i: f"cast(conv(substr(sha2(x.v, 256), {i}, 15), 16, 10) AS long)"
    out = f"transform({good}, x -> struct(x.s AS s, {at} AS k, x.s + length(x.h) AS e, {part(1)} AS a, {part(16)} AS b, {of(_LOOKS.format(rlike='rlike'), 'x')} AS looks))"
    return F.expr(f"CASE WHEN text IS NOT NULL AND {gate} THEN {out} ELSE cast(array() AS array<struct<s: int, k: int, e: int, a: long, b: long, looks: boolean>>) END")


def candidates(docs: DataFrame, owner: str = "source", repo: str = "doc_id") -> DataFrame:
    """A table of (_n, _row, _owner, _repo, _spans): what the patterns propose in each row, and all its columns but the text."""
    named = docs.select(packed(docs, "text", "secrets"), F.struct(F.col(f"`{owner}`").alias("x")).alias("_owner"), F.struct(F.col(f"`{repo}`").alias("x")).alias("_repo"), "text")
    return checkpoint(named.select("_row", "_owner", "_repo", F.array_sort(F.concat(*[_candidates(i) for i in range(len(KINDS))])).alias("_spans"), F.monotonically_increasing_id().alias("_n")))


def ownership(found: DataFrame, wide_owners: int = WIDE_OWNERS, wide_repos: int = WIDE_REPOS) -> DataFrame:
    """For each hash (a, b): owners, repos, occurrences, and its standing."""
    each = found.select("_owner", "_repo", F.explode("_spans").alias("p")).groupBy("p.a", "p.b", "_owner", "_repo").agg(F.max("p.looks").alias("looks"), F.count("*").alias("n"))
    counted = each.groupBy("a", "b").agg(F.count_distinct("_owner").alias("owners"), F.count_distinct("_repo").alias("repos"), F.sum("n").alias("occurrences"), F.max("looks").alias("looks"))
    standing = f"CASE WHEN owners >= {int(wide_owners)} OR owners > 1 AND repos >= {int(wide_repos)} THEN 'example' WHEN owners > 1 THEN 'shared' WHEN looks THEN 'live' ELSE 'weak' END"
    return counted.select("a", "b", "owners", "repos", "occurrences", F.expr(standing).alias("standing"))


def find(docs: DataFrame, owner: str = "source", repo: str = "doc_id", wide_owners: int = WIDE_OWNERS, wide_repos: int = WIDE_REPOS) -> DataFrame:
    """docs without their text, and with secrets: array of structs (s, k, kind, e, owners, repos, standing), by start, then kind."""
    found = candidates(docs, owner, repo)
    spans = found.select("_n", F.inline("_spans"))
    told = join_hot(spans, ownership(found, wide_owners, wide_repos), ["a", "b"]).where(f"k < {BASE} OR standing = 'live'")
    kind = F.element_at(F.array(*[F.lit(k[0]) for k in KINDS]), F.col("k") + 1)
    each = told.groupBy("_n").agg(F.array_sort(F.collect_list(F.struct("s", "k", kind.alias("kind"), "e", "owners", "repos", "standing"))).alias("secrets"))
    return found.select("_n", "_row").join(each, "_n", "left").select(*unpacked(docs, "text", "secrets"), F.coalesce("secrets", F.array().cast(each.schema["secrets"].dataType)).alias("secrets"))


def op12_secrets(spark, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    joined = "array_join(transform({}, p -> {}), ',')"
    place = "concat(p.kind, ':', p.s, ':', p.e)"
    return found.select(
        "doc_id",
        *[F.expr(f"size(filter(secrets, p -> p.k = {i}))").cast("long").alias(f"n_{KINDS[i][0]}") for i in range(BASE)],
        F.sha2(F.expr(joined.format(f"filter(secrets, p -> p.k < {BASE})", place)), 256).alias("base_sha256"),
        F.expr(joined.format("secrets", place)).alias("spans"),
        F.expr(joined.format("secrets", "p.standing")).alias("standings"),
        F.expr(joined.format("secrets", "cast(p.owners AS string)")).alias("owners"),
        F.expr(joined.format("secrets", "cast(p.repos AS string)")).alias("repos"),
        F.expr("size(filter(secrets, p -> p.standing = 'live'))").cast("long").alias("n_live"),
    )


def _sql() -> str:
    value = "regexp_extract(h, '^[A-Za-z_]+[\\x22\\x27]?\\x20*[:=]\\x20*[\\x22\\x27]?(.*)$', 1)"
    mixed = "length(regexp_replace(h, '[^0-9]', '', 'g')) >= 5 AND length(regexp_replace(h, '[^A-Za-z]', '', 'g')) >= 5"
    ok = ("length(v) >= 6", "length(h) >= 20", "true", f"length(h) <= 256 AND {mixed}", "true")
    parts = [
        f"""
SELECT doc_id, source, s, {i} AS k, '{kind[0]}' AS kind, e, v, {_LOOKS.format(rlike='regexp_matches')} AS looks
FROM (SELECT doc_id, source, h, {value if i == 0 else 'h'} AS v, (sum(length(pre) + length(h)) OVER w - length(h))::BIGINT AS s, (sum(length(pre) + length(h)) OVER w)::BIGINT AS e
      FROM (SELECT doc_id, source, unnest(regexp_extract_all(text, '{kind[2]}')) AS h, unnest(string_split_regex(text, '{kind[2]}')) AS pre, generate_subscripts(string_split_regex(text, '{kind[2]}'), 1) AS i FROM documents)
      WHERE h IS NOT NULL WINDOW w AS (PARTITION BY doc_id ORDER BY i)) WHERE {ok[i]}"""
        for i, kind in enumerate(KINDS)
    ]
    return f"""
WITH c AS ({' UNION ALL '.join(parts)}),
o AS (SELECT v, count(DISTINCT coalesce(source, chr(1))) AS owners, count(DISTINCT doc_id) + max((doc_id IS NULL)::INT) AS repos, bool_or(looks) AS looks FROM c GROUP BY v),
s AS (SELECT * FROM (SELECT c.doc_id, s, k, kind, e, owners, repos, CASE WHEN owners >= {WIDE_OWNERS} OR owners > 1 AND repos >= {WIDE_REPOS} THEN 'example' WHEN owners > 1 THEN 'shared' WHEN o.looks THEN 'live' ELSE 'weak' END AS standing FROM c JOIN o ON c.v = o.v) WHERE k < {BASE} OR standing = 'live'),
a AS (SELECT doc_id, count(*) FILTER (WHERE k = 0) AS n_assign, count(*) FILTER (WHERE k = 1) AS n_access, count(*) FILTER (WHERE k = 2) AS n_hex, count(*) FILTER (WHERE standing = 'live') AS n_live,
             string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) FILTER (WHERE k < {BASE}) AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) AS spans,
             string_agg(standing, ',' ORDER BY s, k) AS standings, string_agg(owners::VARCHAR, ',' ORDER BY s, k) AS owners, string_agg(repos::VARCHAR, ',' ORDER BY s, k) AS repos FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(standings, '') AS standings, coalesce(owners, '') AS owners, coalesce(repos, '') AS repos, coalesce(n_live, 0) AS n_live
FROM documents d LEFT JOIN a ON d.doc_id = a.doc_id
"""


SQL = _sql()
