"""Personal data in text: patterns propose, checksums confirm, context scores.

Only DataFrame functions are used. A pattern's matches and their places come
from one walk of the matcher (spans). Patterns start at the
head of a run (or where the last match ended) and use possessive repeats, which
find the same leftmost matches in linear time and without deep recursion.

Kinds email, ip, card (Luhn) and phone are the base; iban (mod-97) and secret (keys
and tokens: long runs of letters and digits, with many of both) are added. A
span's score is the kind's own plus 10, 100 at most, where one of the kind's
context words stands within 40 characters of it; a secret's is 90 where it does.

Context is read from pieces of the text, so that the work grows with the text
and not with its square.

Defined cases: null and empty text have no spans; every row is judged by itself,
so null or repeated ids and tied spans change nothing; places count code points,
ends are exclusive; spans of different kinds may overlap; other columns pass
through, but for one called pii, whose place the result takes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import packed, table, unpacked
from .spans import matches

_CARD_LUHN = """aggregate(sequence(1, length({d})), 0, (a, i) -> a + CASE WHEN i % 2 = 1 THEN int(substr({d}, length({d}) - i + 1, 1))
    ELSE int(substr({d}, length({d}) - i + 1, 1)) * 2 - CASE WHEN int(substr({d}, length({d}) - i + 1, 1)) > 4 THEN 9 ELSE 0 END END) % 10 = 0"""
_IBAN_97 = """aggregate(split(concat(substr({d}, 5), substr({d}, 1, 4)), ''), 0, (a, c) -> CASE WHEN c = '' THEN a WHEN c >= 'A' THEN (a * 100 + ascii(c) - 55) % 97 ELSE (a * 10 + int(c)) % 97 END) = 1"""

#: Kind, pattern, a test that any text with a match passes, digits of the match, its confirmation, score, context words.
KINDS = (
    ("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", r"contains(text, '@')", "h", "true", 85, "mail|contact|write"),
    ("ip", r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"rlike(text, '[0-9][.][0-9]++[.][0-9]++[.][0-9]')", "h", r"forall(split(h, '[.]'), p -> rlike(p, '^0*([0-9]{1,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$'))", 70, "server|host|address|client"),
    ("card", r"[0-9](?:[\x20-]?[0-9])++", r"rlike(text, '[0-9](?:[ -]?[0-9]){13}')", "regexp_replace(h, '[^0-9]', '')", "length({d}) BETWEEN 14 AND 19 AND " + _CARD_LUHN, 80, "card|credit|debit|visa|payment"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"contains(text, '+')", "regexp_replace(h, '[^0-9]', '')", "length({d}) BETWEEN 10 AND 15", 60, "phone|call|mobile|fax"),
    ("iban", r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?", r"rlike(text, '[A-Z][A-Z][0-9][0-9] ?[A-Z0-9]{4}')", "regexp_replace(h, '[^A-Z0-9]', '')", "length({d}) BETWEEN 15 AND 34 AND " + _IBAN_97, 90, "iban|account|bank"),
    ("secret", r"[A-Za-z0-9_-]{32,}+", r"rlike(text, '[A-Za-z0-9_-]{32}')", "h", "length(h) <= 256 AND length(regexp_replace(h, '[^0-9]', '')) >= 6 AND length(regexp_replace(h, '[^A-Za-z]', '')) >= 6", 80, "token|secret|key|passw|auth"),
)
BASE = 4
NEAR = 40


PIECE = 4096


def _spans(at: int) -> Column:
    """Confirmed spans of one kind, as structs (s, k, kind, e, score); reads text and its pieces (_cuts)."""
    kind, pattern, gate, digits, confirm, score, context = KINDS[at]
    confirm = confirm.replace("{d}", "d")
    placed = matches(pattern)
    checked = f"filter(transform({placed}, x -> struct(x.s AS s, x.h AS h, transform(array(x.h), h -> {digits})[0] AS d)), x -> transform(array(struct(x.h AS h, x.d AS d)), y -> {_of('y', confirm)})[0])"
    # The text from place p: two pieces are enough for NEAR characters.
    some = lambda p: f"substr(concat(_cuts[({p}) div {PIECE}], coalesce(get(_cuts, int(({p}) div {PIECE} + 1)), '')), ({p}) % {PIECE} + 1"
    before = some(f"greatest(x.s - {NEAR}, 0)") + f", least(x.s, {NEAR}))"
    after = f"CASE WHEN (x.s + length(x.h)) div {PIECE} >= size(_cuts) THEN '' ELSE {some('x.s + length(x.h)')}, {NEAR}) END"
    around = f"lower(concat({before}, ' ', {after}))"
    out = f"transform({checked}, x -> struct(x.s AS s, {at} AS k, '{kind}' AS kind, x.s + length(x.h) AS e, {score} + CASE WHEN rlike({around}, '{context}') THEN 10 ELSE 0 END AS score))"
    return F.expr(f"CASE WHEN text IS NOT NULL AND {gate} THEN {out} ELSE cast(array() AS array<struct<s: int, k: int, kind: string, e: int, score: int>>) END")


def _of(name: str, expr: str) -> str:
    """expr with its h and d taken from the struct called name."""
    import re

    return re.sub(r"(?<![\w.'])([hd])(?![\w'])", rf"{name}.\1", expr)


def find(docs: DataFrame) -> DataFrame:
    """docs with a column pii: array of structs (s, k, kind, e, score), by start, then kind."""
    each = docs.select(packed(docs, "pii"), "text", F.regexp_extract_all("text", F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)).alias("_cuts"))
    return each.select("_row", F.array_sort(F.concat(*[_spans(i) for i in range(len(KINDS))])).alias("pii")).select(*unpacked(docs, "pii"), "pii")


def redact(docs: DataFrame, least: int = 0) -> DataFrame:
    """docs with each span of at least that score replaced by <KIND>; where spans overlap, the first stays."""
    out = find(docs)
    done = f"""aggregate(filter(pii, p -> p.score >= {int(least)}), struct(0 AS at, '' AS t), (a, p) -> CASE WHEN p.s < a.at THEN a ELSE
        struct(p.e AS at, concat(a.t, substr(text, a.at + 1, p.s - a.at), '<', upper(p.kind), '>') AS t) END, a -> concat(a.t, substr(text, a.at + 1)))"""
    return out.select(*[(F.expr(done).alias("text") if c == "text" else F.col(f"`{c}`")) for c in docs.columns if c != "pii"], F.col("pii"))


def op5_pii(spark, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    joined = "array_join(transform({}, p -> concat(p.kind, ':', p.s, ':', p.e)), ',')"
    return found.select(
        "doc_id",
        *[F.expr(f"size(filter(pii, p -> p.k = {i}))").cast("long").alias(f"n_{KINDS[i][0]}") for i in range(BASE)],
        F.sha2(F.expr(joined.format(f"filter(pii, p -> p.k < {BASE})")), 256).alias("base_sha256"),
        F.expr(joined.format("pii")).alias("spans"),
        F.expr("array_join(transform(pii, p -> cast(p.score AS string)), ',')").alias("scores"),
        *[F.expr(f"size(filter(pii, p -> p.k = {i}))").cast("long").alias(f"n_{KINDS[i][0]}") for i in range(BASE, len(KINDS))],
        F.size("pii").cast("long").alias("n_pii"),
    )


def _sql() -> str:
    patterns = (
        r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        r"[0-9]([\x20-]?[0-9])+",
        r"\+[0-9][\x20().0-9-]+[0-9]",
        r"[A-Z]{2}[0-9]{2}(\x20?[A-Z0-9]{4}){2,7}(\x20?[A-Z0-9]{1,3})?",
        r"[A-Za-z0-9_-]{32,}",
    )
    ok = (
        "true",
        "len(list_filter(string_split(h, '.'), lambda p: NOT regexp_full_match(p, '0*([0-9]{1,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])'))) = 0",
        "length(g) BETWEEN 14 AND 19 AND list_sum(list_transform(range(1, length(g) + 1), lambda i: CASE WHEN i % 2 = 1 THEN g[length(g) - i + 1]::INT ELSE g[length(g) - i + 1]::INT * 2 - CASE WHEN g[length(g) - i + 1]::INT > 4 THEN 9 ELSE 0 END END)) % 10 = 0",
        "length(g) BETWEEN 10 AND 15",
        "length(h2) BETWEEN 15 AND 34 AND list_reduce(list_prepend(0::BIGINT, list_transform(string_split(substr(h2, 5) || substr(h2, 1, 4), ''), lambda c: (CASE WHEN c >= 'A' THEN 1000 + ascii(c) - 55 ELSE c::INT END)::BIGINT)), lambda a, c: CASE WHEN c >= 1000 THEN (a * 100 + c - 1000) % 97 ELSE (a * 10 + c) % 97 END) = 1",
        "length(h) <= 256 AND length(regexp_replace(h, '[^0-9]', '', 'g')) >= 6 AND length(regexp_replace(h, '[^A-Za-z]', '', 'g')) >= 6",
    )
    parts = []
    for i, (kind, _, _, _, _, score, context) in enumerate(KINDS):
        p = "'" + patterns[i] + "'"
        parts.append(f"""
SELECT doc_id, s, {i} AS k, '{kind}' AS kind, e, {score} + CASE WHEN regexp_matches(lower(substr(text, greatest(s - {NEAR - 1}, 1), least(s, {NEAR})) || ' ' || substr(text, e + 1, {NEAR})), '{context}') THEN 10 ELSE 0 END AS score
FROM (SELECT doc_id, text, h, regexp_replace(h, '[^0-9]', '', 'g') AS g, regexp_replace(h, '[^A-Z0-9]', '', 'g') AS h2, (sum(length(pre) + length(h)) OVER (PARTITION BY doc_id ORDER BY i) - length(h))::BIGINT AS s,
             (sum(length(pre) + length(h)) OVER (PARTITION BY doc_id ORDER BY i))::BIGINT AS e
      FROM (SELECT doc_id, text, unnest(regexp_extract_all(text, {p})) AS h, unnest(string_split_regex(text, {p})) AS pre, generate_subscripts(string_split_regex(text, {p}), 1) AS i FROM documents)
      WHERE h IS NOT NULL) WHERE {ok[i]}""")
    return f"""
WITH s AS ({' UNION ALL '.join(parts)}),
a AS (SELECT doc_id, count(*) FILTER (WHERE k = 0) AS n_email, count(*) FILTER (WHERE k = 1) AS n_ip, count(*) FILTER (WHERE k = 2) AS n_card, count(*) FILTER (WHERE k = 3) AS n_phone, count(*) FILTER (WHERE k = 4) AS n_iban, count(*) FILTER (WHERE k = 5) AS n_secret, count(*) AS n_pii,
             string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) FILTER (WHERE k < {BASE}) AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) AS spans, string_agg(score::VARCHAR, ',' ORDER BY s, k) AS scores FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(scores, '') AS scores, coalesce(n_iban, 0) AS n_iban, coalesce(n_secret, 0) AS n_secret, coalesce(n_pii, 0) AS n_pii
FROM documents d LEFT JOIN a ON d.doc_id = a.doc_id
"""


SQL = _sql()
