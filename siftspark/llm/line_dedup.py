"""Line dedup by overlapping windows of three lines.

Consecutive lines are hashed in the JVM, three at a time; windows that occur
more than once in the corpus are found by one aggregation, and every occurrence
but the first (by doc_id, text hash and position) covers its lines. Covered
positions are merged and removed. Only DataFrame functions are used.

Defined cases: lines are compared without blanks, tabs and carriage returns at
their ends; blank lines join no window, but go if they lie inside one that goes.
A document of fewer than three lines that aren't blank keeps all of them. Null
text has no lines and stays null. Rows that repeat doc_id and text are one
document and get the same result; null ids come first. Other columns pass
through untouched, but for columns called n_lines, n_removed and n_spans: the
result's take their place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, join_hot, on_key, packed, table, text_hash, unpacked

WINDOW = 3


def _windows(docs: DataFrame) -> DataFrame:
    """One row for each window: the document, first and last position and a hash of 128 bits."""
    lines = docs.select("doc_id", F.coalesce(F.xxhash64("text"), F.lit(0)).alias("_th"), F.expr(r"""
        transform(filter(transform(split(text, '\n', -1), (l, i) -> struct(i AS p, trim(BOTH ' \t\r' FROM l) AS t)), x -> x.t <> ''),
                  x -> struct(x.p AS p, xxhash64(x.t) AS g, xxhash64(7L, x.t) AS h))""").alias("_l"))
    n = f"greatest(size(_l) - {WINDOW - 1}, 0)"
    triples = lines.where(f"size(_l) >= {WINDOW}").select("doc_id", "_th", F.expr(f"""
        transform(arrays_zip(slice(_l, 1, {n}), slice(_l, 2, {n}), slice(_l, 3, {n})),
                  x -> struct(x.`0`.p AS first, x.`2`.p AS last, xxhash64(x.`0`.g, x.`1`.g, x.`2`.g) AS k1, xxhash64(x.`0`.h, x.`1`.h, x.`2`.h) AS k2))""").alias("_w"))
    return triples.select("doc_id", "_th", F.inline_outer("_w"))  # inline() would infer a filter that repeats all of _w


def covered(docs: DataFrame) -> DataFrame:
    """doc_id, _th and the sorted positions (_cov) of the lines to remove, for documents that have some."""
    windows = checkpoint(_windows(docs))  # texts are split and hashed once
    here = F.struct("doc_id", "_th", "first")
    firsts = windows.groupBy("k1", "k2").agg(F.count("*").alias("_n"), F.min(here).alias("_f")).where("_n > 1")
    later = join_hot(windows, firsts, ["k1", "k2"]).where(~here.eqNullSafe(F.col("_f")))
    spans = later.groupBy("doc_id", "_th").agg(F.collect_set(F.struct("first", "last")).alias("_s"))
    return spans.select("doc_id", "_th", F.expr("array_sort(array_distinct(flatten(transform(_s, s -> sequence(s.first, s.last)))))").alias("_cov"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs with the text that is left, and n_lines, n_removed and n_spans (runs of removed lines)."""
    counts = ("n_lines", "n_removed", "n_spans")
    left = docs.select("doc_id", text_hash(), packed(docs, "text", *counts), F.split("text", "\n", -1).alias("_lines"))
    both = on_key(left, covered(docs), "left")
    kept = "CASE WHEN _cov IS NULL THEN _lines WHEN size(_cov) = size(_lines) THEN array() ELSE transform(array_except(sequence(0, size(_lines) - 1), _cov), i -> _lines[i]) END"
    text = F.array_join(F.expr(kept), "\n").alias("text")
    rest = dict(zip([c for c in docs.columns if c != "text" and c not in counts], unpacked(docs, "text", *counts), strict=True))
    return both.select(
        *[text if c == "text" else rest[c] for c in docs.columns if c not in counts],
        F.expr("CASE WHEN _lines IS NULL THEN 0L ELSE size(_lines) END").cast("long").alias("n_lines"),
        F.expr("coalesce(size(_cov), 0)").cast("long").alias("n_removed"),
        F.expr("coalesce(size(_cov) - size(array_intersect(_cov, transform(_cov, x -> x + 1))), 0)").cast("long").alias("n_spans"),
    )


def op2_line_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_lines", "n_removed", "n_spans", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS p FROM documents),
t AS (SELECT doc_id, p, trim(line, chr(32) || chr(9) || chr(13)) AS t FROM l),
w AS (SELECT doc_id, p AS first, lead(p, 2) OVER o AS last, t AS a, lead(t, 1) OVER o AS b, lead(t, 2) OVER o AS c FROM t WHERE t <> '' WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
r AS (SELECT *, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, first) AS k FROM w WHERE last IS NOT NULL),
cov AS (SELECT DISTINCT doc_id, unnest(range(first, last + 1)) AS p FROM r WHERE k > 1),
runs AS (SELECT doc_id, count(*) AS n_removed, count(*) FILTER (WHERE g IS NULL OR p - g > 1) AS n_spans FROM (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS g FROM cov) GROUP BY doc_id),
kept AS (SELECT l.doc_id, string_agg(line, chr(10) ORDER BY l.p) AS text FROM l LEFT JOIN cov ON l.doc_id = cov.doc_id AND l.p = cov.p WHERE cov.p IS NULL GROUP BY l.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN 0 ELSE len(string_split(d.text, chr(10))) END AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(coalesce(kept.text, '')) AS kept_sha256
FROM documents d LEFT JOIN runs ON d.doc_id = runs.doc_id LEFT JOIN kept ON d.doc_id = kept.doc_id
"""
