"""Mixing sources to target weights by temperature.

Each source's share of the corpus' tokens (words between blanks) is raised to an
exponent and normalised. The exponent, 1 for the natural mix and 0 for a uniform
one, is bisected: it is the largest at which the mix has the target entropy (a
fraction of the largest possible one), or more if no source may be repeated
beyond the limit. A weight times the budget gives a source its quota of tokens:
whole passes over the source, then part of a pass. A pass is a permutation of
hashed blocks and of the documents within each block; the partial pass takes
blocks in that order while they fit and cuts the last one to the token.

The driver holds one number for each source; more than MAX_SOURCES is an error.
No task gathers more than one block, or a 4096th of a source's list of blocks.

Defined cases: a null source is the source ''; documents without tokens (null or
empty text) are in no mix; in a tie of hashes the smaller doc_id, then the hash
of the text, goes first; rows that repeat doc_id and text are one document whose
copies share a place and count each; an empty table gives an empty mix; columns
called n_tokens, weight, epoch, block and place give way to the result's.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, on_key, packed, table, text_hash, unpacked

MAX_SOURCES = 100_000
BLOCK_DOCS = 1000


def exponent(tokens: list[int], entropy: float | None, repeats: float | None, budget: int) -> tuple[float, list[float]]:
    """The exponent and the weights, rounded to nine places, for sources of so many tokens."""
    total, n = sum(tokens), len(tokens)
    shares = [t / total for t in tokens]

    def weights(a: float) -> list[float]:
        raw = [s**a for s in shares]
        return [x / sum(raw) for x in raw]

    def spread(a: float) -> bool:
        return entropy is None or n < 2 or -sum(w * math.log(w) for w in weights(a)) >= entropy * math.log(n)

    def within(a: float) -> bool:
        return repeats is None or max(w * budget / t for w, t in zip(weights(a), tokens, strict=True)) <= repeats

    low, high = 0.0, 1.0  # spread() holds below some exponent
    if not spread(1.0):
        for _ in range(50):
            mid = (low + high) / 2
            low, high = (mid, high) if spread(mid) else (low, mid)
    else:
        low = 1.0
    chosen = low
    if not within(chosen):  # within() holds above some exponent
        low, high = chosen, 1.0
        for _ in range(50):
            mid = (low + high) / 2
            low, high = (low, mid) if within(mid) else (mid, high)
        chosen = high
    return chosen, [round(w, 9) for w in weights(chosen)]


def plan(counts: DataFrame, entropy: float | None, repeats: float | None, budget: int | None) -> list[dict]:
    """For each source of counts (_source, tokens, n_docs): its weight, quota, whole passes, tokens of the partial pass and number of blocks."""
    rows = counts.where("tokens > 0").orderBy("_source").limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    if not rows:
        return []
    budget = sum(r["tokens"] for r in rows) if budget is None else budget
    _, weights = exponent([r["tokens"] for r in rows], entropy, repeats, budget)
    out = []
    for r, w in zip(rows, weights, strict=True):
        quota = math.floor(w * budget)
        out.append({"_source": r["_source"], "weight": w, "_passes": quota // r["tokens"], "_part": quota % r["tokens"], "_blocks": -(-r["n_docs"] // BLOCK_DOCS)})
    return out


RESULTS = ("n_tokens", "weight", "epoch", "block", "place")


def mix(docs: DataFrame, entropy: float | None = 0.98, repeats: float | None = 4.0, budget: int | None = None, seed: int = 0, source: str = "source", keep: list[str] | None = None) -> DataFrame:
    """docs (or the columns to keep) in the mix, a row for each time a document is taken, with n_tokens, weight, epoch (from 0), block and place.

    Sorting by epoch, block and place gives the permutation; place is the
    document's rank within its block and pass."""
    spark = docs.sparkSession
    own = docs.select(*[F.col(f"`{c}`") for c in (keep or docs.columns) if c not in RESULTS])
    tokens = F.expr(r"regexp_count(coalesce(text, ''), r'[^\x20\x09-\x0D]+')").cast("long")
    name = F.col(f"`{source}`")
    of_source = F.coalesce(name.cast("string"), F.lit("")).alias("_source")
    # Texts are counted once. A document is its id, text and source, however many rows it has.
    each = docs.select("doc_id", text_hash(), of_source, name.alias("_named"), tokens.alias("n_tokens")).where("n_tokens > 0")
    counted = checkpoint(each.groupBy("doc_id", "_th", "_source").agg(F.min("_named").alias("_named"), F.min("n_tokens").alias("n_tokens"), F.count("*").alias("_copies")))
    counts = counted.groupBy("_source").agg(F.sum(F.col("n_tokens") * F.col("_copies")).alias("tokens"), F.sum("_copies").alias("n_docs"))
    made = plan(counts, entropy, repeats, budget)
    schema = "_source string, weight double, _passes long, _part long, _blocks long"
    plans = spark.createDataFrame([tuple(p.values()) for p in made], schema)
    plans = F.broadcast(plans)  # a row for each source, MAX_SOURCES at most

    def hashed(*cols) -> F.Column:
        return F.md5(F.concat_ws(":", F.lit(str(seed)), *cols))

    doc = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    dealt = counted.join(plans, "_source").withColumn("_b", F.conv(F.substring(hashed(doc), 1, 8), 16, 10).cast("long") % F.col("_blocks"))
    sizes = dealt.groupBy("_source", "_b", "_part").agg(F.sum(F.col("n_tokens") * F.col("_copies")).alias("_size"))
    blocks = checkpoint(_in_order(sizes.withColumn("_h", hashed(F.col("_source"), F.col("_b").cast("string")))))
    placed = dealt.join(blocks, ["_source", "_b"])
    within = Window.partitionBy("_source", "_b").orderBy(hashed(F.lit("d"), doc), "doc_id", "_th")
    upto = F.sum(F.col("n_tokens") * F.col("_copies")).over(within)
    placed = placed.withColumn("place", F.sum("_copies").over(within) - F.col("_copies")).withColumn("_sum", upto)
    taken = F.col("_passes") + F.when(F.col("_sum") <= F.col("_room"), 1).otherwise(0)
    times = placed.withColumn("_times", taken).where("_times > 0")
    epochs = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_times") - 1)).alias("epoch")
    if set(own.columns) <= {"doc_id", source}:  # nothing more to read
        copies = times.withColumn("_copy", F.explode(F.expr("sequence(1L, _copies)")))
        return copies.select(*[F.col("_named" if c == source else c).alias(c) for c in own.columns], "n_tokens", "weight", epochs, "block", "place")
    rows = docs.select("doc_id", text_hash(), of_source, packed(own))
    times = times.select("doc_id", "_th", F.col("_source").alias("_of"), "n_tokens", "weight", "_times", "block", "place")
    both = on_key(rows, times, "inner").where("_source = _of")
    return both.select(*unpacked(own), "n_tokens", "weight", epochs, "block", "place")


def _in_order(sizes: DataFrame) -> DataFrame:
    """_source, _b, block (its number in the order of _h) and _room (tokens of the partial pass that are left when it begins).

    The order is cut by the first digits of the hash, so that no task holds all blocks of a source."""
    head = F.substring("_h", 1, 3).alias("_head")
    sizes = sizes.select("_source", "_b", "_part", "_size", "_h", head)
    first = Window.partitionBy("_source").orderBy("_head")
    heads = sizes.groupBy("_source", "_head").agg(F.sum("_size").alias("_s"), F.count("*").alias("_n"))
    heads = heads.select("_source", "_head", (F.sum("_s").over(first) - F.col("_s")).alias("_s0"), (F.sum("_n").over(first) - F.col("_n")).alias("_n0"))
    order = Window.partitionBy("_source", "_head").orderBy("_h", "_b")
    out = sizes.join(heads, ["_source", "_head"])
    before = F.col("_s0") + F.sum("_size").over(order) - F.col("_size")
    return out.select("_source", "_b", (F.col("_n0") + F.row_number().over(order) - 1).cast("long").alias("block"), (F.col("_part") - before).alias("_room"))


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), keep=["doc_id", "source"]).select("doc_id", "source", "n_tokens", F.round("weight", 6).alias("weight"), "epoch", "block", "place")


SQL = r"""
WITH RECURSIVE t AS (SELECT doc_id, source, coalesce(source, '') AS s, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n_tokens FROM documents),
d AS (SELECT * FROM t WHERE n_tokens > 0),
c AS (SELECT s, sum(n_tokens)::BIGINT AS tokens, count(*) AS n_docs FROM d GROUP BY s),
g AS (SELECT sum(tokens)::BIGINT AS b, count(*) AS n FROM c),
l AS (SELECT list(tokens::DOUBLE / b ORDER BY s) AS p, any_value(n) AS n FROM c, g),
e AS (SELECT 0 AS k, 0.0::DOUBLE AS low, 1.0::DOUBLE AS high
      UNION ALL SELECT k + 1, CASE WHEN ok THEN mid ELSE low END, CASE WHEN ok THEN high ELSE mid END
      FROM (SELECT k, low, high, mid, -list_sum(list_transform(raw, lambda x: x / list_sum(raw) * ln(x / list_sum(raw)))) >= 0.98 * ln(n) AS ok
            FROM (SELECT k, low, high, n, mid, list_transform(p, lambda x: pow(x, mid)) AS raw FROM (SELECT k, low, high, (low + high) / 2 AS mid, p, n FROM e, l WHERE k < 50)))),
a AS (SELECT CASE WHEN (SELECT -list_sum(list_transform(p, lambda x: x * ln(x))) >= 0.98 * ln(n) FROM l) THEN 1.0 ELSE low END AS a FROM e WHERE k = 50),
w AS (SELECT s, tokens, n_docs, round(pow(tokens::DOUBLE / b, a) / sum(pow(tokens::DOUBLE / b, a)) OVER (), 9) AS weight, b FROM c, g, a),
q AS (SELECT s, weight, floor(weight * b)::BIGINT // tokens AS passes, floor(weight * b)::BIGINT % tokens AS part, (n_docs + 999) // 1000 AS blocks FROM w),
dealt AS (SELECT d.*, q.*, ('0x' || substr(md5('0:' || doc_id), 1, 8))::BIGINT % blocks AS bl FROM d JOIN q USING (s)),
z AS (SELECT s, bl, part, sum(n_tokens) AS size FROM dealt GROUP BY s, bl, part),
z2 AS (SELECT s, bl, part - (sum(size) OVER o - size) AS room, row_number() OVER o - 1 AS block FROM z WINDOW o AS (PARTITION BY s ORDER BY md5('0:' || s || ':' || bl), bl)),
f AS (SELECT doc_id, source, n_tokens, weight, passes, room, block, row_number() OVER o - 1 AS place, sum(n_tokens) OVER o AS upto FROM dealt JOIN z2 USING (s, bl) WINDOW o AS (PARTITION BY s, bl ORDER BY md5('0:d:' || doc_id), doc_id))
SELECT doc_id, source, n_tokens, round(weight, 6) AS weight, unnest(range(0, passes + CASE WHEN upto <= room THEN 1 ELSE 0 END)) AS epoch, block, place FROM f
"""
