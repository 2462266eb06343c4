"""A keyword index that follows its documents: immutable segments, tombstones, merges by size.

Each batch of new or changed documents becomes a segment: postings by bucket of
the term, and the documents' lengths by bucket of their key. What it replaces or
deletes in earlier segments is written as tombstones (segment, key). A version of
the index is a list of segments and tombstones and the totals of what lives; it
is made by one exclusive file (manifest), so readers see a batch whole or not at
all, and of two writers one is refused.

A batch reads its own texts, and of the earlier segments only the lengths in the
buckets of its own keys. Scores are those of an index built anew: the documents
of a term are counted among what lives, the totals are kept exactly.

When MERGE segments are of one size class (a power of MERGE), they become one,
from their postings and without the dead; a segment more than half dead is
rewritten alike. So a document is rewritten once for each size class that the
index passes, and a query reads few segments. Files of segments that no version
names any more are removed by vacuum().
"""

from __future__ import annotations

import math
import uuid
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import manifest
from .retrieval import Index, bucket, count_tokens, deal, pieces, shards_of

KEY_BUCKETS, MERGE, TOKEN_CHARS = 16, 4, 6


def _key_bucket(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(KEY_BUCKETS)).cast("int")


def _segment(folder: str, name: str, what: str) -> str:
    return f"{folder}/segments/{name}/{what}"


_SCHEMAS = {"postings": "key {kind}, length long, term string, tf long, bucket int", "docs": "key {kind}, length long, part int", "dead": "segment string, key {kind}, length long"}


def _read(spark: SparkSession, folder: str, state: dict[str, Any], names: list[str], what: str) -> DataFrame:
    """One part of some segments, with the name of its segment."""
    schema = _SCHEMAS[what].format(kind=state.get("key", "long"))
    out = None
    for name in names:
        one = spark.read.schema(schema).parquet(_segment(folder, name, what)).withColumn("segment", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return spark.createDataFrame([], f"{schema}, segment string") if out is None else out


def _dead(spark: SparkSession, folder: str, state: dict[str, Any]) -> DataFrame | None:
    paths = [f"{folder}/dead/{n}" for n in state.get("dead", [])]
    return spark.read.schema(_SCHEMAS["dead"].format(kind=state["key"])).parquet(*paths) if paths else None


def _alive(rows: DataFrame, dead: DataFrame | None) -> DataFrame:
    return rows if dead is None else rows.join(dead.select("segment", "key"), ["segment", "key"], "left_anti")


def _write_postings(postings: DataFrame, folder: str, name: str) -> None:
    """postings: key, length, term, tf, shard and bucket."""
    postings.select("key", "length", "term", "tf", "bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(_segment(folder, name, "postings"))


def _write_docs(lengths: DataFrame, folder: str, name: str) -> None:
    """lengths: key, length."""
    dealt = lengths.select("key", "length", _key_bucket("key").alias("part")).repartition(KEY_BUCKETS, "part")
    dealt.sortWithinPartitions("part", "key").write.partitionBy("part").parquet(_segment(folder, name, "docs"))


def _totals(spark: SparkSession, folder: str, state: dict[str, Any], name: str) -> dict[str, Any]:
    r = _read(spark, folder, state, [name], "docs").agg(F.count("*").alias("docs"), F.coalesce(F.sum("length"), F.lit(0)).alias("tokens")).first()
    return {"name": name, "docs": r.docs, "tokens": r.tokens, "dead_docs": 0, "dead_tokens": 0}


def apply(spark: SparkSession, folder: str, docs: DataFrame | None = None, key: str = "id", text: Column | None = None, deleted: DataFrame | None = None, merge: bool = True) -> int:
    """The version after a batch: docs are added, or replace those of their key; keys of deleted (key) go. A key that is in both is replaced; of rows of one key in docs one stays."""
    version, state = manifest.read(spark, folder)
    segments = [dict(s) for s in state.get("segments", [])]
    dead_files = list(state.get("dead", []))
    state["key"] = state.get("key") or dict((docs if docs is not None else deleted).dtypes)[key if docs is not None else "key"]
    added = None
    if docs is not None:
        name = uuid.uuid4().hex
        texts, chars = pieces(docs, key, text if text is not None else F.col("text"))
        counted = count_tokens(texts.dropDuplicates(["key"]))
        dealt = deal(counted.withColumn("bucket", F.when(F.col("term").isNull(), F.lit(-1)).otherwise(bucket("term"))), shards_of(chars))
        _write_postings(dealt, folder, name)  # the tokens are made once, and their postings written once
        # A document without a token is a row of no term, in a bucket of its own that goes; its length counts in the totals.
        every = _read(spark, folder, state, [name], "postings")
        _write_docs(every.select("key", F.when(F.col("bucket") == -1, F.lit(0)).otherwise(F.col("length")).cast("long").alias("length")).distinct(), folder, name)
        manifest.remove(spark, f"{_segment(folder, name, 'postings')}/bucket=-1")
        added = _totals(spark, folder, state, name)
    gone = None
    if added is not None:
        gone = _read(spark, folder, state, [added["name"]], "docs").select("key", "part")
    if deleted is not None:
        keys = deleted.select(F.col("key")).distinct().withColumn("part", _key_bucket("key"))
        gone = keys if gone is None else gone.unionByName(keys).distinct()
    if gone is not None and segments:
        parts = [r.part for r in gone.select("part").distinct().collect()]  # KEY_BUCKETS at most
        old = _alive(_read(spark, folder, state, [s["name"] for s in segments], "docs").where(F.col("part").isin(parts)), _dead(spark, folder, state))
        file = uuid.uuid4().hex
        old.join(gone, ["key", "part"], "left_semi").select("segment", "key", "length").write.parquet(f"{folder}/dead/{file}")
        for r in spark.read.parquet(f"{folder}/dead/{file}").groupBy("segment").agg(F.count("*").alias("n"), F.sum("length").alias("tokens")).collect():
            own = next(s for s in segments if s["name"] == r.segment)
            own["dead_docs"] += r.n
            own["dead_tokens"] += r.tokens
        dead_files.append(file)
    state = {"key": state["key"], "segments": segments + ([added] if added and added["docs"] else []), "dead": dead_files}
    if merge:
        state = _merged(spark, folder, state)
    manifest.commit(spark, folder, version + 1, state)
    return version + 1


def _class(s: dict[str, Any]) -> int:
    return int(math.log(max(s["docs"] - s["dead_docs"], 1), MERGE))


def _due(segments: list[dict[str, Any]]) -> list[dict[str, Any]]:
    """The segments to be made one: those of a full size class, else one that is more than half dead."""
    classes: dict[int, list[dict[str, Any]]] = {}
    for s in segments:
        classes.setdefault(_class(s), []).append(s)
    for c in sorted(classes):
        if len(classes[c]) >= MERGE:
            return classes[c]
    return next(([s] for s in segments if 2 * s["dead_docs"] > s["docs"]), [])


def _merged(spark: SparkSession, folder: str, state: dict[str, Any]) -> dict[str, Any]:
    """state after the merges that are due; tombstones of merged segments are left behind."""
    while due := _due(state["segments"]):
        names, name = [s["name"] for s in due], uuid.uuid4().hex
        dead = _dead(spark, folder, state)
        postings = deal(_alive(_read(spark, folder, state, names, "postings"), dead), shards_of(TOKEN_CHARS * sum(s["tokens"] for s in due)))
        _write_postings(postings, folder, name)
        _write_docs(_alive(_read(spark, folder, state, names, "docs"), dead), folder, name)
        rest = [s for s in state["segments"] if s["name"] not in names]
        one = _totals(spark, folder, state, name)
        state = {"key": state["key"], "segments": rest + ([one] if one["docs"] else []), "dead": state["dead"] if any(s["dead_docs"] for s in rest) else []}
    return state


def open_index(spark: SparkSession, folder: str, version: int | None = None) -> Index:
    """A version of the index, as retrieval reads one: what lives of its postings, the documents of each term, the totals."""
    _, state = manifest.read(spark, folder, version)
    segments = state.get("segments", [])
    alive = _alive(_read(spark, folder, state, [s["name"] for s in segments], "postings"), _dead(spark, folder, state))
    total = sum(s["docs"] - s["dead_docs"] for s in segments)
    tokens = sum(s["tokens"] - s["dead_tokens"] for s in segments)
    corpus = spark.createDataFrame([(total, tokens / total if total else 0.0)], "total long, mean double")
    return Index(alive, alive.groupBy("bucket", "term").agg(F.count("*").alias("n")), corpus)


def vacuum(spark: SparkSession, folder: str, keep: int = 1) -> int:
    """Remove the files that none of the last `keep` versions names; how many segments went. Readers of older versions fail then."""
    last, _ = manifest.read(spark, folder)
    used, dead = set(), set()
    for n in range(max(1, last - keep + 1), last + 1):
        state = manifest.read(spark, folder, n)[1]
        used |= {s["name"] for s in state.get("segments", [])}
        dead |= set(state.get("dead", []))
    gone = [n for n in manifest.names(spark, f"{folder}/segments") if n not in used]
    for n in gone:
        manifest.remove(spark, f"{folder}/segments/{n}")
    for n in manifest.names(spark, f"{folder}/dead"):
        if n not in dead:
            manifest.remove(spark, f"{folder}/dead/{n}")
    return len(gone)
