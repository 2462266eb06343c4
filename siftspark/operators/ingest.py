"""The archive tier as one operation: every item's one passage, kept in step in the keyword index, the vectors and the clusters.

A run compares each item's text with the hash that is stored, and writes what is
missing, has changed, or lacks a vector that can be made: a batch of passages, a
segment of the keyword index, and the cluster changes of its items. Batches are
immutable and the last one of an item counts, so nothing else is rewritten; a
version names the batches, and comes last. A run that stops half-way is made up
by the next, and one that finds nothing to do leaves everything as it is.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import clusters, manifest, segments
from .chunks import archive_text, context_header, passage_hash
from .retrieval import BAND_DAYS, knn
from .storage import checkpoint

PASSAGES = "item_id long, hash string, header string, text string, source_id string, kind string, trust string, paper_key long, day date, embed_model string, embed_dim int, embedding array<float>"
NEIGHBOURS = 5


@dataclass(frozen=True)
class Ingested:
    """What a run did; problem says why passages have no vectors."""

    archived: int
    embedded: int
    removed: int
    clustered: int
    problem: str | None = None


def archive_texts(items: DataFrame, sources: DataFrame, triage: DataFrame) -> DataFrame:
    """Each item's passage: item_id, hash, header, text, source_id, kind, trust, paper_key, day. Items whose source is gone have none."""
    none = F.array().cast("array<string>")
    named = sources.select(F.col("id").alias("source_id"), F.col("name").alias("source_name"), "trust")
    # The sources that are followed, a short row each: by their name no text is shuffled, and none waits for the others of its source.
    rows = items.join(F.broadcast(named), "source_id").join(triage.select(F.col("item_id").alias("id"), "tags"), "id", "left")
    text = archive_text(F.col("title"), F.col("summary"), F.col("source_name"), F.coalesce("tags", none))
    header = context_header(F.col("source_name"), F.col("title"), F.lit(""))
    day = F.to_date(F.coalesce("published_at", "first_seen"))
    return rows.select(F.col("id").alias("item_id"), passage_hash(header, text).alias("hash"), header.alias("header"), text.alias("text"), "source_id", "kind", "trust", "paper_key", day.alias("day"))


def _batches(spark: SparkSession, folder: str, state: dict) -> DataFrame:
    out = spark.createDataFrame([], PASSAGES + ", batch long")
    for n, name in enumerate(state.get("batches", []), 1):
        out = out.unionByName(spark.read.schema(PASSAGES).parquet(f"{folder}/passages/{name}").withColumn("batch", F.lit(n).cast("long")))
    return out


def passages(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """The stored passages as they are now, with the batch that wrote each; only the columns asked for are read."""
    _, state = manifest.read(spark, folder)
    want = list(columns) or [c.split()[0] for c in PASSAGES.split(", ")]
    some = [c for c in want if c not in ("item_id", "batch")]
    rows = _batches(spark, folder, state).select("item_id", "batch", *some)
    last = rows.groupBy("item_id").agg(F.max_by(F.struct(*some), "batch").alias("_p"), F.max("batch").alias("batch")) if some else rows.groupBy("item_id").agg(F.max("batch").alias("batch"))
    gone = state.get("gone", [])
    if gone:
        left = spark.read.schema("item_id long, batch long").parquet(*[f"{folder}/gone/{n}" for n in gone]).groupBy("item_id").agg(F.max("batch").alias("_gone"))
        last = last.join(left, "item_id", "left").where("_gone IS NULL OR batch > _gone").drop("_gone")
    return last.select("item_id", *(["_p.*"] if some else []), "batch").select(*dict.fromkeys(["item_id", *want, "batch"]))


def _edges(known: DataFrame, todo: DataFrame, threshold: float) -> DataFrame:
    """a, b: the batch's items with the partners of their papers and, of their nearest within the band of days, those that are near enough."""
    here, all_ = todo.where("paper_key IS NOT NULL"), known.where("paper_key IS NOT NULL")
    partners = here.select("paper_key", F.col("item_id").alias("a"), F.col("kind").alias("ka")).join(all_.select("paper_key", F.col("item_id").alias("b"), F.col("kind").alias("kb")), "paper_key").where("a <> b AND ka <> kb")
    q = todo.where("embedding IS NOT NULL").select(F.col("item_id").alias("query_id"), "embedding", F.col("day").alias("qday"))
    near = knn(q, known.where("embedding IS NOT NULL").select(F.col("item_id").alias("chunk_id"), "embedding", "day"), NEIGHBOURS, keep="band", least=threshold)
    return partners.select("a", "b").unionByName(near.select(F.col("query_id").alias("a"), F.col("chunk_id").alias("b")))


def ingest_archive(spark: SparkSession, folder: str, items: DataFrame, sources: DataFrame, triage: DataFrame, embed: Callable[[Column], Column] | None = None, model: str = "", dim: int = 0, threshold: float | None = None) -> Ingested:
    """Bring the archive under folder in step with items, sources and triage.

    embed makes the vectors of model, of dim numbers; without one passages are found by their words alone. Vectors of
    another model than those stored are refused: the index has to be made anew. With a threshold items are clustered."""
    version, state = manifest.read(spark, folder)
    stored = passages(spark, folder, "hash", "embed_model", "embed_dim")
    problem = None if embed else "no embedder"
    if embed:
        kinds = stored.where("embed_model IS NOT NULL").select("embed_model", "embed_dim").distinct().limit(2).collect()
        if any((k.embed_model, k.embed_dim) != (model, dim) for k in kinds):
            embed, problem = None, "the stored vectors are of another model: make the index anew"
    texts = archive_texts(items, sources, triage)
    same = F.col("hash").eqNullSafe(F.col("_hash")) & (F.lit(embed is None) | F.col("_model").isNotNull())
    both = texts.join(stored.select("item_id", F.col("hash").alias("_hash"), F.col("embed_model").alias("_model")), "item_id", "left")
    todo = both.where(~F.coalesce(same, F.lit(False))).drop("_hash", "_model")
    vector = embed(F.concat_ws("\n", "header", "text")) if embed else F.lit(None)
    todo = todo.withColumns({"embed_model": F.lit(model if embed else None).cast("string"), "embed_dim": F.lit(dim if embed else None).cast("int"), "embedding": vector.cast("array<float>")})
    name = uuid.uuid4().hex
    todo.select(*[c.split()[0] for c in PASSAGES.split(", ")]).write.parquet(f"{folder}/passages/{name}")
    written = spark.read.schema(PASSAGES).parquet(f"{folder}/passages/{name}")
    lost = checkpoint(stored.select("item_id", "batch").join(texts.select("item_id"), "item_id", "left_anti"))
    archived, removed = written.count(), lost.count()
    if not archived and not removed:
        manifest.remove(spark, f"{folder}/passages/{name}")
        return Ingested(0, 0, 0, 0, problem)
    state = {"batches": [*state.get("batches", []), name], "gone": list(state.get("gone", []))}
    if removed:
        lost.write.parquet(f"{folder}/gone/{name}")
        state["gone"].append(name)
    searched = written.select("item_id", F.concat_ws("\n", "header", "text").alias("text"))
    segments.apply(spark, f"{folder}/index", searched, "item_id", deleted=lost.select(F.col("item_id").alias("key")) if removed else None)
    manifest.commit(spark, folder, version + 1, state)
    clustered = 0
    if threshold is not None:
        home = f"{folder}/clusters"
        if version == 0:
            clusters.write_membership(spark.createDataFrame([], "id long, cluster_id long"), home, "overwrite")
        days = written.agg(F.min("day").alias("low"), F.max("day").alias("high")).first()
        known = passages(spark, folder, "kind", "paper_key", "day", "embedding")
        if archived:
            partner = written.select("paper_key").distinct()
            band = F.col("day").between(F.date_sub(F.lit(days.low), BAND_DAYS), F.date_add(F.lit(days.high), BAND_DAYS)) if days.low else F.lit(False)
            near = checkpoint(known.where(band).unionByName(known.where(~F.coalesce(band, F.lit(False))).join(partner, "paper_key", "left_semi").select(*known.columns)))  # read from four sides
            changes = checkpoint(clusters.update(clusters.open_membership(spark, home), written.select(F.col("item_id").alias("id")), _edges(near, written, threshold)))
            clustered = changes.where("cluster_id IS NOT NULL").count()
            clusters.store_update(spark, home, changes)
    return Ingested(archived, archived if embed else 0, removed, clustered, problem)
