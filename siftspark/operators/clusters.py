"""Similarity edges, clusters of items, siblings, novelty."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import manifest
from .retrieval import knn
from .storage import checkpoint


def partner_edges(items: DataFrame) -> DataFrame:
    """Items about one paper, of different kinds: a < b."""
    a = items.where("paper_key IS NOT NULL").select("paper_key", F.col("id").alias("a"), F.col("kind").alias("ka"))
    b = items.where("paper_key IS NOT NULL").select("paper_key", F.col("id").alias("b"), F.col("kind").alias("kb"))
    return a.join(b, "paper_key").where("a < b AND ka <> kb").select("a", "b")


def neighbour_edges(vectors: DataFrame, threshold: float, k: int = 5) -> DataFrame:
    """a, b, similarity: of the k nearest vectors within 14 days, those of at least the threshold; k comes first."""
    v = vectors.select(F.col("chunk_id"), "embedding", F.col("published_day").alias("day"))
    near = knn(v.select(F.col("chunk_id").alias("query_id"), "embedding", F.col("day").alias("qday")), v, k, keep="band", least=threshold)
    return near.select(F.col("query_id").alias("a"), F.col("chunk_id").alias("b"), "similarity")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, comp (smallest node reachable); nodes without edges are their own component.

    Every node points to a smaller one of its component, at first itself. In a round, what it points to is moved to the
    smallest that a neighbour's points to, and so is the node; then it skips one step. Trees are hooked whole and halved,
    so the rounds grow with the logarithm of the longest path. No side is sent to all executors by way of the driver, and
    nodes without edges take no part."""
    both = checkpoint(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    every = checkpoint(nodes.where("node IS NOT NULL").select("node").distinct().join(both.select(F.col("a").alias("node"), F.lit(True).alias("linked")).distinct().hint("merge"), "node", "left").select("node", "linked"))
    ahead = every.where("linked").select("node", F.col("node").alias("comp"), F.col("node").alias("far"))
    while True:
        near = both.join(ahead.select(F.col("node").alias("b"), "far").hint("merge"), "b").groupBy(F.col("a").alias("node")).agg(F.min("far").alias("near"))
        step = ahead.join(near.hint("merge"), "node", "left").select("node", "comp", F.least("comp", "far", F.coalesce("near", "far")).alias("low"))
        moves = step.select("node", "comp", "low").unionByName(step.where("low < comp").select(F.col("comp").alias("node"), F.lit(None).cast(dict(step.dtypes)["comp"]).alias("comp"), "low"))
        after = checkpoint(moves.groupBy("node").agg(F.max("comp").alias("comp"), F.min("low").alias("next")))
        labels = after.select("node", F.col("next").alias("comp"))
        if after.where("next <> comp").isEmpty():
            return labels.unionByName(every.where("linked IS NULL").select("node", F.col("node").alias("comp")))
        jump = labels.select(F.col("node").alias("comp"), F.col("comp").alias("far"))
        ahead = checkpoint(labels.join(jump.hint("merge"), "comp").select("node", "comp", "far"))


def cluster(items: DataFrame, edges: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """id, cluster_id: the smallest existing cluster among the members, else the smallest member; null for a single item.

    existing has id and cluster_id of items clustered before, whose clusters stay whole."""
    if existing is not None:
        kept = existing.where("cluster_id IS NOT NULL")
        anchor = kept.groupBy("cluster_id").agg(F.min("id").alias("b"))
        edges = edges.select("a", "b").unionByName(kept.join(anchor, "cluster_id").select(F.col("id").alias("a"), "b"))
    comp = components(items.select(F.col("id").alias("node")), edges)
    if existing is not None:
        comp = comp.join(existing.select(F.col("id").alias("node"), F.col("cluster_id").alias("old")), "node", "left")
    else:
        comp = comp.withColumn("old", F.lit(None).cast("long"))
    names = comp.groupBy("comp").agg(F.coalesce(F.min("old"), F.min("node")).alias("name"), F.count("*").alias("n"))
    return comp.join(names, "comp").select(F.col("node").alias("id"), F.when(F.col("n") > 1, F.col("name")).alias("cluster_id"))


PARTS = 32


def _part(c) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(PARTS)).cast("int")


@dataclass(frozen=True)
class Membership:
    """Who is in which cluster (id, cluster_id), twice: by_id in parts of the id, by_cluster in parts of the cluster, without single items."""

    by_id: DataFrame
    by_cluster: DataFrame


def open_membership(spark: SparkSession, folder: str, kind: str = "long") -> Membership:
    return Membership(*[spark.read.schema(f"id {kind}, cluster_id {kind}, part int").parquet(f"{folder}/{t}") for t in ("by_id", "by_cluster")])


def write_membership(clusters: DataFrame, folder: str, mode: str = "errorifexists") -> None:
    """Store id, cluster_id under folder; with mode 'overwrite' only the parts that clusters has rows of are replaced."""
    out = lambda rows, name: rows.repartition("part").write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(f"{folder}/{name}")
    out(clusters.select("id", "cluster_id", _part("id").alias("part")), "by_id")
    out(clusters.where("cluster_id IS NOT NULL").select("id", "cluster_id", _part("cluster_id").alias("part")), "by_cluster")


def _some(rows: DataFrame, wanted: DataFrame, by: str) -> DataFrame:
    """Of rows stored in parts of `by`, those with one of the wanted values; other parts aren't read."""
    parts = [r[0] for r in wanted.select(_part(by)).distinct().collect()]  # PARTS at most
    return rows.where(F.col("part").isin(parts)).join(wanted, by, "left_semi")


def update(known: Membership, new: DataFrame, edges: DataFrame) -> DataFrame:
    """id, cluster_id, part of the items whose cluster changes with new items (id) and their edges (a, b); the others are as they were.

    A cluster that an edge touches is one node; labels run over these nodes and the new items, which is the frontier
    of the batch. Clusters that come together take the smallest one's name, which is also a new item's; items that
    had none take the smallest id. Members are read of those clusters only whose name changes."""
    e = checkpoint(edges.select("a", "b").where("a <> b"))  # read from three sides
    ends = e.select(F.col("a").alias("id")).union(e.select(F.col("b").alias("id"))).union(new.select("id")).distinct()
    found = _some(known.by_id, ends, "id").select("id", "cluster_id")
    of = checkpoint(ends.join(found, "id", "left").withColumn("node", F.when(F.col("cluster_id").isNull(), F.concat(F.lit("item "), F.col("id").cast("string"))).otherwise(F.concat(F.lit("cluster "), F.col("cluster_id").cast("string")))))
    node = lambda c: of.select(F.col("id").alias(c), F.col("node").alias(f"n{c}"))
    between = e.join(node("a"), "a").join(node("b"), "b").select(F.col("na").alias("a"), F.col("nb").alias("b"))
    comp = components(of.select("node").distinct(), between)
    labelled = of.join(comp, "node")
    names = labelled.groupBy("comp").agg(F.coalesce(F.min("cluster_id"), F.min("id")).alias("name"), F.count_distinct("node").alias("n"))
    after = checkpoint(labelled.join(names, "comp").select("id", "cluster_id", F.when(F.col("n") > 1, F.col("name")).otherwise(F.col("cluster_id")).alias("name")))
    renamed = after.where("cluster_id <> name").select("cluster_id", "name").distinct()
    members = _some(known.by_cluster, renamed.select("cluster_id"), "cluster_id").join(renamed, "cluster_id").select("id", F.col("name").alias("cluster_id"))
    alone = after.join(found.select("id"), "id", "left_anti").where("name IS NULL").select("id", F.lit(None).cast(dict(members.dtypes)["cluster_id"]).alias("cluster_id"))
    joined = after.where("cluster_id IS NULL AND name IS NOT NULL").select("id", F.col("name").alias("cluster_id"))
    return members.unionByName(joined).unionByName(alone)


def store_update(spark: SparkSession, folder: str, changes: DataFrame) -> None:
    """The stored membership after changes (id, cluster_id): only the parts of the ids, and of the clusters that gain or lose members, are read and written."""
    known, changes = open_membership(spark, folder), checkpoint(changes)
    before = checkpoint(_some(known.by_id, changes.select("id"), "id").select("id", "cluster_id"))
    touched = [r[0] for r in changes.select(_part("id")).distinct().collect()]
    ids = known.by_id.where(F.col("part").isin(touched)).select("id", "cluster_id").join(changes.select("id"), "id", "left_anti").unionByName(changes)
    moved = before.unionByName(changes).where("cluster_id IS NOT NULL").select(_part("cluster_id").alias("part")).distinct()
    parts = [r[0] for r in moved.collect()]
    named = known.by_cluster.where(F.col("part").isin(parts)).select("id", "cluster_id").join(changes.select("id"), "id", "left_anti").unionByName(changes.where("cluster_id IS NOT NULL"))
    for rows, name, by, all_parts in ((ids, "by_id", "id", touched), (named, "by_cluster", "cluster_id", parts)):
        kept = checkpoint(rows.withColumn("part", _part(by)))
        # A part that has lost all its rows is removed; an overwrite leaves it as it is.
        for empty in set(all_parts) - {r[0] for r in kept.select("part").distinct().collect()}:
            manifest.remove(spark, f"{folder}/{name}/part={empty}")
        kept.repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(f"{folder}/{name}")


def siblings(clusters: DataFrame) -> DataFrame:
    """id, sibling: the other items of an item's cluster."""
    c = clusters.where("cluster_id IS NOT NULL")
    return c.join(c.select(F.col("id").alias("sibling"), "cluster_id"), "cluster_id").where("id <> sibling").select("id", "sibling")


def ordered_siblings(clusters: DataFrame, items: DataFrame) -> DataFrame:
    """id, sibling, n: each item's siblings in the order they are shown, the newest first, then the largest id."""
    from pyspark.sql import Window

    seen = items.select(F.col("id").alias("sibling"), "first_seen")
    w = Window.partitionBy("id").orderBy(F.desc("first_seen"), F.desc("sibling"))
    return siblings(clusters).join(seen, "sibling").select("id", "sibling", F.row_number().over(w).alias("n"))


def groups(clusters: DataFrame) -> DataFrame:
    """id, group: an item's cluster, or a group of its own."""
    return clusters.select("id", F.coalesce("cluster_id", -1 - F.col("id")).alias("group"))


def novelty(vectors: DataFrame, today, window: int = 60) -> DataFrame:
    """id, nov: one less the largest cosine to a vector read in the window, itself excepted; no row if there is none."""
    archive = vectors.where("collection = 'archive'")
    read = archive.where((F.col("read_day") >= F.date_sub(today, window)) & (F.col("read_day") <= today))
    near = knn(archive.select(F.col("chunk_id").alias("query_id"), "embedding"), read, 1, keep="other")
    return near.groupBy(F.col("query_id").alias("id")).agg(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - F.max("similarity"))).alias("nov"))
