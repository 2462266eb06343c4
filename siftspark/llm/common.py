"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A document is told apart by its id and by the hash of its text, so that
#: null and repeated ids need no special path.
KEY = ("doc_id", "_th")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset and no other was chosen, a folder of this machine, if all of Spark is on it; else an error."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not named and sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "siftspark-checkpoints"))
    return named or sc._jsc.sc().getCheckpointDir().get()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage: df written as Parquet in the shared folder, and read again. The files go with the session.

    A table carries no more than its rows. Dataset.checkpoint() keeps the plan's constraints,
    which multiply from round to round where one checkpoint is made of another."""
    spark = df.sparkSession
    where = f"{shared_folder(spark)}/checkpoint-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    df.write.parquet(where)
    return spark.read.schema(df.schema).parquet(where)


def keyed(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, the hash of the text, the text and the columns asked for."""
    return docs.select(F.col("doc_id"), F.coalesce(F.xxhash64("text"), F.lit(0)).alias("_th"), F.col("text"), *[F.col(f"`{c}`") for c in more])


def packed(docs: DataFrame, *skip: str) -> Column:
    """All columns but some as one struct, _row, in which their names clash with nothing."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in skip]).alias("_row")


def unpacked(docs: DataFrame, *skip: str) -> list[Column]:
    return [F.col(f"_row.`{c}`").alias(c) for c in docs.columns if c not in skip]


def text_hash() -> Column:
    return F.coalesce(F.xxhash64("text"), F.lit(0)).alias("_th")


def on_key(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """Join by document; the key of the right side goes."""
    right = right.withColumnsRenamed({"doc_id": "_r_id", "_th": "_r_th"})
    out = left.join(right, F.col("doc_id").eqNullSafe(F.col("_r_id")) & (F.col("_th") == F.col("_r_th")), how)
    return out.drop("_r_id", "_r_th")


def join_hot(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on integer keys of which few may hold most rows of the left side.

    An aggregate on the right would lend the join its partitioning, and then Spark
    can't split a hot key's partition. The complement of the keys is new to it,
    so both sides get an exchange of their own."""
    right = right.select(*[c for c in right.columns if c not in keys], *[F.bitwise_not(k).alias(f"_not_{k}") for k in keys])
    on = None
    for k in keys:
        same = F.bitwise_not(F.col(k)) == F.col(f"_not_{k}")
        on = same if on is None else on & same
    return left.join(right, on).drop(*[f"_not_{k}" for k in keys])


def released(run):
    """A function for mapInArrow that gives Arrow's freed memory back as it ends: idle workers stay and would hold it."""

    def wrapped(batches):
        import pyarrow as pa

        yield from run(batches)
        pa.default_memory_pool().release_unused()

    return wrapped


def crc_mod(n: int) -> Column:
    """crc32 of doc_id as text, modulo n: the folds of the classifiers."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % n


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b): one row (node, comp) for each node that has an edge to another.

    comp is the smallest node of the component. Each round every node takes the
    first, in a random order of that round, of its neighbours and itself as its
    parent, and then the parent's parent's; edges between parents are the next
    round's. What is left shrinks geometrically, whatever the diameter, and so
    the work is that of a few passes over the edges. Rounds are checkpointed.
    """
    left = checkpoint(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    maps: list[DataFrame] = []
    while not maps or not left.isEmpty():
        both = left.select("a", "b").union(left.select("b", "a"))
        place = lambda c, r=len(maps): F.struct(F.xxhash64(c, F.lit(r)).alias("h"), F.col(c).alias("n"))
        first = both.groupBy("a").agg(F.min(place("b")).alias("m"))
        parent = checkpoint(first.select(F.col("a").alias("node"), F.least(place("a"), F.col("m"))["n"].alias("parent")))
        up = parent.select(F.col("node").alias("parent"), F.col("parent").alias("next"))
        twice = parent.join(up, "parent").select("node", F.col("next").alias("parent"))
        parent = checkpoint(twice.join(up, "parent").select("node", F.col("next").alias("parent")))
        maps.append(parent)
        ends = left.join(parent.select(F.col("node").alias("a"), F.col("parent").alias("x")), "a").join(parent.select(F.col("node").alias("b"), F.col("parent").alias("y")), "b")
        left = checkpoint(ends.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    out = maps[-1]
    for m in reversed(maps[:-1]):
        out = m.join(out.select(F.col("node").alias("parent"), F.col("parent").alias("next")), "parent", "left").select("node", F.coalesce("next", "parent").alias("parent"))
    out = checkpoint(out)
    return out.join(out.groupBy("parent").agg(F.min("node").alias("comp")), "parent").select("node", "comp")
