"""A vector index: cells around centroids, stored by cell, scanned by probes.

Centroids are fitted on a bounded sample (SAMPLE_ROWS rows, SAMPLE_BYTES bytes); every vector is then
stored in the cell of its nearest centroid, with the columns that a search filters
by, and each cell knows how far its vectors lie from its centroid. A search ranks
the centroids, reads the nearest cells and ranks what they hold by exact cosine:

- by default it reads as many cells as hold a share of all rows (`effort`), and
  more while a filter leaves fewer than k;
- exact=True then goes on to every cell that could hold a better one, by the angle
  of its centroid and its width: the result is that of a full scan.

tune() measures the recall of some efforts against full scans, and stores the least
that reaches a target. Vectors without a direction (null, zero, not finite) are
in no cell; vectors of another length than the query's are never compared. Hot
cells are dealt to several files.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.score import cosine
from .retrieval import SIDE_K, SearchFilter, allowed, comparable, top
from .storage import checkpoint

MOST_CELLS, SAMPLE_ROWS, SAMPLE_BYTES, FIT_ROUNDS = 4096, 65536, 128 << 20, 8
EFFORTS = (0.02, 0.05, 0.1, 0.2, 0.4, 0.7, 1.0)
PLACED = 1 << 20  # similarities that a task holds at once
SLACK = 1e-6  # of angles, and half a unit of the rounded similarities


@dataclass(frozen=True)
class Cells:
    """rows: the vectors by cell; centroids (dims, cell, centroid, width, n), MOST_CELLS at most for each length; effort: the share of rows that a search reads."""

    rows: DataFrame
    centroids: DataFrame
    effort: float


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _fit(sample: np.ndarray, k: int, seed: int = 7) -> np.ndarray:
    """Spherical k-means on unit vectors; an empty cell starts again at the vector that fits worst."""
    rng = np.random.default_rng(seed)
    c = sample[rng.choice(len(sample), min(k, len(sample)), replace=False)]
    for _ in range(FIT_ROUNDS):
        best, near = np.full(len(sample), -2.0), np.zeros(len(sample), int)
        for i in range(0, len(sample), 4096):
            s = sample[i : i + 4096] @ c.T
            near[i : i + 4096], best[i : i + 4096] = s.argmax(1), s.max(1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, sample)
        norm = np.linalg.norm(sums, axis=1)
        worst = iter(best.argsort())
        c = np.stack([s / n if n > 1e-9 else sample[next(worst)] for s, n in zip(sums, norm, strict=True)])
    return c


def _placed(centroids: dict[int, np.ndarray]):
    """Batches with the cell of each vector and its angle to the centroid."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            dims, angles, cells = batch.column("dims").to_numpy(), np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int32)
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                x = _unit(batch.column("embedding").take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), d))
                step = max(1, PLACED // len(centroids[int(d)]))  # rows at once: a batch's similarities to all cells may be many
                for i in range(0, len(at), step):
                    s = x[i : i + step] @ centroids[int(d)].T
                    cells[at[i : i + step]] = s.argmax(1)
                    angles[at[i : i + step]] = np.arccos(np.clip(s.max(1), -1, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells), pa.array(angles)], names=[*batch.schema.names, "cell", "angle"])

    return run


def write_cells(vectors: DataFrame, folder: str, cells: int | None = None) -> None:
    """Store vectors (chunk_id, embedding and whatever a search filters by) by cell under folder; by default with about the root of their number of cells."""
    spark = vectors.sparkSession
    good = vectors.where(comparable(F.col("embedding"))).withColumn("dims", F.size("embedding"))
    centroids = {}
    for dims, n in sorted(map(tuple, good.groupBy("dims").count().collect())):  # a line for each length
        k = min(MOST_CELLS, cells or max(1, round(math.sqrt(n))))
        most = max(k, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * dims)))
        some = good.where(F.col("dims") == dims).orderBy(F.xxhash64("chunk_id")).limit(most).select("embedding")
        centroids[dims] = _fit(_unit(np.array([r[0] for r in some.collect()], np.float64)), k)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in good.schema.fields) + ", cell int, angle double"
    placed = good.mapInArrow(_placed(centroids), schema)
    dealt = placed.withColumn("shard", F.pmod(F.xxhash64("chunk_id"), F.lit(4))).repartition("dims", "cell", "shard").drop("shard")
    dealt.write.partitionBy("dims", "cell").parquet(f"{folder}/rows")
    width = spark.read.parquet(f"{folder}/rows").groupBy("dims", "cell").agg(F.max("angle").alias("width"), F.count("*").alias("n"))
    named = spark.createDataFrame([(int(d), i, [float(x) for x in v]) for d, c in centroids.items() for i, v in enumerate(c)], "dims int, cell int, centroid array<double>")
    named.join(width, ["dims", "cell"]).write.parquet(f"{folder}/centroids")
    set_effort(spark, folder, 0.1)


def set_effort(spark: SparkSession, folder: str, effort: float) -> None:
    spark.createDataFrame([(float(effort),)], "effort double").coalesce(1).write.mode("overwrite").json(f"{folder}/effort")


def open_cells(spark: SparkSession, folder: str) -> Cells:
    effort = spark.read.schema("effort double").json(f"{folder}/effort").first().effort
    return Cells(spark.read.parquet(f"{folder}/rows"), spark.read.parquet(f"{folder}/centroids"), effort)


def _order(index: Cells, query: np.ndarray) -> list[tuple[int, int, float]]:
    """(cell, rows, the best similarity that it can hold), the nearest centroid first."""
    rows = index.centroids.where(F.col("dims") == len(query)).collect()  # MOST_CELLS at most
    if not rows:
        return []
    angle = np.arccos(np.clip(np.array([r.centroid for r in rows]) @ query, -1, 1))
    bound = np.cos(np.maximum(0, angle - np.array([r.width for r in rows]) - SLACK))
    return [(rows[i].cell, rows[i].n, float(bound[i])) for i in np.lexsort(([r.cell for r in rows], angle))]


def _scan(index: Cells, query: np.ndarray, cells: Sequence[int], keep: Column, k: int) -> DataFrame:
    rows = index.rows.where((F.col("dims") == len(query)) & F.col("cell").isin([int(c) for c in cells]) & keep)
    near = F.round(cosine(F.col("embedding"), F.array(*[F.lit(float(x)) for x in query])), 6)
    return rows.select("chunk_id", near.alias("similarity")).orderBy(F.desc("similarity"), "chunk_id").limit(k)


def search(index: Cells, vector: Sequence[float], f: SearchFilter | Column | None = None, k: int = SIDE_K, effort: float | None = None, exact: bool = False) -> DataFrame:
    """chunk_id, similarity, rank of the k nearest to a vector among those that the filter allows."""
    spark = index.rows.sparkSession
    x = np.array(vector, np.float64)
    keep = allowed(f, True) if isinstance(f, SearchFilter) else F.lit(True) if f is None else f
    if not len(x) or not np.isfinite(x).all() or not x.any():
        return top(spark.createDataFrame([], "chunk_id long, similarity double"), k, F.desc("similarity"), F.asc("chunk_id"))
    x = _unit(x[None])[0]
    order, best, at = _order(index, x), [], 0
    budget = max(k, (index.effort if effort is None else effort) * sum(n for _, n, _ in order))
    while at < len(order):
        end, rows = at, 0
        while end < len(order) and rows < budget:
            rows, end = rows + order[end][1], end + 1
        best = _best(best, _scan(index, x, [c for c, _, _ in order[at:end]], keep, k), k)
        at = end
        if len(best) >= k:
            break
        budget *= 2
    if exact and at < len(order):
        least = best[-1][1] - SLACK if len(best) >= k else -2
        more = [c for c, _, bound in order[at:] if bound >= least]
        if more:
            best = _best(best, _scan(index, x, more, keep, k), k)
    kind = dict(index.rows.dtypes)["chunk_id"]
    return spark.createDataFrame([(*r, n) for n, r in enumerate(best, 1)], f"chunk_id {kind}, similarity double, rank int")


def _best(old: list[tuple], found: DataFrame, k: int) -> list[tuple]:
    return sorted([*old, *((r.chunk_id, r.similarity) for r in found.collect())], key=lambda r: (-r[1], r[0]))[:k]  # k rows


def recalls(index: Cells, queries: DataFrame, k: int, efforts: Sequence[float]) -> DataFrame:
    """effort, query_id, found, read: of the k nearest of each query (query_id, embedding), how many are in the cells that it reads, and the share of rows these hold, for every effort.

    All queries are compared with all rows once, in blocks on the executors: this is the measure, not the search."""
    from pyspark.sql import Window

    from .retrieval import knn

    rows = index.rows.select("chunk_id", "embedding", "dims", "cell")
    true = knn(queries.select("query_id", "embedding"), rows.select("chunk_id", "embedding"), k).select("query_id", "chunk_id")
    q = queries.where(comparable(F.col("embedding"))).select("query_id", "embedding", F.size("embedding").alias("dims"))
    pairs = q.join(F.broadcast(index.centroids.select("dims", "cell", "centroid", "n")), "dims").select("query_id", "cell", "n", cosine(F.col("embedding").cast("array<double>"), F.col("centroid")).alias("s"))
    w = Window.partitionBy("query_id").orderBy(F.desc("s"), "cell")
    before = F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("n").over(Window.partitionBy("query_id"))
    order = checkpoint(pairs.select("query_id", "cell", "n", before.alias("before"), total.alias("total")))  # read for the hits and for the shares
    is_read = lambda e: F.col("before") < F.greatest(F.lit(k), F.lit(float(e)) * F.col("total"))
    each = lambda value: F.array(*[value(e) for e in efforts])
    read = order.groupBy("query_id").agg(each(lambda e: F.sum(F.when(is_read(e), F.col("n"))) / F.max("total")).alias("read"))
    hit = true.join(rows.select("chunk_id", "cell"), "chunk_id").join(order, ["query_id", "cell"])
    found = hit.groupBy("query_id").agg(each(lambda e: F.avg(is_read(e).cast("int"))).alias("found"))
    named = each(lambda e: F.lit(float(e)))
    return found.join(read, "query_id").select("query_id", F.inline(F.arrays_zip(named.alias("effort"), "found", "read"))).select("effort", "query_id", "found", "read")


def recall(index: Cells, queries: DataFrame, k: int = 10, effort: float | None = None) -> DataFrame:
    """query_id, found, read: recalls() of one effort."""
    return recalls(index, queries, k, [index.effort if effort is None else effort]).drop("effort")


def mean_recalls(index: Cells, queries: DataFrame, k: int, efforts: Sequence[float]) -> DataFrame:
    """effort, queries, recall, read of every effort: how many queries there are, and the means of recalls()."""
    by = recalls(index, queries, k, efforts).groupBy("effort").agg(F.count("*").alias("queries"), F.avg("found").alias("recall"), F.avg("read").alias("read"))
    asked = queries.sparkSession.createDataFrame([(float(e),) for e in efforts], "effort double")
    return asked.join(by, "effort", "left").withColumn("queries", F.coalesce("queries", F.lit(0).cast("long")))


def tune(spark: SparkSession, folder: str, queries: DataFrame, target: float = 0.95, k: int = 10) -> list[tuple[float, float, float]]:
    """(effort, recall, share of rows read) of efforts, up to the first whose mean recall reaches the target, which is stored."""
    seen = []
    for r in sorted(mean_recalls(open_cells(spark, folder), queries, k, EFFORTS).collect()):  # a row for each effort
        seen.append((r.effort, r.recall, r.read))
        if r.recall is None or r.recall >= target:
            break
    set_effort(spark, folder, seen[-1][0])
    return seen
