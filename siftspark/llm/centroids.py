"""Centroid clustering of vectors in exact integers, with Hamerly's bounds.

Each vector keeps one upper bound on the distance to its centroid and one lower
bound on the distance to any other. After a round the upper bound grows by its
centroid's drift and the lower one falls by the largest drift of another. Where
they (or half the distance from its centroid to the next) leave a gap, the vector
stays where it is, unread; else its own distance is taken exactly, and where that
doesn't settle it, the distances to all centroids. Bounds are rounded outwards
and gaps are strict, so that ties always go to the scan.

Vectors are written once, in buckets by row, and the bounds of each round as a
table in the same buckets: a round reads both without a shuffle, and writes some
25 bytes a vector. What a round moves comes from vectors that changed centroid
only: each task adds its differences of sums, one line for each centroid that
they touch, and these are summed by Spark; the driver holds the centroids. The
tables are in the shared folder, so a lost executor costs its tasks alone. Equal
vectors and repeated ids are rows like any other; no key groups them.

Defined cases: only vectors with exactly `size` components count, none of them
null, NaN or infinite, or of a magnitude of 2 ** 19 and more (their squared
distances would not fit a long); the others give no row. Seeds tie only where ids
repeat; then the smaller vector, component by component, goes first. A null id is
hashed as nothing. With fewer vectors than centroids, there are as many centroids
as vectors. Repeated rows keep their number; an empty table gives no rows; other
columns are left out.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, released, shared_folder, table

SIZE, SCALE = 64, 256
#: Components in integers are smaller; 64 squares of differences then fit a long.
MOST = 1 << 27
#: Products of this many bits add up exactly in doubles, which is how BLAS can be used.
EXACT = 1 << 22
#: Vectors of a bucket, about: its bounds are one side of a join within a task.
BUCKET = 1 << 20
SCAN = 4096
UP, DOWN = 1 + 1e-12, 1 - 1e-12


def integers(vectors: DataFrame, size: int = SIZE) -> DataFrame:
    """(vec_id, v) of the vectors that count, v in integers."""
    good = f"size(embedding) = {size} AND forall(embedding, x -> x IS NOT NULL AND abs(double(x)) < {MOST // SCALE})"  # NaN is larger than any number
    return vectors.select(F.col("vec_id"), F.col("embedding")).where(F.expr(good)).select("vec_id", F.expr(f"transform(embedding, x -> int(floor({SCALE}D * double(x))))").alias("v"))


def seeds(vectors: DataFrame, k: int, salt: int) -> np.ndarray:
    """The k vectors whose hash of salt and id is smallest."""
    by = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return np.array([r.v for r in vectors.orderBy(by, "v").limit(k).select("v").collect()], np.int64)


def _squares(v: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to centroids: one to one, or (rows, centroids) where centroids is a stack of one."""
    gap = v - centroids
    return np.einsum("...i,...i->...", gap, gap)


def _scan(v: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows to all centroids."""
    if max(np.abs(v).max(initial=0), np.abs(centroids).max(initial=0)) < EXACT:
        product = (v.astype(np.float64) @ centroids.T.astype(np.float64)).astype(np.int64)
        return (v * v).sum(1)[:, None] - 2 * product + (centroids * centroids).sum(1)[None, :]
    return np.stack([_squares(v, c) for c in centroids], 1)


def assign(v: np.ndarray, centroids: np.ndarray, old: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Cluster, upper and lower bound of each row, and how many rows were scanned. old is -1 where a row has no cluster yet; bounds are those after the drift."""
    new, upper, lower = old.copy(), upper.copy(), lower.copy()
    between = np.sqrt(_scan(centroids, centroids).astype(np.float64))
    np.fill_diagonal(between, np.inf)
    half = between.min(1) / 2 * DOWN if len(centroids) else np.zeros(0)
    bar = np.where(old >= 0, np.maximum(lower, half[old]), -1.0)
    close = np.flatnonzero(~(upper < bar))
    known = close[old[close] >= 0]
    upper[known] = np.sqrt(_squares(v[known], centroids[old[known]]).astype(np.float64)) * UP
    close = close[~(upper[close] < bar[close])]
    for i in range(0, len(close), SCAN):
        rows = close[i : i + SCAN]
        d = _scan(v[rows], centroids)
        new[rows] = d.argmin(1)  # the first of equals
        upper[rows] = np.sqrt(d[np.arange(len(rows)), new[rows]].astype(np.float64)) * UP
        d[np.arange(len(rows)), new[rows]] = np.iinfo(np.int64).max
        lower[rows] = np.sqrt(d.min(1).astype(np.float64)) * DOWN if len(centroids) > 1 else np.inf
    return new, upper, lower, len(close)


def _loosened(old: np.ndarray, upper: np.ndarray, lower: np.ndarray, drift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds after each centroid has moved by drift."""
    first = int(drift.argmax())
    second = np.delete(drift, first).max(initial=0.0)
    return (upper + drift[old]) * UP, np.maximum(0.0, (lower - np.where(old == first, second, drift[first])) * DOWN)


def _matrix(column, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size).astype(np.int64)


BOUNDS = "r long, cluster int, upper double, lower double, sums boolean, at int, n long, added array<long>"


def _round(centroids: np.ndarray, drift: np.ndarray | None, size: int):
    """A round on batches of (r, v) or (r, v, cluster, upper, lower): the new bounds, and at the end the differences of sums, under the row of some vector of the task."""

    def run(batches):
        import pyarrow as pa

        def out(r, cluster, upper, lower, sums, at, n, added):
            return pa.RecordBatch.from_arrays([pa.array(r, pa.int64()), pa.array(cluster, pa.int32()), pa.array(upper, pa.float64()), pa.array(lower, pa.float64()), pa.array(sums, pa.bool_()), pa.array(at, pa.int32()), pa.array(n, pa.int64()), pa.array(added, pa.list_(pa.int64()))], names=["r", "cluster", "upper", "lower", "sums", "at", "n", "added"])

        added, n, some = np.zeros((len(centroids), size), np.int64), np.zeros(len(centroids), np.int64), None
        for batch in batches:
            if not batch.num_rows:
                continue
            r, v = batch.column("r").to_numpy(zero_copy_only=False), _matrix(batch.column("v"), size)
            if drift is None:
                old = np.full(len(r), -1)
                upper, lower = np.full(len(r), np.inf), np.zeros(len(r))
            else:
                old, upper, lower = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("cluster", "upper", "lower"))
                old = old.astype(np.int64)
                upper, lower = _loosened(old, upper, lower, drift)
            new, upper, lower, _ = assign(v, centroids, old, upper, lower)
            moved, some = np.flatnonzero(new != old), int(r[0])
            left = moved[old[moved] >= 0]
            for rows, to, sign in ((moved, new[moved], 1), (left, old[left], -1)):
                np.add.at(added, to, sign * v[rows])
                np.add.at(n, to, sign)
            none = pa.nulls(len(r))
            yield out(r, new, upper, lower, np.zeros(len(r), bool), none.cast(pa.int32()), none.cast(pa.int64()), none.cast(pa.list_(pa.int64())))
        touched = np.flatnonzero((n != 0) | added.any(1))
        if len(touched):
            yield out([some] * len(touched), [None] * len(touched), [None] * len(touched), [None] * len(touched), [True] * len(touched), touched, n[touched], added[touched].tolist())

    return released(run)


def _last(centroids: np.ndarray, drift: np.ndarray | None, size: int):
    """The assignment after the last round, with exact distances: (vec_id, cluster, distance)."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            v, n = _matrix(batch.column("v"), size), batch.num_rows
            old, upper, lower = np.full(n, -1), np.full(n, np.inf), np.zeros(n)
            if drift is not None:
                old, upper, lower = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("cluster", "upper", "lower"))
                old = old.astype(np.int64)
                upper, lower = _loosened(old, upper, lower, drift)
            new = assign(v, centroids, old, upper, lower)[0]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(new, pa.int32()), pa.array(_squares(v, centroids[new]), pa.int64())], names=["vec_id", "cluster", "distance"])

    return released(run)


class _Buckets:
    """Tables in the shared folder, in the same buckets by r; the catalogue knows them until they are dropped."""

    def __init__(self, spark, buckets: int):
        self.spark, self.buckets, self.names = spark, buckets, []
        self.folder = f"{shared_folder(spark)}/centroids-{uuid.uuid4().hex}"
        path = spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)

    def write(self, rows: DataFrame) -> DataFrame:
        name = f"centroids_{uuid.uuid4().hex}"
        rows.write.format("parquet").bucketBy(self.buckets, "r").option("path", f"{self.folder}/{len(self.names)}").saveAsTable(name)
        self.names.append(name)
        return self.spark.table(name)

    def forget(self) -> None:
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def _next(bounds: DataFrame, sums: np.ndarray, n: np.ndarray, size: int) -> None:
    """Add what a round moved to the sums and numbers of the clusters, exactly."""
    each = [F.sum(F.col("added")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(size)]
    for r in bounds.where("sums").groupBy("at").agg(F.sum("n").alias("n"), *each).collect():
        n[r.at] += r.n
        for i in range(size):
            sums[r.at, i] += int(r[f"s{i}"])


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, salt: int = 2, size: int = SIZE) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of every vector that counts, as a table in the shared folder, and the centroids."""
    spark = vectors.sparkSession
    kept = integers(vectors, size)
    centroids = seeds(kept, k, salt)
    if not len(centroids):
        return spark.createDataFrame([], f"vec_id {dict(vectors.dtypes)['vec_id']}, cluster int, distance long"), centroids
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), vectors.count() // BUCKET + 1)
    store = _Buckets(spark, buckets)
    try:
        rows = store.write(kept.withColumn("r", F.monotonically_increasing_id()).repartition(buckets, "r"))
        sums, n = np.zeros((len(centroids), size), object), np.zeros(len(centroids), object)
        joined, drift = rows, None
        for _ in range(rounds):
            bounds = store.write(joined.drop("vec_id").mapInArrow(_round(centroids, drift, size), BOUNDS))
            _next(bounds, sums, n, size)
            moved = np.array([[s // int(c) for s in line] if c else list(was) for line, c, was in zip(sums, n, centroids.tolist(), strict=True)], np.int64)
            drift = np.sqrt(_squares(moved, centroids).astype(np.float64)) * UP
            centroids = moved
            joined = rows.join(bounds.where("NOT sums").select("r", "cluster", "upper", "lower").hint("shuffle_hash"), "r")
        kind = dict(vectors.dtypes)["vec_id"]
        return checkpoint(joined.drop("r").mapInArrow(_last(centroids, drift, size), f"vec_id {kind}, cluster int, distance long")), centroids
    finally:
        store.forget()


def op11_centroid_clusters(spark, sf_dir: str) -> DataFrame:
    found, centroids = cluster(table(spark, sf_dir, "embeddings"))
    inertia = dict(found.groupBy("cluster").agg(F.sum("distance")).collect())  # a line for each of 40 clusters
    hashes = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    lines = spark.createDataFrame([(c, i, sum(inertia.values()), hashes[c]) for c, i in inertia.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(lines), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql(k: int = 40, rounds: int = 5, salt: int = 2) -> str:
    near = lambda i: f"""a{i} AS MATERIALIZED (SELECT r, any_value(vec_id) AS vec_id, any_value(v) AS v, arg_min(c, d::HUGEINT * {k} + c) AS c, min(d) AS d FROM (
  SELECT r, vec_id, e.v, c, list_sum(list_transform(range(1, {SIZE + 1}), lambda i: (e.v[i] - w.v[i]) * (e.v[i] - w.v[i])))::BIGINT AS d FROM e CROSS JOIN c{i} w) GROUP BY r)"""  # noqa: E731
    mean = lambda i: f"""c{i + 1} AS MATERIALIZED (SELECT w.c, coalesce(m.v, w.v) AS v FROM c{i} w LEFT JOIN (
  SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS v FROM (SELECT c, i, sum(v[i]) AS s, count(*) AS n FROM a{i} CROSS JOIN range(1, {SIZE + 1}) t(i) GROUP BY c, i) GROUP BY c) m ON w.c = m.c)"""  # noqa: E731
    steps = ",\n".join(f"{near(i)},\n{mean(i)}" for i in range(rounds))
    return f"""
WITH e AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM documents_vectors),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v FROM (SELECT sha256('{salt}:' || coalesce(vec_id::VARCHAR, '')) AS h, v FROM e ORDER BY h, v LIMIT {k})),
{steps},
{near(rounds)}
SELECT vec_id, a.c::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(w.v, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} w ON a.c = w.c
""".replace("documents_vectors", f"(SELECT * FROM embeddings WHERE len(embedding) = {SIZE} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x) OR abs(x) >= {MOST // SCALE})) = 0)")


SQL = _sql()
