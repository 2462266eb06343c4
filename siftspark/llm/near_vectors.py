"""Near-duplicate vectors on a robust-pruned flat graph.

0. Equal vectors are one class, told apart by 128 bits of hash: the smallest vec_id
   stands for it and counts as often as the class has members. Vectors of each
   length are worked on by themselves.
1. TABLES sets of centroids, one for about SHARD vectors (CENTROID_BYTES at most),
   are fitted by spherical k-means on a sample of at most SAMPLE_EACH vectors for
   each (SAMPLE_BYTES at most), chosen by hash. Every vector goes to the shards of
   its two nearest centroids of each set; near vectors that share no shard of one
   set mostly share one of another.
2. In each shard a graph is built: of the nearest CANDIDATES, robust pruning
   keeps DEGREE neighbours that no other kept one is closer to (by ALPHA); edges
   count both ways, and a few random ones are added.
3. A vector's adjacency lists from its shards are united.
4. In each shard, all its vectors are searched for in the united graph: greedily
   with a beam, from the shard's medoids and the vector's own node, and then,
   range-expanding, through every node within the threshold less SLACK. Each
   shard returns a spanning forest of the pairs within that, in single precision.
5. The components of all shards' forests are families: what range expansion over
   the united lists reaches, over any number of shards, as every vector is in
   several and each shard's forest goes on where another's ends. A family is cut
   into blocks; for each
   pair of blocks all cosines are taken in double precision, the links counted,
   and a spanning forest of the links returned. So all links within a family
   count, whether or not their ends share a shard, and no pair is written.

audit() measures recall by brute force, for all vectors whose id is divisible by
20, in blocks against all rows.

Defined cases: vectors that are null, empty, zero or hold null or non-finite
components link with nothing, vectors of different lengths not with each other,
and vectors with a null id with nothing: they have no component and are kept; of rows that
repeat an id the vector with the smallest hash counts, and they give one row;
other columns (labels too) aren't read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, components, join_hot, table

SHARD, SAMPLE_EACH, TABLES = 500, 8, 2
SAMPLE_BYTES, CENTROID_BYTES = 128 << 20, 32 << 20
CANDIDATES, DEGREE, RANDOM, ALPHA = 48, 16, 2, 1.2
MEDOIDS, BEAM, SLACK, PAIRS = 8, 12, 0.05, 100_000
BLOCK, STEP, ROWS = 128, 256, 50_000


def _valid(rows: DataFrame) -> DataFrame:
    """vec_id, v (array of doubles) of the vectors that can link."""
    v = F.col("embedding").cast("array<double>")
    fine = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return rows.where(fine).groupBy("vec_id").agg(F.min_by(v, F.xxhash64("embedding")).alias("v"))


def _matrix(column) -> np.ndarray:
    """Rows of unit length, from a column of arrays."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))
    x = x / np.maximum(np.abs(x).max(1, keepdims=True), 1e-300)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def centroids(x: np.ndarray, k: int, rounds: int = 6, seed: int = 11) -> np.ndarray:
    """Spherical k-means."""
    r = np.random.default_rng(seed)
    c = x[r.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        own = np.concatenate([(x[a : a + 4096] @ c.T).argmax(1) for a in range(0, len(x), 4096)])
        order = np.argsort(own, kind="stable")
        ids, first = np.unique(own[order], return_index=True)
        total = np.add.reduceat(x[order], first, axis=0)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        c[ids] = np.where(norm > 1e-12, total / np.maximum(norm, 1e-12), c[ids])
    return c


def _assign(tables: list[np.ndarray]):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("v"))
            near, before = [], 0
            for c in tables:
                out = []
                step = max(1, (4 << 20) // len(c))
                for a in range(0, len(x), step):
                    s = x[a : a + step].astype(np.float32) @ c.T
                    home = s.argmax(1)
                    s[np.arange(len(s)), home] = -2
                    out.append(np.stack([home, s.argmax(1) if len(c) > 1 else home], 1))
                near.append(np.concatenate(out) + before)
                before += len(c)
            near = np.concatenate(near, 1)
            ends = np.arange(len(x) + 1, dtype=np.int32) * near.shape[1]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array([r.tobytes() for r in x.astype(np.float32)], pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(near.ravel()))], names=["vec_id", "x", "shards"])

    return run


def _prune(x: np.ndarray, seed: int) -> np.ndarray:
    """Neighbours of each row, -1 where there are fewer."""
    n = len(x)
    k = min(CANDIDATES, n - 1)
    if k < 1:
        return np.full((n, 1), -1)
    kept = np.full((n, DEGREE), -1)
    for a in range(0, n, 512):
        s = x[a : a + 512] @ x.T
        rows = np.arange(len(s))
        s[rows, rows + a] = -2
        cand = np.argpartition(-s, k - 1, axis=1)[:, :k]
        own = np.take_along_axis(s, cand, 1)
        order = np.argsort(-own, axis=1, kind="stable")
        cand, own = np.take_along_axis(cand, order, 1), np.take_along_axis(own, order, 1)
        between = np.einsum("ncd,ned->nce", x[cand], x[cand])
        far, apart = np.sqrt(np.maximum(2 - 2 * own, 0)), np.sqrt(np.maximum(2 - 2 * between, 0))
        alive = np.ones(cand.shape, bool)
        for d in range(DEGREE):
            pick = alive.argmax(1)
            some = alive[rows, pick]
            kept[a + rows[some], d] = cand[rows[some], pick[some]]
            alive &= ~((ALPHA * apart[rows, pick] <= far) & some[:, None])
            alive[rows, pick] = False
    r = np.random.default_rng(seed)
    return np.concatenate([kept, r.integers(0, n, (n, RANDOM))], 1)


def _units(batches, keys, solve):
    """Runs solve on the rows of each key; batches come sorted by the keys."""
    held, now = [], None
    for batch in batches:
        cols = np.stack([batch.column(k).to_numpy() for k in keys], 1)
        cuts = [0, *(np.flatnonzero((cols[1:] != cols[:-1]).any(1)) + 1).tolist(), len(cols)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a == b:
                continue
            key = tuple(cols[a].tolist())
            if key != now and held:
                yield from solve(now, pa.Table.from_batches(held))
                held = []
            now = key
            held.append(batch.slice(a, b - a))
    if held:
        yield from solve(now, pa.Table.from_batches(held))


def _vectors(t) -> np.ndarray:
    return np.frombuffer(b"".join(t.column("x").to_pylist()), np.float32).reshape(t.num_rows, -1)


def _build(batches):
    def solve(key, t):
        ids, near = t.column("vec_id").to_numpy(), _prune(_vectors(t), key[0])
        u, v = np.repeat(np.arange(len(ids)), near.shape[1]), near.ravel()
        u, v = u[v >= 0], v[v >= 0]
        both = np.unique(np.concatenate([np.stack([u, v], 1), np.stack([v, u], 1)]), axis=0)
        both = both[both[:, 0] != both[:, 1]]
        ends = np.concatenate([[0], np.cumsum(np.bincount(both[:, 0], minlength=len(ids)))]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.ListArray.from_arrays(pa.array(ends), pa.array(ids[both[:, 1]]))], names=["vec_id", "near"])

    yield from _units(batches, ["shard"], solve)


def _search(threshold: float):
    def solve(key, t):
        ids, x = t.column("vec_id").to_numpy(), _vectors(t)
        n = len(ids)
        order = np.argsort(ids)
        near = t.column("near").combine_chunks()
        owner = np.repeat(np.arange(n), np.diff(near.offsets.to_numpy()))
        flat = near.flatten().to_numpy(zero_copy_only=False)
        at = np.minimum(np.searchsorted(ids[order], flat), n - 1)
        here = ids[order][at] == flat
        owner, to = owner[here], order[at[here]]
        degree = np.bincount(owner, minlength=n)
        first = np.cumsum(degree) - degree
        starts = [int((x @ x.mean(0)).argmax())]  # medoid of the shard, then of its far corners
        most = x @ x[starts[0]]
        while len(starts) < min(MEDOIDS, n):
            starts.append(int(most.argmin()))
            most = np.maximum(most, x @ x[starts[-1]])
        wide = []
        step = max(1, min(n, 2_000_000 // max(n, 1) + 1))
        for a in range(0, n, step):
            queries = np.arange(a, min(a + step, n))
            wide.append(_forest(n, *_range_search(x, queries, starts, to, first, degree, threshold)))
        final = _forest(n, *(np.concatenate(z) for z in zip(*wide, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(ids[final[0]]), pa.array(ids[final[1]])], names=["a", "b"])

    return lambda batches: _units(batches, ["shard"], solve)


def _count(threshold: float):
    """Links of each vector within its family, copies counted, and a spanning forest of them."""

    def solve(key, t):
        ids, x, own, copies = t.column("vec_id").to_numpy(), _matrix(t.column("v")), t.column("own").to_numpy(), t.column("copies").to_numpy()
        n, (_, i, j) = len(ids), key
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        counts, links = np.zeros(n, np.int64), [(np.zeros(0, np.int64),) * 2]
        for a in range(0, len(left), STEP):
            part = left[a : a + STEP]
            link = x[part] @ x[right].T >= threshold
            if i == j:
                link[np.arange(len(part)), np.arange(a, a + len(part))] = False
            else:
                counts[right] += copies[part] @ link
            counts[part] += link @ copies[right]
            u, v = np.nonzero(link)
            links.append(_forest(n, part[u], right[v]))
        u, v = _forest(n, *(np.concatenate(z) for z in zip(*links, strict=True)))
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([ids[some], ids[u]])), pa.array(np.concatenate([counts[some], np.zeros(len(u), np.int64)])), pa.array(np.concatenate([ids[some], ids[v]]))], names=["vec_id", "n_links", "other"])

    def run(batches):
        held, rows = [], 0
        for out in _units(batches, ["family", "i", "j"], solve):
            held.append(out)
            rows += out.num_rows
            if rows > ROWS:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, rows = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return run


def _forest(n: int, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each node to the smallest of its component."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[u], label[v])
        after = label.copy()
        np.minimum.at(after, u, low)
        np.minimum.at(after, v, low)
        after = after[after]
        if (after == label).all():
            break
        label = after
    moved = np.flatnonzero(label != np.arange(n))
    return moved, label[moved]


def _range_search(x, queries, starts, to, first, degree, threshold):
    """Pairs (query, neighbour) of at least the threshold less SLACK, found from the starts and each query's own node."""
    n, m = len(x), len(queries)
    seen = np.zeros((m, n), bool)
    seen[np.arange(m), queries] = True

    def sims(q, v):
        return np.concatenate([np.einsum("ij,ij->i", x[queries[q[a : a + PAIRS]]], x[v[a : a + PAIRS]]) for a in range(0, len(q), PAIRS)]) if len(q) else np.zeros(0)

    def spread(q, v):
        """The unseen neighbours of nodes v, for queries q; now seen."""
        c = degree[v]
        rq = np.repeat(q, c)
        rv = to[np.repeat(first[v] - (np.cumsum(c) - c), c) + np.arange(c.sum())]
        fresh = ~seen[rq, rv]
        key = np.unique(rq[fresh].astype(np.int64) * n + rv[fresh])
        rq, rv = key // n, key % n
        seen[rq, rv] = True
        return rq, rv

    # greedy: a beam of the best nodes of each query, and which of them have been expanded
    beam, score, done = np.tile(np.append(starts, 0), (m, 1)), np.full((m, len(starts) + 1), -2.0), np.zeros((m, len(starts) + 1), bool)
    beam[:, -1] = queries
    score[:, :-1] = x[queries] @ x[starts].T
    score[:, -1] = 1.0
    seen[:, starts] = True
    found_q, found_v, found_s = [np.repeat(np.arange(m), len(starts))], [np.tile(starts, m)], [score[:, :-1].ravel()]
    for _ in range(4 * BEAM):
        open_score = np.where(done, -3, score)
        pick = open_score.argmax(1)
        live = np.flatnonzero(open_score[np.arange(m), pick] > -2)
        if not len(live):
            break
        done[live, pick[live]] = True
        q, v = spread(live, beam[live, pick[live]])
        s = sims(q, v)
        found_q.append(q)
        found_v.append(v)
        found_s.append(s)
        c = np.bincount(q, minlength=m)
        col = np.arange(len(q)) - np.repeat(np.cumsum(c) - c, c)
        width = int(c.max(initial=0))
        more_b, more_s = np.zeros((m, width), np.int64), np.full((m, width), -2.0)
        more_b[q, col], more_s[q, col] = v, s
        beam, score, done = np.concatenate([beam, more_b], 1), np.concatenate([score, more_s], 1), np.concatenate([done, more_s <= -2], 1)
        if beam.shape[1] > BEAM:
            top = np.argpartition(-score, BEAM - 1, axis=1)[:, :BEAM]
            beam, score, done = (np.take_along_axis(z, top, 1) for z in (beam, score, done))
    q, v, s = np.concatenate(found_q), np.concatenate(found_v), np.concatenate(found_s)
    out_q, out_v = [], []
    while len(q):  # range-expanding
        wide = s >= threshold - SLACK
        out_q.append(queries[q[wide]])
        out_v.append(v[wide])
        q, v = spread(q[wide], v[wide])
        s = sims(q, v)
    return (np.concatenate(out_q), np.concatenate(out_v)) if out_q else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _fitted(good: DataFrame, n: int, dims: int) -> list[np.ndarray]:
    """Sets of centroids for n vectors, fitted on a bounded sample."""
    k = max(1, min(CENTROID_BYTES // (4 * dims), -(-n // SHARD)))
    draw = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30))
    want = max(2, min(k * SAMPLE_EACH, SAMPLE_BYTES // (8 * dims)))
    chosen = good.where(draw < int(min(1.0, 1.3 * want / max(n, 1)) * (1 << 30))).orderBy(draw, "vec_id").limit(want)
    seed = _matrix(chosen.select("v").toArrow().column("v")).astype(np.float32)
    k = min(k, len(seed))
    return [centroids(seed, k, seed=11 + t) for t in range(TABLES if k > 1 else 1)] if k else []


def _linked(good: DataFrame, n: int, dims: int, threshold: float) -> DataFrame | None:
    """vec_id, n_links, other: rows with vec_id = other count links in one pair of blocks, the others connect what links connect."""
    tables = _fitted(good, n, dims)
    if not tables:
        return None
    placed = checkpoint(good.mapInArrow(_assign(tables), "vec_id long, x binary, shards array<long>"))
    shard = F.explode(F.array_distinct("shards")).alias("shard")
    parts = placed.select("vec_id", "x", shard).repartition("shard").sortWithinPartitions("shard")
    lists = parts.mapInArrow(_build, "vec_id long, near array<long>")
    united = lists.groupBy("vec_id").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
    ready = placed.join(united, "vec_id").select("vec_id", "x", "near", shard).repartition("shard").sortWithinPartitions("shard")
    family = components(ready.mapInArrow(_search(threshold), "a long, b long")).select(F.col("node").alias("vec_id"), F.col("comp").alias("family"))
    sizes = family.groupBy("family").agg(F.count("*").alias("members"))
    block = f"greatest({BLOCK}, least(4096, members div 12))"
    family = join_hot(family, sizes, ["family"]).withColumn("blocks", F.expr(f"int(ceil(members / {block}))"))
    dealt = good.join(family, "vec_id").withColumn("own", F.expr("pmod(xxhash64(vec_id), blocks)")).withColumn("to", F.explode(F.expr("sequence(0L, blocks - 1L)")))
    dealt = dealt.select("family", F.least("own", "to").alias("i"), F.greatest("own", "to").alias("j"), "own", "vec_id", "v", "copies")
    unit = ["family", "i", "j"]
    return checkpoint(dealt.repartition(*unit).sortWithinPartitions(*unit).mapInArrow(_count(threshold), "vec_id long, n_links long, other long"))


def near_vectors(rows: DataFrame, threshold: float = 0.95) -> DataFrame:
    """vec_id, n_links, component_id, kept of rows (vec_id, embedding)."""
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    good = checkpoint(_valid(rows).withColumn("h1", F.xxhash64("v")).withColumn("h2", F.xxhash64(F.lit(7), "v")))
    classes = checkpoint(good.groupBy("h1", "h2").agg(F.min("vec_id").alias("vec_id"), F.min_by("v", "vec_id").alias("v"), F.count("*").alias("copies")))
    found = rows.sparkSession.createDataFrame([], "vec_id long, n_links long, other long")
    for r in classes.groupBy(F.size("v").alias("dims")).count().where("count > 1").orderBy("dims").collect():
        some = _linked(classes.where(F.size("v") == r["dims"]).select("vec_id", "v", "copies"), r["count"], r["dims"], threshold)
        found = found if some is None else found.unionByName(some)
    comp = components(found.where("vec_id <> other").select(F.col("vec_id").alias("a"), F.col("other").alias("b"))).withColumnsRenamed({"node": "of", "comp": "comp"})
    counts = found.where("vec_id = other").groupBy(F.col("vec_id").alias("of")).agg(F.sum("n_links").alias("n"))
    told = classes.select("h1", "h2", F.col("vec_id").alias("of"), "copies").join(counts, "of", "left").join(comp, "of", "left")
    told = told.select("h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("comp", "of").alias("comp"))
    members = join_hot(good.select(F.col("vec_id").alias("member"), "h1", "h2"), told, ["h1", "h2"])
    out = rows.select("vec_id").distinct().join(members, F.col("vec_id") == F.col("member"), "left")
    component = F.coalesce("comp", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def audit(rows: DataFrame, result: DataFrame, threshold: float = 0.95, every: int = 20, block: int = 2000) -> float:
    """Share of the true links of the queries (all ids divisible by `every`, block after block) that the counts of result hold."""
    good = checkpoint(_valid(rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")))
    held, true, last = 0, 0, None
    while True:
        wanted = good.where(F.col("vec_id") % every == 0)
        queries = (wanted if last is None else wanted.where(F.col("vec_id") > last)).orderBy("vec_id").limit(block).collect()
        if not queries:
            return held / true if true else 1.0
        last = queries[-1]["vec_id"]
        for dims in {len(r["v"]) for r in queries}:
            some = [r for r in queries if len(r["v"]) == dims]
            ids = np.array([r["vec_id"] for r in some])
            q = np.array([r["v"] for r in some], np.float64)
            q /= np.linalg.norm(q, axis=1, keepdims=True)

            def run(batches, q=q, ids=ids):
                for batch in batches:
                    if batch.num_rows:
                        hits = (_matrix(batch.column("v")) @ q.T >= threshold) & (batch.column("vec_id").to_numpy()[:, None] != ids[None, :])
                        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(hits.sum(0))], names=["vec_id", "true_links"])

            counted = good.where(F.size("v") == dims).mapInArrow(run, "vec_id long, true_links long").groupBy("vec_id").agg(F.sum("true_links").alias("true_links"))
            got = counted.join(result, "vec_id").agg(F.sum("true_links").alias("t"), F.sum(F.least("true_links", "n_links")).alias("f")).first()
            held, true = held + (got["f"] or 0), true + (got["t"] or 0)


def op1_near_vectors(spark, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
