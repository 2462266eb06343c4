"""Merkle manifest of a dataset: every row a leaf, a tree for each group, a tree over the groups' roots.

The tree is worked off in Pregel-style supersteps on RDDs. A vertex is a subtree
of up to FAN ** HEIGHT consecutive nodes: it hashes its own levels as soon as it
has all of its nodes, and sends one message, its top, to the vertex above. The
next superstep runs on the tops, until each tree has one; then the groups' roots
are the nodes of one more tree. In the reverse supersteps a vertex that knows the
path from its top to the root sends each of its nodes the siblings on its way up,
so that a path travels once for a subtree and not once for a leaf. At the leaves
the paths are hashed, and folded once more from the digests that are claimed.

Digests and order come from DataFrames: the text is read once, for both digests
of a row, and what moves on is some 100 bytes a row. Positions come from range
partitions and their sizes, so that one group may hold any share of the rows:
the driver gets one line for each partition and no more. Leaves, packed runs and
tops are tables in the shared folder; a lost executor costs the shuffle files
that are made again from them.

Defined cases: groups and order columns ascend, null first; rows that tie in both
ascend by digest (equal rows are told apart by their place in the table, which
changes nothing); null fields count as `-`, empty ones as `0:`; a lone leaf is its
group's root, and a lone group's root the dataset's; a leaf without siblings has
the digest of nothing as its proof; an empty table gives no rows; other columns
are left out. A null doc_id is not tampered with in op13.
"""

from __future__ import annotations

from hashlib import sha256

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpoint, table

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FAN, HEIGHT = 3, 7
UNIT = FAN**HEIGHT
TOP = -1  # the tree over the groups' roots


def digest(fields: dict[str, Column]) -> Column:
    """The 32 bytes of the hash of fields: `-` for null, else UTF-8 length, `:` and value, all joined."""
    texts = [c.cast("string") for c in fields.values()]
    return F.unhex(F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256))


def _steps(unit: int, count: int) -> int:
    """Levels that a vertex hashes: all, unless it is its tree's only one and has fewer nodes."""
    if unit or count == UNIT:
        return HEIGHT
    steps = 0
    while FAN**steps < count:
        steps += 1
    return steps


def _hash(nodes: list[str]) -> str:
    return sha256("".join(nodes).encode()).hexdigest()


def _climb(unit: int, nodes: list[str]) -> list[list[str]]:
    """All levels of a vertex, its nodes first and its top last."""
    levels = [nodes]
    for _ in range(_steps(unit, len(nodes))):
        nodes = [_hash(nodes[i : i + FAN]) for i in range(0, len(nodes), FAN)]
        levels.append(nodes)
    return levels


def _others(nodes: list[str], i: int) -> tuple[int, list[str]]:
    """Place of node i in its run, and the run's other nodes."""
    at = i % FAN
    run = nodes[i - at : i - at + FAN]
    return at, run[:at] + run[at + 1 :]


def _fold(node: str, path: list[tuple[int, list[str]]]) -> str:
    for at, others in path:
        node = _hash([*others[:at], node, *others[at:]])
    return node


def _gathered(parts) -> tuple[list, ...]:
    """Messages (offset, list, list, ...) of one vertex, put in order and joined."""
    parts = sorted(parts, key=lambda m: m[0])
    return tuple([x for m in parts for x in m[k]] for k in range(1, len(parts[0])))


def _cut(tree: int, pos: int, columns: tuple):
    """Messages to the vertices over which nodes from pos on are spread."""
    n, i = len(columns[0]), 0
    while i < n:
        unit, offset = divmod(pos + i, UNIT)
        j = min(n, i + UNIT - offset)
        yield (tree, unit), (offset, *[c[i:j] for c in columns])
        i = j


def _supersteps(messages, partitions: int, spark, column: int):
    """Upward supersteps: the vertices of each, and the trees' roots (tree, digest). column: which part of a message has the digests."""
    vertices, roots = [], None
    while True:
        vertices.append(messages.groupByKey(partitions))

        def top(vertex, c=column):
            (tree, unit), parts = vertex
            nodes = _gathered(parts)[c]
            return tree, unit, _climb(unit, nodes)[-1][0], unit == 0 and len(nodes) < UNIT

        tops = checkpoint(spark.createDataFrame(vertices[-1].map(top), "tree long, unit long, digest string, done boolean", verifySchema=False))
        done = tops.where("done").select("tree", "digest")
        roots = done if roots is None else roots.unionByName(done)
        rest = tops.where("NOT done")
        if rest.isEmpty():
            return vertices, roots
        messages = rest.rdd.flatMap(lambda r: _cut(r.tree, r.unit, ([r.digest],)))
        partitions, column = max(1, partitions // 64), 0


def _paths(vertex):
    """Downward: to each node of a vertex, the siblings on its way to the root, its group's root and the root."""
    (tree, unit), (nodes, (subroot, root, above)) = vertex
    levels = _climb(unit, nodes)
    ways = [above]
    for level in reversed(levels[:-1]):
        ways = [[_others(level, i), *ways[i // FAN]] for i in range(len(level))]
    for i, way in enumerate(ways):
        yield unit * UNIT + i, nodes[i], subroot, root, way


def _met(vertices, told, column=None):
    """Vertices together with what they are told; word from their own tree goes before word from the groups' tree."""

    def both(value):
        parts, words = value
        columns = _gathered([m for group in parts for m in group])
        return (columns[column] if column is not None else columns), max(words)[1]

    partitions = vertices.getNumPartitions()
    return vertices.cogroup(told.partitionBy(partitions), partitions).filter(lambda v: v[1][0]).mapValues(both)


def _pack(batches):
    """Rows in order to runs of up to UNIT of one group, k counting the groups of partition p, and at a group's rows in it."""
    import pyarrow as pa
    from pyspark import TaskContext

    schema = None
    p, k, at, group = TaskContext.get().partitionId(), -1, 0, None
    for batch in batches:
        if schema is None:
            schema = pa.schema([("p", pa.int64()), ("k", pa.int64()), ("at", pa.int64()), ("n", pa.int64()), ("group", batch.schema.field("group").type), ("ids", pa.list_(batch.schema.field("id").type)), ("leaves", pa.binary()), ("claims", pa.binary())])
        groups, ids, leaves, claims = (batch.column(c) for c in ("group", "id", "leaf", "claim"))
        names, i, runs = groups.to_pylist(), 0, []
        while i < len(names):
            j = i + 1
            while j < len(names) and j - i < UNIT and names[j] == names[i]:
                j += 1
            if k < 0 or names[i] != group:
                k, at, group = k + 1, 0, names[i]
            cut = lambda c, i=i, j=j: b"".join(c.slice(i, j - i).to_pylist())
            runs.append({"p": p, "k": k, "at": at, "n": j - i, "group": group, "ids": ids.slice(i, j - i).to_pylist(), "leaves": cut(leaves), "claims": cut(claims)})
            at, i = at + j - i, j
        if runs:
            yield pa.RecordBatch.from_pylist(runs, schema=schema)


def _bases(runs: DataFrame) -> tuple[dict[int, tuple[int, int]], int]:
    """For each partition, the number of its first group and how many of that group's rows lie before; and the number of groups."""
    sizes = runs.groupBy("p", "k").agg(F.sum("n").alias("n"), F.first("group").alias("group"))
    ends = sizes.groupBy("p").agg(F.max("k").alias("k"), F.min_by(F.struct("group", "n"), "k").alias("first"), F.max_by(F.struct("group", "n"), "k").alias("last"))
    bases, last, run, groups = {}, None, 0, 0
    for r in ends.orderBy("p").collect():
        goes_on = bool(groups) and r.first.group == last
        bases[r.p] = (groups - 1, run) if goes_on else (groups, 0)
        run = r.last.n + (run if goes_on and r.k == 0 else 0)
        groups, last = bases[r.p][0] + r.k + 1, r.last.group
    return bases, groups


def _hexes(data) -> list[str]:
    text = bytes(data).hex()
    return [text[i : i + 64] for i in range(0, len(text), 64)]


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, group: str = "source", order: str = "doc_id", claim: Column | None = None) -> DataFrame:
    """One row (order, leaf, subroot, root, proof_sha256, folded_root, verified) for each of docs.

    claim: the digest (32 bytes, as digest() gives it) that each row is to be verified against; by default the row's own."""
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = docs.schema[order].dataType
    out = T.StructType([T.StructField(order, kind), *[T.StructField(c, T.StringType()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")], T.StructField("verified", T.BooleanType())])
    leaf = digest({c: F.col(f"`{c}`") for c in fields})
    leaves = checkpoint(docs.select(F.col(f"`{group}`").alias("group"), F.col(f"`{order}`").alias("id"), leaf.alias("leaf"), (leaf if claim is None else claim).alias("claim"), F.monotonically_increasing_id().alias("n")))
    keys = ["group", "id", "leaf", "n"]
    of = {f.name: f.dataType.simpleString() for f in leaves.schema.fields}
    runs = leaves.repartitionByRange(partitions, *keys).sortWithinPartitions(*keys).mapInArrow(_pack, f"p long, k long, at long, n long, group {of['group']}, ids array<{of['id']}>, leaves binary, claims binary")
    runs = checkpoint(runs)
    bases, groups = _bases(runs)
    if not groups:
        return spark.createDataFrame([], out)

    def sent(r):
        base, before = bases[r.p]
        return _cut(base + r.k, r.at + (before if r.k == 0 else 0), (r.ids, _hexes(r.leaves), _hexes(r.claims)))

    vertices, subroots = _supersteps(runs.select("p", "k", "at", "ids", "leaves", "claims").rdd.flatMap(sent), partitions, spark, 1)
    over, tops = _supersteps(subroots.rdd.flatMap(lambda r: _cut(TOP, r.tree, ([r.digest],))), max(1, partitions // 64), spark, 0)
    root = tops.first().digest

    told = spark.sparkContext.parallelize([((TOP, 0), (1, ("", root, [])))], 1)
    for v in reversed(over):
        told = _met(v, told, 0).flatMap(_paths).map(lambda x: ((TOP, x[0]), (1, ("", x[3], x[4]))))
    from_top = _met_roots(subroots, told)
    told = from_top
    for v in reversed(vertices[1:]):
        below = _met(v, told, 0).flatMap(lambda x: [((x[0][0], pos), (1, (subroot, whole, way))) for pos, _, subroot, whole, way in _paths(x)])
        told = from_top.union(below)

    def proofs(vertex):
        (_, unit), ((ids, nodes, claims), (subroot, whole, above)) = vertex
        levels = _climb(unit, nodes)
        inside = [[]]
        for level in reversed(levels[:-1]):
            inside = [[_others(level, i), *inside[i // FAN]] for i in range(len(level))]
        rest, same = "".join(x for _, others in above for x in others), _fold(levels[-1][0], above)
        for i, way in enumerate(inside):
            # What folds up from a leaf that is claimed as it is has been hashed already, as far as the vertex's top.
            folded = same if claims[i] == nodes[i] else _fold(claims[i], [*way, *above])
            yield ids[i], nodes[i], subroot, whole, sha256(("".join(x for _, others in way for x in others) + rest).encode()).hexdigest(), folded, folded == whole

    return spark.createDataFrame(_met(vertices[0], told).flatMap(proofs), out, verifySchema=False)


def _met_roots(subroots: DataFrame, told):
    """The groups' roots as messages to the first vertex of each group's tree, with the path from there to the root."""
    digests = subroots.rdd.map(lambda r: ((TOP, r.tree), r.digest))
    return told.join(digests).map(lambda x: ((x[0][1], 0), (0, (x[1][1], x[1][0][1][1], x[1][0][1][2]))))


def op13_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    odd = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    text = F.when(odd, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return manifest(docs, claim=digest({c: F.col(c) for c in FIELDS} | {"text": text}))


def _sql(levels: int = 13) -> str:
    """Level by level; 13 are enough for 3 ** 13 rows of a source, and as many sources."""
    field = lambda c: f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"
    leaf = lambda text: f"sha256({' || '.join(field(text if c == 'text' else c) for c in FIELDS)})"
    bits = "list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))"
    crc = f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda c, b: {bits}))"
    tampered = f"CASE WHEN {crc} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END"
    parts = [
        f"l AS (SELECT row_number() OVER () AS r, doc_id, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, {leaf('text')} AS leaf, {leaf('changed')} AS claim FROM (SELECT *, {tampered} AS changed FROM documents))",
        "p AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM l)",
        "n0 AS (SELECT tree, pos, n, leaf AS d FROM p)",
        "w0 AS (SELECT r, tree, tree AS own, pos, n, claim AS d, '' AS proof FROM p)",
    ]

    def climb(name: str, walk: str) -> None:
        for i in range(levels):
            run = f"(PARTITION BY tree, pos // {FAN} ORDER BY pos ROWS BETWEEN"
            parts.append(f"{name}s{i} AS (SELECT *, CASE WHEN n > 1 THEN coalesce(string_agg(d, '') OVER {run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') ELSE '' END AS lefts, CASE WHEN n > 1 THEN coalesce(string_agg(d, '') OVER {run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') ELSE '' END AS rights FROM {name}{i})")
            parts.append(f"{name}{i + 1} AS (SELECT tree, pos // {FAN} AS pos, max((n + {FAN - 1}) // {FAN}) AS n, CASE WHEN max(n) = 1 THEN min(d) ELSE sha256(string_agg(d, '' ORDER BY pos)) END AS d FROM {name}{i} GROUP BY tree, pos // {FAN})")
            parts.append(f"{walk}{i + 1} AS (SELECT r, w.tree, own, w.pos // {FAN} AS pos, (w.n + {FAN - 1}) // {FAN} AS n, CASE WHEN w.n = 1 THEN w.d ELSE sha256(lefts || w.d || rights) END AS d, proof || lefts || rights AS proof FROM {walk}{i} w JOIN {name}s{i} s ON w.tree = s.tree AND w.pos = s.pos)")

    climb("n", "w")
    parts.append(f"t0 AS (SELECT 0 AS tree, tree AS pos, count(*) OVER () AS n, d FROM n{levels})")
    parts.append(f"v0 AS (SELECT r, 0 AS tree, own, own AS pos, (SELECT count(*) FROM t0) AS n, d, proof FROM w{levels})")
    climb("t", "v")
    return f"""
WITH {', '.join(parts)}
SELECT p.doc_id, leaf, n.d AS subroot, t.d AS root, sha256(proof) AS proof_sha256, v.d AS folded_root, v.d = t.d AS verified
FROM p JOIN v{levels} v ON p.r = v.r JOIN n{levels} n ON p.tree = n.tree CROSS JOIN t{levels} t
"""


SQL = _sql()
