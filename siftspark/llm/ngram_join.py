"""Exact Jaccard join of documents on word n-grams, by vertical partitioning.

Shingles have SIZE words, and documents with at least PERCENT % in common are
linked, unless a caller says otherwise, as op8_ngram_join does (3 words, 90 %).

A document's set are the hashes of its distinct shingles; the order of the
hashes is the global n-gram order. Cut into V fragments of equal range, that
order cuts each set into V segments.

Candidates. Two sets with at least p % in common differ in at most
k = (|x| + |y|) (100 - p) / (100 + p) shingles, which spoil k segments at most; of V = k + 1 + s
segments more than s are equal. Sets with no more than s empty segments
therefore share one that isn't empty, and need to be looked up by these only; the
others are looked up by the empty ones too. s grows with V as the number of empty
segments does, so that such sets stay as rare among long texts as among short. As V depends on size, sizes
are cut into classes, each with the V of its largest; a set is looked up in its
own class, and in the next one if a partner can be there. No frequency table and
no cap is needed: a frequent shingle or line is only part of a segment.

dedup() looks sets up by prefixes instead, since at lower percentages segments are
short and many unrelated sets share one. Two sets that are linked share 1 + m EXTRA / 100
of the first n - ceil(n p / 100) + 1 + n EXTRA / 100 elements of each, where m is
the smaller size, in any global order; here the shingles that a sample has least
often come first. The sample only moves work: the result is the same for any order.
Shingles that many sets look up join sets only by a prefix of their own (_by_prefix),
so that a passage which many documents share doesn't make a family of them.

Families. Sets that share a segment are joined to the least of them (a star, not
pairs); the connected components are families, outside of which there is no
link. Equal sets are one node from the start, so copies are never paired.

Partial overlaps. Sets are stored by fragment of the global order. A family is
cut into blocks of about BLOCK sets; a pair of blocks (a family of BLOCK sets is
one) is a task's unit. It counts the overlaps of its pairs one fragment after the
other, sums the partial counts per pair, tests 100 * intersection >= p * union in
whole numbers, and returns a spanning forest of the links. In a family of more
than LARGE sets, whose blocks would be sent too often, each set is first paired with the star's centre that
it shares most segments with: a join on set and fragment gives a partial overlap
for each pair and fragment, their sum is the pair's. There is one pair a set,
however large the family is, and in a group of near copies these links connect
many. What isn't in the largest part that the family then has is compared with all
of it, in units of a block of these by a block of any. The components of all these
links are those of all links.

Defined cases: null, empty and blank texts have an empty set and no link; with
fewer words than the shingle's, the whole sequence is one shingle; sets are
compared by 64-bit hashes of shingles, and told apart by one of the whole set;
rows that repeat doc_id and text are copies; null ids are never the smallest of
a component that has another; other columns aren't read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytes_kernel import buffers, cuts, mixed, parts, prefix, string_hashes
from .common import checkpoint, components, join_hot, keyed, on_key, packed, table, text_hash, unpacked

SIZE, PERCENT = 5, 80
SPARE = 3
FRAGMENTS = 4
BLOCK, LARGE = 2048, 16 * 2048
COLUMNS = 4096
SAMPLE, SKETCH_BITS, FEW, EXTRA = 20_000, 22, 8, 5
CHUNK = 1 << 19
_U = np.uint64
_C1, _C2 = _U(0xD6E8FEB86659FD93), _U(0xA0761D6478BD642F)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def _words(x: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each word; starts has where each row starts, and the end."""
    word = ~_SPACE[x]
    edge = np.zeros(len(x) + 1, bool)
    edge[starts] = True
    begin = np.flatnonzero(word & (edge[:-1] | np.concatenate([[True], ~word[:-1]])))
    end = np.flatnonzero(word & (edge[1:] | np.concatenate([~word[1:], [True]]))) + 1
    return string_hashes(_LOWER[x], begin, end), np.searchsorted(starts, begin, side="right") - 1


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int):
    """For runs of rows: first row, sorted distinct shingles of all of them, and how many each row has."""
    for a, b in parts(offsets, CHUNK):
        x = data[offsets[a] : offsets[b]]
        if b - a == 1 and len(x) > CHUNK:
            h = np.concatenate([_words(x[i:j], np.array([0, j - i]))[0] for i, j in cuts(x, CHUNK, ~_SPACE)])
            row = np.zeros(len(h), np.int64)
        else:
            h, row = _words(x, offsets[a : b + 1] - offsets[a])
        n = np.bincount(row, minlength=b - a)
        s = np.zeros(len(h), np.uint64)
        rest = len(h)
        for k in range(size - 1, -1, -1):  # of word i: words i .. i + size - 1, as far as they go
            rest = max(len(h) - k, 0)
            s[:rest] = mixed(h[k:] + _C1 * s[:rest] + _C2)
        at = np.cumsum(n) - n
        take = np.maximum(n - size + 1, 0)
        short = np.flatnonzero((n > 0) & (n < size))
        use = np.zeros(len(h), bool)
        if len(h) >= size:
            use[: len(h) - size + 1] = row[: len(h) - size + 1] == row[size - 1 :]
        for r in short:
            own = _U(0)
            with np.errstate(over="ignore"):
                for w in h[at[r] : at[r] + n[r]][::-1]:
                    own = mixed(np.array([w + _C1 * own + _C2 + _U(n[r])]))[0]
            s[at[r]], use[at[r]], take[r] = own, True, 1
        s = s[use]
        ends = np.cumsum(take)
        for lo, hi in zip(ends - take, ends, strict=True):
            s[lo:hi].sort()
        r = np.repeat(np.arange(b - a), take)
        new = np.ones(len(s), bool)
        new[1:] = (s[1:] != s[:-1]) | (r[1:] != r[:-1])
        yield a, s[new], np.bincount(r[new], minlength=b - a)


def size_classes(percent: int, largest: int) -> tuple[np.ndarray, np.ndarray]:
    """Largest size and number of fragments of each class."""
    tops = [1]
    while tops[-1] < largest * 2:
        tops.append(max(tops[-1] + 1, tops[-1] * 100 // percent, tops[-1] * 13 // 10))
    tops = np.array(tops)
    return tops, 2 * tops * (100 - percent) // (100 + percent) + 1


def _signatures(s: np.ndarray, n: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Segments to look up, and their row, of sets s of sizes n."""
    tops, frags = size_classes(percent, int(n.max(initial=1)))
    own = np.searchsorted(tops, n)
    cum = prefix(mixed(s * _C2))
    at = np.cumsum(n) - n
    sigs, rows = [], []
    for step in (0, 1):
        cls = own + step
        some = (n > 0) & (frags[cls] > 1)
        if step:
            some &= n * 100 >= percent * (tops[own] + 1)  # a partner of the next class is at least that large
        row = np.flatnonzero(some)
        if not len(row):
            continue
        spare = SPARE + frags[cls[row]] // 40
        v = frags[cls[row]] + spare
        idx = np.repeat(at[row] - (np.cumsum(n[row]) - n[row]), n[row]) + np.arange(n[row].sum())
        first = np.cumsum(v) - v
        frag = ((s[idx] >> _U(32)) * np.repeat(v, n[row]).astype(np.uint64) >> _U(32)).astype(np.int64) + np.repeat(first, n[row])
        total = int(v.sum())
        count = np.bincount(frag, minlength=total)
        new = np.flatnonzero(np.concatenate([[True], frag[1:] != frag[:-1]]))
        last = np.concatenate([new[1:], [len(frag)]]) - 1
        sums = np.zeros(total, np.uint64)
        sums[frag[new]] = cum[idx[last] + 1] - cum[idx[new]]
        of = np.repeat(np.arange(len(row)), v)
        number = (np.arange(total) - first[of]).astype(np.uint64)
        sig = mixed(sums + mixed(number * _C1 + cls[row][of].astype(np.uint64) * _C2 + count.astype(np.uint64)))
        empty = np.bincount(of, weights=count == 0, minlength=len(row))
        use = (count > 0) | (empty[of] > spare[of])
        sigs.append(sig[use])
        rows.append(row[of[use]])
    if not sigs:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(sigs), np.concatenate(rows)


def _slots(s: np.ndarray) -> np.ndarray:
    return (s >> _U(64 - SKETCH_BITS)).astype(np.int64)


def _prefixes(s: np.ndarray, n: np.ndarray, percent: int, often: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingles to look up, and their row, of sets s of sizes n: those of the prefix in the order of often, then of the hashes."""
    row = np.repeat(np.arange(len(n)), n)
    s = s[np.argsort(row * 256 + often[_slots(s)], kind="stable")]
    use = np.arange(len(s)) - (np.cumsum(n) - n)[row] < (n + (-percent * n) // 100 + 1 + n * EXTRA // 100)[row]
    return s[use], row[use]


def _tally(size: int):
    def run(batches):
        often = np.zeros(1 << SKETCH_BITS, np.uint32)
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            for _, s, _ in shingle_sets(data, offsets, size):
                np.add.at(often, _slots(s), np.uint32(1))
        yield pa.RecordBatch.from_arrays([pa.array([np.minimum(often, 255).astype(np.uint8).tobytes()], pa.binary())], names=["often"])

    return run


def _often(base: DataFrame, size: int) -> np.ndarray:
    """How often a sample of about SAMPLE texts has the shingles of each slot, 255 at most."""
    draw = F.pmod("_th", F.lit(1 << 30)) < int(min(1.0, SAMPLE / max(base.count(), 1)) * (1 << 30))
    total = np.zeros(1 << SKETCH_BITS, np.uint16)
    for r in base.where(draw).select("text").repartition(4).mapInArrow(_tally(size), "often binary").toLocalIterator():
        total += np.frombuffer(r["often"], np.uint8)
    return np.minimum(total, 255).astype(np.uint8)


def _describe(size: int, percent: int, often: np.ndarray | None = None):
    def run(batches):
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            for a, s, n in shingle_sets(data, offsets, size):
                rows = len(n)
                cum = prefix(mixed(s * _C1))
                ends = np.cumsum(n)
                whole = mixed(cum[ends] - cum[ends - n] + n.astype(np.uint64)).view(np.int64)
                sig, row = _signatures(s, n, percent) if often is None else _prefixes(s, n, percent, often)
                order = np.argsort(row, kind="stable")
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=rows))]).astype(np.int32)), pa.array(sig[order].view(np.int64)))
                ids = batch.column("doc_id").slice(a, rows)
                th = batch.column("_th").slice(a, rows)
                yield pa.RecordBatch.from_arrays([ids, th, pa.array(whole), pa.array(n.astype(np.int64)), lists], names=["doc_id", "_th", "set", "n", "sigs"])

    return run


def _fetch(size: int):
    """The sets of texts, a row for each fragment that isn't empty: family, members, set, frag, part (sorted hashes), n (size of the whole set)."""

    def run(batches):
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            for a, s, n in shingle_sets(data, offsets, size):
                key = np.repeat(np.arange(len(n)), n) * FRAGMENTS + (s >> _U(62)).astype(np.int64)
                count = np.bincount(key, minlength=len(n) * FRAGMENTS)
                some = np.flatnonzero(count)
                ends = np.concatenate([[0], np.cumsum(count[some])]).astype(np.int64) * 8
                part = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(some), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(s))]).cast(pa.binary())
                row = some // FRAGMENTS
                of = [batch.column(c).slice(a, len(n)).take(pa.array(row)) for c in ("family", "members", "set")]
                yield pa.RecordBatch.from_arrays([*of, pa.array((some % FRAGMENTS).astype(np.int32)), part, pa.array(n[row].astype(np.int64))], names=["family", "members", "set", "frag", "part", "n"])

    return run


def _partial(batches):
    """How many elements the parts x and y of pairs have in common."""
    for batch in batches:
        x, y = (buffers(batch.column(c)) for c in ("x", "y"))
        out = np.zeros(batch.num_rows, np.int64)
        for i in range(batch.num_rows):
            both = np.concatenate([d[o[i] : o[i + 1]].view(np.uint64) for d, o in (x, y)])
            both.sort()
            out[i] = np.count_nonzero(both[1:] == both[:-1])
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("a", "b", "na", "nb")], pa.array(out)], names=["a", "b", "na", "nb", "o"])


def overlaps(sets: list[np.ndarray], left: int | None = None) -> np.ndarray:
    """Sizes of the intersections of sets (of the first left with the others, if given), fragment after fragment of the order of their elements."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(flat := np.concatenate(sets), kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.concatenate([[True], flat[1:] != flat[:-1]])
    col = np.cumsum(new) - 1
    shared = np.bincount(col)[col] > 1
    col, owner = np.unique(col[shared], return_inverse=True)[1], owner[shared]
    a, b = (slice(None), slice(None)) if left is None else (slice(0, left), slice(left, None))
    total = np.zeros((len(sets) if left is None else left, len(sets) - (left or 0)), np.float32)
    for start in range(0, int(col.max(initial=-1)) + 1, COLUMNS):
        i, j = np.searchsorted(col, [start, start + COLUMNS])
        part = np.zeros((len(sets), min(COLUMNS, int(col.max()) + 1 - start)), np.float32)
        part[owner[i:j], col[i:j] - start] = 1
        total += part[a] @ part[b].T
    return total.astype(np.int64)


def _forest(ids: np.ndarray, sets: list[np.ndarray], left: int | None, percent: int) -> list[tuple[int, int]]:
    """Edges that connect what links connect: of each set with the first of its local component."""
    n = np.array([len(s) for s in sets])
    o = overlaps(sets, left)
    na, nb = (n, n) if left is None else (n[:left], n[left:])
    link = 100 * o >= percent * (na[:, None] + nb[None, :] - o)
    i, j = np.nonzero(link)
    j = j + (left or 0)
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label[i], label[j])
        after = label.copy()
        np.minimum.at(after, i, low)
        np.minimum.at(after, j, low)
        after = after[after]
        if (after == label).all():
            break
        label = after
    moved = np.flatnonzero(label != np.arange(len(ids)))
    return [(int(ids[x]), int(ids[label[x]])) for x in moved]


def _count(percent: int):
    """Rows sorted by family, i, j, own, set, frag: the sets of block i and those of block j."""

    def run(batches):
        def solve(key, rows):
            ids, sets, left, last = [], [], 0, None
            for s, own, frag, part in rows:
                if last is None or s != last[0]:
                    ids.append(s)
                    sets.append([])
                    left += own == key[1]
                elif frag == last[1]:  # of rows that repeat doc_id and text
                    continue
                last = (s, frag)
                sets[-1].append(np.frombuffer(part, np.uint64))
            if len(ids) < 2 or key[1] != key[2] and left in (0, len(ids)):
                return []
            return _forest(np.array(ids), [np.concatenate(x) for x in sets], None if key[1] == key[2] else left, percent)

        def emit(edges):
            return pa.RecordBatch.from_arrays([pa.array([e[0] for e in edges], pa.int64()), pa.array([e[1] for e in edges], pa.int64())], names=["a", "b"])

        key, rows, edges = None, [], []
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("family", "i", "j", "set", "own", "frag", "part")]
            for f, i, j, s, own, frag, part in zip(*cols, strict=True):
                if (f, i, j) != key:
                    if rows:
                        edges += solve(key, rows)
                    key, rows = (f, i, j), []
                rows.append((s, own, frag, part))
            if len(edges) > 10_000:
                yield emit(edges)
                edges = []
        if rows:
            edges += solve(key, rows)
        yield emit(edges)

    return run


def describe(docs: DataFrame, size: int = SIZE, percent: int = PERCENT, prefix: bool = False) -> DataFrame:
    """doc_id, _th, set (hash of the set of shingles), n (its size), sigs (segments, or shingles of the prefix, to look up); checkpointed."""
    base = keyed(docs)
    out = base.mapInArrow(_describe(size, percent, _often(base, size) if prefix else None), f"doc_id {dict(base.dtypes)['doc_id']}, _th long, set long, n long, sigs array<long>")
    return checkpoint(out.withColumn("set", F.when(F.col("n") > 0, F.col("set")).otherwise(F.xxhash64("doc_id", F.lit("no words"), "_th"))))


def _by_prefix(described: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b, c) that connect all sets that can be linked; c counts what a and b were found by.

    Of t = ceil(n percent / 100) shingles that a set of n has in common with a linked one at least, all but
    t - 1 - n EXTRA / 100 are in both prefixes; so linked sets share 1 + t EXTRA / 100 (need) there, with
    the t of either. Shingles that no more than FEW rows look up make pairs, which are kept if what they share so
    far, the hot shingles that they can share, and all that is beyond the prefix could be enough. The others
    are hot. Two sets that share need of them share one of the first h - need + 1 of the h that each has, the
    rarest first: these join sets to the least of them. Who has fewer hot ones than need is joined by none."""
    each = described.select("set", "n", F.explode("sigs").alias("sig"))
    shared = each.groupBy("sig").agg(F.min("set").alias("low"), F.max("set").alias("high"), F.count("*").alias("rows")).where("low <> high").select("sig", "rows")
    found = checkpoint(join_hot(each, shared, ["sig"]))
    least = f"(({percent} * n + 99) div 100)"
    need, rest = f"(1 + {least} * {EXTRA} div 100)", f"greatest({least} - 1 - n * {EXTRA} div 100, 0)"
    hot = found.where(F.col("rows") > FEW).groupBy("set", "n").agg(F.array_sort(F.collect_set(F.struct("rows", "sig"))).alias("hot"))
    hot = checkpoint(hot.selectExpr("set", "size(hot) AS h", f"if(size(hot) >= {need}, transform(slice(hot, 1, int(size(hot) - {need} + 1)), x -> x.sig), array()) AS sigs"))
    keys = hot.select("set", F.explode("sigs").alias("sig"))
    lows = keys.groupBy("sig").agg(F.min("set").alias("low"), F.max("set").alias("high")).where("low <> high").select("sig", "low")
    stars = join_hot(keys, lows, ["sig"]).where("set <> low").groupBy(F.col("set").alias("a"), F.col("low").alias("b")).agg(F.count("*").alias("c"))
    few = found.where(F.col("rows") <= FEW).join(hot.select("set", "h"), "set", "left")
    few = few.groupBy("sig").agg(F.collect_set(F.struct("set", "n", F.coalesce("h", F.lit(0)).alias("h"), F.expr(need).alias("need"), F.expr(rest).alias("rest"))).alias("m")).select("m", F.explode("m").alias("x"))
    pairs = few.select("x", F.explode(F.expr("filter(m, y -> y.set > x.set)")).alias("y")).groupBy("x", "y").agg(F.count("*").alias("c"))
    most = "c + least(x.h, y.h, greatest(x.need, y.need) - 1) + greatest(x.rest, y.rest)"
    able = pairs.where(f"{100 + percent} * ({most}) >= {percent} * (x.n + y.n) AND 100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n)")
    return stars.union(able.select(F.col("y.set").alias("a"), F.col("x.set").alias("b"), "c"))


def linked(docs: DataFrame, described: DataFrame, size: int = SIZE, percent: int = PERCENT, prefix: bool = False) -> DataFrame:
    """set, comp: the component of all links for each set that may have one."""
    base = keyed(docs)
    each = described.select("set", F.explode("sigs").alias("sig"))
    if prefix:
        stars = _by_prefix(described, percent)
    else:
        shared = each.groupBy("sig").agg(F.min("set").alias("low"), F.max("set").alias("high")).where("low <> high").select("sig", "low")
        stars = join_hot(each, shared, ["sig"]).where("set <> low").groupBy(F.col("set").alias("a"), F.col("low").alias("b")).agg(F.count("*").alias("c"))
    stars = checkpoint(stars)
    family = components(stars.select("a", "b")).withColumnsRenamed({"node": "set", "comp": "family"})
    family = checkpoint(join_hot(family, family.groupBy("family").agg(F.count("*").alias("members")), ["family"]).select("set", "family", "members"))
    one = described.where("n > 0").groupBy("set").agg(F.min(F.struct("doc_id", "_th")).alias("r"))
    want = family.join(one, "set").select("r.doc_id", "r._th", "set", "family", "members")
    texts = on_key(base, want, "inner").select("text", "set", "family", "members")
    parts = checkpoint(texts.mapInArrow(_fetch(size), "family long, members long, set long, frag int, part binary, n long"))  # texts are shuffled once
    unit = ["family", "i", "j"]

    def counted(units: DataFrame) -> DataFrame:
        return units.repartition(*unit).sortWithinPartitions(*unit, "own", "set", "frag").mapInArrow(_count(percent), "a long, b long")

    blocks = F.expr(f"int(ceil(members / {BLOCK}))")
    few = parts.where(F.col("members") <= LARGE).withColumn("own", F.pmod(F.xxhash64("set"), blocks).cast("int")).withColumn("to", F.explode(F.sequence(F.lit(0), blocks - 1)))
    edges = counted(few.select("family", F.least("own", "to").alias("i"), F.greatest("own", "to").alias("j"), "own", "set", "frag", "part"))
    known = family.select("set", F.col("set").alias("known"))
    large = family.where(F.col("members") > LARGE)
    if not large.isEmpty():
        parts = parts.where(F.col("members") > LARGE).dropDuplicates(["set", "frag"])
        sure = checkpoint(_by_best(stars, parts, percent))
        known = checkpoint(family.join(components(sure).withColumnsRenamed({"node": "set", "comp": "known"}), "set", "left").select("set", "family", "members", F.coalesce("known", "set").alias("known")))
        left = _apart(known.where(F.col("members") > LARGE))
        dealt = left.withColumn("to", F.explode(F.expr("sequence(0, last)"))).select("family", F.least("own", "to").alias("i"), F.greatest("own", "to").alias("j"), "own", "set")
        edges = edges.union(counted(dealt.join(parts.select("set", "frag", "part"), "set")))
    ends = [known.select(F.col("set").alias(e), F.col("known").alias(f"k{e}")) for e in ("a", "b")]
    between = edges.join(ends[0], "a").join(ends[1], "b").where("ka <> kb").select(F.col("ka").alias("a"), F.col("kb").alias("b"))
    return join_hot(known.select("set", "known"), _whole(known, components(between)), ["known"]).select("set", "comp")


def _by_best(stars: DataFrame, parts: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) among the pairs of each set with the centre that it shares most with: partial overlaps by fragment, and their sums."""
    sizes = parts.groupBy("set").agg(F.max("n").alias("n"))
    best = stars.groupBy("a").agg(F.max_by("b", F.struct("c", "b")).alias("b"))
    sized = best.join(sizes.select(F.col("set").alias("a"), F.col("n").alias("na")), "a")
    sized = join_hot(sized, sizes.select(F.col("set").alias("b"), F.col("n").alias("nb")), ["b"]).where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")
    x = sized.join(parts.select(F.col("set").alias("a"), "frag", F.col("part").alias("x")), "a")
    pairs = join_hot(x, parts.select(F.col("set").alias("b"), "frag", F.col("part").alias("y")), ["b", "frag"])
    summed = pairs.select("a", "b", "na", "nb", "x", "y").mapInArrow(_partial, "a long, b long, na long, nb long, o long").groupBy("a", "b", "na", "nb").agg(F.sum("o").alias("o"))
    return summed.where(f"100 * o >= {percent} * (na + nb - o)").select("a", "b")


def _apart(known: DataFrame) -> DataFrame:
    """family, set, own (its block) and last (the last block that it meets) for families of more than one part.

    Blocks 0 .. rows - 1 are of what stands apart, the others of the main part, whose pairs need no test."""
    per = known.groupBy("family", "known").agg(F.count("*").alias("m"))
    main = per.groupBy("family").agg(F.max_by("known", F.struct("m", "known")).alias("main"), F.sum("m").alias("members"), F.max("m").alias("most")).where("most < members")
    main = main.select("family", "main", F.expr(f"int(ceil((members - most) / {BLOCK}))").alias("rows"), F.expr(f"int(ceil(most / {BLOCK}))").alias("columns"))
    left = join_hot(known.drop("members"), main, ["family"]).withColumn("apart", F.col("known") != F.col("main"))
    own = F.expr("int(if(apart, pmod(xxhash64(set), rows), rows + pmod(xxhash64(set), columns)))")
    return checkpoint(left.select("family", "set", own.alias("own"), F.expr("if(apart, rows + columns, rows) - 1").alias("last")))


def _whole(known: DataFrame, merged: DataFrame) -> DataFrame:
    """known, comp: for each part that the sure links make, the component that the other links make of parts."""
    parts = known.select("known").distinct()
    return parts.join(merged.select(F.col("node").alias("known"), "comp"), "known", "left").select("known", F.coalesce("comp", "known").alias("comp"))


def groups(docs: DataFrame, size: int = SIZE, percent: int = PERCENT, prefix: bool = False) -> DataFrame:
    """doc_id, _th, n_shingles, component_id (smallest doc_id reachable by links) and first (the key of the document that stays)."""
    described = describe(docs, size, percent, prefix)
    comp = linked(docs, described, size, percent, prefix)
    classes = described.groupBy("set").agg(F.min("doc_id").alias("low"), F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "_th")).alias("key"))
    lows = comp.join(classes, "set").groupBy("comp").agg(F.min("low").alias("low"), F.min("key").alias("key"))
    of_set = classes.join(comp.join(lows, "comp").select("set", F.col("low").alias("low2"), F.col("key").alias("key2")), "set", "left")
    of_set = of_set.select("set", F.coalesce("low2", "low").alias("component_id"), F.coalesce("key2", "key").alias("first"))
    return join_hot(described.select("doc_id", "_th", "set", F.col("n").alias("n_shingles")), of_set, ["set"]).select("doc_id", "_th", "n_shingles", "component_id", "first")


def dedup(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """docs with one document of each component: that of the smallest doc_id, then of the smallest hash of its text."""
    stays = groups(docs, size, percent, prefix=True).where("first.doc_id <=> doc_id AND first._th = _th").select("doc_id", "_th").distinct()
    left = docs.select("doc_id", text_hash(), packed(docs))
    return on_key(left, stays, "left_semi").dropDuplicates(["doc_id", "_th"]).select(*unpacked(docs))


def op8_ngram_join(spark, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents"), 3, 90).select("doc_id", "n_shingles", "component_id")


def brute_force(rows: list[tuple[int, str | None]], size: int = SIZE, percent: int = PERCENT) -> dict[int, tuple[int, int]]:
    """n_shingles and component_id by comparing all pairs that share a shingle."""
    import re

    lower = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    sets, by = {}, {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
        for s in sets[i]:
            by.setdefault(s, []).append(i)
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, own in sets.items():
        seen: dict[int, int] = {}
        for s in own:
            for j in by[s]:
                seen[j] = seen.get(j, 0) + 1
        for j, o in seen.items():
            if j > i and 100 * o >= percent * (len(own) + len(sets[j]) - o):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}
