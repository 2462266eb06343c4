"""Removal of repeated substrings of LENGTH bytes by a distributed suffix array.

The suffix array is sparse: of the suffixes only those that start at an anchor are
moved. A substring's anchor is the TOKEN-byte string within it whose hash is
least (the leftmost of equals), so equal substrings have equal anchors at equal
places. Neighbouring substrings that share their anchor are one run (lo .. lo +
span); the corpus has one run for about eighty bytes. A run is moved as the suffix
from its anchor, whose first TOKEN bytes are its leading token, and the bytes
before it that its substrings need.

1. Anchors are counted by hash; a run whose anchor occurs once in the corpus has
   no repeated substring and goes no further.
2. Runs that are equal as a whole are one class; where a class has two members or
   more, all of their substrings are repeated, and one member stands for them.
3. Runs that are alone in their class but share an anchor, and the members that
   stand for other classes of it, are fetched with their bytes. They are
   range-partitioned by their leading token, the bytes themselves, between
   splitters that Spark samples (repartitionByRange). Each bucket sorts the
   LENGTH-byte heads of the substrings by multikey quicksort, with eight bytes as
   a character, and compares neighbours. A splitter never lies between equal
   leading tokens, so the last of a bucket and the first of the next differ.
4. A token with more than HOT different runs would make a bucket too large. Its
   runs are cut by a longer leading token (TOKEN2 bytes) and go through steps 2
   and 3 once more. Where that is hot, too, substrings are told apart by 128 bits
   of hash and counted by one aggregation: the same answer without a bound.
5. What is found is merged and cut out, by document.

In buckets bytes are compared. Classes are told apart by 128 bits: the hash of
the anchor, and that of the whole run.

Defined cases: null text is empty; a document shorter than LENGTH has nothing to
remove; matches never cross documents; rows that repeat doc_id and text are
copies of each other and both lose what they share; null ids are ids like
others; other columns aren't read. Texts are worked on in pieces of CHUNK bytes
and runs in blocks of ROWS, so that memory doesn't grow with the longest text.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytes_kernel import block_hashes, buffers, mixed, parts, ranges, sliding_min, words_at
from .common import checkpoint, join_hot, keyed, on_key, released, table

LENGTH, TOKEN, TOKEN2, BLOCK = 200, 40, 160, 40
CHUNK = 1 << 17
ROWS = 1000
HOT = 256
_MASK = np.uint64((1 << 22) - 1)
_MORE = np.uint64(0xD6E8FEB86659FD93)


def _pieces(offsets: np.ndarray):
    """Lists of (row, first byte in row, bytes) of about CHUNK bytes each; long rows come in pieces that overlap by LENGTH - 1."""
    for a, b in parts(offsets, CHUNK):
        n = int(offsets[b] - offsets[a])
        if b - a > 1 or n <= CHUNK + LENGTH:
            yield np.arange(a, b), np.zeros(b - a, np.int64), np.diff(offsets[a : b + 1])
        else:
            for s in range(0, n - LENGTH + 1, CHUNK):
                yield np.array([a]), np.array([s]), np.array([min(CHUNK + LENGTH - 1, n - s)])


def _chained(blocks: np.ndarray, n: int, size: int) -> np.ndarray:
    """Hash of the size bytes at each of the first n places, from those of BLOCK bytes."""
    out = blocks[:n]
    for k in range(BLOCK, size, BLOCK):
        out = mixed(out * _MORE + blocks[k : k + n])
    return out


def _cut_runs(x: np.ndarray, starts: np.ndarray, counts: np.ndarray, token: int) -> tuple[np.ndarray, ...]:
    """Runs of the suffixes (counts of them from each start): segment, lo, hi (places in x), place of the anchor, hashes of anchor and content."""
    blocks = block_hashes(x, BLOCK)
    n = len(x) - token + 1
    h = _chained(blocks, n, token)
    least = sliding_min((h & ~_MASK) | np.arange(n, dtype=np.uint64), LENGTH - token + 1)
    at = ranges(starts, counts)
    place = (least[at] & _MASK).astype(np.int64)
    seg = np.repeat(np.arange(len(starts)), counts)
    new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (seg[1:] != seg[:-1])]))
    lo, hi, place, seg = at[new], at[np.concatenate([new[1:], [len(at)]]) - 1], place[new], seg[new]
    content = mixed(((hi - lo) * 4096 + place - lo).astype(np.uint64))
    for end in (lo, hi):  # ten blocks cover a run: its first LENGTH bytes and its last
        for k in range(0, LENGTH, BLOCK):
            content = mixed(content * _MORE + blocks[end + k])
    return seg, lo, hi, place, h[place], content


def _runs(batches):
    """Of each document (doc_id, _th, text): lo, span, place of the anchor in the run, token and content (hashes)."""
    for batch in batches:
        data, offsets = buffers(batch.column("text"))
        for rows, first, sizes in _pieces(offsets):
            begin = int(offsets[rows[0]] + first[0])
            starts = np.cumsum(sizes) - sizes
            counts = np.maximum(sizes - LENGTH + 1, 0)
            if not counts.sum():
                continue
            seg, lo, hi, place, token, content = _cut_runs(data[begin : begin + int(sizes.sum())], starts, counts, TOKEN)
            row = pa.array(rows[seg])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(row), batch.column("_th").take(row), pa.array((lo - starts[seg] + first[seg]).astype(np.int64)), pa.array((hi - lo).astype(np.int16)), pa.array((place - lo).astype(np.int16)), pa.array(token.view(np.int64)), pa.array(content.view(np.int64))],
                names=["doc_id", "_th", "lo", "span", "anchor", "token", "content"])


def _binary(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(data[ranges(starts, sizes)])]).cast(pa.binary())


def _finer(batches):
    """Runs with bytes, cut by their longer tokens."""
    for batch in batches:
        data, offsets = buffers(batch.column("body"))
        for a, b in parts(offsets, CHUNK):
            x, starts = data[offsets[a] : offsets[b]], offsets[a:b] - offsets[a]
            seg, lo, hi, place, token, content = _cut_runs(x, starts, np.diff(offsets[a : b + 1]) - LENGTH + 1, TOKEN2)
            row = pa.array(seg + a)
            first = batch.column("lo").to_numpy()[seg + a] + lo - starts[seg]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(row), batch.column("_th").take(row), pa.array(first), pa.array((hi - lo).astype(np.int16)), pa.array((place - lo).astype(np.int16)), pa.array(token.view(np.int64)), pa.array(content.view(np.int64)), batch.column("many").take(row), _binary(x, lo, hi - lo + LENGTH)],
                names=["doc_id", "_th", "lo", "span", "anchor", "token", "content", "many", "body"])


def _bodies(batches):
    """The bytes of the runs of _want: one row for each."""
    names = ["lo", "span", "anchor", "token", "many"]
    for batch in batches:
        data, offsets = buffers(batch.column("text"))
        want = batch.column("_want")
        flat, row = want.flatten(), np.repeat(np.arange(len(want)), np.diff(want.offsets.to_numpy()))
        for a in range(0, len(row), ROWS):
            some, r = flat.slice(a, ROWS), row[a : a + ROWS]
            lo, span = some.field("lo").to_numpy(), some.field("span").to_numpy().astype(np.int64)
            take = pa.array(r)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(take), batch.column("_th").take(take), *[some.field(c) for c in names], _binary(data, offsets[r] + lo, span + LENGTH)], names=["doc_id", "_th", *names, "body"])


def _windows(batches):
    """Each suffix of the runs with bytes, by two hashes of its LENGTH bytes."""
    for batch in batches:
        data, offsets = buffers(batch.column("body"))
        for a, b in parts(offsets, CHUNK):
            x, starts = data[offsets[a] : offsets[b]], offsets[a:b] - offsets[a]
            counts = np.diff(offsets[a : b + 1]) - LENGTH + 1
            at, of = ranges(starts, counts), np.repeat(np.arange(a, b), counts)
            row = pa.array(of)
            whole = [pa.array(_chained(block_hashes(x, BLOCK, salt), len(x) - LENGTH + 1, LENGTH)[at].view(np.int64)) for salt in (1, 2)]
            lo = batch.column("lo").to_numpy()[of] + at - starts[of - a]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(row), batch.column("_th").take(row), pa.array(lo), batch.column("many").take(row), *whole], names=["doc_id", "_th", "lo", "many", "w1", "w2"])


def multikey_ties(data: np.ndarray, at: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Whether the LENGTH bytes at each place equal those at another of its group (groups come in ascending order).

    Multikey quicksort, eight bytes a character: at each depth the classes that are still tied and whose
    characters differ are sorted by them and split; what stands alone drops out, and the rest goes one deeper."""
    chars = words_at(data)
    left, cls = np.arange(len(at)), group - (group[0] if len(group) else 0)
    for depth in range(0, LENGTH, 8):
        if not len(left):
            break
        key = chars[at[left] + depth]
        new = cls[1:] != cls[:-1]
        split = np.zeros(int(cls[-1]) + 1, bool)
        split[cls[1:][(key[1:] != key[:-1]) & ~new]] = True
        some = np.flatnonzero(split[cls])
        if len(some):
            order = some[np.lexsort((key[some], cls[some]))]
            left[some], key[some] = left[order], key[order]
        edge = np.concatenate([[True], new | (key[1:] != key[:-1])])
        cls = np.cumsum(edge) - 1
        tied = np.bincount(cls)[cls] > 1
        left, cls = left[tied], cls[tied]
    out = np.zeros(len(at), bool)
    out[left] = True
    return out


def _sorted_bucket(token: int):
    """Rows sorted by their leading token: what of the runs that stand alone (not many) is repeated, as doc_id, _th, s, e."""

    def leads(t):
        data, offsets = buffers(t.column("body"))
        return data[(offsets[:-1] + t.column("anchor").to_numpy())[:, None] + np.arange(token)]

    def solve(t):
        data, offsets = buffers(t.column("body"))
        lead = leads(t)
        group = np.cumsum(np.concatenate([[True], (lead[1:] != lead[:-1]).any(1)]))
        counts = np.diff(offsets) - LENGTH + 1
        at, row = ranges(offsets[:-1], counts), np.repeat(np.arange(len(group)), counts)
        hit = np.flatnonzero(multikey_ties(data, at, group[row]) & ~t.column("many").to_numpy()[row])
        if not len(hit):
            return None
        new = np.concatenate([[True], (hit[1:] != hit[:-1] + 1) | (row[hit[1:]] != row[hit[:-1]])])
        first = hit[new]
        last = hit[np.concatenate([np.flatnonzero(new)[1:], [len(hit)]]) - 1]
        r = row[first]
        base = t.column("lo").to_numpy()[r] - offsets[:-1][r]
        take = pa.array(r)
        return pa.RecordBatch.from_arrays([t.column("doc_id").take(take).combine_chunks(), t.column("_th").take(take).combine_chunks(), pa.array(base + at[first]), pa.array(base + at[last] + LENGTH)], names=["doc_id", "_th", "s", "e"])

    def run(batches):
        held, rows = [], 0
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                held.append(batch.slice(a, ROWS))
                rows += held[-1].num_rows
                if rows < 2 * ROWS:
                    continue
                t = pa.Table.from_batches(held)
                lead = leads(t)
                other = np.flatnonzero((lead != lead[-1]).any(1))
                if len(other):
                    cut = int(other[-1]) + 1
                    if (out := solve(t.slice(0, cut))) is not None:
                        yield out
                    held, rows = t.slice(cut).to_batches(), t.num_rows - cut
        if rows and (out := solve(pa.Table.from_batches(held))) is not None:
            yield out

    return run


def merged(spans: np.ndarray) -> np.ndarray:
    """Maximal runs of spans (s, e)."""
    if not len(spans):
        return spans.reshape(-1, 2)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.concatenate([[True], spans[1:, 0] > reach[:-1]])
    return np.stack([spans[new, 0], reach[np.concatenate([np.flatnonzero(new)[1:], [len(spans)]]) - 1]], 1)


def _cut(batches):
    """n_bytes, n_removed, n_spans and kept of each document, for its spans."""
    for batch in batches:
        data, offsets = buffers(batch.column("text"))
        spans = batch.column("_spans")
        flat = spans.flatten()
        ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(spans), 0).to_numpy())])
        both = np.stack([flat.field("s").to_numpy(), flat.field("e").to_numpy()], 1) if len(flat) else np.zeros((0, 2), np.int64)
        for a, b in parts(offsets, 8 * CHUNK):
            removed, runs, kept = np.zeros(b - a, np.int64), np.zeros(b - a, np.int64), []
            for i in range(a, b):
                x, gone = data[offsets[i] : offsets[i + 1]], merged(both[ends[i] : ends[i + 1]])
                removed[i - a], runs[i - a] = (gone[:, 1] - gone[:, 0]).sum(), len(gone)
                kept.append(b"".join(x[s:e].tobytes() for s, e in zip([0, *gone[:, 1]], [*gone[:, 0], len(x)], strict=True)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(np.diff(offsets[a : b + 1]).astype(np.int64)), pa.array(removed), pa.array(runs), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


_RUN = "doc_id {0}, _th long, lo long, span short, anchor short, token long"


def _alone(kinds: DataFrame) -> DataFrame:
    """Tokens with more than one kind of run, of which one occurs once: token, hot."""
    return kinds.groupBy("token").agg(F.count("*").alias("k"), F.sum(F.when((F.col("n") == 1) & ~F.col("many"), 1).otherwise(0)).alias("alone")).where("k > 1 AND alone > 0").select("token", (F.col("k") > HOT).alias("hot"))


def repeats(base: DataFrame, id_type: str) -> DataFrame:
    """doc_id, _th, s, e: byte ranges covered by repeated substrings; base has doc_id, _th and text."""
    run, found = _RUN.format(id_type), f"doc_id {id_type}, _th long, s long, e long"
    place = F.struct("doc_id", "_th", "lo", "span", "anchor")
    whole = ["doc_id", "_th", F.col("lo").alias("s"), F.expr(f"lo + span + {LENGTH}").alias("e")]

    def buckets(rows: DataFrame, token: int) -> DataFrame:
        lead = F.expr(f"substring(body, anchor + 1, {token})")
        return rows.repartitionByRange(lead).sortWithinPartitions(lead).mapInArrow(released(_sorted_bucket(token)), found)

    runs = base.mapInArrow(released(_runs), f"{run}, content long")
    often = runs.groupBy("token").count().where("count > 1").select("token")
    alike = checkpoint(join_hot(runs, often, ["token"]))
    kinds = alike.groupBy("token", "content").agg(F.count("*").alias("n"), F.min(place).alias("r")).withColumn("many", F.lit(False))
    out = [join_hot(alike, kinds.where("n > 1").select("token", "content"), ["token", "content"]).select(*whole)]
    fetch = join_hot(kinds, _alone(kinds), ["token"]).select("r.*", "token", (F.col("n") > 1).alias("many"), "hot")

    def fetched(hot: bool, how, more: str) -> DataFrame:
        want = fetch.where(F.col("hot") == F.lit(hot)).groupBy("doc_id", "_th").agg(F.collect_list(F.struct("lo", "span", "anchor", "token", "many")).alias("_want"))
        return on_key(base, want, "inner").mapInArrow(released(how), f"{run}, {more}, body binary")

    out.append(buckets(fetched(False, _bodies, "many boolean"), TOKEN))
    # Three branches read this exchange, and all read that of the texts, so that each is written once.
    finer = fetched(True, lambda batches: _finer(_bodies(batches)), "content long, many boolean").repartition("doc_id", "_th", "lo")
    kinds = finer.groupBy("token", "content").agg(F.count("*").alias("n"), F.max("many").alias("many"), F.min(place).alias("r"))
    out.append(join_hot(finer.where("NOT many").drop("many", "body"), kinds.where("n > 1").select("token", "content"), ["token", "content"]).select(*whole))
    first = join_hot(kinds, _alone(kinds), ["token"]).select("token", "content", F.col("many").alias("_many"), (F.col("n") > 1).alias("_more"), "r", "hot")
    again = join_hot(finer.drop("many"), first, ["token", "content"]).where(place.eqNullSafe(F.col("r"))).select("doc_id", "_th", "lo", "span", "anchor", "token", (F.col("_many") | F.col("_more")).alias("many"), "body", "hot")
    out.append(buckets(again.where("NOT hot").drop("hot"), TOKEN2))
    each = again.where("hot").drop("hot").mapInArrow(released(_windows), f"doc_id {id_type}, _th long, lo long, many boolean, w1 long, w2 long")
    twice = each.groupBy("w1", "w2").count().where("count > 1").select("w1", "w2")
    out.append(join_hot(each.where("NOT many"), twice, ["w1", "w2"]).select("doc_id", "_th", F.col("lo").alias("s"), F.expr(f"lo + {LENGTH}").alias("e")))
    result = out[0]
    for more in out[1:]:
        result = result.unionByName(more)
    return result


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (binary) of every document."""
    base = keyed(docs)
    id_type = dict(base.dtypes)["doc_id"]
    spans = repeats(base, id_type).groupBy("doc_id", "_th").agg(F.collect_list(F.struct("s", "e")).alias("_spans"))
    return on_key(base, spans, "left").mapInArrow(released(_cut), f"doc_id {id_type}, n_bytes long, n_removed long, n_spans long, kept binary")


def op3_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(texts: list[str | None]) -> list[tuple[int, int, int, str]]:
    """n_bytes, n_removed, n_spans, kept_sha256 of each text, by a dictionary of all substrings."""
    data = [(t or "").encode() for t in texts]
    seen: dict[bytes, int] = {}
    for d in data:
        for i in range(len(d) - LENGTH + 1):
            seen[d[i : i + LENGTH]] = seen.get(d[i : i + LENGTH], 0) + 1
    out = []
    for d in data:
        gone = [False] * len(d)
        for i in range(len(d) - LENGTH + 1):
            if seen[d[i : i + LENGTH]] > 1:
                gone[i : i + LENGTH] = [True] * LENGTH
        left = bytes(c for c, g in zip(d, gone, strict=True) if not g)
        out.append((len(d), sum(gone), sum(g and not h for g, h in zip(gone, [False, *gone], strict=False)), hashlib.sha256(left).hexdigest()))
    return out
