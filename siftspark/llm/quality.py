"""Quality by a byte-level convolutional network in numpy.

Learned embeddings of bytes go through learned filters, WIDTH bytes wide and
STRIDE apart. Chunks of CHUNK_BYTES overlap by half and cover the whole text;
each filter is max-pooled over a chunk, and a linear layer makes the pooled
values the chunk's log-odds. The mean, largest and smallest of a text's chunks,
and the share of chunks above zero, are combined by a logistic regression into
one probability.

Learned from at most 2 * EACH labelled texts of a label (fewer where they are long:
fit.sample, MOST_BYTES in all), chosen by hash. Network and combination see all
chunks of each: a step of Adam draws texts of both labels, then any chunk of each.
Embedding and filters collapse into one table by byte and place in the filter,
which goes to the executors with the task. Texts are scored whole, SLICE bytes at
a time, with the same result as in one piece.

Defined cases: null and empty texts are one chunk of zeros; where nothing can be
learned the score is the share of label 1 (0.5 without labels); rows that repeat
get the same result; null ids are held out or not as the empty text is; other
columns aren't read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytes_kernel import buffers, parts, ranges
from .common import crc_mod, table
from .fit import logistic, sample, sigmoid

WIDTH, STRIDE, FILTERS, EMBED = 8, 4, 16, 6
CHUNK_BYTES = 256
HALF = CHUNK_BYTES // STRIDE // 2
EACH, STEPS, BATCH, MOST_BYTES = 600, 500, 256, 64 << 20
FOLDS, HELD = 3, 1
SLICE = 1 << 17
GRID = 1 << 20


def _padded(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts from multiples of half a chunk, with a filter's width of zeros or more between; and the half chunks that each has."""
    halves = -(-(sizes + WIDTH) // (HALF * STRIDE))
    first = np.cumsum(halves) - halves
    out = np.zeros(int(halves.sum()) * HALF * STRIDE + WIDTH, np.uint8)
    out[ranges(first * HALF * STRIDE, sizes)] = data[ranges(starts, sizes)]
    return out, halves


class Network:
    def __init__(self, seed: int = 7) -> None:
        r = np.random.default_rng(seed)
        self.p = {"e": r.normal(0, 0.5, (256, EMBED)), "w": r.normal(0, (WIDTH * EMBED) ** -0.5, (WIDTH * EMBED, FILTERS)), "b": np.zeros(FILTERS), "v": r.normal(0, FILTERS**-0.5, FILTERS), "c": np.zeros(1)}
        self.head: tuple[np.ndarray, float] | None = None
        self.share = 0.5

    def fit(self, texts: list[bytes], y: np.ndarray, seed: int = 7) -> None:
        """Adam on the chunks of texts with labels y; a step draws texts, then a chunk of each."""
        sizes = np.array([len(t) for t in texts])
        data, halves = _padded(np.frombuffer(b"".join(texts), np.uint8), np.cumsum(sizes) - sizes, sizes)
        data = np.concatenate([data, np.zeros(CHUNK_BYTES, np.uint8)])
        first, count = np.cumsum(halves) - halves, np.maximum(halves - 1, 1)
        inside = np.arange(CHUNK_BYTES + WIDTH)
        r = np.random.default_rng(seed)
        p = self.p
        m = {k: np.zeros_like(v) for k, v in p.items()}
        s = {k: np.zeros_like(v) for k, v in p.items()}
        places = np.arange(CHUNK_BYTES // STRIDE)[:, None] * STRIDE + np.arange(WIDTH)
        sides = [np.flatnonzero(y == 0), np.flatnonzero(y == 1)]
        for step in range(1, STEPS + 1):
            pick = np.concatenate([r.choice(side, BATCH // 2) for side in sides])
            at = (first[pick] + (r.random(len(pick)) * count[pick]).astype(np.int64)) * HALF * STRIDE
            end = (first[pick] + halves[pick]) * HALF * STRIDE
            chunk = np.where(at[:, None] + inside < end[:, None], data[at[:, None] + inside], 0)
            x, t = chunk[:, places], y[pick]
            emb = p["e"][x].reshape(BATCH, len(places), WIDTH * EMBED)
            conv = emb @ p["w"]
            top = conv.argmax(1)
            most = np.take_along_axis(conv, top[:, None, :], 1)[:, 0] + p["b"]
            pooled = np.maximum(most, 0)
            d = (sigmoid(pooled @ p["v"] + p["c"]) - t) / BATCH
            g = {"v": pooled.T @ d, "c": np.array([d.sum()])}
            dm = d[:, None] * p["v"] * (most > 0)
            g["b"] = dm.sum(0)
            at = np.take_along_axis(emb, top[:, :, None], 1)  # batch, filter, width * embed
            g["w"] = np.einsum("bfk,bf->kf", at, dm)
            de = np.einsum("bf,kf->bfk", dm, p["w"]).reshape(-1, EMBED)
            g["e"] = np.zeros_like(p["e"])
            np.add.at(g["e"], np.take_along_axis(x, top[:, :, None], 1).reshape(-1), de)
            for k in p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                s[k] = 0.999 * s[k] + 0.001 * g[k] ** 2
                p[k] = p[k] - 0.01 * (1 - 0.9 * step / STEPS) * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)

    def table(self) -> np.ndarray:
        """What each byte at each place of a filter adds: (WIDTH, 256, FILTERS)."""
        return np.einsum("xe,tef->txf", self.p["e"], self.p["w"].reshape(WIDTH, EMBED, FILTERS)).astype(np.float32)

    def chunk_odds(self, x: np.ndarray, ends: np.ndarray, adds: np.ndarray) -> np.ndarray:
        """Log-odds of the chunks that begin at each half chunk of x but the last; ends has the last half chunk of each text that ends here.

        A text's last place would reach into the next one and is that before it."""
        n = (len(x) - WIDTH) // STRIDE
        conv = adds[0].take(x[: n * STRIDE : STRIDE], axis=0)
        for k in range(1, WIDTH):
            conv += adds[k].take(x[k : k + n * STRIDE : STRIDE], axis=0)
        last = ends * HALF + HALF - 1
        conv[last] = conv[last - 1]
        half = conv.reshape(-1, HALF, FILTERS).max(1)
        both = np.maximum(half, np.concatenate([half[1:], half[-1:]]))
        both[ends] = half[ends]
        z = (np.maximum(both + self.p["b"], 0) * self.p["v"]).sum(1) + self.p["c"]
        return np.round(np.clip(z, -1e6, 1e6) * GRID).astype(np.int64)  # whole numbers: their sum doesn't depend on slices


def _gather(net: Network, adds: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """What the combination sees of each text: mean, largest, smallest, share above zero of its chunks."""
    n = len(offsets) - 1
    total, above, chunks = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    most, least = np.full(n, np.iinfo(np.int64).min), np.full(n, np.iinfo(np.int64).max)

    def count(rows, z, at):
        total[rows] += np.add.reduceat(z, at)
        above[rows] += np.add.reduceat((z > 0).astype(np.int64), at)
        chunks[rows] += np.diff(np.append(at, len(z)))
        most[rows] = np.maximum(most[rows], np.maximum.reduceat(z, at))
        least[rows] = np.minimum(least[rows], np.minimum.reduceat(z, at))

    step = SLICE // (HALF * STRIDE)
    for a, b in parts(offsets, SLICE):
        x, halves = _padded(data[offsets[a] : offsets[b]], offsets[a:b] - offsets[a], np.diff(offsets[a : b + 1]))
        if b - a > 1 or halves[0] <= step + 1:
            ends = np.cumsum(halves) - 1
            z = net.chunk_odds(x, ends, adds)
            keep = np.ones(len(z), bool)
            keep[ends[halves > 1]] = False  # the last half chunk is in the chunk before it
            own = np.maximum(halves - 1, 1)
            count(np.arange(a, b), z[keep], np.cumsum(own) - own)
        else:
            for h in range(0, int(halves[0]) - 1, step):  # slices share a half chunk: chunks that begin in h .. e - 1
                e = min(h + step, int(halves[0]) - 1)
                ends = np.array([e - h] if e == halves[0] - 1 else [], np.int64)
                z = net.chunk_odds(x[h * HALF * STRIDE : (e + 1) * HALF * STRIDE + WIDTH], ends, adds)
                count(np.array([a]), z[: e - h], np.zeros(1, np.int64))
    return np.clip(np.stack([total / GRID / chunks, most / GRID, least / GRID, above / chunks], 1), -12, 12)


def train(docs: DataFrame, labels: DataFrame, each: int = EACH) -> Network:
    """Learn from labelled rows that aren't held out."""
    marks = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg(F.min("quality").cast("int").alias("label"))
    known = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("_size")).where(crc_mod(FOLDS) != HELD).join(marks, "doc_id")
    chosen, counts = sample(known, "label", each, most_bytes=MOST_BYTES)
    net = Network()
    if counts:
        net.share = counts.get(1, 0) / sum(counts.values())
    if len(counts) < 2:
        return net
    rows = chosen.select("label", F.encode("text", "UTF-8").alias("text")).collect()
    texts, label = [bytes(r["text"]) for r in rows], np.array([r["label"] for r in rows], float)
    if len(set(label)) < 2:
        return net
    net.fit(texts, label)
    x = _gather(net, net.table(), np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
    weight = np.where(label == 1, counts[1] / max((label == 1).sum(), 1), counts[0] / max((label == 0).sum(), 1))
    net.head = logistic(x, label, weight, 1e-3)
    return net


def score(docs: DataFrame, net: Network) -> DataFrame:
    """docs (doc_id, held_out, text) as doc_id, held_out, score, predicted."""
    adds = net.table()

    def run(batches):
        for batch in batches:
            if net.head is None:
                p = np.full(batch.num_rows, net.share)
            else:
                p = sigmoid(_gather(net, adds, *buffers(batch.column("text"))) @ net.head[0] + net.head[1])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(p)], names=["doc_id", "held_out", "score"])

    out = docs.select("doc_id", "held_out", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op10_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = train(docs, table(spark, sf_dir, "labels"))
    return score(docs.select("doc_id", "text", (crc_mod(FOLDS) == HELD).alias("held_out")), net)
