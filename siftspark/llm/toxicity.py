"""Toxicity by a chain of classifiers.

Categories are predicted one after the other by logistic regressions over the
words that a text holds and the heads of its words (letters, lower case in
ASCII; the first HEADS bytes), each as whether it occurs at least once, twice
and so on (LEVELS).
Each later model also gets the log-odds of the categories before it; for its
training those come from out-of-fold predictions, so that it learns how far the
earlier models can be trusted on texts that they haven't seen. The same
predictions place the last model's cut, a score of 0.5, where F1 is best.

`labels` marks texts as toxic or not and as good or bad. The chain's categories
are made of these: abuse in text of bad quality, abuse in good text, abuse.

Learned from at most 2 * EACH labelled texts of each combination of labels (fewer
where they are long: fit.sample, MOST_BYTES in all), chosen by hash; the vocabulary are the features whose presence depends most on a
label (chi-square at least LEAST_CHI2, in at least LEAST_DOCS of the texts, at
most VOCABULARY). The models are a few tables of numbers and go to the executors
with the task; every text is scored whole where it lies.

Defined cases: null and empty texts hold no word and get the chain's score for
that; where no category has both labels every score is 0; rows that repeat get
the same result; other columns aren't read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytes_kernel import buffers, cuts, mixed, parts, string_hashes
from .common import crc_mod, table
from .fit import logistic, sample, sigmoid

EACH = 1000
HEADS, LEVELS = (4, 6, 8), (1, 2, 4)
VOCABULARY = 2000
LEAST_CHI2, LEAST_DOCS = 12.0, 4
HELD_OUT_OF, K = 5, 5
MOST_BYTES = 64 << 20
CHUNK = 1 << 18
_LETTER = np.zeros(256, bool)
_LETTER[128:] = True
_FOLD = np.arange(256, dtype=np.uint8)
for _c in range(26):
    _LETTER[ord("a") + _c] = _LETTER[ord("A") + _c] = True
    _FOLD[ord("A") + _c] = ord("a") + _c

#: Category and the labels that make it, in the order of the chain.
CATEGORIES = (("abuse_in_bad_text", "toxic = 1 AND quality = 0"), ("abuse_in_good_text", "toxic = 1 AND quality = 1"), ("toxic", "toxic = 1"))


def word_hashes(data: np.ndarray, offsets: np.ndarray):
    """For runs of rows: the first row, hashes of each word and of its heads, and their rows counted from the first."""
    for a, b in parts(offsets, CHUNK):
        x, starts = _FOLD[data[offsets[a] : offsets[b]]], offsets[a : b + 1] - offsets[a]
        out, rows = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for s, e in cuts(x, CHUNK, _LETTER) if b - a == 1 else [(0, len(x))]:  # a long text in pieces, between words
            y = x[s:e]
            letter = _LETTER[y]
            edge = np.zeros(len(y) + 1, bool)
            edge[starts[(starts >= s) & (starts <= e)] - s] = True
            begin = np.flatnonzero(letter & (edge[:-1] | np.concatenate([[True], ~letter[:-1]])[: len(y)]))
            end = np.flatnonzero(letter & (edge[1:] | np.concatenate([~letter[1:], [True]])[: len(y)])) + 1
            row = np.searchsorted(starts, begin + s, side="right") - 1
            out.append(string_hashes(y, begin, end))
            rows.append(row)
            for k in HEADS:
                long = end - begin > k
                out.append(string_hashes(y, begin[long], begin[long] + k) + np.uint64(k))
                rows.append(row[long])
        yield a, b, np.concatenate(out), np.concatenate(rows)


def leveled(h: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of hashes that occur so often, and which hash each is of."""
    at = [np.flatnonzero(counts >= k) for k in LEVELS]
    return np.concatenate([mixed(h[i] + np.uint64(k)) for k, i in zip(LEVELS, at, strict=True)]), np.concatenate(at)


def _collect(batches):
    """The distinct words and heads of each text and their counts, as bytes."""
    for batch in batches:
        data, offsets = buffers(batch.column("text"))
        for a, b, h, row in word_hashes(data, offsets):
            order = np.argsort(row, kind="stable")
            ends = np.cumsum(np.bincount(row, minlength=b - a))
            words = []
            for r in range(b - a):
                own, n = np.unique(h[order[(ends[r - 1] if r else 0) : ends[r]]], return_counts=True)
                words.append(own.tobytes() + np.minimum(n, max(LEVELS)).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("toxic").slice(a, b - a), batch.column("quality").slice(a, b - a), pa.array(words, pa.binary())], names=["toxic", "quality", "words"])


def _best_cut(odds: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The log-odds, between two unseen texts, at which a cut has the best F1."""
    order = np.argsort(-odds)
    hits, taken = np.cumsum((y * weight)[order]), np.cumsum(weight[order])
    best = int(np.argmax(2 * hits / (taken + (y * weight).sum())))
    return float((odds[order[best]] + odds[order[min(best + 1, len(order) - 1)]]) / 2)


class Chain:
    """Models of the categories in order; each has weights of words, of the log-odds before it, and a bias."""

    def __init__(self, sets: list[bytes], labels: np.ndarray, weight: np.ndarray) -> None:
        n = len(sets)
        size = [len(s) // 9 for s in sets]
        base = np.concatenate([np.frombuffer(s, np.uint64, k) for s, k in zip(sets, size, strict=True)]) if n else np.zeros(0, np.uint64)
        counts = np.concatenate([np.frombuffer(s, np.uint8, offset=8 * k) for s, k in zip(sets, size, strict=True)]) if n else np.zeros(0, np.uint8)
        flat, of = leveled(base, counts)
        owner = np.repeat(np.arange(n), size)[of]
        words, col = np.unique(flat, return_inverse=True)
        df = np.bincount(col, minlength=len(words))
        best = np.zeros(len(words))
        for k in range(labels.shape[1]):
            pos = labels[:, k].sum()
            if 0 < pos < n:
                a = np.bincount(col, weights=labels[owner, k], minlength=len(words))
                dep = n * (a * (n - pos - (df - a)) - (pos - a) * (df - a)) ** 2 / np.maximum(pos * (n - pos) * df * (n - df), 1)
                best = np.maximum(best, dep)
        best[(df < LEAST_DOCS) | (best < LEAST_CHI2)] = 0
        keep = np.argsort(-best, kind="stable")[:VOCABULARY]
        self.words = np.sort(words[keep[best[keep] > 0]])
        self.base = np.unique(base[of[np.isin(flat, self.words)]])
        x = np.zeros((n, len(self.words)), np.float32)
        at = np.searchsorted(self.words, flat)
        hit = np.flatnonzero((at < len(self.words)) & (self.words[np.minimum(at, len(self.words) - 1)] == flat)) if len(self.words) else np.zeros(0, int)
        x[owner[hit], at[hit]] = 1
        fold = np.arange(n) % K
        self.models, odds = [], np.zeros((n, 0), np.float32)
        for k in range(labels.shape[1]):
            y = labels[:, k]
            z = np.concatenate([x, odds], 1)
            if not 0 < y.sum() < n:
                self.models.append((np.zeros(z.shape[1]), -40.0))
                odds = np.concatenate([odds, np.full((n, 1), -8, np.float32)], 1)
                continue
            unseen = np.zeros(n)
            for f in range(K):
                w, b = logistic(z[fold != f], y[fold != f], weight[fold != f], 2e-5)
                unseen[fold == f] = z[fold == f] @ w + b
            w, b = logistic(z, y, weight, 2e-5)
            if k == labels.shape[1] - 1:
                b -= _best_cut(unseen, y, weight)
            self.models.append((w, b))
            odds = np.concatenate([odds, np.clip(unseen, -8, 8).astype(np.float32)[:, None]], 1)

    def predict(self, rows: int, h: np.ndarray, row: np.ndarray) -> np.ndarray:
        """A probability for each row and category, for words h of rows."""
        v, m = len(self.words), len(self.base)
        if v:
            at = np.searchsorted(self.base, h)
            hit = np.flatnonzero(self.base[np.minimum(at, m - 1)] == h)
            own, n = np.unique(row[hit] * m + at[hit], return_counts=True)
            f, of = leveled(self.base[own % m], n)
            at = np.searchsorted(self.words, f)
            hit = np.flatnonzero(self.words[np.minimum(at, v - 1)] == f)
            r, c = own[of[hit]] // m, at[hit]
        else:
            r = c = np.zeros(0, int)
        odds = np.zeros((rows, 0))
        for w, b in self.models:
            z = b + odds @ w[v:] + np.bincount(r, weights=w[:v][c], minlength=rows)
            odds = np.concatenate([odds, np.clip(z, -8, 8)[:, None]], 1)
        return sigmoid(odds)


def train(docs: DataFrame, labels: DataFrame, each: int = EACH) -> Chain:
    """Learn from labelled rows that aren't held out."""
    marks = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.max(F.coalesce("quality", F.lit(1))).alias("quality"))
    known = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("_size")).where(crc_mod(HELD_OUT_OF) != 0).join(marks, "doc_id").withColumn("_kind", F.col("toxic") * 2 + F.col("quality"))
    chosen, counts = sample(known, "_kind", each, most_bytes=MOST_BYTES)
    rows = chosen.select(F.col("toxic").cast("int").alias("toxic"), F.col("quality").cast("int").alias("quality"), "text").mapInArrow(_collect, "toxic int, quality int, words binary").collect()
    toxic, quality = np.array([r["toxic"] for r in rows], int), np.array([r["quality"] for r in rows], int)
    made = np.stack([(toxic == 1) & (quality == 0), (toxic == 1) & (quality == 1), toxic == 1], 1).astype(float) if rows else np.zeros((0, 3))
    kind = toxic * 2 + quality
    weight = np.ones(len(rows))
    for k, n in counts.items():
        if (kind == k).any():
            weight[kind == k] = n / (kind == k).sum()
    return Chain([bytes(r["words"]) for r in rows], made, weight)


def score(docs: DataFrame, chain: Chain) -> DataFrame:
    """docs (doc_id, held_out, text) as doc_id, held_out, a probability p_<category> for each, score (the last), predicted (0 or 1)."""
    names = [f"p_{c}" for c, _ in CATEGORIES]

    def run(batches):
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            for a, b, h, row in word_hashes(data, offsets):
                p = chain.predict(b - a, h, row)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), batch.column("held_out").slice(a, b - a), *[pa.array(p[:, k]) for k in range(p.shape[1])]], names=["doc_id", "held_out", *names])

    out = docs.select("doc_id", "held_out", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, held_out boolean, " + ", ".join(f"{c} double" for c in names))
    return out.withColumn("score", F.col(names[-1])).withColumn("predicted", (F.col("score") >= 0.5).cast("int")).withColumn("toxic", F.col("score") >= 0.5)


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    chain = train(docs, table(spark, sf_dir, "labels"))
    return score(docs.select("doc_id", "text", (crc_mod(HELD_OUT_OF) == 0).alias("held_out")), chain)
