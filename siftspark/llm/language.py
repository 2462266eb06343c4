"""Language identification by hierarchical discrimination.

Letters of the whole text, as bytes, give hashed trigram counts (DIMENSIONS of
them), taken as square roots of shares. Linear support vector machines first
tell language families apart, one family against another; within the winning
family, one-versus-one machines separate its languages. The score is the least
sigmoid of the winning pairwise margins on the way.

Learned from at most 2 * EACH texts of a language, fewer where languages are many
(fit.sample: 20000 texts and 256 MB in all), chosen by hash among all rows whose
language is known and whose fold is not held out. Every language is learned.
Prediction sees the text alone. Batches of texts are scored where they lie, in pieces of CHUNK bytes.

Defined cases: a text that is null or has no letter is 'und' with score 0; where
nothing can be learned every text is 'und'; rows that repeat get the same
result; ties between languages go to the first in alphabetical order; null ids
are held out or not as the empty text is; other columns aren't read and pass
through, but for columns called lang_pred and score, whose place the result takes.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytes_kernel import buffers, pieces
from .common import crc_mod, packed, table, unpacked
from .fit import linear_svm, sample, sigmoid

DIMENSIONS = 2048
EACH = 500
CHUNK = 1 << 19
FOLDS = 5
SCALE = 4.0

#: Families of languages by their usual codes; a language not listed is a family of its own.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "fo", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv", "yi"),
    "romance": ("ca", "es", "fr", "gl", "it", "la", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
}
_OF = {code: family for family, codes in FAMILIES.items() for code in codes}

_CODE = np.zeros(256, np.uint32)
for _i in range(26):
    _CODE[ord("a") + _i] = _CODE[ord("A") + _i] = _i + 1
_CODE[128:] = np.arange(27, 155)


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of unit length for each text."""
    n = len(offsets) - 1
    out = np.zeros((n, DIMENSIONS), np.float32)
    for rows, begin, end, starts in pieces(offsets, CHUNK, 2):
        if end - begin < 3:
            continue
        c = _CODE[data[begin:end]]
        tri = (c[:-2] * np.uint32(24_137_569) + c[1:-1] * np.uint32(4_913_017) + c[2:] * np.uint32(786_433)) * np.uint32(2_654_435_761) >> np.uint32(32 - 11)
        use = (c[1:-1] > 0) & ((c[:-2] > 0) | (c[2:] > 0))
        if len(rows) > 1:
            at = np.searchsorted(starts, np.arange(end - begin - 2), side="right") - 1
            bound = np.append(starts[1:], end - begin)
            use &= np.arange(end - begin - 2) + 3 <= bound[at]
            out[rows[0] : rows[-1] + 1] += np.bincount((at * DIMENSIONS + tri)[use], minlength=len(rows) * DIMENSIONS).reshape(len(rows), DIMENSIONS).astype(np.float32)
        else:
            out[rows[0]] += np.bincount(tri[use], minlength=DIMENSIONS).astype(np.float32)
    out /= np.maximum(out.sum(1, keepdims=True), 1)
    return np.sqrt(out, out=out)


def _vectors(batches):
    for batch in batches:
        x = features(*buffers(batch.column("text")))
        yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array([r.tobytes() for r in x], pa.binary())], names=["label", "x"])


class Pairs:
    """One-versus-one machines between labels, and the vote among them."""

    def __init__(self, x: np.ndarray, y: np.ndarray) -> None:
        self.labels = sorted(set(y.tolist()))
        self.pairs = list(combinations(range(len(self.labels)), 2))
        self.w, self.b = np.zeros((x.shape[1], len(self.pairs)), np.float32), np.zeros(len(self.pairs), np.float32)
        for k, (i, j) in enumerate(self.pairs):
            some = (y == self.labels[i]) | (y == self.labels[j])
            self.w[:, k], self.b[k] = linear_svm(x[some], np.where(y[some] == self.labels[i], 1.0, -1.0))

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the winning label, and its score."""
        n, m = len(x), len(self.labels)
        p = sigmoid(SCALE * (x @ self.w + self.b))
        least, votes = np.ones((n, m)), np.zeros((n, m))
        for k, (i, j) in enumerate(self.pairs):
            for label, q in ((i, p[:, k]), (j, 1 - p[:, k])):
                least[:, label] = np.minimum(least[:, label], q)
                votes[:, label] += q
        best = votes.argmax(1)
        return best, least[np.arange(n), best]


class Hierarchy:
    """A vote among families, then one among the languages of the winner."""

    def __init__(self, x: np.ndarray, y: np.ndarray) -> None:
        family = np.array([_OF.get(v, v) for v in y])
        self.families = Pairs(x, family)
        self.within = [Pairs(x[family == f], y[family == f]) for f in self.families.labels]

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        family, score = self.families.predict(x)
        lang = np.empty(len(x), object)
        for f, pairs in enumerate(self.within):
            if len(at := np.flatnonzero(family == f)):
                best, inner = pairs.predict(x[at])
                lang[at], score[at] = np.array(pairs.labels, object)[best], np.minimum(score[at], inner)
        return lang, score


def train(docs: DataFrame, each: int = EACH) -> Hierarchy | None:
    """Learn from rows of docs (doc_id, text, lang) that aren't held out."""
    known = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.col("lang").alias("label")).where((crc_mod(FOLDS) != 0) & F.col("lang").isNotNull() & F.rlike("text", F.lit(r"\p{L}")))
    chosen, _ = sample(known, "label", each)
    rows = chosen.select("label", "text").mapInArrow(_vectors, "label string, x binary").collect()
    if not rows:
        return None
    return Hierarchy(np.frombuffer(b"".join(bytes(r["x"]) for r in rows), np.float32).reshape(len(rows), DIMENSIONS), np.array([r["label"] for r in rows]))


def identify(docs: DataFrame, model: Hierarchy | None) -> DataFrame:
    """docs with lang_pred and score. Only texts go to the Python workers, and only the two values come back."""

    @F.arrow_udf(T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))
    def told(text: pa.Array) -> pa.Array:
        lang, score = np.full(len(text), "und", object), np.zeros(len(text))
        if model is not None:
            for a in range(0, len(text), 256):
                x = features(*buffers(text.slice(a, 256)))
                lang[a : a + len(x)], score[a : a + len(x)] = model.predict(x)
        return pa.StructArray.from_arrays([pa.array(lang.tolist(), pa.string()), pa.array(score)], ["lang_pred", "score"])

    out = docs.select(packed(docs, "lang_pred", "score"), F.coalesce(F.rlike("text", F.lit(r"\p{L}")), F.lit(False)).alias("_letter"), told("text").alias("_told"))
    return out.select(*unpacked(docs, "lang_pred", "score"), F.when(F.col("_letter"), F.col("_told.lang_pred")).otherwise("und").alias("lang_pred"), F.when(F.col("_letter"), F.col("_told.score")).otherwise(0.0).alias("score"))


def op4_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs)
    return identify(docs.select("doc_id", "text", (crc_mod(FOLDS) == 0).alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score")
