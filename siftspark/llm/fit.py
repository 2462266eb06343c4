"""Small linear models in numpy, and the bounded samples that they are fitted on."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SPACE = 1 << 30
MOST_BROADCAST = 100_000  # labels whose rates go to every executor


def sample(rows: DataFrame, label: str, each: int, most_rows: int = 20_000, most_bytes: int = 256 << 20) -> tuple[DataFrame, dict]:
    """About `each` rows of every label, chosen by a hash of doc_id and text, and the label's number of rows.

    The counts cover all rows, and every label is learned. Where labels are many, or texts long, fewer rows
    of each are taken: about most_rows, and about most_bytes of text, in all."""
    spark = rows.sparkSession
    size = F.col("_size") if "_size" in rows.columns else F.octet_length("text")  # _size: made below a join, which then needs no texts
    sizes = rows.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"), F.avg(size).alias("size")).orderBy(label).collect()
    counts = {r[0]: r["n"] for r in sizes}
    if not counts:
        return rows.where("false"), {}
    each = max(1, min(each, most_rows // (2 * len(counts)), int(most_bytes / (2 * sum(r["size"] + 1 for r in sizes)))))
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(_SPACE))
    rate = {k: int(min(1.0, 1.2 * each / n) * _SPACE) for k, n in counts.items()}
    rates = spark.createDataFrame(list(rate.items()), f"_label {dict(rows.dtypes)[label]}, _rate long")
    some = rows.where(draw < max(rate.values()))  # reaches below whatever join made rows
    wanted = some.join(F.broadcast(rates) if len(rate) <= MOST_BROADCAST else rates, F.col(label) == F.col("_label")).where(draw < F.col("_rate")).drop("_label", "_rate")
    return wanted.orderBy(draw, "doc_id").limit(2 * each * len(counts)), counts


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def linear_svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, steps: int = 300) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear support vector machine (squared hinge, y is 1 or -1), by accelerated gradient descent."""
    x, y = np.asarray(x, np.float32), np.asarray(y, np.float32)
    n, d = x.shape
    w, b = np.zeros(d, np.float32), 0.0
    vw, vb, t = w.copy(), b, 1.0
    weight = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1))
    rate = np.float32(1 / (1 / c + 2 * (1 + float((x**2).sum(1).max(initial=1.0)))))
    for _ in range(steps):
        slack = (np.maximum(0, 1 - y * (x @ vw + np.float32(vb))) * weight * y).astype(np.float32)
        gw, gb = vw * np.float32(10 / c / n) - 2 * (x.T @ slack), -2 * float(slack.sum())
        nw, nb = vw - rate * gw, vb - rate * gb
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        go = np.float32((t - 1) / nt)
        vw, vb = nw + go * (nw - w), nb + float(go) * (nb - b)
        w, b, t = nw, nb, nt
    return w.astype(np.float64), float(b)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, l2: float = 1e-3, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression, by Newton's method where x is narrow, else by accelerated descent."""
    n, d = x.shape
    weight = np.full(n, 1 / max(n, 1)) if weight is None else weight / weight.sum()
    if d <= 64:
        xb = np.concatenate([x, np.ones((n, 1))], 1).astype(np.float64)
        reg = np.concatenate([np.full(d, l2), [1e-6]])
        w = np.zeros(d + 1)
        for _ in range(40):
            p = sigmoid(xb @ w)
            g = xb.T @ (weight * (p - y)) + reg * w
            h = (xb * (weight * p * (1 - p))[:, None]).T @ xb + np.diag(reg)
            step = np.linalg.solve(h, g)
            w -= step * min(1.0, 5 / (np.abs(step).max() + 1e-12))
        return w[:-1], float(w[-1])
    x = np.asarray(x, np.float32)
    w, b = np.zeros(d, np.float32), 0.0
    vw, vb, t = w, b, 1.0
    rate = np.float32(1 / (0.25 * float((((x**2).sum(1) + 1) * weight).sum()) + l2))
    for _ in range(steps):
        miss = (weight * (sigmoid(x @ vw + vb) - y)).astype(np.float32)
        nw, nb = vw - rate * (x.T @ miss + np.float32(l2) * vw), vb - float(rate) * float(miss.sum())
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        go = np.float32((t - 1) / nt)
        vw, vb = nw + go * (nw - w), nb + float(go) * (nb - b)
        w, b, t = nw, nb, nt
    return w.astype(np.float64), float(b)
