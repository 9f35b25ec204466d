"""Small numpy models over bounded samples, and the sampling itself."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from .shared import join_counted, settle


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def bounded(rows: DataFrame, key: str, per_class: int, seed: int) -> DataFrame:
    """About ``per_class`` rows of each value of ``key`` (all, where there are no more), chosen by a
    hash of doc_id; the number of rows per class is counted over all rows. The list of classes is
    broadcast if it is short."""
    counts = rows.groupBy(key).count().select(F.col(key).alias("__fl_class"), (F.lit(per_class) / F.col("count")).alias("__fl_share"))
    counts = settle(counts.filter("__fl_class IS NOT NULL"))
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(seed)), F.lit(1_000_003)) / F.lit(1_000_003.0)
    keyed = rows.filter(F.col(key).isNotNull()).withColumn("__fl_class", F.col(key))
    return join_counted(keyed, counts, "__fl_class", "inner").filter(draw < F.col("__fl_share")).drop("__fl_class", "__fl_share")


def crc_remainder(divisor: int) -> Column:
    """crc32 of doc_id as text, modulo ``divisor`` (null ids: null)."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % divisor


class Bags:
    """Sparse rows: feature numbers ``idx`` and values ``val``, row k from ptr[k] to ptr[k + 1]."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]]):
        self.ptr = np.concatenate([[0], np.cumsum([len(i) for i, _ in rows])]).astype(np.int64)
        self.idx = np.concatenate([i for i, _ in rows]) if rows else np.zeros(0, np.int64)
        self.val = np.concatenate([v for _, v in rows]).astype(np.float64) if rows else np.zeros(0)
        self.row = np.repeat(np.arange(len(rows)), np.diff(self.ptr))
        self.n = len(rows)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.val * w[self.idx], minlength=self.n)

    def back(self, g: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.idx, self.val * g[self.row], minlength=size)


def logistic(bags: Bags, y: np.ndarray, size: int, weight: np.ndarray | None = None, steps: int = 80, rate: float = 0.5, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Adagrad on the weighted logistic loss; returns weights and intercept."""
    w, b = np.zeros(size), 0.0
    gw, gb = np.full(size, 1e-6), 1e-6
    weight = np.ones(bags.n) if weight is None else weight
    for _ in range(steps):
        g = weight * (sigmoid(bags.dot(w) + b) - y) / max(1.0, weight.sum())
        d, e = bags.back(g, size) + decay * w, g.sum()
        gw += d * d
        gb += e * e
        w -= rate * d / np.sqrt(gw)
        b -= rate * e / np.sqrt(gb)
    return w, b


def dense_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 30) -> np.ndarray:
    """Newton steps on a ridge logistic regression; the last weight is the intercept."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = sigmoid(x @ w)
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w
