"""Sparse logistic regression for bounded samples, and samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bounded(df: DataFrame, key: str, rows: int, seed: int) -> DataFrame:
    """At most ``rows`` rows, by a seeded hash of ``key``. Where there are many more, the hash first
    leaves about four times as many, so that no task sends its own ``rows`` rows."""
    parts = 2**30
    h = F.xxhash64(F.lit(seed), key)
    share = 4 * rows / max(1, df.count())
    if share < 1:
        df = df.filter(F.pmod(h, F.lit(parts)) < int(share * parts))
    return df.orderBy(h, key).limit(rows)


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, columns: list, rows: int, seed: int) -> DataFrame:
    """``columns`` of ``docs`` joined to at most ``rows`` rows of ``labels``; that bound is what makes the broadcast safe."""
    few = bounded(labels.dropDuplicates([id_col]), id_col, rows, seed)
    return docs.select(F.col(id_col).cast("long").alias(id_col), *columns).join(F.broadcast(few), id_col)


class Logistic:
    """Weights over named features, fitted to soft labels by Adam with an L2 penalty."""

    def __init__(self, weights: dict, bias: float):
        self.weights, self.bias = weights, bias

    @classmethod
    def fit(cls, rows: list[dict], targets, *, counts=None, l2: float = 1e-3, steps: int = 300, rate: float = 0.1) -> Logistic:
        import numpy as np

        names = sorted({k for r in rows for k in r})
        at = {k: i for i, k in enumerate(names)}
        row = np.fromiter((i for i, r in enumerate(rows) for _ in r), np.int64)
        col = np.fromiter((at[k] for r in rows for k in r), np.int64)
        val = np.fromiter((v for r in rows for v in r.values()), np.float64)
        y = np.asarray(targets, np.float64)
        weight = np.ones(len(rows)) if counts is None else np.asarray(counts, np.float64)
        weight = weight / max(weight.sum(), 1e-9)
        w, b = np.zeros(len(names)), 0.0
        m, s, mb, sb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
        for t in range(1, steps + 1):
            z = np.bincount(row, val * w[col], len(rows)) + b if len(row) else np.full(len(rows), b)
            r = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weight
            g = np.bincount(col, r[row] * val, len(names)) + l2 * w if len(row) else l2 * w
            gb = r.sum()
            m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
            mb, sb = 0.9 * mb + 0.1 * gb, 0.99 * sb + 0.01 * gb * gb
            c1, c2 = 1 - 0.9**t, 1 - 0.99**t
            w = w - rate * (m / c1) / (np.sqrt(s / c2) + 1e-8)
            b -= rate * (mb / c1) / (sb / c2 + 1e-16) ** 0.5
        return cls({k: float(w[i]) for k, i in at.items() if abs(w[i]) > 1e-6}, float(b))

    def logit(self, row: dict) -> float:
        return self.bias + sum(self.weights.get(k, 0.0) * v for k, v in row.items())
