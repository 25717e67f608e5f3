"""Bounded labelled samples and a small logistic regression."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hash_share, q


def clear_labels(labels: DataFrame, doc_id: str, **flags: Column) -> DataFrame:
    """``(label_id, flag...)``: one row per id whose flags are known and agree in all its rows."""
    rows = labels.select(q(doc_id).alias("label_id"), *[c.cast("int").alias(k) for k, c in flags.items()])
    rows = rows.filter(F.col("label_id").isNotNull())
    for k in flags:
        rows = rows.filter(F.col(k).isin(0, 1))
    rows = rows.groupBy("label_id").agg(*[x for k in flags for x in (F.min(k).alias(k), F.max(k).alias(f"{k}_hi"))])
    for k in flags:
        rows = rows.filter(F.col(k) == F.col(f"{k}_hi"))
    return rows.select("label_id", *flags)


def sample_ids(labels: DataFrame, by: list[str], most: int, seed: int) -> tuple[DataFrame, dict[tuple, int]]:
    """At most ``most`` rows of ``labels`` for each combination of 0/1 flags, those of smallest hash of the id.

    Also the number of rows of each combination there are.
    """
    counts = {tuple(r[k] for k in by): r["count"] for r in labels.groupBy(*by).count().collect()}
    key = F.xxhash64(F.lit(seed), "label_id")
    out = labels.limit(0)
    for combo, n in sorted(counts.items()):
        part = labels
        for k, v in zip(by, combo, strict=True):
            part = part.filter(F.col(k) == v)
        out = out.unionByName(part.filter(hash_share(key, most, n)).orderBy(F.shiftrightunsigned(key, 1), "label_id").limit(most))
    return out, counts


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, l2: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Weights and, last, the intercept of a ridge logistic regression (Newton's method)."""
    x = np.hstack([x, np.ones((len(x), 1))])
    weight = np.ones(len(x)) if weight is None else weight
    ridge = np.full(x.shape[1], l2)
    ridge[-1] = 1e-3
    w = np.zeros(x.shape[1])

    def loss(v):
        z = x @ v
        return float((weight * (np.logaddexp(0, z) - y * z)).sum() + 0.5 * (ridge * v * v).sum())
    now = loss(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - y)) + ridge * w
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(hess, grad)
        size = 1.0
        while size > 1e-4 and loss(w - size * step) > now:
            size /= 2
        w = w - size * step
        new = loss(w)
        if now - new < 1e-7 * max(1.0, now):
            break
        now = new
    return w


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))
