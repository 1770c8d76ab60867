"""Small numeric fits on bounded samples and the sampling that goes with them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null ids fall in no class."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def labelled_sample(labels: DataFrame, label: str, rows: int, learn: Column) -> DataFrame:
    """At most ``rows`` rows ``doc_id, label`` that may be learnt from, those with the least hashes: a bounded, repeatable
    sample that does not depend on partitions. Held by the driver, so that it can be broadcast."""
    good = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).where(learn)
    picked = (good.groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("label"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).collect())
    return labels.sparkSession.createDataFrame([(r[0], r[1]) for r in picked], f"doc_id {labels.schema['doc_id'].dataType.simpleString()}, label int")


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, penalty: float = 1.0, rounds: int = 12) -> np.ndarray:
    """Coefficients (intercept last) of a logistic regression on soft labels, by Newton steps with a ridge penalty."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    weight = np.ones(len(x)) if weight is None else weight
    ridge = np.full(x.shape[1], penalty)
    ridge[-1] = 1e-6
    for _ in range(rounds):
        p = sigmoid(x @ w)
        grad = x.T @ (weight * (p - y)) + ridge * w
        curve = (x * (weight * np.maximum(p * (1 - p), 1e-4))[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(curve, grad)
        w = w - step * min(1.0, 4 / max(1e-12, np.abs(step).max()))
    return w


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def apply(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]
