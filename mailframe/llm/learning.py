"""What the trained operators share: bounded samples of labelled rows, and calibration."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows with a label that a model is fitted on, at most (about: they are chosen by a hash of the id,
#: whose rate is set from the counts of all labelled rows).
SAMPLE_ROWS = 4000


def chosen(key: Column, rate: Column) -> Column:
    """True for about `rate` of the keys, the same in each run."""
    return F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(1 << 30)) < rate * F.lit(float(1 << 30))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, text, y of about `rows` labelled doc_ids, the labels balanced as far as they go.

    learn: which doc_ids may be learned from. Each label value gets half of the rows. Null ids and labels
    are left out; of several labels of one id the greatest counts, of several texts of one id the least, so
    repeated rows can't make the sample longer.
    """
    known = labels.select("doc_id", F.col(label).cast("int").alias("y")).filter(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull()).filter(learn)
    known = known.groupBy("doc_id").agg(F.max("y").alias("y"))
    counts = {r.y: r["count"] for r in known.groupBy("y").count().collect()}
    rate = F.when(F.col("y") == 1, F.lit(min(1.0, rows / 2 / max(1, counts.get(1, 0))))).otherwise(F.lit(min(1.0, rows / 2 / max(1, counts.get(0, 0)))))
    few = known.filter(chosen(F.col("doc_id"), rate))
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(few), "doc_id")  # bounded by `rows`
    return found.groupBy("doc_id", "y").agg(F.min("text").alias("text")).select("doc_id", "text", "y")


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def platt(score: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1e-3) -> tuple[float, float]:
    """a, b so that sigmoid(a score + b) fits y, by Newton steps; (1, 0) if y is of one kind."""
    if len(y) < 10 or y.min() == y.max():
        return 1.0, 0.0
    weight = np.ones(len(y)) if weight is None else weight
    x, beta = np.stack([score, np.ones(len(y))], axis=1), np.array([1.0, 0.0])
    for _ in range(50):
        p = sigmoid(x @ beta)
        grad = x.T @ (weight * (p - y)) + ridge * (beta - [1.0, 0.0])
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(2)
        step = np.linalg.solve(hess, grad)
        beta = beta - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return (float(beta[0]), float(beta[1])) if beta[0] > 0 else (1.0, 0.0)
