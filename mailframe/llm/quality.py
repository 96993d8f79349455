"""Quality by supervised subword embeddings.

Hashed words, character n-grams (orders 3 and 4) and repetition marks (is a word the one before it, or
the one before that) have learned vectors; a document is the average of the means of these three
kinds; a softmax over the two labels follows. Vectors and
softmax are fitted together by stochastic gradient descent in numpy, on a bounded sample of labelled
rows; the output is calibrated on rows kept apart. Texts are read whole, in pieces of bounded length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_hash, pieces, points, short_batches, table
from .learning import labelled_sample, platt, sigmoid
from .minhash import word_hashes

BITS = 15
SIZE = 1 << BITS  # buckets of words, and as many of n-grams
KINDS = 3
ALL = 2 * SIZE + 4  # the marks: at distance 1 new and repeated, at distance 2 the same
ORDERS = (3, 4)
DIMENSIONS = 16
CALIBRATION = 0.2
_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)


def features(text: str | None) -> Iterator[np.ndarray]:
    """Buckets of all occurrences: words below SIZE, n-grams from SIZE on, marks from 2 SIZE on. Digits count as 0."""
    text = text or ""
    last = np.zeros(0, np.uint64)
    for new in word_hashes(text.encode("utf-8", "surrogatepass")):
        yield (new >> np.uint64(64 - BITS)).astype(np.int64)
        run = np.concatenate([last, new])
        for d in (1, 2):
            at = np.arange(max(len(last), d), len(run))
            yield (run[at] == run[at - d]).astype(np.int64) + (2 * SIZE + 2 * (d - 1))
        last = run[-2:]
    for k, piece in enumerate(pieces(text, max(ORDERS) - 1)):
        cp = points(piece)
        cp = np.where((cp >= 48) & (cp <= 57), np.uint32(48), cp)
        h = np.zeros(len(cp), np.uint32)
        for i in range(max(ORDERS)):
            if len(cp) <= i:
                break
            h = h[: len(cp) - i] + cp[i:] * _FACTORS[i]
            if i + 1 in ORDERS:
                x = h[max(ORDERS) - 1 - i if k else 0 :]
                x = ((x ^ (x >> np.uint32(15))) * np.uint32(0x2C1B3C6D) + np.uint32(i)) * np.uint32(0x297A2D39)
                yield (x >> np.uint32(32 - BITS)).astype(np.int64) + SIZE


@dataclass
class QualityModel:
    """gain: each bucket's vector times the difference of the two softmax rows, as only that is asked of a text."""

    gain: np.ndarray
    bias: float = 0.0
    a: float = 1.0
    b: float = 0.0

    def raw(self, text: str | None) -> float:
        total, n = [0.0] * KINDS, [0] * KINDS
        for x in features(text):
            if len(x):
                kind = int(x[0] // SIZE)
                total[kind] += float(self.gain[x].sum(dtype=np.float64))
                n[kind] += len(x)
        return self.bias + sum(t / (KINDS * max(1, k)) for t, k in zip(total, n, strict=True))

    def score(self, text: str | None) -> float:
        return float(sigmoid(self.a * self.raw(text) + self.b))


def bag(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and their shares in the document's average."""
    counts = np.zeros(ALL)
    for x in features(text):
        counts += np.bincount(x, minlength=ALL)
    for kind in (counts[:SIZE], counts[SIZE : 2 * SIZE], counts[2 * SIZE :]):
        kind /= KINDS * max(1.0, kind.sum())
    at = np.flatnonzero(counts)
    return at, counts[at]


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = 12, rate: float = 2.0, seed: int = 5) -> QualityModel:
    """rows: (buckets, shares, label). The prior of an empty model is even."""
    rng = np.random.default_rng(seed)
    vectors = rng.normal(0, 1 / DIMENSIONS, (ALL, DIMENSIONS)).astype(np.float32)
    out, bias = np.zeros((DIMENSIONS, 2), np.float32), np.zeros(2, np.float32)
    order = rng.permutation(len(rows))
    cut = int(len(rows) * CALIBRATION)
    learn, steps = order[cut:], 0
    for _ in range(epochs):
        for i in rng.permutation(learn):
            at, share, y = rows[i]
            lr = rate * (1 - steps / (epochs * len(learn)))
            steps += 1
            share = share.astype(np.float32)
            v = share @ vectors[at]
            s = v @ out + bias
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1
            back = out @ p
            out -= lr * np.outer(v, p)
            bias -= 0.1 * lr * p
            vectors[at] -= lr * share[:, None] * back
    model = QualityModel((vectors @ (out[:, 1] - out[:, 0])).astype(np.float64), float(bias[1] - bias[0]))
    kept = order[:cut]
    raw = np.array([model.bias + rows[i][1] @ model.gain[rows[i][0]] for i in kept])
    model.a, model.b = platt(raw, np.array([rows[i][2] for i in kept], float)) if len(kept) else (1.0, 0.0)
    return model


def fit(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "quality") -> QualityModel:
    """A model from labels of the doc_ids for which `learn` holds; without labels every score is 0.5."""
    short_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bags = [bag(t.as_py()) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([x[0].astype("<i4").tobytes() for x in bags], pa.binary()), pa.array([x[1].astype("<f4").tobytes() for x in bags], pa.binary()), b.column(1)], names=["at", "share", "y"])

    sample = labelled_sample(docs, labels, label, learn).select("text", "y").mapInArrow(run, "at binary, share binary, y int")
    rows = [(np.frombuffer(r.at, "<i4"), np.frombuffer(r.share, "<f4"), r.y) for r in sample.collect()]
    rows.sort(key=lambda r: (r[2], r[0].tobytes(), r[1].tobytes()))
    return train(rows)


def score(docs: DataFrame, model) -> DataFrame:
    """doc_id, score of every row: null ids and repeated rows give a row each, an empty table none.

    A null text counts as empty. Other columns are not read.
    """
    short_batches(docs.sparkSession)
    slim = docs.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([model.score(t.as_py()) for t in b.column(1)], pa.float64())], names=["doc_id", "score"])

    return slim.mapInArrow(run, f"doc_id {slim.schema[0].dataType.simpleString()}, score double")


def held_out(doc_id: Column) -> Column:
    return F.pmod(id_hash(doc_id), F.lit(4)) == 2


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels", "doc_id", "quality"), ~held_out(F.col("doc_id")))
    out = score(docs, model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
