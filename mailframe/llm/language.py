"""Language identification.

Sparse multinomial logistic regression on TF-IDF character n-grams (orders 1 to 3, hashed), fitted by
follow-the-regularised-leader with an elastic-net penalty, then calibrated by a temperature. Document
frequencies are counted over all rows that may be learned from; the regression is fitted on a bounded
sample of them. Texts are read whole, in pieces of bounded length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_hash, pieces, points, short_batches, table
from .learning import chosen

BITS = 15
ORDERS = (1, 2, 3)
#: Labelled rows that the regression is fitted on, about, and the least for each language.
SAMPLE_ROWS, LEAST_ROWS = 3000, 50
#: Languages that are learned at most: it bounds the model.
MOST_LANGUAGES = 256
#: Share of the sample that is kept for the temperature.
CALIBRATION = 0.15
UNKNOWN = "und"
_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


def gram_counts(text: str) -> np.ndarray:
    """Counts of hashed n-grams of the lower-cased text."""
    out = np.zeros(1 << BITS, np.int64)
    for k, piece in enumerate(pieces(text, max(ORDERS) - 1)):
        cp = points(piece.lower())
        h = np.zeros(len(cp), np.uint32)
        for i in range(max(ORDERS)):
            if len(cp) <= i:
                break
            h = h[: len(cp) - i] + cp[i:] * _FACTORS[i]
            done = max(ORDERS) - 1 - i if k else 0  # shorter n-grams of the overlap were counted with the piece before
            x = h[done:] ^ (h[done:] >> np.uint32(15))
            x = (x * np.uint32(0x2C1B3C6D) + np.uint32(i)) * np.uint32(0x297A2D39)
            out += np.bincount(x >> np.uint32(32 - BITS), minlength=1 << BITS)
    return out


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


@dataclass
class LanguageModel:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # (features, languages)
    bias: np.ndarray
    temperature: float = 1.0

    def vector(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Features and values of unit length."""
        at = np.flatnonzero(counts)
        x = np.log1p(counts[at]) * self.idf[at]
        return at, x / max(float(np.sqrt(x @ x)), 1e-12)

    def logits(self, at: np.ndarray, x: np.ndarray) -> np.ndarray:
        return x @ self.weights[at] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and calibrated probability; (und, 0) for a text without a letter, or with no language learned."""
        if not self.languages or not has_letter(text):
            return UNKNOWN, 0.0
        p = softmax(self.logits(*self.vector(gram_counts(text))) / self.temperature)
        k = int(np.argmax(p))
        return self.languages[k], float(p[k])

    def fit(self, rows: list[tuple[int, np.ndarray, np.ndarray]], epochs: int = 3, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.002, l2: float = 0.002) -> None:
        """FTRL-proximal over (language, features, counts); weights that l1 holds at zero stay zero."""
        c = len(self.languages)
        z, n = np.zeros((len(self.idf) + 1, c)), np.zeros((len(self.idf) + 1, c))
        rng = np.random.default_rng(1)

        def weights(at):
            small = np.abs(z[at]) <= l1
            return np.where(small, 0.0, -(z[at] - np.sign(z[at]) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2))

        data = []
        for k, at, counts in rows:
            dense = np.log1p(counts) * self.idf[at]
            data.append((k, np.r_[at, len(self.idf)], np.r_[dense / max(float(np.sqrt(dense @ dense)), 1e-12), 1.0]))
        for _ in range(epochs):
            for i in rng.permutation(len(data)):
                k, at, x = data[i]
                w = weights(at)
                p = softmax(x @ w)
                p[k] -= 1.0
                g = x[:, None] * p
                z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha * w
                n[at] += g * g
        full = weights(np.arange(len(self.idf) + 1))
        self.weights, self.bias = full[:-1], full[-1]

    def calibrate(self, rows: list[tuple[int, np.ndarray, np.ndarray]]) -> None:
        """The temperature with the least log loss, by golden-section search on its logarithm."""
        if not rows:
            return
        logits, want = [], []
        for k, at, counts in rows:
            x = np.log1p(counts) * self.idf[at]
            logits.append(self.logits(at, x / max(float(np.sqrt(x @ x)), 1e-12)))
            want.append(k)
        logits, want = np.array(logits), np.array(want)

        def loss(log_t):
            p = softmax(logits / np.exp(log_t))
            return -np.log(np.clip(p[np.arange(len(want)), want], 1e-12, 1)).mean()

        lo, hi, g = -3.5, 3.0, (5**0.5 - 1) / 2
        for _ in range(40):
            a, b = hi - g * (hi - lo), lo + g * (hi - lo)
            lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
        self.temperature = float(np.exp((lo + hi) / 2))


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Rows in which each hashed n-gram occurs, and the number of rows, over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, rows = np.zeros(1 << BITS, np.int64), 0
        for b in batches:
            for t in b.column(0):
                df += gram_counts(t.as_py() or "") > 0
                rows += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[at, -1]), pa.array(np.r_[df[at], rows])], names=["feature", "n"])

    out, rows = np.zeros(1 << BITS, np.int64), 0
    for r in docs.select("text").mapInArrow(run, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect():
        if r.feature < 0:
            rows = r.n
        else:
            out[r.feature] = r.n
    return out, rows


def fit(docs: DataFrame, learn: Column, sample_rows: int = SAMPLE_ROWS) -> LanguageModel:
    """A model from text and lang of the rows for which `learn` holds and lang is not null.

    The MOST_LANGUAGES most frequent languages are learned. The regression's sample holds different texts only,
    so that repeated rows and ids (or null ones) can't make it longer. An empty table gives a model that knows no language.
    """
    short_batches(docs.sparkSession)
    known = docs.select("doc_id", "text", "lang").filter(learn & F.col("lang").isNotNull())
    counts = {r.lang: r["count"] for r in known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGUAGES).collect()}
    languages = sorted(counts)
    if not languages:
        return LanguageModel([], np.ones(1 << BITS), np.zeros((1 << BITS, 0)), np.zeros(0))
    df, n = document_frequencies(known)
    idf = np.log((1 + n) / (1 + df)) + 1.0
    each = max(LEAST_ROWS, sample_rows // len(languages))
    rates = F.create_map(*[x for lang, k in counts.items() for x in (F.lit(lang), F.lit(min(1.0, each / k)))])
    few = known.filter(chosen(F.xxhash64("doc_id", "text"), F.coalesce(rates[F.col("lang")], F.lit(0.0)))).dropDuplicates(["lang", "text"])
    names = {lang: k for k, lang in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ks, ats, values = [], [], []
            for t, lang in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if has_letter(t):
                    c = gram_counts(t)
                    at = np.flatnonzero(c)
                    ks.append(names[lang])
                    ats.append(at.astype("<u2").tobytes())
                    values.append(np.minimum(c[at], 65535).astype("<u2").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ks, pa.int32()), pa.array(ats, pa.binary()), pa.array(values, pa.binary())], names=["k", "at", "n"])

    rows = [(r.k, np.frombuffer(r.at, "<u2").astype(np.int64), np.frombuffer(r.n, "<u2")) for r in few.mapInArrow(run, "k int, at binary, n binary").collect()]
    rows.sort(key=lambda r: (r[0], r[1].tobytes(), r[2].tobytes()))  # as partitions may come in any order
    order = np.random.default_rng(0).permutation(len(rows))
    cut = int(len(rows) * CALIBRATION)
    model = LanguageModel(languages, idf, np.zeros((1 << BITS, len(languages))), np.zeros(len(languages)))
    model.fit([rows[i] for i in order[cut:]])
    model.calibrate([rows[i] for i in order[:cut]])
    return model


def identify(docs: DataFrame, model: LanguageModel, key: str = "doc_id") -> DataFrame:
    """key, lang_pred, score of every row; see LanguageModel.predict.

    Null ids and repeated rows give a row each, an empty table none. Other columns are not read.
    """
    short_batches(docs.sparkSession)
    slim = docs.select(key, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [model.predict(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64())], names=[key, "lang_pred", "score"])

    return slim.mapInArrow(run, f"`{key}` {slim.schema[0].dataType.simpleString()}, lang_pred string, score double")


def reject(docs: DataFrame, model: LanguageModel, least: float = 0.35) -> DataFrame:
    """docs without rows that are in no learned language or whose best language has a probability below `least`.

    Columns as they were, whatever their names; repeated rows are judged each.
    """
    short_batches(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([s >= least and lang != UNKNOWN for lang, s in (model.predict(t.as_py()) for t in b.column(at))], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out(doc_id: Column) -> Column:
    return F.pmod(id_hash(doc_id), F.lit(3)) == 1


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    model = fit(docs, ~held_out(F.col("doc_id")))
    out = identify(docs, model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
