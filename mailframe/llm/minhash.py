"""Document fingerprints by MinHash.

Words (A-Z lower-cased, split at ASCII white space) are hashed in numpy by prefix sums of a polynomial,
shingles of five words from the words' hashes. A signature holds, for each of 128 universal hash
functions a x + b mod 2^64, 16 bits of a hash of the least value over the shingles (of the whole value, as
its highest bits are all 0 in long texts). Likeness is the share of equal places, an estimate of the Jaccard
similarity with a standard error of 0.044 or less, whatever the length. Bands of signatures are joined in Spark and the pairs they bring together verified by
exact Jaccard similarity.

Texts are hashed piece by piece, words that a piece cuts are carried over, so that memory doesn't grow with a text that
has no white space.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, short_batches, table
from .simhash import CHUNK, LOWER, _unite, components, with_least

SHINGLE = 5
PLACES = 128
#: Two texts of similarity 0.8 share one of 20 bands of 6 places with probability 0.998.
BANDS, BAND_PLACES = 20, 6
THRESHOLD = 0.8
#: Rows of a range of ids, and ranges at most.
RANGE, RANGES = 4096, 20_000
_RNG = np.random.default_rng(20)
_A = _RNG.integers(0, 1 << 64, PLACES, dtype=np.uint64) | np.uint64(1)
_B = _RNG.integers(0, 1 << 64, PLACES, dtype=np.uint64)
_COMBINE = _RNG.integers(0, 1 << 64, SHINGLE, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
#: Bytes of a text that are hashed in one numpy step.
STEP = 1 << 17


def _powers(base: int) -> np.ndarray:
    out = np.full(STEP + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWER, _INVERSE = _powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def word_hashes(raw: bytes) -> Iterator[np.ndarray]:
    """A hash for each word of a text in UTF-8, in order, in arrays of bounded length.

    A word's hash is mixed from its length and the sum of (byte + 1) base^place, which may be summed up over pieces.
    """
    carried, length = 0, 0  # sum and bytes of a word that the last piece cut
    for at in range(0, len(raw), STEP):
        b = np.frombuffer(raw, np.uint8, min(STEP, len(raw) - at), at)
        edge = np.diff(np.r_[True, _SPACE[b], True].astype(np.int8))
        starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        sums = np.zeros(len(b) + 1, np.uint64)
        np.cumsum((b.astype(np.uint64) + np.uint64(1)) * _POWER[: len(b)], out=sums[1:])
        own, size = (sums[ends] - sums[starts]) * _INVERSE[starts], ends - starts
        if length and len(starts) and starts[0] == 0:
            own[0] = (carried + pow(_BASE, length, 1 << 64) * int(own[0])) % (1 << 64)
            size[0] += length
        elif length:
            own, size = np.r_[np.uint64(carried), own], np.r_[length, size]
        length = 0
        if at + len(b) < len(raw) and not _SPACE[b[-1]]:
            carried, length = int(own[-1]), int(size[-1])
            own, size = own[:-1], size[:-1]
        if len(own):
            yield _mix(own + size.astype(np.uint64))


def shingle_hashes(text: str | None) -> Iterator[np.ndarray]:
    """Hashes of all shingles, in arrays of bounded length; of the whole sequence if it is shorter than one."""
    raw = (text or "").encode("utf-8", "surrogatepass").translate(LOWER)
    seen, last = 0, np.zeros(0, np.uint64)
    for new in word_hashes(raw):
        seen += len(new)
        w = np.concatenate([last, new])
        n = len(w) - SHINGLE + 1
        if n > 0:
            total = np.zeros(n, np.uint64)
            for k in range(SHINGLE):
                total += w[k : k + n] * _COMBINE[k]
            yield _mix(total)
        last = w[-(SHINGLE - 1) :]
    if 0 < seen < SHINGLE:
        yield _mix((last * _COMBINE[: len(last)]).sum(keepdims=True) + np.uint64(len(last)))


def signature(text: str | None) -> np.ndarray:
    """128 places (uint16); all 65535 for a text without words."""
    return signature_of(shingle_hashes(text))


def signature_of(hashes: Iterable[np.ndarray]) -> np.ndarray:
    """The signature of shingles in any number of arrays."""
    least, seen = np.full(PLACES, ~np.uint64(0)), False
    for x in hashes:
        seen = True
        for k in range(0, len(x), 1024):
            h = x[k : k + 1024, None] * _A
            h += _B
            np.minimum(least, h.min(axis=0), out=least)
    return (_mix(least) >> np.uint64(48) if seen else least).astype(">u2")


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def edited(text: str, following: str) -> str:
    """The text with its last half (rounded down) replaced by as much of the start of another."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_OUT = ("n_chars long", "edited_sha256 string", "fingerprint string", "edited_fingerprint string", "near_edited double", "near_next double")


def fingerprint_chain(docs: DataFrame) -> DataFrame:
    """doc_id and the contract's columns: fingerprints of each text and of its edited form.

    The next document is the one with the next smaller doc_id; rows of one id follow in the order of
    their texts; null ids are the smallest; after the last comes the first, so a single row follows
    itself. A null text is empty. Other columns are not read; an empty table gives an empty result.

    Ids are cut into ranges of about RANGE rows at ids that occur (so each range's first row is known
    beforehand); a range is one partition, read in order, and gets a copy of the first row of the range
    that follows. The texts are shuffled once. Bounds of at most RANGES ranges come to the driver.
    """
    spark = docs.sparkSession
    short_batches(spark)
    least = -(1 << 63)
    ids = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(least)).alias("id"))
    n, top = ids.agg(F.count("*"), F.max("id")).first()
    ranges = max(1, min(n // 1024, max(n // RANGE, 4 * spark.sparkContext.defaultParallelism), RANGES))
    found = ids.approxQuantile("id", [i / ranges for i in range(1, ranges)], 0.1 / ranges) if ranges > 1 else []
    exact = {r[0] for r in ids.filter(F.col("id").cast("double").isin(found)).distinct().collect()} if found else set()
    bounds = np.array(sorted(exact | ({top} if n else set())), np.int64)  # range i: ids above bound i - 1, up to bound i

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            id_ = b.column(0).to_numpy()
            at = np.searchsorted(bounds, id_)
            first = np.flatnonzero(bounds[at] == id_)
            rows = np.r_[np.arange(len(b)), first]
            home = np.r_[at, (at[first] + 1) % len(bounds)]
            copy = np.r_[np.zeros(len(b), bool), np.ones(len(first), bool)]
            yield pa.RecordBatch.from_arrays([pa.array(home), pa.array(copy), *[c.take(pa.array(rows)) for c in b.columns]], names=["home", "copy", "id", "doc_id", "text"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(least)).alias("id"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    dealt = rows.mapInArrow(deal, f"home long, copy boolean, id long, doc_id {kind}, text string")
    in_order = dealt.repartitionById(max(1, len(bounds)), F.col("home").cast("int")).sortWithinPartitions("home", "copy", F.desc("id"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        home = before = None  # before: id, text, signature of the row that waits for its next one
        for b in batches:
            out = []
            for h, copy, doc_id, text in zip(*[b.column(k).to_pylist() for k in (0, 1, 3, 4)], strict=True):
                if h != home:
                    home, before = h, None
                elif copy and before is None:
                    continue  # a further row with the id of the first copy
                own = signature(text)
                if before is not None:
                    last_id, last_text, last = before
                    new = edited(last_text, text)
                    new_print = signature(new)
                    sha = hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest()
                    out.append((last_id, len(last_text), sha, last.tobytes().hex(), new_print.tobytes().hex(), likeness(last, new_print), likeness(last, own)))
                before = None if copy else (doc_id, text, own)
            columns = list(zip(*out, strict=True)) if out else [()] * 7
            kinds = [b.schema.field(3).type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", *[c.split()[0] for c in _OUT]])

    return in_order.mapInArrow(run, f"doc_id {kind}, " + ", ".join(_OUT))


# ---- near-duplicates over bands --------------------------------------------------------------


def minhash_groups(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, component_id of every row: components over pairs of at least this Jaccard similarity.

    component_id is the smallest doc_id of the component. Texts with equal sets of shingles are one
    node; texts without words are one node. A null doc_id is no one's component_id unless alone.
    Rows with equal ids count each. Other columns are not read. Every band brings its nodes together
    (in pairs of chunks where they are many); all its pairs are checked, first by signature, then exactly.
    """
    spark = docs.sparkSession
    short_batches(spark)
    scratch = Scratch(spark)
    slim = docs.select("doc_id", "text")
    kind = slim.schema[0].dataType.simpleString()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes, bands, sets = [], [], []
            for t in b.column(1).to_pylist():
                x = np.unique(np.concatenate([np.zeros(0, np.uint64), *shingle_hashes(t)]))
                s = signature(t)
                nodes.append(hashlib.sha256(x.tobytes()).digest()[:16])
                bands.append([hashlib.sha256(bytes([k]) + s[k * BAND_PLACES : (k + 1) * BAND_PLACES].tobytes()).digest()[:8] for k in range(BANDS)])
                sets.append(x.tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(nodes, pa.binary()), pa.array(bands, pa.list_(pa.binary())), pa.array(sets, pa.binary())], names=["doc_id", "node", "bands", "shingles"])

    signed = scratch.save(slim.mapInArrow(sign, f"doc_id {kind}, node binary, bands array<binary>, shingles binary"))
    nodes = scratch.save(signed.groupBy("node").agg(F.min("doc_id").alias("least"), F.first("bands").alias("bands"), F.first("shingles").alias("shingles")))
    rows = nodes.select("node", F.explode("bands").alias("band"))
    sizes = rows.groupBy("band").agg(F.count("*").alias("size")).filter("size > 1")
    chunks = F.ceil(F.col("size") / CHUNK).cast("int")
    own = F.pmod(F.xxhash64("node"), chunks).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda j: F.struct(F.least("own", j).alias("i"), F.greatest("own", j).alias("j")))
    dealt = rows.join(sizes, "band").withColumns({"chunks": chunks, "own": own}).select("node", "band", F.explode(pairs).alias("pair"))
    dealt = dealt.join(nodes.select("node", "shingles"), "node").select("band", "pair.i", "pair.j", "node", "shingles")
    dealt = dealt.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j")

    def links(names: list[bytes], sets: list[np.ndarray]) -> Iterator[tuple[bytes, bytes]]:
        root = np.arange(len(names))
        sizes = np.array([len(x) for x in sets])
        for i in range(1, len(names)):
            ratio = np.minimum(sizes[:i], sizes[i]) / np.maximum(np.maximum(sizes[:i], sizes[i]), 1)
            for j in np.flatnonzero(ratio >= threshold):
                if root[i] == root[j]:
                    continue
                shared = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if shared >= threshold * (sizes[i] + sizes[j] - shared):
                    _unite(root, np.array([i]), np.array([j]))
                    yield names[i], names[j]

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(pairs):
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.binary()) for k in (0, 1)], names=["a", "b"])

        key, names, sets = None, [], []
        for b in batches:
            out = []
            for band, i, j, node, x in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if (band, i, j) != key:
                    out += links(names, sets)
                    key, names, sets = (band, i, j), [], []
                names.append(node)
                sets.append(np.frombuffer(x, np.uint64))
            yield batch(out)
        yield batch(list(links(names, sets)))

    roots = components(dealt.mapInArrow(verify, "a binary, b binary"), scratch).withColumnRenamed("node", "own")
    rooted = nodes.select("node", "least").join(roots, F.col("node") == F.col("own"), "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    classes = with_least(rooted.withColumnRenamed("least", "own"), "root", "own", "node")
    return signed.select("doc_id", "node").join(classes.select("node", F.col("least").alias("component_id")), "node").select("doc_id", "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_chain(table(spark, sf_dir, "documents", "doc_id", "text"))
