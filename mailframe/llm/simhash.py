"""SimHash near-duplicates by bit-sliced comparison.

1. A fingerprint for each text: a bit is set if it is set in over half of the shingles' hashes.
2. Equal fingerprints become one node first, so that exact copies cost nothing later.
3. Nodes meet in buckets of some of their bits. Inside a bucket, fingerprints are stored as bit
   planes (bit b of 64 fingerprints in one machine word). All pairs at one offset are compared at
   once: XORed planes are summed by carry-save adders, and words whose 64 pairs have all left the
   radius are abandoned.
4. A bucket hands on a spanning forest of its links, not its pairs; components are found over the
   forests by alternating large and small stars, with each round in shared storage.

For cleaning a corpus, fingerprints of distinct shingles are compared in buckets of MinHash bands; the components are
candidates only, inside which each link is verified by exact Jaccard similarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import PIECE, Scratch, short_batches, table

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Fingerprints of a bucket that are compared in one task; a larger bucket is dealt out in pairs of chunks.
CHUNK = 4096
#: Groups that the rows of one node of the component search are dealt out to.
SALTS = 64
#: Rows of 50 bytes or so that one task can hold whatever their keys.
FEW = 1 << 21
#: Fingerprints in one bit-sliced batch of small buckets.
LANES = 1 << 15


@dataclass(frozen=True)
class SimHash:
    """bits: a multiple of 64, one XXH64 seed (42, 43, ...) for each 64. radius: bits that may differ.

    keys: the bit positions of each bucket table.
    """

    words: int
    bits: int
    radius: int
    keys: tuple[tuple[int, ...], ...]


def pigeonhole(bits: int, radius: int, blocks: int) -> tuple[tuple[int, ...], ...]:
    """Tables so that any two fingerprints within the radius share a bucket: every choice of blocks - radius blocks."""
    edges = [bits * i // blocks for i in range(blocks + 1)]
    return tuple(tuple(p for b in chosen for p in range(edges[b], edges[b + 1])) for chosen in combinations(range(blocks), blocks - radius))


#: The contract's: exact, as of 4 blocks at least 2 are equal within radius 2.
EXACT = SimHash(words=3, bits=64, radius=2, keys=pigeonhole(64, 2, 4))


@dataclass(frozen=True)
class Near:
    """For cleaning a corpus: texts whose sets of five-word shingles have at least this Jaccard similarity.

    Texts that share one of the bands (of so many MinHash places) and whose fingerprints of distinct shingles are
    within the radius are candidates. A pair at similarity s shares a band with probability
    1 - (1 - s^places)^bands, 0.99995 at 0.8, and differs in about bits acos(2s / (1 + s)) / pi bits: 19.4 at 0.8, five
    standard deviations below the radius.
    """

    similarity: float = 0.8
    bands: int = 25
    places: int = 5
    bits: int = 128
    radius: int = 40


CORPUS = Near()
#: Texts, and shingles, of a group of candidates that are verified in one task; a larger group is dealt out to chunks.
GROUP, GROUP_SHINGLES = 1024, 1 << 21


def _bit_counts(shingles: list[bytes], seeds: int) -> np.ndarray:
    out = []
    for seed in range(42, 42 + seeds):
        raw = b"".join([xxhash.xxh64_digest(s, seed) for s in shingles])
        out.append(np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64))
    return np.concatenate(out)


def fingerprint(text: str | None, words: int = 3, bits: int = 64) -> bytes:
    """Big-endian fingerprint of a whole text; zero if it has no word. Long texts go piece by piece."""
    raw = (text or "").encode("utf-8", "surrogatepass").translate(LOWER)
    total, counts, last = 0, np.zeros(bits, np.int64), []
    at, n_words = 0, 0
    while at < len(raw):
        end = min(len(raw), at + PIECE)
        while end < len(raw) and raw[end] not in b" \t\n\v\f\r":
            end += 1
        new = raw[at:end].split()
        at, n_words = end, n_words + len(new)
        run = last + new
        if len(run) >= words:
            joined, ends, pos = b" ".join(run), [], -1
            for w in run:
                pos += len(w) + 1
                ends.append(pos)
            starts = [0, *[e + 1 for e in ends]]
            shingles = [joined[s:e] for s, e in zip(starts, ends[words - 1 :], strict=False)]
            counts += _bit_counts(shingles, bits // 64)
            total += len(shingles)
        last = run[-(words - 1) :] if words > 1 else []
    if not n_words:
        return bytes(bits // 8)
    if not total:
        counts, total = _bit_counts([b" ".join(last)], bits // 64), 1
    return np.packbits(2 * counts > total).tobytes()


def fingerprints(docs: DataFrame, spec: SimHash) -> DataFrame:
    """doc_id, fp (binary) of every row."""
    words, bits = spec.words, spec.bits
    slim = docs.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fingerprint(t.as_py(), words, bits) for t in b.column(1)], pa.binary())], names=["doc_id", "fp"])

    return slim.mapInArrow(run, f"doc_id {slim.schema[0].dataType.simpleString()}, fp binary")


# ---- bit-sliced comparison -------------------------------------------------------------------


def planes_of(fps: np.ndarray) -> np.ndarray:
    """Bit planes (bits, words) of fingerprints (n, bytes): bit i of plane b is bit b of fingerprint i."""
    n, size = fps.shape
    lanes = np.zeros((-(-n // 64) * 64, size), np.uint8)
    lanes[:n] = fps
    bits = np.unpackbits(lanes, axis=1)  # (lanes, bits)
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view("<u8")


def shifted(planes: np.ndarray, d: int) -> np.ndarray:
    """The planes moved so that lane i holds what lane i + d held."""
    w, r = divmod(d, 64)
    out = np.zeros_like(planes)
    if w < planes.shape[1]:
        out[:, : planes.shape[1] - w] = planes[:, w:] >> np.uint64(r)
        if r and w + 1 < planes.shape[1]:
            out[:, : planes.shape[1] - w - 1] |= planes[:, w + 1 :] << np.uint64(64 - r)
    return out


def within(a: np.ndarray, b: np.ndarray, valid: np.ndarray, radius: int, check: int = 16) -> np.ndarray:
    """Lanes of `valid` (a word for 64 lanes) in which planes a and b differ in `radius` bits or fewer.

    Differences are summed by carry-save adders: pending[j] holds planes of weight 2^j, any three of
    them become one of weight 2^j and one of 2^(j+1). After each `check` planes the sums are resolved
    and the words in which no lane is left are given up.
    """
    alive = np.flatnonzero(valid)
    left = valid[alive]
    pending: list[list[np.ndarray]] = [[] for _ in range(int(a.shape[0]).bit_length() + 1)]
    for p in range(a.shape[0]):
        if not alive.size:
            break
        x, j = a[p, alive] ^ b[p, alive], 0
        while True:
            pending[j].append(x)
            if len(pending[j]) < 3:
                break
            u, v, w = pending[j]
            uv = u ^ v
            pending[j] = [uv ^ w]
            x, j = (u & v) | (uv & w), j + 1
        if (p + 1) % check == 0 or p + 1 == a.shape[0]:
            total, carry = [], np.zeros_like(left)
            for level in pending:  # at most two planes of a weight, and the carry
                u = level[0] if level else np.zeros_like(left)
                v = level[1] if len(level) > 1 else np.zeros_like(left)
                uv = u ^ v
                total.append(uv ^ carry)
                carry = (u & v) | (uv & carry)
            more, equal = np.zeros_like(left), ~np.zeros_like(left)
            for j in reversed(range(len(total))):  # total > radius, from the highest bit
                if radius >> j & 1:
                    equal &= total[j]
                else:
                    more |= equal & total[j]
                    equal &= ~total[j]
            left &= ~more
            keep = left != 0
            if not keep.all():
                alive, left = alive[keep], left[keep]
                pending = [[x[keep] for x in level] for level in pending]
    out = np.zeros_like(valid)
    out[alive] = left
    return out


def forest(fps: np.ndarray, group: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Lanes (i, root of i), i not the root, of the components of each group's links.

    Rows are sorted by group; every pair of a group is compared, offset by offset.
    """
    n = len(group)
    root = np.arange(n)
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    sizes = np.diff(np.r_[starts, n])
    lanes = np.arange(n)[np.repeat(sizes > 1, sizes)]
    size_of, d = np.repeat(sizes, sizes), 1
    planes = planes_of(fps[lanes])
    while lanes.size:
        g = group[lanes]
        ok = np.zeros(planes.shape[1] * 64, np.uint8)
        ok[: max(0, lanes.size - d)] = g[:-d] == g[d:] if lanes.size > d else []
        if not ok.any():
            break
        hit = within(planes, shifted(planes, d), np.packbits(ok, bitorder="little").view("<u8"), radius)
        if hit.any():
            i = np.flatnonzero(np.unpackbits(hit.view(np.uint8), bitorder="little"))
            _unite(root, lanes[i], lanes[i + d])
        d += 1
        keep = size_of[lanes] > d
        if keep.sum() * 2 < lanes.size:  # groups that are done leave the planes
            lanes = lanes[keep]
            planes = planes_of(fps[lanes])
    i = np.flatnonzero(root != np.arange(n))
    return i, root[i]


def _unite(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merge the sets of a and b, in place; root[x] is the least lane of the set of x."""
    while True:
        x, y = root[a], root[b]
        open_ = x != y
        if not open_.any():
            return
        a, b = a[open_], b[open_]
        lo, hi = np.minimum(x, y)[open_], np.maximum(x, y)[open_]
        np.minimum.at(root, hi, lo)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root[:] = up


# ---- the join in Spark -----------------------------------------------------------------------


def _bucket_rows(nodes: DataFrame, spec: SimHash) -> DataFrame:
    """fp, bucket (a 64-bit key of table and bits) for each table."""
    keys = [np.array(k) for k in spec.keys]
    mixed = [np.uint64(int.from_bytes(xxhash.xxh64_digest(b"table %d" % t), "big") | 1) for t in range(len(keys))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = len(b)
            if not n:
                continue
            bits = np.unpackbits(np.frombuffer(b"".join(b.column(0).to_pylist()), np.uint8).reshape(n, -1), axis=1)
            for t, key in enumerate(keys):
                chosen = np.packbits(bits[:, key], axis=1)
                value = np.zeros((n, 8), np.uint8)
                value[:, : chosen.shape[1]] = chosen
                with np.errstate(over="ignore"):  # odd factors and XOR shifts are one to one: no two keys of a table meet
                    k = value.view("<u8")[:, 0] * mixed[t]
                    k = (k ^ (k >> np.uint64(32))) * mixed[t] + np.uint64(t)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(k.view(np.int64))], names=["fp", "bucket"])

    return nodes.select("fp").mapInArrow(run, "fp binary, bucket long")


def _links(rows: DataFrame, radius: int) -> DataFrame:
    """Edges a, b (binary) of spanning forests of all links among rows (fp, bucket, and node if it isn't fp)."""
    named = [c for c in rows.columns if c == "node"]
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1")
    chunks = F.ceil(F.col("size") / CHUNK).cast("int")
    own = F.pmod(F.xxhash64("fp"), chunks).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda j: F.struct(F.least("own", j).alias("i"), F.greatest("own", j).alias("j")))
    dealt = rows.join(sizes, "bucket").withColumns({"chunks": chunks, "own": own}).select("bucket", "fp", *named, F.explode(pairs).alias("pair")).select("bucket", "pair.i", "pair.j", "fp", *named)
    dealt = dealt.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")

    def compare(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        keys = [t.column(k).to_numpy() for k in range(3)]
        new = np.zeros(len(t), np.int64)
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
        fp = t.column(3).to_pylist()
        i, r = forest(np.frombuffer(b"".join(fp), np.uint8).reshape(len(fp), -1), np.cumsum(new), radius)
        name = t.column(t.num_columns - 1).take(pa.array(np.r_[i, r])).to_pylist()
        return pa.RecordBatch.from_arrays([pa.array(name[: len(i)], pa.binary()), pa.array(name[len(i) :], pa.binary())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            if not len(b):
                continue
            if n >= LANES:  # hand over whole groups only
                last = tuple(held[-1].column(k)[len(held[-1]) - 1].as_py() for k in range(3))
                same = np.ones(len(b), bool)
                for k in range(3):
                    same &= b.column(k).to_numpy() == last[k]
                cut = int(np.argmin(same)) if not same.all() else len(b)
                held.append(b.slice(0, cut))
                if cut == len(b):
                    n += cut
                    continue
                yield compare(held)
                held, n, b = [], 0, b.slice(cut)
            held.append(b)
            n += len(b)
        if held:
            yield compare(held)

    return dealt.mapInArrow(run, "a binary, b binary")


def with_least(rows: DataFrame, key: str, value: str, by: str, n: int | None = None) -> DataFrame:
    """rows with least: the least value among the rows of the same key.

    n: how many rows there are, if that is known. Up to FEW, one task can hold all of them, so a key's rows meet in one. Beyond, they
    meet in SALTS groups (by a hash of another column), which then share their least values; so a key that holds a
    third of all rows is no one task's work. Joins are by sorting, as broadcasts would pass through the driver in each round.
    """
    if n is not None and n <= FEW:
        return rows.withColumn("least", F.min(value).over(Window.partitionBy(key)))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALTS)))
    parts = salted.groupBy(key, "salt").agg(F.min(value).alias("least"))
    whole = parts.groupBy(key).agg(F.min("least").alias("least"))
    return salted.join(parts.select(key, "salt").join(whole.hint("merge"), key).hint("merge"), [key, "salt"]).drop("salt")


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """node, root of every node of the edges (a, b), root being the least node of the component.

    Large and small stars alternate until nothing changes, which takes about log2 of the longest
    path in rounds. Nothing but a count and a checksum comes to the driver.
    """
    e = scratch.save(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())

    def state(x: DataFrame):
        return x.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    now = state(e)
    while now[0]:
        both = with_least(e.union(e.select("v", "u")), "u", "v", "v", 2 * now[0])
        large = both.filter("v > u").select(F.col("v").alias("u"), F.least("u", "least").alias("v")).filter("u <> v").distinct()
        both = with_least(large, "u", "v", "v", 2 * now[0])  # no more than before
        small = both.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("least").alias("v")), F.struct("u", F.col("least").alias("v")))).alias("e"))
        new = scratch.save(small.select("e.u", "e.v").filter("u <> v").distinct())
        scratch.drop(e)
        e, before = new, now
        now = state(e)
        if now == before:
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))


def simhash_groups(docs: DataFrame, spec: SimHash = EXACT) -> DataFrame:
    """doc_id, fp, component_id of every row; component_id is the smallest doc_id that links reach.

    A null or word-less text has fingerprint zero, which links like any other; repeated rows and rows
    with a null doc_id give a row each (component_id is null if a component has null ids only). Other
    columns are not read; an empty table gives an empty result.
    """
    short_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession)
    fps = scratch.save(fingerprints(docs, spec))
    nodes = scratch.save(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(_links(_bucket_rows(nodes, spec), spec.radius), scratch)
    rooted = scratch.save(nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    classes = with_least(rooted.withColumnRenamed("least", "own"), "root", "own", "fp")
    return fps.join(classes.select("fp", F.col("least").alias("component_id")), "fp").select("doc_id", "fp", "component_id")


# ---- cleaning a corpus -----------------------------------------------------------------------


def shingle_fingerprint(x: np.ndarray, bits: int) -> bytes:
    """Fingerprint of distinct 64-bit shingle hashes: the first 64 bits are the hashes' own, the others of them mixed anew."""
    from .minhash import _mix

    counts = []
    for seed in range(bits // 64):
        own = np.zeros(64, np.int64)
        for k in range(0, len(x), PIECE // 64):
            h = x[k : k + PIECE // 64]
            h = _mix(h + np.uint64(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) if seed else h
            own += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        counts.append(own)
    return np.packbits(2 * np.concatenate(counts) > len(x)).tobytes()


def distinct_shingles(text: str | None) -> np.ndarray:
    from .minhash import shingle_hashes

    return np.unique(np.concatenate([np.zeros(0, np.uint64), *shingle_hashes(text)]))


def similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two sets (sorted, distinct) have at least this Jaccard similarity."""
    if min(len(a), len(b)) < similarity * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return shared >= similarity * (len(both) - shared)


def _exact_links(fps: np.ndarray, own: np.ndarray, cluster: list, sets: list[np.ndarray], spec: Near) -> Iterator[tuple[int, int]]:
    """A spanning forest of the exact links among texts, those of one cluster (if not None) being linked already.

    Texts of two chunks are only compared across.
    """
    first: dict[bytes, int] = {}
    root = np.array([k if c is None else first.setdefault(c, k) for k, c in enumerate(cluster)])
    words, across = fps.view(np.uint64), (own != own[0]).any()
    for d in range(1, len(sets)):
        if not root.any():
            return
        near = root[:-d] != root[d:]
        near &= np.bitwise_count(words[:-d] ^ words[d:]).sum(axis=1) <= spec.radius
        if across:
            near &= own[:-d] != own[d:]
        for i in np.flatnonzero(near):
            if root[i] != root[i + d] and similar(sets[i], sets[i + d], spec.similarity):
                _unite(root, np.array([i]), np.array([i + d]))
                yield i, i + d


def _central(fps: np.ndarray) -> tuple[int, int]:
    """The fingerprint nearest to the majority of each bit, and its distance."""
    bits = np.unpackbits(fps, axis=1)
    far = (bits != (2 * bits.sum(axis=0, dtype=np.int64) > len(bits))).sum(axis=1)
    return int(far.argmin()), int(far.min())


def _verify(dealt: DataFrame, spec: Near, leaders: bool = False) -> DataFrame:
    """Edges a, b of the exact links of each group (root, i, j), its rows being node, cluster, own (chunk), fp, text.

    leaders: also root, its most central node and that one's distance, for groups whose j is over 1.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, {}

        def edges() -> list[tuple]:
            if len(held) < 2:
                return []
            names = list(held)
            own, cluster, fp, sets = zip(*held.values(), strict=True)
            fps = np.frombuffer(b"".join(fp), np.uint8).reshape(len(names), -1)
            out = [(names[i], names[j], None) for i, j in _exact_links(fps, np.array(own), cluster, sets, spec)]
            if leaders and group[2] > 1:
                k, far = _central(fps)
                out.append((group[0], names[k], far))
            return out

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            kinds = {"a": pa.binary(), "b": pa.binary(), "far": pa.int32()}
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds.values())], names=list(kinds))

        for b in batches:
            out = []
            for root, i, j, node, cluster, own, fp, text in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if (root, i, j) != group:
                    out += edges()
                    group, held = (root, i, j), {}
                if node not in held:
                    held[node] = (own, cluster, fp, distinct_shingles(text))
            yield batch(out)
        yield batch(edges())

    ordered = dealt.select("root", "i", "j", "node", "cluster", "own", "fp", "text").repartition("root", "i", "j").sortWithinPartitions("root", "i", "j", "node")
    return ordered.mapInArrow(run, "a binary, b binary, far int")


def _chunks(size: Column, total: Column) -> Column:
    """Chunks for so many texts with so many shingles in all."""
    return F.ceil(F.greatest(size / GROUP, total / GROUP_SHINGLES, F.lit(1.0))).cast("int")


def _dealt(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """rows with the columns of groups, by root; a root's rows meet in SALTS groups, so that a large one is no one task's work."""
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)))
    keys = salted.groupBy("root", "salt").agg(F.lit(1)).select("root", "salt")
    return salted.join(keys.join(groups.hint("merge"), "root").hint("merge"), ["root", "salt"]).drop("salt")


def _verified(docs: DataFrame, nodes: DataFrame, candidates: DataFrame, scratch: Scratch, spec: Near) -> DataFrame:
    """node, root of the components of the exact links inside each group of candidates (node, root).

    docs: key, text. Only the texts of candidates are read again, one row for each node.
    A group is dealt out to chunks of GROUP texts, and each chunk is solved by itself. Groups of several chunks are then
    dealt out anew, with the group's most central text in every chunk; so a group of copies of one text is one component
    after two readings. What still isn't in the group's largest component (s of m texts) is compared with all of the
    group, in ceil(s / GROUP) times ceil(m / GROUP) pairs of chunks: no pair is left out.
    """
    whole = candidates.union(candidates.select(F.col("root").alias("node"), "root").distinct())
    members = scratch.save(whole.join(nodes.select("node", "fp", "shingles", F.col("least.key").alias("key")), "node"))
    parts = members.groupBy("root").agg(_chunks(F.count("*"), F.sum("shingles")).alias("chunks"))
    known = scratch.save(docs.join(_dealt(members, parts), "key").select("root", "chunks", "node", "shingles", "fp", "text"))
    own = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    alone = known.select("root", own.alias("i"), F.col("chunks").alias("j"), "node", F.lit(None).cast("binary").alias("cluster"), own.alias("own"), "fp", "text")
    found = scratch.save(_verify(alone, spec, leaders=True))
    edges = found.filter("far IS NULL").select("a", "b")
    leaders = found.filter("far IS NOT NULL").groupBy(F.col("a").alias("root")).agg(F.min_by("b", F.struct("far", "b")).alias("leader"))
    large = known.filter("chunks > 1")
    if not large.limit(1).count():
        return components(edges, scratch)

    again = F.pmod(F.xxhash64("node", F.lit("again")), F.col("chunks")).cast("int")
    spread = F.when(F.col("node") == F.col("leader"), F.sequence(F.lit(0), F.col("chunks") - 1)).otherwise(F.array(again))
    anew = _dealt(large, leaders).withColumn("i", F.explode(spread)).withColumns({"j": F.col("i"), "own": F.col("i"), "cluster": F.lit(None).cast("binary")})
    roots = components(edges.union(_verify(anew, spec).select("a", "b")), scratch)

    placed = scratch.save(large.drop("text").join(roots.withColumnRenamed("root", "cluster"), "node", "left").withColumn("cluster", F.coalesce("cluster", "node")).dropDuplicates(["node"]))
    clusters = placed.groupBy("root", "cluster").agg(F.count("*").alias("size"), F.sum("shingles").alias("total"))
    main = clusters.groupBy("root").agg(F.max_by("cluster", F.struct("size", "cluster")).alias("main"), F.count("*").alias("clusters")).filter("clusters > 1")
    if not main.limit(1).count():
        return roots
    rest = F.col("cluster") != F.col("main")
    side = lambda which: _chunks(F.coalesce(F.sum(F.when(which, F.col("size"))), F.lit(0)), F.coalesce(F.sum(F.when(which, F.col("total"))), F.lit(0)))
    counts = clusters.join(main, "root").groupBy("root", "main").agg(side(rest).alias("few"), side(~rest).alias("many"))
    # The chunks of the rest are 0 to few - 1, those of the largest component few to few + many - 1.
    sided = _dealt(placed, counts).withColumn("own", F.when(rest, F.pmod(F.xxhash64("node"), F.col("few"))).otherwise(F.col("few") + F.pmod(F.xxhash64("node"), F.col("many"))).cast("int"))
    others = F.when(rest, F.sequence(F.lit(0), F.col("few") + F.col("many") - 1)).otherwise(F.sequence(F.lit(0), F.col("few") - 1))
    pairs = F.transform(others, lambda o: F.struct(F.least("own", o).alias("i"), F.greatest("own", o).alias("j")))
    texts = large.select("node", "text")
    across = sided.select("root", "node", "cluster", "own", "fp", pairs.alias("pairs")).join(texts, "node").withColumn("pair", F.explode("pairs")).withColumns({"i": F.col("pair.i"), "j": F.col("pair.j")})
    return components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(_verify(across, spec).select("a", "b")), scratch)


def near_dedup(docs: DataFrame, spec: Near = CORPUS) -> DataFrame:
    """The rows of docs without all but one row of each group of near-duplicates; columns as they were.

    Links are pairs of texts of at least spec.similarity, each verified exactly. Texts with equal sets of shingles
    are one node. The row with the smallest doc_id stays, one with a null doc_id only if there is no other; rows
    are told apart by doc_id and text. Texts without a word are one group.
    """
    from .minhash import signature_of

    short_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession)
    name = F.when(F.col("doc_id").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("doc_id").cast("string")))
    key = F.unhex(F.md5(F.concat(name, F.lit("\0"), F.coalesce("text", F.lit(""))).cast("binary")))
    slim = docs.select(key.alias("key"), "doc_id", "text")
    bands, places, bits = spec.bands, spec.places, spec.bits

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"node": pa.binary(), "fp": pa.binary(), "shingles": pa.int64(), "buckets": pa.list_(pa.int64())}
        for b in batches:
            rows = []
            for t in b.column(2):
                x = distinct_shingles(t.as_py())
                s = signature_of([x] if len(x) else [])
                own = [xxhash.xxh64_intdigest(s[k * places : (k + 1) * places].tobytes(), k) - (1 << 63) for k in range(bands)]
                rows.append((xxhash.xxh128_digest(x.tobytes()), shingle_fingerprint(x, bits), len(x), own))
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)]], names=["key", "doc_id", *kinds])

    kind = docs.schema["doc_id"].dataType.simpleString()
    signed = scratch.save(slim.mapInArrow(sign, f"key binary, doc_id {kind}, node binary, fp binary, shingles long, buckets array<long>"))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("least")
    nodes = scratch.save(signed.groupBy("node").agg(least, F.first("fp").alias("fp"), F.first("shingles").alias("shingles"), F.first("buckets").alias("buckets")))
    candidates = components(_links(nodes.select("node", "fp", F.explode("buckets").alias("bucket")), spec.radius), scratch)
    roots = _verified(slim.select("key", "text"), nodes, candidates, scratch, spec)
    rooted = nodes.select("node", "least").join(roots, "node", "left").select("least", F.coalesce("root", "node").alias("root"))
    keep = rooted.groupBy("root").agg(F.min("least").alias("least")).select(F.col("least.key").alias("key"), F.lit(True).alias("kept"))
    # Only keys of rows that go, or are there more than once, meet the texts: few, so Spark can broadcast them where their size allows.
    odd = scratch.save(signed.groupBy("key").agg(F.count("*").alias("n")).join(keep, "key", "left").filter("kept IS NULL OR n > 1").select("key", F.coalesce("kept", F.lit(False)).alias("kept")))
    scratch.drop(signed)
    name = "_key"
    while name in docs.columns:
        name += "_"
    keyed, odd = docs.withColumn(name, key), odd.withColumnRenamed("key", name)
    out = keyed.join(odd, name, "left_anti")
    repeated = odd.filter("kept")
    if repeated.limit(1).count():
        out = out.unionByName(keyed.join(repeated, name, "left_semi").dropDuplicates([name]))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def hexed(fp: Column) -> Column:
    return F.lower(F.hex(fp))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_groups(table(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", hexed(F.col("fp")).alias("fingerprint"), "component_id")
