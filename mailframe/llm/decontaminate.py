"""Benchmark decontamination by q-gram lemma filtering.

A document holds an item if a part of it is within the item's edit budget k, a sixteenth of its length
(texts normalised: lower case, runs of other characters than letters and digits as one space).
By the q-gram lemma such a part shares at least m + 1 - q - kq of the item's m + 1 - q q-grams,
and these lie on diagonals (place in the text less place in the item) that differ by k at most. So
shared q-grams are counted in overlapping diagonal bands of 2 (k + 1), one beginning at each k + 1;
bands that reach the bound are verified by banded alignment, many at a time. Nothing within budget is lost: texts are
normalised as a stream, and windows of it overlap by more than the longest match, whatever lies between its words.

Items are taken in blocks of bounded size, and the documents are read once for each block: a benchmark of up to 20,000
items and two million characters takes one pass. Blocks go through the driver one at a time and into the plan. Postings of
q-grams that many items share are counted in ranges of items, so that memory is bounded by POSTINGS.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import points, short_batches, table

Q = 12
#: Edits allowed: the item's length over this, as far as the lemma's bound stays above zero.
PER_EDIT = 16
#: Items and characters of items in a block, about.
BLOCK_ITEMS, BLOCK_CHARS = 20_000, 2_000_000
#: Normalised characters of a document that are searched at a time.
PIECE = 1 << 18
#: Shared q-grams that are counted at a time, and bands that are aligned at a time.
POSTINGS, ALIGNED = 1 << 21, 1 << 12
_MUL = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
_TABLE_BITS = 22


@cache
def _letters() -> np.ndarray:
    """For each code point, whether it is a letter or a digit."""
    return np.array([chr(i).isalnum() for i in range(0x110000)])


def stream(text: str, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Code points of the normalised text, and the place of each in the text, `size` characters of the text at a time."""
    after_word = False
    for start in range(0, len(text), size):
        part = text[start : start + size]
        low = part.lower()
        if len(low) != len(part):  # a few letters grow when lowered
            low = "".join(x if len(x := c.lower()) == 1 else c for c in part)
        cp = points(low)
        cp = np.where(cp == 0x3C2, np.uint32(0x3C3), cp)  # one sigma, wherever the word ends
        word = _letters()[cp]
        keep = word.copy()
        keep[1:] |= word[:-1]
        keep[0] |= after_word
        after_word = word[-1]
        at = np.flatnonzero(keep)
        yield np.where(word[at], cp[at], np.uint32(32)), at + start


def normalised(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the normalised text, and the place of each in the text."""
    parts = [(np.zeros(0, np.uint32), np.zeros(0, np.int64)), *stream(text, PIECE)]
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def grams(c: np.ndarray) -> np.ndarray:
    """A hash of each q-gram (12 characters), by doubling: 2, 4 and 8 characters, then 8 and 4."""
    if len(c) < Q:
        return np.zeros(0, np.uint64)
    h = c.astype(np.uint64)
    h2 = h[:-1] * _MUL[0] + h[1:]
    h4 = h2[:-2] * _MUL[1] + h2[2:]
    h4 ^= h4 >> np.uint64(29)
    h8 = h4[:-4] * _MUL[2] + h4[4:]
    h12 = h8[: len(c) - Q + 1] * _MUL[3] + h4[8:]
    return (h12 ^ (h12 >> np.uint64(32))) * _MUL[0]


def banded_distances(items: np.ndarray, sizes: np.ndarray, text: np.ndarray, low: np.ndarray, width: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row, edits and end of the best alignment of a whole item with a part of the text, on `width` diagonals from low on.

    items: a row each, filled up at the right; sizes: their lengths. Edits are k + 1 where there are more than k. The end is a
    place in the text; of equal ones the one on the least diagonal is given. Rows that are beyond k are given up on the way.
    """
    edits, ends = np.full(len(items), k + 1), np.zeros(len(items), np.int64)
    if not len(items):
        return edits, ends
    longest = int(sizes.max())
    padded = np.full(len(text) + 2 * (longest + width), -1, np.int64)  # beyond the text nothing is equal
    padded[longest + width : longest + width + len(text)] = text
    first = np.clip(low + longest + width, 0, len(padded) - longest - width)
    rows, step = np.arange(len(items)), np.arange(width)
    cost = np.zeros((len(items), width), np.int64)
    for i in range(longest):
        new = cost + (padded[(first[rows] + i)[:, None] + step] != items[rows, i, None])
        new[:, :-1] = np.minimum(new[:, :-1], cost[:, 1:] + 1)  # a character of the item is left out
        cost = np.minimum.accumulate(new - step, axis=1) + step  # characters of the text are left out
        best = cost.argmin(axis=1)
        least = cost[np.arange(len(rows)), best]
        done = (sizes[rows] == i + 1) & (least <= k)
        edits[rows[done]] = least[done]
        ends[rows[done]] = (sizes[rows] + low[rows] + best)[done]
        alive = (least <= k) & (sizes[rows] > i + 1)
        if not alive.all():
            rows, cost = rows[alive], cost[alive]
            if not len(rows):
                break
    return edits, ends


@dataclass
class Index:
    """The q-grams of a block of items."""

    ids: list
    items: list[np.ndarray]
    keys: np.ndarray
    first: np.ndarray
    item: np.ndarray
    place: np.ndarray
    edits: np.ndarray
    bound: np.ndarray
    short: dict[str, list]

    @classmethod
    def of(cls, rows: list[tuple[object, str]]) -> Index:
        ids, items, short = [], [], {}
        for key, text in rows:
            c = normalised(text or "")[0]
            c = c[:-1] if len(c) and c[-1] == 32 else c
            if len(c) >= Q:
                ids.append(key)
                items.append(c)
            elif len(c):  # too short for a q-gram: looked for as it is, as whole words
                short.setdefault(f" {''.join(map(chr, c))} ", []).append(key)
        m = np.array([len(c) for c in items], np.int64)
        edits = np.minimum(m // PER_EDIT, (m - Q) // Q)
        hashes = [grams(c) for c in items]
        h = np.concatenate([np.zeros(0, np.uint64), *hashes])
        item = np.repeat(np.arange(len(items)), [len(x) for x in hashes])
        place = np.concatenate([np.zeros(0, np.int64), *[np.arange(len(x)) for x in hashes]])
        order = np.argsort(h, kind="stable")
        keys, first = np.unique(h[order], return_index=True)
        return cls(ids, items, keys, np.r_[first, len(h)], item[order], place[order], edits, m + 1 - Q - edits * Q, short)

    def table(self) -> np.ndarray:
        """Which values of the hashes' highest bits occur."""
        out = np.zeros(1 << _TABLE_BITS, bool)
        out[self.keys >> np.uint64(64 - _TABLE_BITS)] = True
        return out


class Matcher:
    def __init__(self, index: Index):
        self.x, self.seen = index, index.table()
        self.reach = max((len(c) + 4 * (int(k) + 1) for c, k in zip(index.items, index.edits, strict=True)), default=2 * Q)
        self.size = np.array([len(c) for c in index.items], np.int64)
        # the key of each posting and its item as one number, in order: a key's postings of a range of items are one slice
        self.order = np.repeat(np.arange(len(index.keys)), np.diff(index.first)) * max(1, len(index.items)) + index.item

    def find(self, text: str | None) -> dict[object, tuple[int, int, int]]:
        """Item id -> (edits, start, end) of its best place in the text; the first of equal ones."""
        out: dict[object, tuple[int, int, int]] = {}
        size, keep = max(PIECE, 4 * self.reach), self.reach + 2 * Q
        c, at, begin = np.zeros(0, np.uint32), np.zeros(0, np.int64), True
        for new, places in stream(text or "", size):
            c, at = np.concatenate([c, new]), np.concatenate([at, places])
            if len(c) >= size:
                self._window(c, at, out, begin, False)
                c, at, begin = c[-keep:], at[-keep:], False
        if len(c):
            self._window(c, at, out, begin, True)
        return out

    def _window(self, c: np.ndarray, at: np.ndarray, out: dict, begin: bool, end: bool) -> None:
        if self.x.short:
            flat = " " * begin + c.astype("<u4").tobytes().decode("utf-32-le", "replace") + " " * bool(end and c[-1] != 32)
            for words, keys in self.x.short.items():
                if (p := flat.find(words)) >= 0:
                    p += 1 - begin
                    for k in keys:
                        out.setdefault(k, (0, int(at[p]), int(at[p + len(words) - 3]) + 1))
        for k, found in self._find(c, at).items():
            if k not in out or found[0] < out[k][0]:
                out[k] = found

    def _find(self, c: np.ndarray, at: np.ndarray) -> dict[object, tuple[int, int, int]]:
        x, out = self.x, {}
        h = grams(c)
        i = np.flatnonzero(self.seen[h >> np.uint64(64 - _TABLE_BITS)])
        if not i.size:
            return out
        k = np.searchsorted(x.keys, h[i])
        k[k == len(x.keys)] = 0
        same = x.keys[k] == h[i]
        i, k = i[same], k[same]
        if not i.size:
            return out
        n, total = len(x.items), int((x.first[k + 1] - x.first[k]).sum())
        parts = -(-total // POSTINGS)
        for p in range(parts):
            first, last = x.first[k], x.first[k + 1]
            if parts > 1:
                first = np.searchsorted(self.order, k * n + p * n // parts)
                last = np.searchsorted(self.order, k * n + (p + 1) * n // parts)
            many = last - first
            post = np.repeat(first - np.cumsum(many) + many, many) + np.arange(many.sum())
            item, diagonal = x.item[post], np.repeat(i, many) - x.place[post]
            band = (diagonal + (1 << 30)) // (x.edits[item] + 1)
            key = np.concatenate([item * (1 << 32) + band, item * (1 << 32) + band - 1])
            key, count = np.unique(key, return_counts=True)
            key = key[count >= x.bound[key >> 32]]
            for j, edits, end in self._verified(c, key >> 32, key & 0xFFFFFFFF):
                own = x.ids[j]
                if own not in out or edits < out[own][0]:
                    end = max(1, min(end, len(c)))
                    out[own] = (edits, int(at[max(0, min(end - 1, end - int(self.size[j])))]), int(at[end - 1]) + 1)
        return out

    def _verified(self, c: np.ndarray, item: np.ndarray, band: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """item, edits, end of the bands that hold an item, by item and place."""
        found = []
        for k in np.unique(self.x.edits[item]):
            own = np.flatnonzero(self.x.edits[item] == k)
            for start in range(0, len(own), ALIGNED):
                j = item[own[start : start + ALIGNED]]
                low = band[own[start : start + ALIGNED]] * (k + 1) - (1 << 30) - k
                items = np.zeros((len(j), int(self.size[j].max())), np.int64)
                for row, one in enumerate(j):
                    items[row, : self.size[one]] = self.x.items[one]
                edits, ends = banded_distances(items, self.size[j], c, low, int(4 * k + 2), int(k))
                found += [(int(j[r]), int(low[r]), int(edits[r]), int(ends[r])) for r in np.flatnonzero(edits <= k)]
        for j, _, edits, end in sorted(found):
            yield j, edits, end


def blocks(benchmark: DataFrame) -> Iterator[Index]:
    """Indexes of blocks of the benchmark, of bounded size each; together they hold every item."""
    rows = benchmark.select("item_id", "text").filter(F.col("text").isNotNull())
    n, chars = rows.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    parts = max(1, -(-n // BLOCK_ITEMS), -(-chars // BLOCK_CHARS))
    for p in range(parts if n else 0):
        own = rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == p)
        yield Index.of([(r.item_id, r.text) for r in own.collect()])


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, edits, start, end: a row for each document and item that it holds, at its best place.

    Null and empty texts and items hold nothing and are held by nothing; items without a q-gram (under
    12 characters) are looked for exactly, as whole words. Repeated documents give their rows again; items of one
    id (null is one, too) in a block give one row, at the best place of any of them. Other columns are not read; an
    empty table of documents or items gives an empty result.
    """
    short_batches(docs.sparkSession)
    slim = docs.select("doc_id", "text")
    kind, item = slim.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {kind}, item_id {item}, edits int, start long, end long"
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    out = docs.sparkSession.createDataFrame([], schema)
    for index in blocks(benchmark):

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(index)
            for b in batches:
                found = [(r, k, *v) for r, t in enumerate(b.column(1).to_pylist()) for k, v in matcher.find(t).items()]
                take = b.column(0).take(pa.array([f[0] for f in found], pa.int64()))
                yield pa.RecordBatch.from_arrays([take, *[pa.array([f[n] for f in found], arrow.field(n).type) for n in range(1, 5)]], names=arrow.names)

        out = out.unionByName(slim.mapInArrow(run, schema))
    return out


def remove_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows that hold an item. Columns as they were, whatever their names; rows are judged each, without a shuffle."""
    short_batches(docs.sparkSession)
    at = docs.columns.index("text")
    for index in blocks(benchmark):

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(index)
            for b in batches:
                yield b.filter(pa.array([not matcher.find(t) for t in b.column(at).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))
