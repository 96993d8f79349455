"""URL filters: a bit-parallel wildcard automaton.

Glob rules are packed, one after another, into a multiword Shift-And mask. One bit stands for one
state of one rule; a step over one character moves all rules of all URLs of a batch at once:

    D' = (D << 1) & B[c]  |  D & S[c]

B[c] has the states that are entered by character c, S[c] those that keep looping on c (a wildcard).
The start state of a rule is never in B, so no bit crosses from one rule into the next.

Globs: `*` any run without `/`, `**` any run, `?` one character but `/`, all else literal. A glob
must match the whole canonical URL, which is host + path (see `canonical`).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import points, table

#: (action, host and path prefix). The longest that fits decides.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
#: Where no rule fits, a URL that one of these globs matches is blocked, any other allowed.
BLOCK_GLOBS = ("**casino**", "**cheap-pills**", "**free-bets**", "**spam-farm**", "**adult-**", "ads-*", "*.ads-*", "ads-*/**", "*.ads-*/**")


class ShiftAnd:
    """All globs as one automaton; match() gives a Boolean row for each text, a column for each glob."""

    def __init__(self, globs: Sequence[str]):
        literals = sorted({c for g in globs for c in g if c not in "*?"} | {"/"})
        self.alphabet = np.array([ord(c) for c in literals], dtype=np.uint32)
        enter = [0] * (len(literals) + 1)  # the last class: any other character
        loop = [0] * (len(literals) + 1)
        start = bit = 0
        self.final: list[int] = []
        slash = literals.index("/")
        for glob in globs:
            start |= 1 << bit
            i = 0
            while i < len(glob):
                if glob[i] == "*":
                    wide = glob[i : i + 2] == "**"
                    for k in range(len(loop)):
                        if wide or k != slash:
                            loop[k] |= 1 << bit
                    i += 1 + wide
                    continue
                bit += 1
                for k in range(len(enter)) if glob[i] == "?" else (literals.index(glob[i]),):
                    if glob[i] != "?" or k != slash:
                        enter[k] |= 1 << bit
                i += 1
            self.final.append(bit)
            bit += 1
        self.words = max(1, -(-bit // 64))
        self.start, self.enter, self.loop = self._pack([start])[0], self._pack(enter), self._pack(loop)

    def _pack(self, masks: list[int]) -> np.ndarray:
        return np.array([np.frombuffer(m.to_bytes(8 * self.words, "little"), dtype="<u8") for m in masks])

    def match(self, texts: Sequence[str]) -> np.ndarray:
        n = len(texts)
        lengths = np.array([len(t) for t in texts], dtype=np.int64)
        cp = points("".join(texts))
        at = np.searchsorted(self.alphabet, cp)
        at[at == len(self.alphabet)] = 0
        classes = np.where(self.alphabet[at] == cp, at, len(self.alphabet))
        order = np.argsort(-lengths, kind="stable")
        begins = (np.cumsum(lengths) - lengths)[order]
        sorted_lengths = -lengths[order]
        state = np.tile(self.start, (n, 1))
        for t in range(int(lengths.max(initial=0))):
            k = int(np.searchsorted(sorted_lengths, -t))  # texts longer than t come first
            c = classes[begins[:k] + t]
            d = state[:k]
            moved = d << np.uint64(1)
            moved[:, 1:] |= d[:, :-1] >> np.uint64(63)
            state[:k] = (moved & self.enter[c]) | (d & self.loop[c])
        out = np.empty((n, len(self.final)), dtype=bool)
        for j, bit in enumerate(self.final):
            out[order, j] = (state[:, bit // 64] >> np.uint64(bit % 64)) & np.uint64(1)
        return out


class UrlFilter:
    """Host and path rules over globs, in one automaton."""

    def __init__(self, rules=RULES, block_globs=BLOCK_GLOBS):
        self.rules = sorted(rules, key=lambda r: len(r[1]))  # a later, longer one overrides
        globs = [g for _, rule in self.rules for g in (f"{rule}**", f"*.{rule}**")]
        self.automaton = ShiftAnd([*globs, *block_globs])

    def judge(self, urls: Sequence[str]) -> tuple[list[str | None], list[str]]:
        hit = self.automaton.match(urls)
        k = len(self.rules)
        rule = np.full(len(urls), None, dtype=object)
        verdict = np.where(hit[:, 2 * k :].any(axis=1), "block", "allow").astype(object)
        for j, (action, text) in enumerate(self.rules):
            fits = hit[:, 2 * j] | hit[:, 2 * j + 1]
            rule[fits], verdict[fits] = text, action
        return rule.tolist(), verdict.tolist()


def canonical(url: Column) -> tuple[Column, Column]:
    """Host (after the first ://, A-Z lower-cased) and path (up to ? or #); both empty without ://."""
    text, upper = F.coalesce(url, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    parts = r"://([^/?#]*)([^?#]*)"
    return F.translate(F.regexp_extract(text, parts, 1), upper, upper.lower()), F.regexp_extract(text, parts, 2)


def filter_urls(df: DataFrame, key: str = "page_id", url: str = "url", rules=RULES, block_globs=BLOCK_GLOBS) -> DataFrame:
    """key, host, path, rule, verdict of every row.

    A null or scheme-less url has an empty host and path and fits no rule; the block globs judge it
    (allow, as none matches the empty text). Repeated rows and null keys give a row each; other
    columns are not read; an empty table gives an empty result.
    """
    judge = UrlFilter(rules, block_globs).judge
    host, path = canonical(F.col(url))
    slim = df.select(F.col(key), host.alias("host"), path.alias("path"))
    schema = f"`{key}` {slim.schema[0].dataType.simpleString()}, host string, path string, rule string, verdict string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rule, verdict = judge([h + p for h, p in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(rule, pa.string()), pa.array(verdict, pa.string())], names=[key, "host", "path", "rule", "verdict"])

    return slim.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages", "page_id", "url"))


SQL = r"""
WITH p AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
r AS (
  SELECT *,
    CASE WHEN ('.' || host) LIKE '%.www.example.com' AND starts_with(path, '/en/') THEN 'www.example.com/en/'
         WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/en/') THEN 'example.com/en/'
         WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/es/') THEN 'net/es/'
         WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/fr/') THEN 'net/fr/'
         WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/') THEN 'com/' END AS rule
  FROM p)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow'
       WHEN rule IS NOT NULL THEN 'block'
       WHEN contains(host || path, 'casino') OR contains(host || path, 'cheap-pills') OR contains(host || path, 'free-bets')
         OR contains(host || path, 'spam-farm') OR contains(host || path, 'adult-')
         OR contains('.' || host, '.ads-') THEN 'block'
       ELSE 'allow' END AS verdict
FROM r
"""
