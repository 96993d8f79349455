"""Small string and header-map functions, all of them built-in expressions."""

from __future__ import annotations

import json
import zlib
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from .hosts import _let


def without_parentheses(text: Column) -> Column:
    """Remove parenthesised parts to any depth: in one pass up to P.DEEPEST levels, else innermost first, a level a pass."""
    count = lambda c: F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))
    depth = F.least(count("("), count(")"))  # nested no deeper
    level = lambda acc, _: F.when(F.contains(acc, F.lit("(")), F.regexp_replace(acc, P.INNERMOST, "")).otherwise(acc)
    return F.when(depth > P.DEEPEST, F.aggregate(F.sequence(F.lit(1), F.greatest(depth, F.lit(1))), text, level)).when(depth > 0, F.regexp_replace(text, P.PARENTHESES, "")).otherwise(text)


def trim_edges(text: Column) -> Column:
    """Remove semicolons and white space at both ends."""
    return F.regexp_replace(text, P.EDGES, "")


def flatten_white(text: Column) -> Column:
    """Runs of white space become one space."""
    return F.regexp_replace(text, r"(?U)\s+", " ")


def media_type(headers: Column) -> Column:
    """Last Content-Type value, without parameters; null without one."""
    return F.trim(F.split_part(F.try_element_at(F.try_element_at(headers, F.lit("content-type")), F.lit(-1)), F.lit(";"), F.lit(1)))


def file_extension(name: Column) -> Column:
    """Last suffix of a file name, lower case, without the dot; null without one."""
    return F.nullif(F.lower(F.regexp_extract(name, r"[^/]\.([^./]+)$", 1)), F.lit(""))


def headers_map(pairs: Column, colons: bool = False) -> Column:
    """array<struct<name, value>> to map<lower-case name, values in order>; empty values are dropped.

    colons: dots in names become colons, as keys of body parts have them.
    """
    name = lambda p: F.replace(F.lower(p["name"]), F.lit("."), F.lit(":")) if colons else F.lower(p["name"])
    full = F.filter(pairs, lambda p: F.length(p["value"]) > 0)
    keys = F.array_distinct(F.transform(full, name))
    return F.map_from_entries(F.transform(keys, lambda k: F.struct(k.alias("key"), F.transform(F.filter(full, lambda p: name(p) == k), lambda p: p["value"]).alias("value"))))


def content_headers(headers: Column, bodies: Column) -> Column:
    """With one body only the content-* headers, as the others are the message's; else all."""
    return F.when(bodies == 1, F.map_filter(headers, lambda k, _: F.startswith(k, F.lit("content")))).otherwise(headers)


#: Lists that the names of character references are dealt out to, as a look into a map takes time in proportion to its size.
_BUCKETS = 1024


def _entities() -> str:
    """JSON of the standard's names (with their semicolons; some old ones also without), dealt out by their CRC-32."""
    buckets: list[dict[str, str]] = [{} for _ in range(_BUCKETS)]
    for name, value in html5.items():
        buckets[zlib.crc32(name.encode()) % _BUCKETS][name] = value
    return json.dumps(buckets)


def _numbers() -> str:
    """JSON of the numbers that stand for Windows-1252."""
    return json.dumps({str(n): bytes([n]).decode("cp1252") for n in range(128, 160) if n not in (129, 141, 143, 144, 157)})


def unescape_entities(text: Column) -> Column:
    """Character references, each decoded once. Old names count without a semicolon, too, and as the start of a longer word."""
    names, numbers = F.from_json(F.lit(_entities()), "array<map<string,string>>"), F.from_json(F.lit(_numbers()), "map<string,string>")
    old = "|".join(sorted((n for n in html5 if not n.endswith(";")), key=len, reverse=True))

    def char(number: Column) -> Column:
        good = number.between(1, 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
        wide = F.decode(F.unhex(F.lpad(F.hex(F.when(good, number).otherwise(F.lit(0xFFFD))), 8, "0")), "UTF-32")
        return F.coalesce(F.when(number.between(128, 159), F.try_element_at(numbers, number.cast("string"))), wide)

    def number(head: Column) -> Column:
        digits = F.translate(head, "#xX;", "")
        return F.when(F.rlike(head, F.lit("^#[xX]")), F.conv(digits, 16, 10)).otherwise(digits).cast("long")

    def decoded(part: Column) -> Column:
        plain, after = F.concat(F.lit("&"), part), lambda head: F.substring(part, F.length(head) + 1, F.length(part))
        value = lambda name: F.try_element_at(F.get(names, (F.crc32(name) % _BUCKETS).cast("int")), name)
        numbered = _let(F.regexp_extract(part, r"^#(?:[0-9]{1,9}+|[xX][0-9a-fA-F]{1,8}+);?", 0), lambda h: F.when(h == "", plain).otherwise(F.concat(_let(number(h), char), after(h))))
        start = _let(F.regexp_extract(part, f"^(?:{old})", 0), lambda n: F.when(n == "", plain).otherwise(F.concat(value(n), after(n))))
        named = _let(F.regexp_extract(part, r"^[A-Za-z][A-Za-z0-9]*+;?", 0), lambda n: F.coalesce(F.concat(value(n), after(n)), start))
        return F.when(F.startswith(part, F.lit("#")), numbered).otherwise(named)

    parts = F.split(text, "&")
    rest = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), decoded)
    return F.concat(parts[0], F.array_join(rest, ""))
