"""Indicators of bodies: as arrays on each body, as rows, hashed, and without whitelisted ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Options
from ..functions import extract, hashing

KINDS = ("uri", "uri_noscheme", "email", "domain", "ip")


def body_indicators(df: DataFrame, text: str = "text", options: Options = Options()) -> DataFrame:
    """Adds the arrays uri, uri_noscheme, email, domain, ip."""
    t = F.col(text)
    out = df.withColumn("_urls", extract.urls(t, options)).withColumns({"email": extract.emails(t, options), "domain": extract.domains(t, options), "ip": extract.ips(t, options)})
    return out.withColumns({"uri": F.filter("_urls", extract.has_scheme), "uri_noscheme": F.filter("_urls", lambda u: ~extract.has_scheme(u))}).drop("_urls")


def hashed_indicators(df: DataFrame) -> DataFrame:
    """The arrays as SHA-256 (of lower case) in *_hash columns; scheme-less URLs have none, and the plain arrays go."""
    out = df.withColumns({f"{k}_hash": F.array_distinct(hashing.hashed(F.col(k))) for k in ("uri", "email", "domain", "ip")})
    return out.drop(*KINDS)


def indicator_rows(df: DataFrame, *keys: str, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """keys, kind, value: one row for each indicator of these kinds; others aren't searched."""
    return df.select(*keys, F.explode(F.map_from_arrays(F.array(*[F.lit(k) for k in kinds]), F.array(*kinds))).alias("kind", "some")).select(*keys, "kind", F.explode("some").alias("value"))


def without_listed(rows: DataFrame, listed: DataFrame) -> DataFrame:
    """Rows (kind, value, ...) without those of a whitelist (kind, value), of any size: Spark picks the join by its size."""
    return rows.join(listed.select("kind", "value").distinct(), ["kind", "value"], "left_anti")


def in_ranges(rows: DataFrame, ranges: DataFrame, bits: int = 16) -> DataFrame:
    """IPv4 rows (value) joined with ranges (low, high: numbers; name), by equal prefixes of 32 - bits bits.

    A range is dealt out to the prefixes that it covers, so that the join has a key and is no cross join.
    """
    from ..functions import hosts

    width = 1 << bits
    dealt = ranges.select("low", "high", "name", F.explode(F.sequence(F.floor(F.col("low") / width), F.floor(F.col("high") / width))).alias("prefix"))
    numbered = rows.filter(hosts.is_ipv4(F.col("value"))).withColumn("number", hosts.ipv4_number(F.col("value"))).withColumn("prefix", F.floor(F.col("number") / width))
    return numbered.join(dealt, "prefix").filter(F.col("number").between(F.col("low"), F.col("high"))).drop("prefix", "low", "high")
