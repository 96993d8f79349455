"""Dates of mails. Spark keeps the instant; the ISO text keeps the offset."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from .decoding import parse_date

EPOCH = "1970-01-01T00:00:00+00:00"
# Zone names of RFC 5322.
ZONES = (("UT", "+0000"), ("UTC", "+0000"), ("GMT", "+0000"), ("EST", "-0500"), ("EDT", "-0400"), ("CST", "-0600"), ("CDT", "-0500"), ("MST", "-0700"), ("MDT", "-0600"), ("PST", "-0800"), ("PDT", "-0700"))


def tidy(text: Column) -> Column:
    """Without comments, weekday and zone names; white space flattened."""
    t = F.regexp_replace(F.regexp_replace(text, r"\([^()]*\)", " "), r"^\s*[A-Za-z]{3,9}\s*,\s*", "")
    t = F.trim(F.regexp_replace(t, r"\s+", " "))
    zone = F.upper(F.regexp_extract(t, r" ([A-Za-z]{2,3})$", 1))
    offset = F.create_map(*[F.lit(x) for pair in ZONES for x in pair])[zone]
    return F.when(offset.isNull(), t).otherwise(F.concat(F.regexp_extract(t, r"^(.*) [A-Za-z]{2,3}$", 1), F.lit(" "), offset))


def parse_tidy(t: Column) -> Column:
    """Timestamp of a tidied text by the format that its length and form call for, or null."""
    zoned, seconds = F.rlike(t, F.lit(r"[+-]\d{4}$")), F.rlike(t, F.lit(r"\d:\d\d:\d\d"))
    at = lambda f: F.try_to_timestamp(t, F.lit(f))
    words = F.when(zoned & seconds, at("d MMM yyyy H:mm:ss xx")).when(zoned, at("d MMM yyyy H:mm xx")).when(seconds, at("d MMM yyyy H:mm:ss")).otherwise(at("d MMM yyyy H:mm"))
    iso = F.when(F.contains(t, F.lit("T")) | F.contains(t, F.lit("t")), at("yyyy-MM-dd'T'HH:mm:ssXXX")).otherwise(at("yyyy-MM-dd HH:mm:ss"))
    return F.when(F.rlike(t, F.lit(r"^[1-9]\d{3}-")), iso).when(F.rlike(t, F.lit(r"^\d{1,2} \w+ [1-9]\d{3} ")), words)


def parse(text: Column) -> Column:
    """Timestamp by the common formats alone, or null; no Python."""
    return F.element_at(F.transform(F.array(tidy(text)), parse_tidy), 1)  # tidied once


def parse_or_epoch(text: Column) -> Column:
    return F.coalesce(parse(text), F.lit(EPOCH).cast("timestamp"))


@F.pandas_udf(StringType())
def _robust_iso(text: pd.Series) -> pd.Series:
    return text.map(lambda t: parse_date(t).isoformat())


def robust_iso(text: Column) -> Column:
    """ISO text with offset of any date that can be made sense of, else the epoch; fuzzy ones take Python."""
    return F.when(F.length(F.coalesce(text, F.lit(""))) == 0, F.lit(EPOCH)).otherwise(_robust_iso(text))


@F.pandas_udf(ArrayType(StringType()))
def robust_isos(texts: pd.Series) -> pd.Series:
    """ISO texts of the dates in an array; null arrays and null dates stay null."""
    return texts.map(lambda a: None if a is None else [None if t is None else parse_date(t).isoformat() for t in a])


def robust(text: Column) -> Column:
    """Timestamp: common formats in the JVM, only the rest in Python."""
    fast = parse(text)
    rest = F.when(fast.isNull() & (F.length(F.coalesce(text, F.lit(""))) > 0), text)
    return F.coalesce(fast, F.when(rest.isNotNull(), robust_iso(rest).cast("timestamp")), F.lit(EPOCH).cast("timestamp"))


def trailing(flat: Column) -> Column:
    """The date after the last semicolon of a flattened line without parentheses; empty if there is none."""
    return F.trim(F.regexp_extract(flat, r";([\pL\pN_ :,+\-()]+)$", 1))
