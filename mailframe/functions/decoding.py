"""Decoding of header fields, charsets and dates, in Python; and the same as vectorised columns."""

from __future__ import annotations

import base64
import binascii
import datetime
import email.utils
import functools
import quopri
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

try:
    from charset_normalizer import from_bytes
except ImportError:  # detection is optional
    from_bytes = None
try:
    from dateutil import parser as fuzzy
except ImportError:
    fuzzy = None

#: Bytes below which a guess at the charset is no better than Latin-1.
DETECTABLE = 64
UTC = datetime.timezone.utc
DEFAULT_DATE = datetime.datetime(1970, 1, 1, tzinfo=UTC)
_NO_YEAR = re.compile(r"[A-Za-z]{3}[ -]+0\d{3}\b")  # years of a first millennium are no dates of mails
_MONTHS = {m: k for k, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split(), 1)}
_PLAIN = re.compile(rf"(?:(?:mon|tue|wed|thu|fri|sat|sun), )?([0-9]{{1,2}}) ({'|'.join(_MONTHS)}) ([1-9][0-9]{{3}}) ([0-9]{{2}}):([0-9]{{2}}):([0-9]{{2}}) (?!-0000)([+-])([0-9]{{2}})([0-9]{{2}})", re.I | re.A)
WORD = re.compile(r"=\?([^\s?*]+)(?:\*[^\s?]*)?\?([BbQq])\?([^?]*)\?=")


def decode_bytes(raw: bytes, charset: str | None = None) -> str:
    """By the hint, else UTF-8, else by detection, else as Latin-1."""
    if charset:
        try:
            return raw.decode(charset)
        except (LookupError, ValueError):
            pass
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        pass
    if from_bytes is not None and len(raw) >= DETECTABLE:
        best = from_bytes(raw).best()
        if best is not None:
            return str(best)
    return raw.decode("latin-1")


def unfold(value: str) -> str:
    """A header value on one line."""
    if "\n" not in value and "\r" not in value:
        return value
    return re.sub(r"\r?\n(?=[ \t])", "", value).replace("\r", "").replace("\n", "")


def has_bytes(value: str) -> bool:
    """Whether a raw header value holds eight-bit bytes, as surrogates."""
    return not value.isascii() and any("\udc80" <= c <= "\udcff" for c in value)


def _word_bytes(kind: str, data: str) -> bytes | None:
    raw = data.encode("ascii", "ignore")
    try:
        return base64.b64decode(raw + b"=" * (-len(raw) % 4)) if kind in "Bb" else quopri.decodestring(raw, header=True)
    except (binascii.Error, ValueError):
        return None


def decode_words(value: str, strict: bool = False) -> str:
    """RFC 2047 words decoded; white space between two words goes; what can't be decoded stays.

    strict: words in an unknown charset are read as ASCII; else the charset is detected.
    """
    out, at, pending, charset_before = [], 0, b"", None

    def flush():
        nonlocal pending, charset_before
        if charset_before is not None:
            try:
                out.append(pending.decode(charset_before, "replace") if strict else decode_bytes(pending, charset_before))
            except LookupError:
                out.append(pending.decode("ascii", "ignore"))
        pending, charset_before = b"", None

    for m in WORD.finditer(value):
        between = value[at : m.start()]
        raw = _word_bytes(m[2], m[3])
        if raw is None:
            continue
        if charset_before is None or between.strip():
            flush()
            out.append(between)
        if charset_before is not None and m[1].lower() != charset_before:
            flush()
        pending, charset_before, at = pending + raw, m[1].lower(), m.end()
    flush()
    return "".join(out) + value[at:]


def decode_header(value: str) -> str:
    """A raw header value as text: unfolded, eight-bit bytes decoded, words decoded."""
    if value.isascii() and "=?" not in value:
        return unfold(value)
    if has_bytes(value):
        value = decode_bytes(value.encode("ascii", "surrogateescape") if value.isascii() else value.encode("utf-8", "surrogateescape"))
    return decode_words(unfold(value)).encode("utf-8", "replace").decode("utf-8")


def plain_date(text: str) -> datetime.datetime | None:
    """A date in RFC 5322's usual form, or null: what the library's parser gives for it, in a tenth of the time."""
    m = _PLAIN.fullmatch(text)
    if not m:
        return None
    day, month, year, hour, minute, second, sign, hours, minutes = m.groups()
    offset = datetime.timedelta(hours=int(hours), minutes=int(minutes))
    try:
        found = datetime.datetime(int(year), _MONTHS[month.lower()], int(day), int(hour), int(minute), int(second), tzinfo=datetime.timezone(-offset if sign == "-" else offset))
        found.astimezone(UTC)
    except (OverflowError, ValueError):
        return None
    return found


@functools.lru_cache(maxsize=4096)  # a mail's date is asked for in several places, and dates that are none come again and again
def parse_date(text: str | None) -> datetime.datetime:
    """RFC 5322, else any date that can be found in the text, else the epoch. Missing fields come from the epoch."""
    plain = plain_date(text) if text else None
    if plain is not None:
        return plain
    if not text or not text.strip() or _NO_YEAR.search(text):
        return DEFAULT_DATE
    found = None
    try:
        found = email.utils.parsedate_to_datetime(text)
    except (TypeError, ValueError, IndexError, OverflowError):
        if fuzzy is not None:
            try:
                found = fuzzy.parse(text, fuzzy=True, default=datetime.datetime(1970, 1, 1))
            except (ValueError, OverflowError, TypeError, AttributeError):
                found = None
    if found is None or found.year < 1000:
        return DEFAULT_DATE
    found = found if found.tzinfo else found.replace(tzinfo=UTC)
    try:
        found.astimezone(UTC)
    except (OverflowError, ValueError):
        return DEFAULT_DATE
    return found


@F.pandas_udf(StringType())
def _decode_field(value: pd.Series) -> pd.Series:
    return value.map(decode_header, na_action="ignore")


@F.pandas_udf(StringType())
def _decode_strict(value: pd.Series) -> pd.Series:
    return value.map(lambda v: decode_words(unfold(v), strict=True), na_action="ignore")


@F.pandas_udf(StringType())
def _decode_bytes(raw: pd.Series, charset: pd.Series) -> pd.Series:
    return pd.Series([None if r is None else decode_bytes(bytes(r), c) for r, c in zip(raw, charset, strict=True)])


def decoded_field(value: Column) -> Column:
    """Decode words; only values that hold one go through Python."""
    return F.when(F.contains(value, F.lit("=?")), _decode_field(F.when(F.contains(value, F.lit("=?")), value))).otherwise(value)


def decoded_strictly(value: Column) -> Column:
    return F.when(F.contains(value, F.lit("=?")), _decode_strict(F.when(F.contains(value, F.lit("=?")), value))).otherwise(value)


def decoded_bytes(raw: Column, charset: Column | None = None) -> Column:
    return _decode_bytes(raw, F.lit(None).cast("string") if charset is None else charset)
