"""Digests, sizes, Base64 and file signatures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KINDS = ("md5", "sha1", "sha256", "sha512")


def digest(value: Column, kind: str) -> Column:
    """Lower-case hex digest; strings count as UTF-8."""
    if kind not in KINDS:
        raise ValueError(f"unknown digest {kind!r}; known: {', '.join(KINDS)}")
    return {"md5": F.md5, "sha1": F.sha1, "sha256": lambda v: F.sha2(v, 256), "sha512": lambda v: F.sha2(v, 512)}[kind](value)


def digests(value: Column) -> Column:
    return F.struct(*[digest(value, k).alias(k) for k in KINDS])


def hashed(values: Column) -> Column:
    """SHA-256 of the lower-cased values."""
    return F.transform(values, lambda v: F.sha2(F.lower(v), 256))


def base64(payload: Column) -> Column:
    """Base64 on one line (the JVM's encoder breaks it after 76 characters)."""
    return F.replace(F.base64(payload), F.lit("\r\n"), F.lit(""))


def size(payload: Column) -> Column:
    return F.octet_length(payload).cast("long")


# Leading bytes (hex), description, media type.
SIGNATURES = (
    ("255044462D", "PDF document", "application/pdf"),
    ("89504E470D0A1A0A", "PNG image data", "image/png"),
    ("FFD8FF", "JPEG image data", "image/jpeg"),
    ("474946383761", "GIF image data", "image/gif"),
    ("474946383961", "GIF image data", "image/gif"),
    ("504B0304", "Zip archive data", "application/zip"),
    ("1F8B", "gzip compressed data", "application/gzip"),
    ("526172211A07", "RAR archive data", "application/x-rar"),
    ("377ABCAF271C", "7-zip archive data", "application/x-7z-compressed"),
    ("D0CF11E0A1B11AE1", "Composite Document File V2 Document", "application/x-ole-storage"),
    ("4D5A", "PE executable", "application/x-dosexec"),
    ("7F454C46", "ELF executable", "application/x-executable"),
    ("7B5C727466", "Rich Text Format data", "text/rtf"),
    ("3C3F786D6C20", "XML document", "text/xml"),
    ("25215053", "PostScript document", "application/postscript"),
    ("49492A00", "TIFF image data", "image/tiff"),
    ("4D4D002A", "TIFF image data", "image/tiff"),
    ("425A68", "bzip2 compressed data", "application/x-bzip2"),
    ("FD377A585A00", "XZ compressed data", "application/x-xz"),
    ("28B52FFD", "Zstandard compressed data", "application/zstd"),
    ("4D534346", "Microsoft Cabinet archive data", "application/vnd.ms-cab-compressed"),
    ("494433", "MPEG audio with ID3", "audio/mpeg"),
    ("4F676753", "Ogg data", "application/ogg"),
    ("664C6143", "FLAC audio", "audio/flac"),
    ("53514C697465", "SQLite database", "application/vnd.sqlite3"),
    ("0061736D", "WebAssembly binary", "application/wasm"),
)


def media_signature(payload: Column) -> Column:
    """struct<mime_type, mime_type_short> by the leading bytes; null where none is known."""
    head = F.hex(F.substring(payload, 1, 8))
    out = None
    for magic, name, kind in SIGNATURES:
        value = F.struct(F.lit(name).alias("mime_type"), F.lit(kind).alias("mime_type_short"))
        out = F.when(F.startswith(head, F.lit(magic)), value) if out is None else out.when(F.startswith(head, F.lit(magic)), value)
    return out
