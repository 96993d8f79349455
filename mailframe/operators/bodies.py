"""Bodies and attachments out of the parts of mails."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Options
from ..functions import hashing, text
from ..sources.mail import parts


def bodies(messages: DataFrame, *keep: str) -> DataFrame:
    """msg_id (and `keep` of the message), part_path, text, content_header, content_type, hash, boundary of each body; body_no from 0.

    Only one body: only the content headers are its own.
    """
    found = messages.select("msg_id", *keep, F.posexplode(F.filter("parts", lambda p: p["is_body"])).alias("body_no", "part"), F.size(F.filter("parts", lambda p: p["is_body"])).alias("n"))
    headers = text.headers_map(F.col("part.headers"), colons=True)
    return found.withColumn("all_headers", headers).select(
        "msg_id", *keep, "body_no", "part.part_path", "part.text", text.content_headers(F.col("all_headers"), F.col("n")).alias("content_header"),
        text.media_type(F.col("all_headers")).alias("content_type"), hashing.digest(F.col("part.text"), "sha256").alias("hash"), "part.boundary",
    )


def attachments(messages: DataFrame, options: Options = Options(), *keep: str) -> DataFrame:
    """msg_id (and `keep` of the message), part_path, filename, size, extension, hash, mime type by signature, headers; raw (base64) if asked for."""
    p = parts(messages, *keep).filter("is_attachment")
    out = p.select(
        "msg_id", *keep, "part_path", "filename", "size", text.file_extension(F.col("filename")).alias("extension"), hashing.digests(F.col("payload")).alias("hash"),
        hashing.media_signature(F.col("payload")).alias("media"), text.headers_map(F.col("headers")).alias("content_header"), "payload",
    )
    out = out.select("msg_id", *keep, "part_path", "filename", "size", "extension", "hash", "media.mime_type", "media.mime_type_short", "content_header", *(["payload"] if options.attachment_data else []))
    return out.withColumn("raw", hashing.base64(F.col("payload"))).drop("payload") if options.attachment_data else out


def safe_name(name: str, path: list[int]) -> str:
    """Place in the mail and file name, without folders, control characters and leading dots."""
    base = "".join(c for c in name.replace("\\", "/").rsplit("/", 1)[-1] if c.isprintable()).lstrip(". ")
    return f"{'.'.join(map(str, path)) or '0'}-{base[:150] or 'part'}"


def write_attachments(messages: DataFrame, folder: str) -> None:
    """Write payloads to a folder that all executors share, one subfolder a message; names can't leave it."""

    def run(rows) -> None:
        for k, r in enumerate(rows):
            own = os.path.join(folder, r.msg_id)
            os.makedirs(own, exist_ok=True)
            name = safe_name(r.filename, r.part_path)
            temporary = os.path.join(own, f".{name}.{k}")
            with open(temporary, "wb") as file:
                file.write(r.payload)
            os.replace(temporary, os.path.join(own, name))  # a task that runs again writes the same file

    parts(messages).filter("is_attachment").select("msg_id", "part_path", "filename", "payload").foreachPartition(run)
