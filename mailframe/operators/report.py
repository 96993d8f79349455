"""One nested report a message, as a struct and as JSON (absent keys are left out)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Options
from ..functions import extract, hashing, text
from . import received as R

JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ssXXX", "ignoreNullFields": "true"}


def report(messages: DataFrame, options: Options = Options(), *keep: str) -> DataFrame:
    """msg_id (and `keep` of the message), header, body, attachment of every mail, in its own row: nothing is shuffled.

    Mails of equal bytes have a report each. A mail that couldn't be parsed has empty lists. Payloads, and texts unless they are
    asked for, are dropped before the path is parsed.
    """
    lists = {"_body": _bodies(F.col("parts")), "_attachment": _attachments(F.col("parts"), options)}
    df = R.fixed(messages, **lists).drop("parts")
    df = R.fixed(df, _body=_found(F.col("_body"), options))
    df = R.fixed(df, _body=_shown(F.col("_body"), options))
    df = R.with_path(df, "_hops")
    if options.entry_hosts:
        df = R.with_entries(df, options, "_hops")
    df = R.with_path_indicators(df, options, "_hops")
    header = F.struct(
        "subject", "defect", "from", "to", "cc", "delivered_to", F.to_timestamp("date_iso").alias("date"), "date_iso", F.col("_hops").alias("received"),
        "received_email", "received_domain", "received_ip", "received_foremail", *(["received_src"] if options.entry_hosts else []), text.headers_map(F.col("headers")).alias("header"),
    )
    attachment = [F.when(F.size("_attachment") > 0, F.col("_attachment")).alias("attachment")] if options.attachments else []
    return df.select("msg_id", *keep, header.alias("header"), F.col("_body").alias("body"), *attachment)


def _of(parts: Column, flag: str, made) -> Column:
    """Structs of the parts with a flag, in order; empty if there are no parts at all."""
    some = F.transform(F.filter(parts, lambda p: p[flag]), made)
    return F.coalesce(some, F.filter(F.transform(F.array(F.get(parts, F.lit(0))), made), lambda _: F.lit(False)))


def _bodies(parts: Column) -> Column:
    return _of(parts, "is_body", lambda p: F.struct(p["text"].alias("text"), p["boundary"].alias("boundary"), text.headers_map(p["headers"], colons=True).alias("headers")))


def _found(bodies: Column, options: Options) -> Column:
    """Bodies with the lists of their indicators."""
    n = F.size(bodies)

    def one(b: Column) -> Column:
        lists = {"urls": extract.urls, "email": extract.emails, "domain": extract.domains, "ip": extract.ips}
        return F.struct(
            *[f(b["text"], options).alias(k) for k, f in lists.items()], b["text"].alias("content"), text.content_headers(b["headers"], n).alias("content_header"),
            text.media_type(b["headers"]).alias("content_type"), hashing.digest(b["text"], "sha256").alias("hash"), b["boundary"].alias("boundary"),
        )

    return F.transform(bodies, one)


def _shown(bodies: Column, options: Options) -> Column:
    """Bodies as reports have them: lists null where empty, as they are or hashed."""
    own = ("content_header", "content_type", "hash", "boundary")

    def one(b: Column) -> Column:
        lists = {"uri": F.filter(b["urls"], extract.has_scheme), "uri_noscheme": F.filter(b["urls"], lambda u: ~extract.has_scheme(u)), "email": b["email"], "domain": b["domain"], "ip": b["ip"]}
        if not options.raw_body:
            lists = {f"{k}_hash": F.array_distinct(hashing.hashed(v)) for k, v in lists.items() if k != "uri_noscheme"}
        return F.struct(*[F.when(F.size(v) > 0, v).alias(k) for k, v in lists.items()], *([b["content"].alias("content")] if options.raw_body else []), *[b[k].alias(k) for k in own])

    return F.transform(bodies, one)


def _attachments(parts: Column, options: Options) -> Column:
    def one(p: Column) -> Column:
        media = hashing.media_signature(p["payload"])
        raw = [hashing.base64(p["payload"]).alias("raw")] if options.attachment_data else []
        return F.struct(
            p["filename"].alias("filename"), p["size"].alias("size"), text.file_extension(p["filename"]).alias("extension"), hashing.digests(p["payload"]).alias("hash"),
            media["mime_type"].alias("mime_type"), media["mime_type_short"].alias("mime_type_short"), text.headers_map(p["headers"]).alias("content_header"), *raw,
        )

    return _of(parts, "is_attachment", one)


def to_json(reports: DataFrame, pretty: bool = False) -> DataFrame:
    """msg_id (and what the reports keep), json."""
    fields = [c for c in ("header", "body", "attachment") if c in reports.columns]
    return reports.select(*[c for c in reports.columns if c not in fields], F.to_json(F.struct(*fields), {**JSON, "pretty": str(pretty).lower()}).alias("json"))


def summary(messages: DataFrame) -> DataFrame:
    """Message counts by sender's host, and how many distinct indicators their bodies have, summed over bodies.

    Repeated mails count each. Indicators are counted in the row of the mail: only hosts and two numbers are shuffled.
    """
    found = lambda p: F.size(extract.urls(p["text"])) + F.size(extract.emails(p["text"])) + F.size(extract.domains(p["text"])) + F.size(extract.ips(p["text"]))
    n = F.aggregate(F.transform(F.filter("parts", lambda p: p["is_body"]), found), F.lit(0).cast("long"), lambda a, x: a + x)
    host = F.element_at(F.split("from", "@"), -1)
    return messages.select(host.alias("sender_host"), F.coalesce(n, F.lit(0)).alias("n")).groupBy("sender_host").agg(F.count("*").alias("messages"), F.sum("n").alias("indicators"))
