"""Mails and Received lines rendered from tables, in built-in expressions; for tests and round trips."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

END = "\r\n"


def base64_lines(data: Column) -> Column:
    """Base64 in lines of 76 characters (the JVM's encoder ends them with CR LF)."""
    return F.regexp_replace(F.regexp_replace(F.base64(data), r"\s+", ""), r"(.{76})(?=.)", "$1\r\n")


def rfc_date(ts: Column) -> Column:
    return F.date_format(ts, "d MMM yyyy HH:mm:ss +0000")


def encoded_word(text: Column) -> Column:
    return F.concat(F.lit("=?utf-8?b?"), F.regexp_replace(F.base64(F.encode(text, "utf-8")), r"\s+", ""), F.lit("?="))


def simple(text: Column, sender: Column, to: Column, subject: Column) -> Column:
    """Bytes of a mail with one base64 text part and an encoded subject."""
    return F.encode(
        F.concat(
            F.lit("From: "), sender, F.lit(f"{END}To: "), to, F.lit(f"{END}Subject: "), encoded_word(subject),
            F.lit(f"{END}MIME-Version: 1.0{END}Content-Type: text/plain; charset=utf-8{END}Content-Transfer-Encoding: base64{END}{END}"), base64_lines(F.encode(text, "utf-8")), F.lit(END),
        ),
        "utf-8",
    )


def multipart(plain: Column, html: Column, name: Column, payload: Column) -> Column:
    """Bytes of mixed(alternative(plain, html), attachment); a null name is left out."""
    head = "Content-Transfer-Encoding: base64"
    part = lambda kind, data: F.concat(F.lit(f"{END}Content-Type: {kind}{END}{head}{END}{END}"), base64_lines(data), F.lit(END))
    disposition = F.concat(F.lit("Content-Disposition: attachment"), F.coalesce(F.concat(F.lit('; filename="'), name, F.lit('"')), F.lit("")))
    return F.encode(
        F.concat(
            F.lit(f"From: a@example.com{END}To: b@example.com{END}Subject: parts{END}MIME-Version: 1.0{END}Content-Type: multipart/mixed; boundary=outer{END}{END}"),
            F.lit(f"--outer{END}Content-Type: multipart/alternative; boundary=inner{END}{END}--inner"),
            part("text/plain; charset=utf-8", F.encode(plain, "utf-8")), F.lit("--inner"), part("text/html; charset=utf-8", F.encode(html, "utf-8")), F.lit(f"--inner--{END}--outer{END}"),
            F.lit(f"Content-Type: application/octet-stream{END}{head}{END}"), disposition, F.lit(f"{END}{END}"), base64_lines(payload), F.lit(f"{END}--outer--{END}"),
        ),
        "utf-8",
    )


def nested(inner: Column) -> Column:
    """Bytes of a mail that carries another as message/rfc822."""
    head = F.lit(f"From: relay@example.org{END}To: c@example.org{END}Subject: forwarded{END}MIME-Version: 1.0{END}Content-Type: message/rfc822{END}{END}")
    return F.encode(F.concat(head, F.decode(inner, "utf-8")), "utf-8")


def hop_line(sender: Column, ip: Column, by: Column, kind: Column, to: Column, ts: Column) -> Column:
    return F.concat(F.lit("from "), sender, F.lit(" ("), sender, F.lit(" ["), ip, F.lit("]) by "), by, F.lit(" (Postfix (outer (inner))) with "), kind, F.lit(" for <"), to, F.lit(">; "), rfc_date(ts))


def mails_of_conversations(conversations: DataFrame) -> DataFrame:
    """key, turn, text, content: one simple mail a turn."""
    c = conversations
    return c.select(
        "conv_id", "turn", "role", "text",
        simple(F.coalesce("text", F.lit("")), F.concat(F.lit("User "), F.col("conv_id"), F.lit(" <U"), F.col("conv_id"), F.lit("@Example.com>")), F.concat(F.col("role"), F.lit("@example.org, Copy <copy@example.org>")), F.concat(F.lit("Größe "), F.col("conv_id"), F.lit("/"), F.col("turn"))).alias("content"),
    )
