"""Mails as tables: from files, from a column of bytes, as a data source and as a table function."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..config import Options
from ..schema import MESSAGE
from . import mime

#: Mails in one Arrow batch, as payloads may be large.
BATCH = 64


def files(spark: SparkSession, path: str, glob: str = "*.eml", recursive: bool = False) -> DataFrame:
    """path, modificationTime, length, content of mail files in any store that Spark reads."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower()).load(path)


def parse_mails(df: DataFrame, options: Options = Options(), content: str = "content", path: str | None = "path", fields: tuple[str, ...] | None = None) -> DataFrame:
    """Rows of schema.MESSAGE from a column of bytes; null bytes are an empty mail.

    fields: columns to have, if not all; the others aren't worked out.
    Payloads of attachments stay in the rows; columns that aren't asked for are dropped by the JVM right after the parse.
    """
    schema = MESSAGE if fields is None else StructType([f for f in MESSAGE if f.name in fields])
    arrow = to_arrow_schema(schema)
    slim = df.select(F.col(content).alias("content"), (F.col(path) if path and path in df.columns else F.lit(None)).cast("string").alias("path"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, len(b), BATCH):
                part = b.slice(k, BATCH)
                rows = [mime.parse(c or b"", options, p, fields) for c, p in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return slim.mapInArrow(run, schema)


def parts(messages: DataFrame, *keep: str) -> DataFrame:
    """One row a part, with msg_id (and `keep`) of its message."""
    return messages.select("msg_id", *keep, F.explode("parts").alias("part")).select("msg_id", *keep, "part.*")


class MailFiles(DataSource):
    """format("rfc822"): options path, recursive, suffix, filesPerTask, skip_bad_start, email_needs_tld.

    pushdown: filters on path choose the files (needs spark.sql.python.filterPushdown.enabled).
    """

    @classmethod
    def name(cls) -> str:
        return "rfc822"

    def schema(self):
        return MESSAGE

    def reader(self, schema):
        return (FilteringMailReader if self.options.get("pushdown") == "true" else MailReader)(self.options)


class MailReader(DataSourceReader):
    """Files of a folder that all executors see, some to a partition."""

    def __init__(self, options: dict):
        self.path = options.get("path", "")
        self.recursive = options.get("recursive", "false") == "true"
        self.suffix = options.get("suffix", ".eml")
        self.per_task = int(options.get("filespertask", "200"))
        flag = lambda k: options.get(k.replace("_", ""), options.get(k, "false")) == "true"
        self.config = Options(skip_bad_start=flag("skip_bad_start"), email_needs_tld=flag("email_needs_tld"))
        self.wanted: set[str] | None = None

    def partitions(self):
        found = []
        for folder, _, names in os.walk(self.path):
            paths = [os.path.join(folder, n) for n in names if n.endswith(self.suffix)]
            found += [p for p in paths if self.wanted is None or p in self.wanted]
            if not self.recursive:
                break
        found.sort()
        return [InputPartition(found[k : k + self.per_task]) for k in range(0, len(found), self.per_task)] or [InputPartition([])]

    def read(self, partition):
        arrow = to_arrow_schema(MESSAGE)
        for k in range(0, len(partition.value), BATCH):
            rows = []
            for path in partition.value[k : k + BATCH]:
                with open(path, "rb") as file:
                    rows.append(mime.parse(file.read(), self.config, path))
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)


class FilteringMailReader(MailReader):
    """Filters on path reach the listing."""

    def pushFilters(self, filters):
        for f in filters:
            if type(f).__name__ == "EqualTo" and tuple(f.attribute) == ("path",):
                self.wanted = {f.value} if self.wanted is None else self.wanted & {f.value}
            elif type(f).__name__ == "In" and tuple(f.attribute) == ("path",):
                self.wanted = set(f.value) if self.wanted is None else self.wanted & set(f.value)
            else:
                yield f


class ParseMail:
    """Table function: parse_rfc822(content) gives a row for each part."""

    def eval(self, content: bytes):
        row = mime.parse(bytes(content or b""))
        for p in row.get("parts") or ():
            yield row["msg_id"], row.get("subject"), row.get("from"), p["part_path"], p.get("content_type"), p.get("filename"), p["is_body"], p["is_attachment"], p.get("text"), p.get("size"), p.get("error")


def register(spark: SparkSession) -> None:
    """Make format("rfc822") and the SQL table function parse_rfc822 known to a session."""
    spark.dataSource.register(MailFiles)
    kind = "msg_id string, subject string, sender string, part_path array<int>, content_type string, filename string, is_body boolean, is_attachment boolean, text string, size bigint, error string"
    spark.udtf.register("parse_rfc822", F.udtf(ParseMail, returnType=kind))
