"""The same transformations over mails that arrive."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..config import Options
from ..operators import indicators
from ..schema import MESSAGE
from ..sources import mail, mime

FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def mail_stream(spark: SparkSession, folder: str, options: Options = Options(), glob: str = "*.eml", files_per_batch: int = 1000) -> DataFrame:
    """Parsed mails of files as they appear in a folder; a row keeps when its file was written (arrived)."""
    files = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_batch).load(folder)
    arrived = files.select(F.sha2("content", 256).alias("msg_id"), F.col("modificationTime").alias("arrived"), "content", "path")
    return _parsed(arrived, options)


def _parsed(arrived: DataFrame, options: Options) -> DataFrame:
    """Parse row by row and keep the time of arrival, without a join."""
    schema = StructType([*MESSAGE.fields, arrived.schema["arrived"]])
    arrow = to_arrow_schema(MESSAGE)

    def run(batches):
        for b in batches:
            for k in range(0, len(b), mail.BATCH):
                part = b.slice(k, mail.BATCH)
                rows = [mime.parse(c or b"", options, p) for c, p in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)]
                out = pa.RecordBatch.from_pylist(rows, schema=arrow)
                yield pa.RecordBatch.from_arrays([*out.columns, part.column(2)], names=[*arrow.names, "arrived"])

    return arrived.select("content", "path", "arrived").mapInArrow(run, schema)


def first_seen(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each message once, by the hash of its bytes, within the watermark."""
    return stream.withWatermark("arrived", late).dropDuplicatesWithinWatermark(["msg_id"])


def indicator_stream(stream: DataFrame, options: Options = Options()) -> DataFrame:
    """arrived, msg_id, kind, value of the indicators in bodies."""
    texts = stream.select("msg_id", "arrived", F.explode(F.transform(F.filter("parts", lambda p: p["is_body"]), lambda p: p["text"])).alias("text"))
    return indicators.indicator_rows(indicators.body_indicators(texts, "text", options), "arrived", "msg_id")


def indicator_counts(rows: DataFrame, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Indicators by window of arrival."""
    return rows.withWatermark("arrived", late).groupBy(F.window("arrived", window), "kind").agg(F.count("*").alias("n"), F.approx_count_distinct("value").alias("distinct_values"))
