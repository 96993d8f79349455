"""Shared helpers: table reading, shared scratch storage, text to code points."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch; texts are long, so batches are kept short.
ARROW_ROWS = 512
#: Characters that are handled in one numpy step; longer texts go piece by piece.
PIECE = 1 << 20
#: The white space of the word contracts.
WHITE = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A driver table, narrowed to `columns` so that the scan reads no others."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def short_batches(spark: SparkSession) -> None:
    """Bound the rows of an Arrow batch, as whole texts travel in them."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > ARROW_ROWS or int(spark.conf.get(key, "10000")) <= 0:
        spark.conf.set(key, str(ARROW_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where that is unset and everything runs in one JVM (tests), a local folder is made.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="mailframe-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


class Scratch:
    """Tables written to the shared folder, which cut lineage and survive lost executors.

    Each is removed by drop(), or when the driver's JVM ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"
        self.count = 0
        self._path(self.base, lambda fs, p: fs.deleteOnExit(p))

    def _path(self, path: str, act) -> None:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        fs.mkdirs(jvm.org.apache.hadoop.fs.Path(self.base))
        act(fs, p)

    def save(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.base}/{self.count}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Remove a saved table that no later plan reads."""
        self._path(df._scratch_path, lambda fs, p: fs.delete(p, True))


def id_hash(doc_id: Column) -> Column:
    """crc32 of the id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def points(text: str) -> np.ndarray:
    """Unicode code points of a text."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def pieces(text: str, overlap: int, size: int = PIECE):
    """A text in slices of bounded length; each repeats the last `overlap` characters of the one before.

    Windows of overlap + 1 characters are thus met exactly once.
    """
    if len(text) <= size:
        yield text
        return
    for start in range(0, max(1, len(text) - overlap), size - overlap):
        yield text[start : start + size]
