"""Mixing sources to target weights, by Efraimidis-Spirakis sampling.

Each source gets a budget of words. It is met by complete epochs (every document once, or more
often) and then by a fraction of an epoch: documents in the order of exponential keys
-ln(u) / weight, u being a hash of the id and the weight the document's quality, until the prefix
sum of words reaches the rest of the budget. The document at the end gives its first words only, so
that a budget is met exactly.

No source is sorted in one task. Two rounds of a histogram over the keys find the one narrow range of keys in which
a source's budget ends; all below is taken, all above left, and only that range is sorted. Ranges are even in the mean
of the distributions of keys of weights 1 and 0.1, so that, whatever its weights between these, a source has less than 2.3
times an even share in each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WHITE, Scratch, table

WEIGHTS = (3, 1, 2)
#: All targets together, as a share of all words.
SHARE = 1.5
#: A target stops at so many times its source's words.
MOST = 2
#: Ranges of keys in a histogram; after two rounds a range holds about a 2^-24th of a source, 2.3 times that at most.
RANGES = 4096
PUNCTUATION = "0123456789#$%&*|!<>{}[]()=+/_~^@"


def words_in(text: Column) -> Column:
    """Number of words; 0 for null."""
    text = F.coalesce(text, F.lit(""))
    gaps = F.length(F.regexp_replace(text, f"[^{WHITE}]+", "x")) - F.length(F.regexp_replace(text, f"[^{WHITE}]+", ""))
    return gaps.cast("long")


def quality_weight(text: Column) -> Column:
    """Between 0.1 and 1: one less four times the share of digits and symbols among the characters."""
    text = F.coalesce(text, F.lit(""))
    odd = F.length(text) - F.length(F.translate(text, PUNCTUATION, ""))
    return F.greatest(F.lit(0.1), F.lit(1.0) - F.lit(4.0) * odd / F.greatest(F.length(text), F.lit(1)))


def place(key: Column) -> Column:
    """Between 0 and 1, growing with the key: the mean of the distribution functions of keys of weights 1 and 0.1."""
    return -(F.expm1(-key) + F.expm1(key * F.lit(-0.1))) / F.lit(2.0)


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size, target from source, source_size.

    One row a source, in windows over all sources: one task, whose few hundred bytes a source bound it to about a million sources.

    Sources fill up in the order of room per weight: if the k with the least room are full, the others share
    the rest by weight; k is the least number at which none of these is above its room.
    """
    w = Window.orderBy(F.col("source").asc_nulls_last())
    pick = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(w) - 1, F.lit(len(weights))) + 1).cast("int"))
    by_room = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before, everything = by_room.rowsBetween(Window.unboundedPreceding, -1), Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = sources.withColumn("weight", pick).withColumn("room", F.lit(float(most)) * F.col("source_size"))
    s = s.withColumn("ratio", F.col("room") / F.col("weight"))
    total = F.sum("source_size").over(everything) * F.lit(float(share))
    level = (total - F.coalesce(F.sum("room").over(before), F.lit(0.0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    s = s.withColumn("level", level)
    first = F.min(F.when(F.col("ratio") > F.col("level"), F.struct("ratio", "level"))).over(everything)["level"]
    return s.select("source", "source_size", F.least("room", F.coalesce(F.col("weight") * first, F.col("room"))).alias("target"))


def _cut(rows: DataFrame, sources: DataFrame, range_: Column) -> DataFrame:
    """source with the range of keys in which its rest ends, and the rest on entering that range.

    rows: source_key, key, size; sources: source_key, rest. A window per source sees RANGES rows at most.
    """
    hist = rows.groupBy("source_key", range_.alias("range")).agg(F.sum("size").alias("words"))
    w = Window.partitionBy("source_key").orderBy("range")
    run = hist.withColumn("upto", F.sum("words").over(w)).join(sources, "source_key")
    ends = run.filter(F.col("upto") >= F.col("rest")).groupBy("source_key").agg(F.min(F.struct("range", "upto", "words", "rest")).alias("e"))
    return ends.select("source_key", F.col("e.range").alias("range"), (F.col("e.rest") - (F.col("e.upto") - F.col("e.words"))).alias("rest"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = 42, weight: Column | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, key of every row.

    A null text has size 0 and takes nothing; a null source is a source of its own, the last. Rows
    with equal ids and texts have equal keys and follow each other, larger sizes last. Sources without
    words have target 0. An empty table gives an empty result. Other columns are not read. Reruns
    agree: keys are hashes of the id, the text and the seed.
    """
    scratch = Scratch(docs.sparkSession)
    digest = F.md5(F.concat_ws("|", F.col("doc_id").cast("string"), "text", F.lit(str(seed))))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + 0.5) / F.lit(float(1 << 52))
    key = -F.log(u) / (quality_weight(F.col("text")) if weight is None else weight)
    slim = docs.select("doc_id", "source", words_in(F.col("text")).alias("size"), key.alias("key"))
    source_key = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n"))
    rows = scratch.save(slim.withColumns({"source_key": source_key, "place": place(F.col("key"))}))
    sums = rows.groupBy("source", "source_key").agg(F.sum("size").alias("source_size"))
    aims = scratch.save(
        targets(sums.select("source", "source_size"), weights, share, most)
        .withColumn("source_key", source_key)
        .withColumn("words", F.round("target").cast("long"))
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("words") / F.greatest("source_size", F.lit(1)))).otherwise(0).cast("long"))
        .withColumn("rest", F.col("words") - F.col("epochs") * F.col("source_size"))
        .drop("source")
    )
    coarse = F.least(F.floor(F.col("place") * RANGES), F.lit(RANGES - 1)).cast("int")
    fine = F.least(F.floor((F.col("place") * RANGES - F.col("range")) * RANGES), F.lit(RANGES - 1)).cast("int")
    open_ = aims.filter("rest > 0").select("source_key", "rest")
    first = scratch.save(_cut(rows, open_, coarse))
    inside = rows.join(first.select("source_key", "range"), "source_key").filter(coarse == F.col("range"))
    second = _cut(inside, first.select("source_key", "rest"), fine).withColumnRenamed("range", "fine")
    cuts = scratch.save(aims.join(first.select("source_key", "range"), "source_key", "left").join(second.withColumnRenamed("rest", "last"), "source_key", "left"))
    every = rows.join(cuts, "source_key").withColumn("coarse", coarse).withColumn("part", F.when(F.col("coarse") == F.col("range"), fine))
    at_end = (F.col("coarse") == F.col("range")) & (F.col("part") == F.col("fine"))
    below = (F.col("coarse") < F.col("range")) | ((F.col("coarse") == F.col("range")) & (F.col("part") < F.col("fine")))
    every = every.withColumn("at_end", F.coalesce(at_end, F.lit(False)))
    w = Window.partitionBy("source_key").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    ends = every.filter("at_end").withColumn("part_taken", F.greatest(F.lit(0), F.least("size", F.col("last") - F.coalesce(F.sum("size").over(w), F.lit(0)))))
    rest = every.filter("not at_end").withColumn("part_taken", F.when(below, F.col("size")).otherwise(F.lit(0)))
    taken = (F.col("epochs") * F.col("size") + F.col("part_taken")).cast("long")
    return rest.unionByName(ends).select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), "key")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents", "doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken")


_BEFORE = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
_WORD = r"[^\x20\x09-\x0D]+"
SQL = f"""
WITH s AS (SELECT doc_id, source, text, coalesce(text, '') AS t FROM documents),
d AS (
  SELECT doc_id, source, length(regexp_replace(t, '{_WORD}', 'x', 'g')) - length(regexp_replace(t, '{_WORD}', '', 'g')) AS size,
    -ln((('0x' || substr(md5(concat_ws('|', CAST(doc_id AS VARCHAR), text, '42')), 1, 13))::BIGINT + 0.5e0) / 4503599627370496e0)
      / greatest(0.1e0, 1e0 - 4e0 * (length(t) - length(translate(t, '{PUNCTUATION}', ''))) / greatest(length(t), 1)) AS key
  FROM s),
g AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3e0 WHEN 1 THEN 1e0 ELSE 2e0 END AS weight FROM g),
r AS (SELECT *, 2e0 * source_size AS room, 2e0 * source_size / weight AS ratio FROM w),
l AS (
  SELECT *, (1.5e0 * CAST(sum(source_size) OVER () AS BIGINT) - coalesce(sum(room) OVER (ORDER BY ratio, source NULLS LAST {_BEFORE}), 0e0))
    / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY ratio, source NULLS LAST {_BEFORE}), 0e0)) AS level
  FROM r),
t AS (SELECT source, source_size, least(room, coalesce(weight * (SELECT level FROM l WHERE ratio > level ORDER BY ratio, level LIMIT 1), room)) AS target FROM l),
e AS (SELECT *, CAST(round(target) AS BIGINT) AS words, CASE WHEN source_size > 0 THEN CAST(round(target) AS BIGINT) // source_size ELSE 0 END AS epochs FROM t)
SELECT doc_id, size, source_size, target,
  CAST(epochs * size + greatest(0, least(size, words - epochs * source_size
    - coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id NULLS FIRST, size {_BEFORE}), 0))) AS BIGINT) AS taken
FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source
"""
