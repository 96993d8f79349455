"""Cleaning a corpus: five stages, each an operator of mailframe.llm.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; a driver writes it as Parquet and reads it
again as the next one's docs. All but the last return the columns of docs as they were.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailframe.llm import decontaminate, language, mixing, simhash, toxicity
from mailframe.llm.common import Scratch, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents of toxicity 0.7 or more; the model learns from the labelled rows among docs."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"), ~toxicity.held_out(F.col("doc_id")))
    return toxicity.reject(docs, model)


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents in no language that was learned."""
    return language.reject(docs, language.fit(docs, ~language.held_out(F.col("doc_id"))))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, Jaccard similarity of 0.8 or more."""
    return simhash.near_dedup(docs, simhash.CORPUS)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that hold a benchmark item."""
    return decontaminate.remove_leaks(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, size, source_size, target, taken of every document that stayed."""
    return mixing.mix(docs).select("doc_id", "source", "size", "source_size", "target", "taken")


STAGES = [
    ("toxicity", drop_toxic),
    ("language", drop_unknown_language),
    ("simhash", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("mixing", mix_sources),
]

#: Trained models and hashes of 64 bits are beyond SQL; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, with each stage's result written to the shared folder and read again."""
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
