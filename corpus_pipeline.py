"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps, with the columns
of ``documents``; the last returns the mix: doc_id, source, size, source_size, target, taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changefold.llm.common import settled, table
from changefold.llm.decontam import decontaminate
from changefold.llm.jaccard import keep_one
from changefold.llm.lines import dedup_lines
from changefold.llm.mixing import mix_sources
from changefold.llm.quality import score_quality

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts. Null and empty texts are scored like
    any; rows that repeat are kept or rejected alike; an empty table gives an empty one."""
    return score_quality(docs, table(spark, sf_dir, "labels")).filter("predicted = 1").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that recur across documents go, except from the last document that holds them;
    documents stay, with the length of what is left. Null texts stay null, and so do lengths
    where nothing is dropped; a null doc_id is the smallest."""
    done = dedup_lines(docs).withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return done.select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares four fifths of its five-word shingles: the one
    with the smallest doc_id, null last. Documents without words are kept; rows equal in
    doc_id and text collapse to one."""
    return keep_one(docs, n=5, percent=80).select(*COLUMNS)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage. Null and empty texts have none; an empty
    benchmark removes nothing."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, and how many words of each."""
    mixed = mix_sources(docs).filter("taken > 0")
    return mixed.select("doc_id", "source", "size", "source_size", "target", "taken")


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("benchmark", benchmark), ("mix", mix)]
#: Trained trees and seeded hashes are beyond SQL; tests hold the stages to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written and read again; what a stage keeps on the way to its
    result is deleted when that is written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settled(spark, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
