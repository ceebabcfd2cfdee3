"""A training corpus from documents: quality, exact and near duplicates, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before
kept.  All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm.common import discard, read_table, written
from lodestone.llm.exact_dedup import exact_dedup
from lodestone.llm.packing import pack
from lodestone.llm.quality_qda import keep_quality
from lodestone.llm.similar import drop_similar
from lodestone.llm.winnow import decontaminate


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return keep_quality(docs, read_table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group of documents that are equal but for white space."""
    return exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each component of texts whose five-word shingles are similar to 0.8 or more."""
    return drop_similar(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of words with the benchmark."""
    return decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    return pack(docs)


STAGES = [("quality", quality), ("exact dedup", exact), ("near dedup", near), ("decontamination", benchmark), ("packing", packed)]
#: SQL has neither the fingerprints' hash nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to the documents of sf_dir, each one's result written as a table for the next and deleted when that has its own."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
        discard(before)
    out = STAGES[-1][1](spark, docs, sf_dir)  # reads its own tables, not the documents, from here on
    discard(docs)
    return out
