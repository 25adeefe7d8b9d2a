"""From raw documents to packed sequences, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the stage before
kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridmill.llm import line_dedup, mixing, ngram_join, packing, quality_rules
from gridmill.store import materialize, release, temporary_tables

#: Near-duplicates share at least so many percent of their shingles of so many words; 3 and 90 are the contract of op5_ngram_join alone.
NEAR_WORDS = 5
NEAR_PERCENT = 80


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or a learned rule go."""
    rules = quality_rules.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_rules.filter_documents(docs, rules)


def drop_recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go, but for those of the first document."""
    return line_dedup.without_recurring(docs)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that link, directly or through others, the one with the smallest identifier stays."""
    return ngram_join.one_of_each(docs, NEAR_WORDS, NEAR_PERCENT)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are taken not at all, once or twice, so that sources come near their targets."""
    return mixing.repeat_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents, with their places in sequences of 1024 tokens."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality_rules", reject_low_quality),
    ("line_dedup", drop_recurring_lines),
    ("ngram_join", keep_one_of_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Learned rules, templates, tilted rates and token identifiers are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage has written on its way goes when its result is written, and that when the next stage's is."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        with temporary_tables(spark) as made:
            docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
            made.remove(docs._gridmill_table)
        if before is not None:
            release(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
