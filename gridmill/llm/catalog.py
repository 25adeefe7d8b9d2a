"""The queries of this folder: each applies its operator to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmill.llm import (
    conversation_trie, exact_topk, language_id, line_dedup, mixing, ngram_join, oracles, packing, periodic_runs, pii, quality_classifier, quality_rules,
    spotsigs, substring_dedup,
)
from gridmill.llm.ids import in_fold


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality_classifier.fit(docs, _table(spark, sf_dir, "labels"))
    return quality_classifier.score(docs, model).select(
        "doc_id", in_fold(F.col("doc_id"), 3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    rules = quality_rules.fit(docs, _table(spark, sf_dir, "labels"))
    return quality_rules.judge(docs, rules).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule"
    )


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(_table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.fit(docs)).select(
        "doc_id", in_fold(F.col("doc_id"), 5, 0).alias("held_out"), "lang_pred", "score"
    )


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def op3_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spotsigs.edited_and_next(_table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        spotsigs.fingerprint(F.col("sigs")).alias("fingerprint"),
        spotsigs.fingerprint(F.col("edited_sigs")).alias("edited_fingerprint"),
        spotsigs.likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"),
        spotsigs.likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"),
    )


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = substring_dedup.dedup(_table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.classes(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = line_dedup.drop_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return left.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op11_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.build(_table(spark, sf_dir, "conversations")).nodes()


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = periodic_runs.collapse(periodic_runs.with_planted_repeats(_table(spark, sf_dir, "documents")))
    best = F.col("strongest")
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        best["start"].alias("start"),
        best["length"].alias("length"),
        best["period"].alias("period"),
        F.floor(1000 * best["length"] / best["period"]).alias("exponent_milli"),
        F.sha2(periodic_runs.runs_text(F.col("runs")), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_classifier": op1_quality_classifier,
        "op2_quality_rules": op2_quality_rules,
        "op3_spotsigs": op3_spotsigs,
        "op4_substring_dedup": op4_substring_dedup,
        "op5_ngram_join": op5_ngram_join,
        "op6_mixing": op6_mixing,
        "op7_packing": op7_packing,
        "op8_pii": op8_pii,
        "op9_line_dedup": op9_line_dedup,
        "op10_language_id": op10_language_id,
        "op11_exact_topk": op11_exact_topk,
        "op12_conversation_trie": op12_conversation_trie,
        "op13_periodic_runs": op13_periodic_runs,
    }


def oracle_sql() -> dict[str, str]:
    """The other operators learn, hash, or depend on an order that SQL cannot state; they are tested against brute force."""
    return {
        "op4_substring_dedup": oracles.SUBSTRING_DEDUP,
        "op5_ngram_join": oracles.NGRAM_JOIN,
        "op11_exact_topk": oracles.EXACT_TOPK,
        "op12_conversation_trie": oracles.CONVERSATION_TRIE,
    }
