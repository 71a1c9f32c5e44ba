"""The queries of this subpackage and the SQL that some of them equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from capturelake.llm import fingerprints, html, kneser_ney, language, matching, mixing, quality, resampling, sentencepiece, simhash, topk, toxicity, warc


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_read(spark, sf_dir, "documents"))


def op2_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op3_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(_read(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(_read(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.detect(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str, model: str = sentencepiece.MODEL) -> DataFrame:
    rows = sentencepiece.encode(_read(spark, sf_dir, "documents"), model)
    return rows.select("doc_id", "copy", "sample", "n_tokens", "log_prob", "perturbed", "log_inclusion", "ids_digest", "round_trip")


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.evaluate(_read(spark, sf_dir, "documents")).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(_read(spark, sf_dir, "pages"))


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.verdicts(_read(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op11_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.describe(_read(spark, sf_dir, "documents"))


def op12_row_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = matching.matches(_read(spark, sf_dir, "clicks"))
    return rows.withColumn("labels_sha256", F.sha2("labels", 256)).drop("labels")


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark")).drop("n_words")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash_dedup": op1_simhash_dedup,
    "op2_topk_search": op2_topk_search,
    "op3_warc_bundles": op3_warc_bundles,
    "op4_language_id": op4_language_id,
    "op5_toxicity": op5_toxicity,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_lm_scoring": op7_lm_scoring,
    "op8_html_extraction": op8_html_extraction,
    "op9_source_mix": op9_source_mix,
    "op10_quality_rules": op10_quality_rules,
    "op11_document_fingerprints": op11_document_fingerprints,
    "op12_row_patterns": op12_row_patterns,
    "op13_importance_resampling": op13_importance_resampling,
}

ORACLE_SQL: dict[str, str] = {
    "op2_topk_search": topk.ORACLE,
    "op3_warc_bundles": warc.ORACLE,
    "op9_source_mix": mixing.ORACLE,
    "op10_quality_rules": quality.ORACLE,
    "op12_row_patterns": matching.ORACLE,
    "op13_importance_resampling": resampling.ORACLE,
}
