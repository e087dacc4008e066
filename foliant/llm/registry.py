"""The subpackage's queries, one per operator, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import backoff, lines, packing, piece_counts, quality, resample, simhash, templates, toxicity, wavelet
from foliant.llm.common import load


def op1_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures, base rules and host verdict of each document."""
    judged = quality.judge(load(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host_rejected")


def op6_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that each document keeps once cross-site boilerplate is gone."""
    kept = lines.deduplicate(load(spark, sf_dir, "documents"), counts=True)
    return kept.select("doc_id", "n_lines", "n_removed", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_md5"))


def op2_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that documents hold, verbatim or re-parameterised."""
    return templates.leaks(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op3_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language-model score of each document under all others."""
    return backoff.score(load(spark, sf_dir, "documents"))


def op4_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of each document."""
    scored = toxicity.score_documents(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))
    strongest = F.try_element_at(F.array_sort("segments", lambda x, y: F.when(x["score"] > y["score"], -1).when(x["score"] < y["score"], 1).otherwise(x["first"].cast("int") - y["first"].cast("int"))), F.lit(1))
    return scored.select("doc_id", "held_out", "score", "predicted", F.size("segments").cast("long").alias("n_segments"), strongest["first"].alias("segment_first"), strongest["end"].alias("segment_end"))


def op5_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode all documents, write wavelet-matrix shards, read them back."""
    table = wavelet.write_shards(load(spark, sf_dir, "documents"), end=1)
    return wavelet.read_shards(table).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op7_piece_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and greedy word pieces of each document."""
    return piece_counts.piece_counts(load(spark, sf_dir, "documents"))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of each document."""
    return simhash.near_duplicates(load(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op9_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that importance resampling keeps."""
    weighed = resample.weigh(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))
    return weighed.where("kept").select("doc_id", "n_grams", "log_weight", "key", "beyond_cut", "kept")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sequence and place of each piece of all documents."""
    return packing.pack(load(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_host_quality,
        op2_template_decontamination,
        op3_stupid_backoff,
        op4_toxic_segments,
        op5_wavelet_tokens,
        op6_line_spread,
        op7_piece_counts,
        op8_simhash_near_dedup,
        op9_importance_resampling,
        op10_best_fit_packing,
    )
}

SQL: dict[str, str] = {"op1_host_quality": quality.SQL, "op6_line_spread": lines.SQL}
