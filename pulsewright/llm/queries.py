"""The corpus operators as registered queries: each runs over its whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pulsewright.llm import divergence_audit, language_id, pfair_mix, pii_bootstrap, quality_rules, setsketch_dedup, substring_trees, suffix_cover_dedup, token_files, vector_codes, warc_salvage, weak_quality, winnow_decontam


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tokenizer_path() -> str:
    """The public byte-level vocabulary; at the same place on all machines."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.digest(_documents(spark, sf_dir), tokenizer_path())


def op2_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pfair_mix.digest(_documents(spark, sf_dir))


def op3_winnow_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow_decontam.digest(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.digest(_documents(spark, sf_dir))


def op5_suffix_cover_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_cover_dedup.digest(_documents(spark, sf_dir))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.digest(_documents(spark, sf_dir))


def op7_setsketch_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setsketch_dedup.digest(_documents(spark, sf_dir))


def op8_pii_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_bootstrap.digest(_documents(spark, sf_dir))


def op9_weak_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_quality.digest(_documents(spark, sf_dir))


def op10_substring_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_trees.digest(_documents(spark, sf_dir))


def op11_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence_audit.digest(_documents(spark, sf_dir))


def op12_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_salvage.digest(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.digest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_files": op1_token_files,
    "op2_pfair_mix": op2_pfair_mix,
    "op3_winnow_decontam": op3_winnow_decontam,
    "op4_language_id": op4_language_id,
    "op5_suffix_cover_dedup": op5_suffix_cover_dedup,
    "op6_quality_rules": op6_quality_rules,
    "op7_setsketch_dedup": op7_setsketch_dedup,
    "op8_pii_bootstrap": op8_pii_bootstrap,
    "op9_weak_quality": op9_weak_quality,
    "op10_substring_trees": op10_substring_trees,
    "op11_divergence_audit": op11_divergence_audit,
    "op12_warc_salvage": op12_warc_salvage,
    "op13_vector_codes": op13_vector_codes,
}

#: None for the others: models, schedules and files are not SQL; they are tested against brute force.
ORACLES: dict[str, str] = {
    "op3_winnow_decontam": winnow_decontam.ORACLE_SQL,
    "op5_suffix_cover_dedup": suffix_cover_dedup.ORACLE_SQL,
    "op6_quality_rules": quality_rules.ORACLE_SQL,
    "op7_setsketch_dedup": setsketch_dedup.ORACLE_SQL,
    "op10_substring_trees": substring_trees.ORACLE_SQL,
    "op11_divergence_audit": divergence_audit.ORACLE_SQL,
    "op12_warc_salvage": warc_salvage.ORACLE_SQL,
    "op13_vector_codes": vector_codes.ORACLE_SQL,
}
