"""The corpus pipeline: language ID, near-duplicates, benchmark decontamination, mixing, token output.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next one's docs. All but the last return the
columns of documents, with whatever further columns there are.

Null, empty and letterless texts go in the first stage. Rows that repeat an id with the same
text, and copies under other ids, leave one row in the second; rows without an id are no
one's copies and stay. Ties go to the smallest id. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsewright.cluster import discard, materialise
from pulsewright.llm import language_id, pfair_mix, setsketch_dedup, token_files, winnow_decontam
from pulsewright.llm.queries import tokenizer_path


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is not rejected."""
    return language_id.keep_known(docs)


def first_of_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return setsketch_dedup.drop_near_duplicates(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return winnow_decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the schedule: file by file and row by row."""
    return pfair_mix.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in the order in which the documents lie in their files, read back: one row per document."""
    order = [F.col("_metadata.file_name"), F.col("_metadata.row_index")]
    return token_files.digest(docs, tokenizer_path(), order=order)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", known_language),
    ("near_dedup", first_of_group),
    ("decontaminate", without_benchmark),
    ("mix", mixed),
    ("tokens", tokens),
]

#: Trained models and files are not SQL; the stages are tested against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard(before)
    out = STAGES[-1][1](spark, docs, sf_dir)  # the token files are written by now
    discard(docs)
    return out
