"""The queries of this subpackage, each over its whole table with the operators' own parameters.

Each returns one row per row of its table, in any order; what nulls, empty and very long texts, ties, repeated rows, empty
tables and further columns give is stated by the operator that the query calls. Further columns of the tables are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, jaccard, langid, mixing, pii, quality, repeats, secrets, toxicity, warc

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives written, read back and assembled: a row per page."""
    return warc.archive_and_read(table(spark, sf_dir, "pages")).drop("uri")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score per document, learned from the labels outside the held-out fold."""
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and class of every document, 4-word shingles at 85 %."""
    return jaccard.similar_documents(table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What benchmark windows hit in every document."""
    return decontaminate.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    q = quality.quality(table(spark, sf_dir, "documents"))
    return q.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in every document."""
    return pii.digest(table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned outside the held-out fold."""
    return langid.identify(table(spark, sf_dir, "documents"))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words the mix takes of every document, and in which shards."""
    plan = mixing.mix(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "source", "size", "source_size", "target", "taken", F.to_json("shards").alias("shards"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that earlier 20-word windows repeat."""
    return repeats.remove_repeats(table(spark, sf_dir, "documents"), digest=True)


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in every document."""
    return secrets.digest(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_warc_captures": op1_warc_captures,
    "op2_toxicity": op2_toxicity,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_decontamination": op4_decontamination,
    "op5_quality_rules": op5_quality_rules,
    "op6_personal_data": op6_personal_data,
    "op7_language_id": op7_language_id,
    "op8_source_mixing": op8_source_mixing,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_secret_scan": op10_secret_scan,
}
