"""From raw documents to a training mix, in five stages.

Each stage takes (spark, docs, sf_dir) and works on everything that the stage before it has kept; all but the last return
the columns of `documents`. ``run`` writes each stage's rows to the shared folder and reads them again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clauseflow.llm import decontaminate, jaccard, langid, mixing, secrets
from clauseflow.llm.scratch import materialize
from clauseflow.narrow import parted

#: Near duplicates: word shingles of five words, similarity of at least 80 %.
SHINGLE, PERCENT = 5, 80


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language is rejected: null texts, texts without letters, and those whose margin between two
    languages is narrower than usual for their length. Repeated rows stay or go together."""
    learned = langid.learn(docs)
    kept = langid.classify(docs, learned, margins=langid.calibrate(docs, learned)).where(~F.col("rejected"))
    return kept.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each group of near copies, once where its row is repeated.

    Texts without words are copies of nothing and stay. A null doc_id counts as below all others. Rows that share a
    doc_id, or have none, are judged each on their own; only those equal in doc_id and text are repeats.
    """
    keyed = _told_apart(docs)
    same = jaccard.similar_documents(keyed.select(F.col("_key").alias("doc_id"), "text"), SHINGLE, PERCENT)
    members = same.select(F.col("doc_id").alias("_key"), "component_id").distinct().join(keyed.select("_key", "doc_id").distinct(), "_key")
    members = materialize(members, "near-members")
    kept = members.groupBy("component_id").agg(F.min(F.struct("doc_id", "_key")).alias("first")).select(F.col("first._key").alias("_key"))
    # Keys that go, and keys of several rows; no row of another key is moved, but for a few.
    gone = materialize(members.join(kept, "_key", "left_anti").select("_key", F.lit(True).alias("_gone")), "near-gone")
    several = keyed.groupBy("_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("_key", F.lit(False).alias("_gone"))
    judged = materialize(gone.unionByName(several).groupBy("_key").agg(F.max("_gone").alias("_gone")), "near-judged")
    maybe, others = parted(keyed, judged.select("_key"), ["_key"])
    order = Window.partitionBy("_key").orderBy(*(c for c in ("source", "lang") if c in docs.columns), "text")
    left = maybe.join(judged.where("_gone"), "_key", "left_anti").withColumn("_nth", F.row_number().over(order)).where("_nth = 1")
    return left.select(*docs.columns).unionByName(others.select(*docs.columns))


def _told_apart(docs: DataFrame) -> DataFrame:
    """docs with _key, which rows share that are equal in doc_id and text: doc_id, or a hash of both where texts share it."""
    text, number = F.xxhash64("text"), F.col("doc_id").cast("long")
    shared = docs.groupBy("doc_id").agg(F.min(text).alias("low"), F.max(text).alias("high")).where("doc_id IS NULL OR low != high")
    shared = materialize(shared.select("doc_id", F.lit(True).alias("_shared")), "shared-ids")
    if shared.isEmpty():
        return docs.withColumn("_key", number)
    # Rows without a doc_id don't go through the join, where they would all meet in one task.
    numbered = docs.where("doc_id IS NOT NULL").join(shared, "doc_id", "left").withColumn("_key", F.when(F.col("_shared"), F.xxhash64("doc_id", "text")).otherwise(number))
    return numbered.select(*docs.columns, "_key").unionByName(docs.where("doc_id IS NULL").withColumn("_key", F.xxhash64(F.lit("no doc_id"), "text")))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which a benchmark window occurs. Null and empty texts have none and stay, as do all texts where the
    benchmark is empty; repeated rows stay or go together."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks secrets in place; n_chars follows the masked text, all documents stay."""
    masked = secrets.redact(docs)
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else masked


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The plan of the mix: for each document how many words it gives and which of its blocks go to which output shards.

    Null and empty texts give none, a null source is a source of its own, repeated rows count each.
    """
    plan = mixing.mix(docs)
    return plan.select("doc_id", "source", "size", "source_size", "target", "taken", F.to_json("shards").alias("shards"))


STAGES = [
    ("language ID", language_id),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("secret scans", secret_scan),
    ("mixing sources to target weights", source_mix),
]

#: Compression, the random field and the random draws have no SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (_, stage) in enumerate(STAGES):
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{n}")
    return docs
