"""History of analyses: saving, keeping the latest, comparing two."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clauseflow import constants as K
from clauseflow import taxonomy as T

ENTRY = "id string, saved_at timestamp, title string, risk_score int, verdict string, finding_count int, severity_counts map<string,int>, mode string, chars int, clause_count int, tags array<struct<category:string,severity:string>>"


def entries(found: DataFrame, reports: DataFrame, docs: DataFrame, saved_at: str) -> DataFrame:
    """History rows of ENTRY's columns; docs has doc_id, title, chars and clause_count."""
    counts = F.map_from_entries(F.array_compact(F.array(*(F.when(F.col(f"n_{s}") > 0, F.struct(F.lit(s), F.col(f"n_{s}").cast("int"))) for s in T.SEVERITIES))))
    per = found.groupBy("doc_id").agg(
        *(F.count_if(F.col("severity") == s).alias(f"n_{s}") for s in T.SEVERITIES),
        F.transform(F.slice(F.array_sort(F.collect_list(F.struct("rank", "category", "severity"))), 1, K.HISTORY_TAGS), lambda x: F.struct(x["category"].alias("category"), x["severity"].alias("severity"))).alias("tags"),
    )
    df = docs.join(reports.select("doc_id", "risk_score", "verdict", "n_findings"), "doc_id").join(per, "doc_id", "left")
    return df.select(
        F.col("doc_id").cast("string").alias("id"), F.lit(saved_at).cast("timestamp").alias("saved_at"), F.coalesce("title", F.lit("未命名协议")).alias("title"), "risk_score", "verdict",
        F.col("n_findings").alias("finding_count"), counts.alias("severity_counts"), F.lit("heuristic").alias("mode"), "chars", F.col("clause_count").cast("int").alias("clause_count"), "tags",
    )


def save(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def delete(spark: SparkSession, path: str, ids: list[str], to: str) -> None:
    """History without these entries, written to another path: a table isn't overwritten while it is read."""
    spark.read.schema(ENTRY).parquet(path).where(~F.col("id").isin(ids)).write.mode("overwrite").parquet(to)


def clear(spark: SparkSession, path: str) -> None:
    spark.createDataFrame([], ENTRY).write.mode("overwrite").parquet(path)


def chosen(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Those of docs that are chosen by ids (doc_id); ids that aren't there choose nothing."""
    return docs.join(ids.select("doc_id").distinct(), "doc_id", "left_semi")


def save_json(results: DataFrame, path: str) -> None:
    """Results as JSON lines."""
    results.write.mode("overwrite").json(path)


def latest(spark: SparkSession, path: str, most: int = K.HISTORY_ENTRIES) -> DataFrame:
    return retain(spark.read.schema(ENTRY).parquet(path), most)


def retain(rows: DataFrame, most: int = K.HISTORY_ENTRIES) -> DataFrame:
    """The newest row of each id, and of these the `most` newest."""
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("saved_at")))).where("_n = 1").drop("_n")
    return rows.orderBy(F.desc("saved_at"), "id").limit(most)


def compare(older: DataFrame, newer: DataFrame) -> DataFrame:
    """Categories whose number of findings changed, per doc_id: category, before, after, delta, largest changes first (pos)."""
    count = lambda f, name: f.groupBy("doc_id", "category").agg(F.count(F.lit(1)).alias(name))
    both = count(older, "before").join(count(newer, "after"), ["doc_id", "category"], "full_outer").na.fill(0, ["before", "after"])
    changed = both.withColumn("delta", F.col("after") - F.col("before")).where("delta != 0")
    pos = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc(F.abs("delta")), "category"))
    return changed.withColumn("pos", pos)


def merge_corpus(current: DataFrame, saved: DataFrame) -> DataFrame:
    """Documents at hand and those saved, each id once; those at hand win."""
    return current.unionByName(saved.join(current, "doc_id", "left_anti"))
