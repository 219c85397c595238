"""Pushed documents as a stream: numbered items, a cursor over them, and analysis batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from clauseflow.operators import normalize, scan, segment

ITEM = "seq long, at timestamp, title string, url string, text string"


def items(spark: SparkSession, path: str, per_trigger: int | None = None) -> DataFrame:
    """A stream of the JSON items that arrive under path; titles, addresses and texts are cut to their limits."""
    reader = spark.readStream.schema(ITEM)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.json(path).select("seq", "at", F.substring("title", 1, 300).alias("title"), F.substring("url", 1, 2000).alias("url"), F.substring("text", 1, 400_000).alias("text"), F.length("text").alias("chars"))


def latest(rows: DataFrame, since: int = 0) -> DataFrame:
    """The newest item after a sequence number, or no row."""
    return rows.where(F.col("seq") > since).agg(F.max_by(F.struct(*rows.columns), "seq").alias("x")).where("x IS NOT NULL").select("x.*")


def analyse(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Findings of every item, appended to Parquet under out; the checkpoint remembers what has been read."""

    def batch(rows: DataFrame, _: int) -> None:
        docs = normalize.normalize_documents(rows.select(F.col("seq").alias("doc_id"), "text"))
        scan.findings(segment.clauses(docs.select("doc_id", "text"))).write.mode("append").parquet(out)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def daily_counts(stream: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Items per day of arrival, final once the watermark has passed."""
    return stream.withWatermark("at", lateness).groupBy(F.window("at", "1 day")).agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("chars"))
