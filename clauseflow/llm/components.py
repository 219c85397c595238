"""Connected components of an edge table, without gathering edges, components or fingerprints anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import discard, materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of edges (a, b): comp is the smallest node that can be reached.

    Each round takes the smallest label among a node and its neighbours, then follows labels one step (label of the
    label), so that chains halve; rounds go on until no label changes. Every round is written to the shared folder. Nulls
    and loops are ignored; no edges give no rows.
    """
    e = edges.select("a", "b").where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    both = materialize(e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("comp"), F.lit(True).alias("changed")), "labels")
    while not labels.where("changed").isEmpty():
        near = both.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        step = labels.select("node", F.col("comp").alias("old")).join(near, "node").select("node", "old", F.least("old", "near").alias("c"))
        step = materialize(step, "labels-step")
        up = step.select(F.col("node").alias("c"), F.col("c").alias("above"))
        discard(labels)
        labels = materialize(step.join(up, "c", "left").select("node", F.least("c", "above").alias("comp"), (F.least("c", "above") != F.col("old")).alias("changed")), "labels")
        discard(step)
    discard(both)
    return labels.select("node", "comp")
