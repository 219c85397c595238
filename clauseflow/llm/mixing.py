"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Documents are cut into blocks of at most `BLOCK` words, and each source's blocks lie in one random order. A source that
owes `target` words owes whole passes over all of its blocks, then, of one more pass, the first blocks in that order that
make up the rest: its block quota is an exact count. A tree over the output shards splits these quotas: a node holds the
quotas of a range of shards, and its left half draws its share of them without replacement (a multivariate hypergeometric
draw), down to single shards, so quotas add up exactly and every shard is a random sample of the mix. A shard then draws as
many blocks of each source as its table says: the next run of the source's permuted blocks, no block of one pass twice.
What the mix takes of a document is what the shards drew of its blocks. Inside a shard, blocks are ordered by a second hash.

The random order never gathers a source in one task. A hash puts each block in one of about `blocks / BIN_BLOCKS` bins of
its source; words and blocks per (source, bin) are summed before they are shuffled; offsets of the bins come from those
sums, and only the blocks of one bin are ordered against each other.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import discard, materialize

BLOCK, BIN_BLOCKS, SEED = 512, 50_000, 11
MAX_PASSES = 3
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    """Number of words; null texts have none. Words are counted as the separators in front of them, without listing them."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    gaps = F.regexp_count(trimmed, F.lit(r"[\x20\x09-\x0D]+"))
    return F.when(F.length(trimmed) == 0, F.lit(0)).otherwise(gaps + 1).cast("long")


def targets(sizes: dict[str | None, int], weights: dict[str | None, float]) -> dict[str | None, float]:
    """Words each source should give: shares of all words by weight, none above MAX_PASSES times its size; what is cut off
    is shared out again by weight among the rest until nothing is above."""
    total, out = float(sum(sizes.values())), {}
    free = [s for s in sizes if sizes[s]]
    while free:
        left = total - sum(out.values())
        weight = sum(weights[s] for s in free)
        over = [s for s in free if left * weights[s] / weight > MAX_PASSES * sizes[s]]
        if not over:
            out |= {s: left * weights[s] / weight for s in free}
            break
        out |= {s: float(MAX_PASSES * sizes[s]) for s in over}
        free = [s for s in free if s not in over]
    return {s: out.get(s, 0.0) for s in sizes}


def default_weights(sources: list[str | None]) -> dict[str | None, float]:
    """1, 2, 3, repeating, over the sources by code point, null last."""
    ordered = sorted((s for s in sources if s is not None), key=lambda s: s.encode("utf-8", "surrogatepass")) + [None] * (None in sources)
    return {s: float(1 + i % 3) for i, s in enumerate(ordered)}


def split_quotas(quotas: np.ndarray, shards: int, seed: int = SEED) -> np.ndarray:
    """A (shards x sources) table of block quotas that adds up to quotas; shard totals differ by at most one per level."""
    out = np.zeros((shards, len(quotas)), np.int64)
    stack = [(0, shards, quotas.astype(np.int64))]
    while stack:
        lo, hi, q = stack.pop()
        if hi - lo == 1 or not q.sum():
            out[lo] = q
            continue
        mid = (lo + hi) // 2
        rng = np.random.default_rng([seed, lo, hi])
        left, need, rest = np.zeros_like(q), int(q.sum()) * (mid - lo) // (hi - lo), int(q.sum())
        for i, n in enumerate(q):  # one source after the other: large populations are no problem for this form
            if need and n:
                left[i] = _draw(rng, int(n), rest - int(n), need)
            need -= int(left[i])
            rest -= int(n)
        stack += [(lo, mid, left), (mid, hi, q - left)]
    return out


def _draw(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of n things drawn without replacement are good: hypergeometric, whatever the population.

    numpy's own draw ends at 10**9. Beyond it, let every thing be chosen with chance n / (good + bad): given that n are chosen,
    the number of good ones among them has just this distribution, so pairs of binomial draws are made until one adds up.
    """
    if max(good, bad) < 10**9:
        return int(rng.hypergeometric(good, bad, n))
    if n in (0, good + bad):
        return good if n else 0
    while True:
        x = rng.binomial(good, n / (good + bad), 1 << 16)
        y = rng.binomial(bad, n / (good + bad), 1 << 16)
        hits = np.flatnonzero(x + y == n)
        if len(hits):
            return int(x[hits[0]])


def _local(spark: SparkSession, rows: list[tuple], **types: pa.DataType) -> DataFrame:
    """A small table that goes to the JVM as Arrow data, and starts no Python on executors as one from a list of rows would."""
    return spark.createDataFrame(pa.table({name: pa.array([r[i] for r in rows], kind) for i, (name, kind) in enumerate(types.items())}))


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, shards: int = 16, seed: int = SEED) -> DataFrame:
    """The plan of the mix, one row per document: doc_id, source, size, source_size, target, taken, u and shards.

    taken is the number of words that the shards draw of the document, repeats counted; shards lists the draws as (pass,
    shard, block, words, position), u is a hash of the row that `blocks` finds its text by. A source's taken words come up
    to its target, rounded; the last block of the last pass is cut to fit. Empty documents, null texts and sources without
    words take nothing. Repeated rows count each. The plan is the same for the same rows, whatever their order. Only
    doc_id, text and source of docs are read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    base = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.xxhash64(F.col("doc_id"), F.col("text"), F.lit(seed)).alias("u"))
    base = materialize(base.withColumn("row", F.monotonically_increasing_id()), "mix-sizes")
    per_source = base.groupBy("source").agg(F.sum("size").alias("words"), F.sum(F.ceil(F.col("size") / BLOCK)).alias("blocks"))
    # One row per source on the driver; documents stay where they are.
    per = {r["source"]: (int(r["words"]), int(r["blocks"])) for r in per_source.collect()}
    names = sorted(per, key=lambda s: (s is None, (s or "").encode("utf-8", "surrogatepass")))
    want = targets({s: per[s][0] for s in names}, weights or default_weights(names))
    passes = {s: int(want[s] // per[s][0]) if per[s][0] else 0 for s in names}
    rows = [(s, per[s][0], per[s][1], want[s], passes[s], round(want[s]) - passes[s] * per[s][0], -(-per[s][1] // BIN_BLOCKS)) for s in names]
    plan = _local(spark, rows, p_source=pa.string(), source_size=pa.int64(), source_blocks=pa.int64(), target=pa.float64(), passes=pa.int32(), part_words=pa.int64(), bins=pa.int64())
    same = lambda of: F.col("source").eqNullSafe(F.col(of))
    whole = base.where("size > 0").join(plan.select("p_source", "bins"), same("p_source")).drop("p_source")
    each = whole.select("row", "source", "u", "bins", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / BLOCK))).alias("block"))
    each = each.withColumn("v", F.xxhash64("u", "block")).withColumn("words", F.least(F.lit(BLOCK).cast("long"), F.col("size") - F.col("block") * BLOCK))
    each = materialize(each.select("row", "source", "block", "words", "v", F.pmod("v", "bins").alias("bin")), "mix-blocks")
    sums = materialize(each.groupBy("source", "bin").agg(F.sum("words").alias("words"), F.count(F.lit(1)).alias("n")), "mix-bins")
    before = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(F.col("source").alias("o_source"), F.col("bin").alias("o_bin"), F.coalesce(F.sum("words").over(before), F.lit(0)).alias("w0"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("b0"))
    inside = Window.partitionBy("source", "bin").orderBy("v", "block", "row")
    ordered = each.withColumn("w1", F.sum("words").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("words")).withColumn("b1", F.row_number().over(inside) - 1)
    ordered = ordered.join(offsets, same("o_source") & (F.col("bin") == F.col("o_bin")))
    # rank: the block's place in its source's order. left: words that the last pass still owes when it comes to this block.
    ordered = ordered.join(plan.select("p_source", "passes", "part_words", "source_blocks"), same("p_source"))
    ordered = ordered.select("row", "source", "block", "words", "v", "passes", "source_blocks", (F.col("b0") + F.col("b1")).alias("rank"), (F.col("part_words") - F.col("w0") - F.col("w1")).alias("left"))
    ordered = materialize(ordered, "mix-ranks")
    extra = {r["source"]: int(r["n"]) for r in ordered.where("left > 0").groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()}
    quotas = np.array([passes[s] * per[s][1] + extra.get(s, 0) for s in names], np.int64)
    ends = np.cumsum(split_quotas(quotas, shards, seed), axis=0) if names else np.zeros((shards, 0), np.int64)
    draws = _local(spark, [(s, [int(x) for x in ends[:, i]]) for i, s in enumerate(names)], d_source=pa.string(), ends=pa.list_(pa.int64()))

    def draw(p: Column) -> Column:
        """This block's draw in one pass: the shard whose run of the source's order it falls into."""
        at = p * F.col("source_blocks") + F.col("rank")
        shard = F.size(F.filter("ends", lambda e: e <= at))
        words = F.when(p < F.col("passes"), F.col("words")).otherwise(F.least("words", "left"))
        return F.struct(p.cast("int").alias("pass"), shard.alias("shard"), F.col("block").alias("block"), words.alias("words"), F.xxhash64("v", p).alias("position"))

    last = F.col("passes") - F.when(F.col("left") > 0, 0).otherwise(1)
    drawn = ordered.where(last >= 0).join(draws, same("d_source")).select("row", F.explode(F.transform(F.sequence(F.lit(0), last), draw)).alias("x"))
    taken = drawn.where(F.col("x.shard") < shards).groupBy("row").agg(F.sum("x.words").alias("taken"), F.array_sort(F.collect_list("x")).alias("shards"))
    out = base.join(taken, "row", "left").join(plan, same("p_source"))
    discard(each, sums)
    none = F.array().cast("array<struct<pass:int,shard:int,block:bigint,words:bigint,position:bigint>>")
    return out.select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"), "u", F.coalesce("shards", none).alias("shards"))


def blocks(docs: DataFrame, plan: DataFrame, shards: int = 16, seed: int = SEED) -> DataFrame:
    """The mix itself: shard, position, pass, doc_id and text of every drawn block, one partition per shard, shuffled inside.

    Words keep their order inside a block and are joined by single spaces. docs and seed as given to `mix`.
    """
    drawn = plan.where(F.col("taken") > 0).select("u", F.explode("shards").alias("x")).select("u", "x.*")
    texts = docs.select("doc_id", "text", F.xxhash64(F.col("doc_id"), F.col("text"), F.lit(seed)).alias("u")).dropDuplicates(["u"])
    parts = F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), (F.col("block") * BLOCK + 1).cast("int"), F.col("words").cast("int"))
    out = drawn.join(texts, "u").select("shard", "position", "pass", "doc_id", F.array_join(parts, " ").alias("text"))
    return out.repartition(shards, "shard").sortWithinPartitions("shard", "position", "pass", "doc_id")
