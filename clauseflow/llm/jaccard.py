"""Exact set-similarity join of documents' word shingles, by size: a heavy-light join.

Equal sets become one first. Light sets (up to a size that costs decide) enumerate subsets: two sets of sizes s and t that
are similar enough share at least o(s, t) elements, so both list all their subsets of exactly that size, and a pair meets
under a common subset. Heavy sets scan inverted lists: of every set only a prefix is indexed, in an order that puts the
most frequent shingles last, and a similar pair shares a prefix element. Both kinds of keys are lists of sets.

Lists are not expanded into pairs. Every set first proposes a link to one centre, the small-numbered set of similar size
that it meets most often; proposals are checked on whole texts and joined into components. What is left are lists that
still hold several components; there sets count what they share with those of other components, and none is left out. A
list of many sets that are alike in this list alone is scanned by each of them, in blocks spread over tasks; pairs whose
counts can't reach the overlap needed never leave the scan.

A set's key is the smallest doc_id that has it, or, where rows share that doc_id but not their sets, the first half of its
digest; so each key stands for one set.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauseflow.narrow import narrowed

from .components import components
from .repeats import NULL_ID
from .scratch import discard, lean, materialize, tune
from .wordhash import LOWER, SPACED, U, mix, run_hashes, text_chunks, window_hashes, word_bounds, word_hashes, words

SHINGLE, PERCENT = 4, 85
#: Shingles whose counts are kept for the index order and sent to all tasks: the most frequent ones (8 bytes each).
HEAVY = 1 << 16
#: Largest size for which subsets are considered, and what a scanned list entry costs against an enumerated subset.
MAX_LIGHT, SCAN_COST = 32, 2.0
BUFFER = 1 << 20
#: Bytes of texts whose words are held at once.
TEXT_BYTES = 1 << 18
#: A link is proposed at first where one in this many prefix elements leads to the same centre.
PROPOSE = 4
#: Rounds of proposals, and the length from which a list is scanned in parts.
TURNS, LONG = 2, 20_000
#: Sets in a block of a list that others scan, and entries a scanning set holds before it adds them up.
BLOCK, HELD = 4096, 1 << 20
#: Pairs of one centre that are checked in one task.
CHECKED = 512


def least_overlap(s: int, t: int, percent: int = PERCENT) -> int:
    """Common elements that sets of sizes s and t need: 100 * i >= percent * (s + t - i)."""
    return -(-percent * (s + t) // (100 + percent))


def prefix_size(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1


def partners(s: int, light: int, percent: int = PERCENT) -> list[int]:
    return [t for t in range(-(-percent * s // 100), min(light, s * 100 // percent) + 1) if least_overlap(s, t, percent) <= min(s, t) and not (s == t == least_overlap(s, t, percent))]


def boundary(histogram: dict[int, int], percent: int = PERCENT) -> int:
    """The size up to which sets enumerate subsets: the one for which all keys together cost least."""
    scan = lambda n: SCAN_COST * prefix_size(n, percent)

    def cost(light: int) -> float:
        own = sum(n * sum(comb(s, least_overlap(s, t, percent)) for t in partners(s, light, percent)) for s, n in histogram.items() if s <= light)
        return own + sum(n * scan(s) for s, n in histogram.items() if 100 * s >= percent * (light + 1))

    return min(range(1, MAX_LIGHT + 1), key=lambda b: (cost(b), b))


def shingle_sets(texts: pa.Array, k: int = SHINGLE) -> Iterator[list[np.ndarray]]:
    """Blocks of sorted distinct shingle hashes, one array per text; fewer than k words make one shingle."""
    for lo, hi, data, off in text_chunks(texts, TEXT_BYTES):
        data = LOWER[data]
        starts, ends, row = words(data, off, SPACED)
        h, bounds = word_hashes(data, starts, ends), word_bounds(row, hi - lo)
        at, w = window_hashes(h, row, k)
        cut = np.searchsorted(row[at], np.arange(hi - lo + 1))
        n = np.diff(bounds)
        short = np.flatnonzero((n > 0) & (n < k))
        whole = run_hashes(h, bounds[short], bounds[short + 1])
        out = [np.unique(w[cut[i] : cut[i + 1]]) for i in range(hi - lo)]
        for i, x in zip(short, whole, strict=True):
            out[i] = np.array([x], U)
        yield out


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), "text")


def _digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _describe(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [s for block in shingle_sets(b.column(1), k) for s in block]
            digests = [_digest(s) for s in sets]
            halves = [int.from_bytes(x[:8], "little", signed=True) for x in digests]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(halves, pa.int64()), pa.array(digests, pa.binary())], names=["doc_id", "n", "d", "digest"])

    return run


def _count(k: int):
    """Shingles that occur in more than one of the texts at hand, with their counts; sums of these rank frequent ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(h[n > 1].view(np.int64)), pa.array(n[n > 1])], names=["h", "n"])

        for b in batches:
            for block in shingle_sets(b.column(0), k):
                held += block
                size += sum(map(len, block))
                if size > BUFFER:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return run


@lru_cache(4096)
def _salt(s: int, t: int) -> int:
    return (s * 0x1F123BB5 + t * 0x5BD1E995 + 0x9E3779B97F4A7C15) & (2**64 - 1)


def subset_keys(own: np.ndarray, light: int, percent: int = PERCENT) -> list[int]:
    """Keys of the subsets a light set enumerates, for each size of partner the subsets of just the overlap needed."""
    parts, out = [int(x) for x in mix(own ^ U(0x2545F4914F6CDD1D))], []
    n = len(own)
    for t in partners(n, light, percent):
        lo, hi = min(n, t), max(n, t)
        salt = _salt(lo, hi)
        out += [(sum(c) * 0x9E3779B97F4A7C15 + salt) & (2**64 - 1) for c in combinations(parts, least_overlap(n, t, percent))]
    return out


def _index(k: int, percent: int, light: int, heavy: np.ndarray, rank: np.ndarray):
    """List entries of every text's set: key to shuffle by, list, set (first half of its digest), size, and whether the
    list is a frequent shingle's. Entries of such lists are spread over keys of their own. The lowest bit of a list's
    name tells lists of subsets (1) from those of shingles (0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block in shingle_sets(b.column(0), k):
                seen: set[int] = set()  # equal sets in this block speak once
                keys, subs, names, sizes = [], [], [], []
                for s in block:
                    n = len(s)
                    if not n or (name := int.from_bytes(_digest(s)[:8], "little", signed=True)) in seen:
                        continue
                    seen.add(name)
                    parts = [np.array(subset_keys(s, light, percent), U)] if n <= light else [np.zeros(0, U)]
                    if 100 * n >= percent * (light + 1):
                        where = np.minimum(np.searchsorted(heavy, s), max(len(heavy) - 1, 0))
                        often = heavy[where] == s if len(heavy) else np.zeros(n, bool)
                        p, rare = prefix_size(n, percent), s[~often]
                        parts.append(rare[:p])
                        if len(rare) < p:
                            parts.append(s[often][np.argsort(rank[where[often]], kind="stable")][: p - len(rare)])
                    own = np.concatenate(parts)
                    keys.append(own)
                    subs.append(np.arange(len(own)) < len(parts[0]))
                    names.append(np.full(len(own), name))
                    sizes.append(np.full(len(own), n))
                if not keys:
                    continue
                h, sub, d, n_ = np.concatenate(keys), np.concatenate(subs), np.concatenate(names), np.concatenate(sizes)
                where = np.minimum(np.searchsorted(heavy, h), max(len(heavy) - 1, 0))
                often = (heavy[where] == h) & ~sub if len(heavy) else np.zeros(len(h), bool)
                h = np.where(sub, h | U(1), h & ~U(1))
                key = np.where(often, mix(h + d.view(U) * U(0x9E3779B97F4A7C15)), h)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(h.view(np.int64)), pa.array(d), pa.array(n_), pa.array(often)], names=["k", "h", "d", "n", "often"])

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by k and d, each (list, set) once: those of lists with two sets, and those of frequent shingles."""
    held: pa.RecordBatch | None = None
    before: int | None = None  # k of the last group, once it has two sets
    last: tuple[int, int] | None = None
    for b in batches:
        k, d = np.asarray(b.column(0)), np.asarray(b.column(2))
        if not len(k):
            continue
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (d[1:] != d[:-1])
        new[0] = last != (int(k[0]), int(d[0]))
        last = (int(k[-1]), int(d[-1]))
        b = b.filter(pa.array(new))
        if held is not None:
            b = pa.concat_batches([held, b])
        if not b.num_rows:
            continue
        k, keep = np.asarray(b.column(0)), np.array(b.column(4))
        same = k[1:] == k[:-1]
        keep[1:] |= same
        keep[:-1] |= same
        if before is not None:
            keep |= k == before
        if keep[-1]:
            before, held = int(k[-1]), None
        else:  # alone so far: the next batch may bring it company
            held, b, keep = b.slice(b.num_rows - 1), b.slice(0, b.num_rows - 1), keep[:-1]
        yield b.filter(pa.array(keep)).select(["h", "d", "n", "often"])


def _propose(percent: int):
    """Of rows sorted by list and order, (b, n, a, v): a set, its size, the centre it meets and how often.

    In each list the first set of each band of sizes is a centre; sets look at the centre of their own band and of the
    band below, if it is of another component and near enough in size.
    """
    base = float(np.log(100 / percent))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: tuple | None = None
        centres: dict[int, tuple[int, int, int]] = {}
        for batch in batches:
            votes: dict[tuple[int, int, int], int] = {}
            g, h, rep, n, comp = (np.asarray(batch.column(i)).tolist() for i in range(5))
            band = np.floor(np.log(np.maximum(np.asarray(batch.column(3)), 1)) / base).astype(int).tolist()
            for i in range(len(h)):
                if at != (h[i], g[i]):
                    at, centres = (h[i], g[i]), {}
                centres.setdefault(band[i], (rep[i], n[i], comp[i]))
                for x in (band[i], band[i] - 1):
                    c = centres.get(x)
                    if c and c[2] != comp[i] and 100 * min(c[1], n[i]) >= percent * max(c[1], n[i]):
                        key = (rep[i], n[i], c[0])
                        votes[key] = votes.get(key, 0) + 1
            if votes:
                b, n_, a = zip(*votes)
                yield pa.RecordBatch.from_arrays([pa.array(b, pa.int64()), pa.array(n_, pa.int64()), pa.array(a, pa.int64()), pa.array(list(votes.values()), pa.int64())], names=["b", "n", "a", "v"])

    return run


def _prefix_size(n: Column, percent: int) -> Column:
    return n - F.ceil(percent * n / F.lit(100)) + 1


def _verify(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose texts' sets are similar enough.

    A task gets the text of a, then those of at most about CHECKED of its partners, one after the other. So a text with very many
    partners is sent once for each CHECKED of them, and its set is made as often. Texts that no pair names are not moved, but for a few.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, centre = None, np.zeros(0, U)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                found = []
                sets = (s for block in shingle_sets(part.column(3), k) for s in block)
                for a, salt, b, own in zip(*(part.column(i).to_pylist() for i in range(3)), sets, strict=True):
                    if b is None:
                        at, centre = (a, salt), own
                    elif at == (a, salt):
                        common = len(np.intersect1d(centre, own, assume_unique=True))
                        if 100 * common >= percent * (len(centre) + len(own) - common):
                            found.append((a, b))
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

    parts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / F.lit(CHECKED)).alias("parts"))
    salted = pairs.join(parts.where("parts > 1"), "a", "left").select(F.col("b").alias("rep"), "a", F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1))).alias("salt"), "b")
    centres = parts.select(F.col("a").alias("rep"), "a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("salt"), F.lit(None).cast("long").alias("b"))
    named = narrowed(texts, pairs.select(F.col("a").alias("rep")).union(pairs.select("b")), ["rep"])
    rows = named.join(centres.unionByName(salted), "rep").select("a", "salt", "b", "text")
    rows = rows.repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").isNotNull())
    return rows.mapInArrow(lean(run), "a long, b long")


def similar_documents(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id for every row of docs.

    component_id is the smallest doc_id that links lead to. Null and wordless texts have no shingles and link with
    nothing. A null doc_id counts as below all others. Each row counts for itself: rows that share a doc_id are linked where
    their sets are, and may have different components. Of docs only doc_id and text are read; an empty table gives no rows.
    """
    tune(docs.sparkSession)
    keyed = _keyed(docs)
    sets = materialize(keyed.mapInArrow(lean(_describe(k)), "doc_id long, n long, d long, digest binary"), "sets")
    firsts = materialize(sets.where("n > 0").groupBy("digest", "d").agg(F.min("doc_id").alias("doc")), "set-firsts")
    # Ids of several rows; with different sets, their sets go by half a digest, as the id names none of them.
    ids = sets.groupBy("doc_id").agg(F.count(F.lit(1)).alias("c"), (F.min("d") != F.max("d")).alias("shared"))
    repeated = materialize(ids.where("c > 1").select(F.col("doc_id").alias("doc"), "shared"), "set-repeated-ids")
    if any_repeated := not repeated.isEmpty():
        named = firsts.join(repeated, "doc", "left").select("digest", "d", "doc", F.when(F.col("shared"), F.col("d")).otherwise(F.col("doc")).alias("rep"))
        firsts = materialize(named, "set-keys")
    else:
        firsts = firsts.withColumn("rep", F.col("doc"))
    # Wordless rows stay out of the join, where they would all have one key.
    base = sets.where("n > 0").join(firsts.drop("d"), "digest").select("doc_id", "n", "doc", "rep")
    base = materialize(base.unionByName(sets.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("doc"), F.lit(None).cast("long").alias("rep"))), "set-reps")
    lists = _lists(keyed, base, firsts, k, percent)
    texts = materialize(_texts(keyed, firsts, repeated, k), "set-texts") if any_repeated else keyed.select(F.col("doc_id").alias("rep"), "text")
    labels = _link(lists, texts, k, percent)
    if any_repeated:  # the smallest key of a component needn't be its smallest doc_id
        smallest = labels.join(firsts.select("rep", "doc"), "rep").groupBy("comp").agg(F.min("doc").alias("smallest"))
        labels = labels.join(smallest, "comp").select("rep", F.col("smallest").alias("comp"))
    discard(sets, texts)
    component = F.coalesce("comp", "doc")
    out = base.where("rep IS NOT NULL").join(labels, "rep", "left").unionByName(base.where("rep IS NULL").withColumn("comp", F.lit(None).cast("long")))
    return out.select(F.when(F.col("doc_id") != NULL_ID, F.col("doc_id")).alias("doc_id"), F.col("n").alias("n_shingles"), F.when(component != NULL_ID, component).alias("component_id"))


def _texts(keyed: DataFrame, firsts: DataFrame, repeated: DataFrame, k: int) -> DataFrame:
    """(rep, text): for each set a text that has it. Ids of one row give theirs as it is, whether or not it names a set."""
    own = keyed.select(F.col("doc_id").alias("rep"), "text").join(repeated.select(F.col("doc").alias("rep")), "rep", "left_anti")
    names = firsts.join(repeated.select("doc"), "doc").select(F.col("doc").alias("doc_id"), "d", "rep")
    rows = keyed.join(names.select("doc_id").distinct(), "doc_id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            halves = [int.from_bytes(_digest(s)[:8], "little", signed=True) for block in shingle_sets(b.column(1), k) for s in block]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(halves, pa.int64()), b.column(1)], names=["doc_id", "d", "text"])

    several = rows.mapInArrow(lean(run), "doc_id long, d long, text string").join(names, ["doc_id", "d"])
    return own.unionByName(several.groupBy("rep").agg(F.min("text").alias("text")))


def _lists(keyed: DataFrame, base: DataFrame, firsts: DataFrame, k: int, percent: int) -> DataFrame:
    """Lists with several sets: h, rep, n, and the number of parts that the list is scanned in."""
    histogram = {r["n"]: r["count"] for r in base.where(F.col("n").between(1, 2 * MAX_LIGHT)).groupBy("n").count().collect()}
    light = boundary(histogram, percent)
    counted = keyed.select("text").mapInArrow(lean(_count(k)), "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    top = counted.orderBy(F.desc("n"), "h").limit(HEAVY).collect()  # at most HEAVY rows
    heavy, rank = np.array([r["h"] for r in top], np.int64).view(U), np.array([r["n"] for r in top], np.int64)
    order = np.argsort(heavy)
    heavy, rank = heavy[order], rank[order]
    entries = keyed.select("text").mapInArrow(lean(_index(k, percent, light, heavy, rank)), "k long, h long, d long, n long, often boolean")
    shared = entries.repartition("k").sortWithinPartitions("k", "d").mapInArrow(lean(_shared), "h long, d long, n long, often boolean")
    shared = materialize(shared, "set-shared")
    # Should two sets share half a digest, both stand in all of its lists: checks on texts decide anyway.
    lists = materialize(shared.join(firsts.select("d", "rep"), "d").select("h", "rep", "n", "often"), "set-lists")
    discard(shared)
    # Very long lists are scanned in parts. Only frequent shingles have such; there are at most HEAVY of them.
    long = lists.where("often").groupBy("h").agg(F.ceil(F.count(F.lit(1)) / F.lit(LONG)).alias("parts")).where("parts > 1")
    return lists.join(F.broadcast(long), "h", "left").select("h", "rep", "n", F.coalesce("parts", F.lit(1)).alias("parts"))


def _link(lists: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """(rep, comp) for all sets of the lists."""
    labels = materialize(lists.select("rep").distinct().withColumn("comp", F.col("rep")), "set-labels")
    tried = None
    for turn in range(TURNS):
        # Centres are the smallest numbers first, as copies follow their originals, then others each time, by a hash. Parts
        # of long lists are mixed anew each time.
        now = lists.join(labels, "rep") if turn else lists.withColumn("comp", F.col("rep"))
        now = now.withColumn("g", F.pmod(F.xxhash64("rep", F.lit(turn)), F.col("parts")))
        rows = now.select("g", "h", "rep", "n", "comp", (F.xxhash64(F.lit(turn), "rep") if turn else F.col("rep")).alias("o")).repartition("h", "g").sortWithinPartitions("h", "g", "o")
        votes = rows.drop("o").mapInArrow(lean(_propose(percent)), "b long, n long, a long, v long").groupBy("b", "n", "a").agg(F.sum("v").alias("v"))
        # Few common lists promise little; what such a pair has in common is left to the pairs below.
        votes = votes.where((F.col("n") <= MAX_LIGHT) | (PROPOSE * F.col("v") >= _prefix_size(F.col("n"), percent)))
        if tried is not None:
            votes = votes.join(tried, ["a", "b"], "left_anti")
        proposals = materialize(votes.groupBy("b").agg(F.max_by("a", F.struct("v", (-F.col("a")).alias("x"))).alias("a")).select("a", "b"), "set-proposals")
        if proposals.isEmpty():
            break
        tried = proposals if tried is None else materialize(tried.unionByName(proposals), "set-tried")
        labels = _relabel(labels, materialize(_verify(proposals, texts, k, percent), "set-edges"))
    return _relabel(labels, materialize(_verify(_across(lists, labels, percent), texts, k, percent), "set-edges"))


def _across(lists: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """All pairs (a, b) of sets in different components that may be similar, from lists that still hold several.

    Components have an order, by size. In each list, sets outside its first component scan the whole list, which comes in
    blocks of bounded length; a set adds up what it has met in all of its lists and keeps what can reach the overlap
    needed. Of two sets the one of the lesser component scans, in every list that both are in, so its counts are complete.
    """
    sizes = labels.groupBy("comp").agg(F.count(F.lit(1)).alias("size"))
    order = materialize(labels.join(sizes, "comp").select("rep", F.struct("size", "comp").alias("place")), "set-places")
    rows = materialize(lists.select("h", "rep", "n").join(order, "rep"), "set-labelled")
    leads = rows.groupBy("h").agg(F.max("place").alias("lead"), F.min("place").alias("low"), F.count(F.lit(1)).alias("c"))
    leads = materialize(leads.where("lead != low").select("h", "lead", F.ceil(F.col("c") / F.lit(BLOCK)).alias("blocks")), "set-open")
    rows = materialize(rows.join(leads, "h").select("h", "rep", "n", (F.col("place") != F.col("lead")).alias("scans"), "blocks", F.pmod(F.xxhash64("rep"), F.col("blocks")).alias("block")), "set-left")
    blocks = rows.groupBy("h", "block").agg(F.collect_list(F.struct("rep", "n")).alias("x"))
    blocks = blocks.select("h", "block", F.transform("x", lambda x: x["rep"]).alias("reps"), F.transform("x", lambda x: x["n"].cast("int")).alias("ns"))
    scans = rows.where("scans").select("h", F.col("rep").alias("a"), F.col("n").alias("m"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    scans = scans.join(blocks, ["h", "block"]).select("a", "m", F.expr("h & 1 = 1").alias("subset"), "reps", "ns")
    met = scans.repartition("a").sortWithinPartitions("a").mapInArrow(lean(_scan(percent)), "a long, b long")
    of = lambda side: order.select(F.col("rep").alias(side), F.col("place").alias(f"p{side}"))
    pairs = materialize(met.join(of("a"), "a").join(of("b"), "b").where("pa < pb AND pa.comp != pb.comp").select("a", "b"), "set-across")
    discard(order, leads, rows)
    return pairs


def _scan(percent: int):
    """Of rows sorted by a, with blocks of its lists: the sets that a may be similar to.

    Sets that share a subset of the overlap needed are. Of others, up to the lesser of two prefixes' last elements all
    common elements are counted; beyond it that set has only what its prefix left out.
    """

    def add_up(parts: list[tuple]) -> tuple:
        rep, n, common, subset = (np.concatenate(x) for x in zip(*parts))
        rep, at, back = np.unique(rep, return_index=True, return_inverse=True)
        by_subset = np.zeros(len(rep), bool)
        by_subset[back[subset]] = True
        return rep, n[at], np.bincount(back, weights=common, minlength=len(rep)).astype(np.int64), by_subset

    def flush(a: int, m: int, parts: list[tuple]) -> pa.RecordBatch:
        rep, n, common, subset = add_up(parts)
        near = 100 * np.minimum(n, m) >= percent * np.maximum(n, m)
        rest = np.maximum(-(-percent * n // 100), -(-percent * m // 100)) - 1
        need = -(-percent * (n + m) // (100 + percent))
        b = rep[near & (rep != a) & (subset | (common + rest >= need))]
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(b), a)), pa.array(b)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: tuple[int, int] | None = None
        parts: list[tuple] = []
        held = 0
        for batch in batches:
            for a, m, subset, r, n in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3), batch.column(4), strict=True):
                if at is not None and at != (a, m):
                    yield flush(*at, parts)
                    parts, held = [], 0
                at = (a, m)
                reps = np.asarray(r.values)
                parts.append((reps, np.asarray(n.values).astype(np.int64), np.full(len(reps), not subset, np.int64), np.full(len(reps), subset)))
                held += len(reps)
                if held > HELD:
                    parts = [add_up(parts)]
                    held = len(parts[0][0])
                    if held > HELD // 2:  # many partners: let them come to twice as many before the next time
                        held = 0
        if at is not None:
            yield flush(*at, parts)

    return run


def _relabel(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """Labels after joining the components that edges connect; both tables are used up."""
    of = lambda side: labels.select(F.col("rep").alias(side), F.col("comp").alias(f"c{side}"))
    between = edges.join(of("a"), "a").join(of("b"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    found = components(between).select("node", F.col("comp").alias("joined"))
    new = materialize(labels.join(found, F.col("comp") == F.col("node"), "left").select("rep", F.coalesce("joined", "comp").alias("comp")), "set-labels")
    discard(labels, edges)
    return new
