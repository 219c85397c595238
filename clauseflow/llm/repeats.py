"""Substring dedup: every window of WINDOW words whose word sequence also starts earlier is taken out.

Every word is a letter of an alphabet of 256, by a hash, so a phrase of SEED words is a string of SEED letters. Any window has
one seed phrase, the one in it with the smallest hash (a minimizer), and equal windows have equal seeds. Three steps:

1. Confirm. A shuffle of seed phrases, without their places, finds those that recur. One of the documents with a phrase owns it,
   and the others are said to follow the owner.
2. Locate. Owners are dealt out to shards. For each shard an Aho-Corasick automaton over its owners' recurring phrases is
   compiled, and the owners and all documents that follow one of them stream through it, which locates every occurrence.
   A document goes to the shards it may have phrases of, not through all automata: that would grow with the square of the
   corpus. Owners with very many phrases have several shards, shards with very many documents several tasks.
3. Judge. Windows whose seed was located go to a second shuffle under a hash of all their words, sorted so that the first
   occurrence leads its group.

Copies of one passage, however many, don't meet in one task: a map task sends one row for the copies it has seen itself
(one owner of a phrase, one window as its earliest) and passes the rest on wherever there is room, as ranges of windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import materialize, plus, tune
from .wordhash import SPACED, U, mix, run_hashes, text_chunks, word_bounds, word_hashes, words

WINDOW, SEED = 20, 8
CHUNK = 1 << 22
#: Phrases of one automaton, and documents that go through it in one task.
SHARD_PHRASES, SHARD_DOCS = 50_000, 1 << 14
NULL_ID = -(1 << 63)
#: Kinds of rows: a phrase of a document; one that the task saw elsewhere too; a document that follows an owner.
ALONE, SEVERAL, FOLLOWS = 0, 1, 2
_SECOND_STEP = 0xA0761D6478BD642F
#: A window by its hashes (many 0), or a range of so many windows that are known to repeat.
_WINDOW = ["k", "k2", "doc_id", "th", "at", "many"]


def letters_of(h: np.ndarray) -> np.ndarray:
    """A word's letter: the lowest byte of its hash."""
    return (h & U(255)).astype(np.uint8)


def phrases(letters: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first word, its SEED letters as one number) of every phrase within one row."""
    if len(letters) < SEED:
        return np.zeros(0, np.int64), np.zeros(0, U)
    at = np.flatnonzero(row[SEED - 1 :] == row[: len(row) - SEED + 1])
    code = np.zeros(len(at), U)
    for i in range(SEED):
        code |= letters[at + i].astype(U) << U(8 * i)
    return at, code


def seeds(letters: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word of each window, first word of the window's seed, phrase at every word; only those at seeds matter)."""
    if len(letters) < WINDOW:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0, U)
    at, code = phrases(letters, row)
    value, phrase = np.full(len(letters), ~U(0), U), np.zeros(len(letters), U)
    value[at], phrase[at] = mix(code), code
    start = np.flatnonzero(row[WINDOW - 1 :] == row[: len(row) - WINDOW + 1])
    view = np.lib.stride_tricks.sliding_window_view(value, WINDOW - SEED + 1)
    place = start + np.concatenate([view[start[i : i + 65536]].argmin(1) for i in range(0, len(start), 65536)] or [np.zeros(0, np.int64)])
    return start, place, phrase


def _signed(a: np.ndarray) -> np.ndarray:
    return a.view(np.int64)


def _scatter(*parts: np.ndarray) -> np.ndarray:
    """Keys that spread rows evenly."""
    out = np.zeros(len(parts[0]), U)
    for p in parts:
        out = mix(out * U(0x9E3779B97F4A7C15) + p.astype(U) + U(1))
    return out


def _long(*columns: np.ndarray, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(_signed(c) if c.dtype == U else c.astype(np.int64)) for c in columns], names=names)


def _keyed(docs: DataFrame, text: str) -> DataFrame:
    """doc_id (a null one below all others), th (hash of the text; tells rows of one doc_id apart), u (of both) and text."""
    own = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("th"), F.col(text).alias("text"))
    return own.select("doc_id", "th", F.xxhash64("doc_id", "th").alias("u"), "text")


def _emit_phrases(batches: Iterator[pa.RecordBatch], chunk: int) -> Iterator[pa.RecordBatch]:
    """Of u and text: each seed phrase of a chunk once, for the least u that has it; the others that have it follow that one."""
    names = ["k", "u", "o", "kind"]
    for b in batches:
        ids = np.asarray(b.column(0))
        for lo, hi, data, off in text_chunks(b.column(1), chunk):
            starts, ends, row = words(data, off, SPACED)
            _, place, phrase = seeds(letters_of(word_hashes(data, starts, ends)), row)
            place = np.unique(place)
            if not len(place):
                continue
            k, u, at = phrase[place], ids[lo:hi][row[place]], place - word_bounds(row, hi - lo)[row[place]]
            order = np.lexsort((at, u, k))
            k, u, at = k[order], u[order], at[order]
            new = np.concatenate(([True], k[1:] != k[:-1]))
            lead = np.maximum.accumulate(np.where(new, np.arange(len(k)), 0))
            # The row of a document that stands there twice is no repeat of itself.
            other = (u != u[lead]) | (at != at[lead])
            several = np.logical_or.reduceat(other, np.flatnonzero(new))
            yield _long(k[new], u[new], np.zeros(new.sum(), np.int64), np.where(several, SEVERAL, ALONE), names=names)
            far = u != u[lead]
            pairs = np.unique(np.stack([u[far], u[lead][far]], 1), axis=0)
            if len(pairs):
                yield _long(_scatter(pairs[:, 0], pairs[:, 1]), pairs[:, 0], pairs[:, 1], np.full(len(pairs), FOLLOWS), names=names)


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by k and u: (o, k) for owners and their recurring phrases, (u, o) for documents that follow them.

    The first document with a phrase owns it. A task that saw a phrase in several documents let them follow the one it named:
    that one has the phrase as well, and follows the owner.
    """
    names = ["u", "o", "k"]
    last: tuple[int, int, bool] | None = None  # phrase, owner, and whether it is known to recur
    for b in batches:
        k, u, o, kind = (np.asarray(c) for c in b.columns)
        follows = kind == FOLLOWS
        if follows.any():
            yield pa.RecordBatch.from_arrays([pa.array(u[follows]), pa.array(o[follows]), pa.nulls(int(follows.sum()), pa.int64())], names=names)
            k, u, kind = k[~follows], u[~follows], kind[~follows]
        if not len(k):
            continue
        known = np.zeros(len(k), bool)
        if last is not None and last[0] == k[0]:
            k, u, kind, known = np.append(last[0], k), np.append(last[1], u), np.append(ALONE, kind), np.append(last[2], known)
        new = np.concatenate(([True], k[1:] != k[:-1]))
        first = np.flatnonzero(new)
        lead = np.maximum.accumulate(np.where(new, np.arange(len(k)), 0))
        recurs = np.logical_or.reduceat((u != u[lead]) | (kind == SEVERAL) | known, first)
        last = (int(k[-1]), int(u[lead[-1]]), bool(recurs[-1]))
        own = first[recurs & ~known[first]]
        also = np.flatnonzero((kind == SEVERAL) & (u != u[lead]))
        has = np.concatenate((own, also))
        yield pa.RecordBatch.from_arrays([pa.nulls(len(has), pa.int64()), pa.array(u[has]), pa.array(k[has])], names=names)
        pairs = np.unique(np.stack([u, u[lead]], 1)[u != u[lead]], axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.nulls(len(pairs), pa.int64())], names=names)


def compile_automaton(codes: np.ndarray):
    """An Aho-Corasick automaton over phrases, each given as the number of its letters."""
    import ahocorasick

    machine = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
    text = np.unique(codes).astype("<u8").tobytes().decode("latin-1")
    for i in range(0, len(text), SEED):
        machine.add_word(text[i : i + SEED])
    machine.make_automaton()
    return machine


def locate(machine, letters: np.ndarray, row: np.ndarray) -> np.ndarray:
    """First words of all places in these texts, one after the other, where a phrase of the automaton stands."""
    ends = np.fromiter((e for e, _ in machine.iter(letters.tobytes().decode("latin-1"))), np.int64)
    starts = ends - SEED + 1
    return starts[row[starts] == row[ends]]  # not across two documents


def _emit_windows(batches: Iterator[pa.RecordBatch], chunk: int) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by shard, part and kind, first phrases and then documents: the windows whose seed the automaton locates."""
    group, codes, machine = None, [], None
    for b in batches:
        keys = [np.asarray(b.column(i)) for i in range(3)]  # shard, part, kind
        cut = np.flatnonzero(np.any([x[1:] != x[:-1] for x in keys], axis=0)) + 1
        for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), b.num_rows]):
            if lo == hi:
                continue
            if group != (keys[0][lo], keys[1][lo]):
                group, codes, machine = (keys[0][lo], keys[1][lo]), [], None
            if not keys[2][lo]:
                codes.append(np.asarray(b.column(3).slice(lo, hi - lo)).view(U))
                continue
            if machine is None:
                machine = compile_automaton(np.concatenate(codes) if codes else np.zeros(0, U))
            yield from _windows(machine, *(b.column(i).slice(lo, hi - lo) for i in (5, 6, 7)), chunk)


def _windows(machine, doc_ids: pa.Array, hashes: pa.Array, texts: pa.Array, chunk: int = CHUNK) -> Iterator[pa.RecordBatch]:
    all_ids, all_th = np.asarray(doc_ids), np.asarray(hashes)
    for lo, hi, data, off in text_chunks(texts, chunk):
        starts, ends, row = words(data, off, SPACED)
        h = word_hashes(data, starts, ends)
        letters = letters_of(h)
        near = np.zeros(len(h) + 1, bool)
        near[locate(machine, letters, row)] = True
        start, place, _ = seeds(letters, row)
        start = start[near[place]]
        if not len(start):
            continue
        k, k2 = run_hashes(h, start, start + WINDOW), run_hashes(h, start, start + WINDOW, _SECOND_STEP)
        r = row[start]
        own, th, at = all_ids[lo:hi][r], all_th[lo:hi][r], start - word_bounds(row, hi - lo)[r]
        # Of equal windows in this chunk only the earliest can be the first of all.
        o = np.lexsort((at, th, own, k2, k))
        new = np.concatenate(([True], (k[o][1:] != k[o][:-1]) | (k2[o][1:] != k2[o][:-1])))
        lead = o[np.maximum.accumulate(np.where(new, np.arange(len(o)), 0))]
        # Rows of a document that stands there twice share their place and are no repeats of each other.
        later = np.zeros(len(k), bool)
        later[o] = (own[o] != own[lead]) | (th[o] != th[lead]) | (at[o] != at[lead])
        yield _long(k[~later], k2[~later], own[~later], th[~later], at[~later], np.zeros((~later).sum(), np.int64), names=_WINDOW)
        # What repeats already goes on as ranges of window starts, under keys that spread them.
        known = start[later]
        new = np.concatenate(([True], (known[1:] != known[:-1] + 1) | (r[later][1:] != r[later][:-1]))) if len(known) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        own, th, at, many = own[later][first], th[later][first], at[later][first], np.diff(np.append(first, len(known)))
        yield _long(_scatter(own, at), np.zeros(len(at), np.int64), own, th, at, many, names=_WINDOW)


def _later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by both hashes and place: all but those at the first place of their window; ranges pass through."""
    last: tuple[int, ...] | None = None
    for b in batches:
        k, k2, ids, th, at, many = (np.asarray(c) for c in b.columns)
        # Should a range share a window's key, it must not lead the group.
        real = np.flatnonzero(many == 0)
        lead = np.zeros(len(k), bool)
        if len(real):
            rk, rk2, ri, rt, ra = k[real], k2[real], ids[real], th[real], at[real]
            new = np.concatenate(([last is None or (rk[0], rk2[0]) != last[:2]], (rk[1:] != rk[:-1]) | (rk2[1:] != rk2[:-1])))
            head = np.maximum.accumulate(np.where(new, np.arange(len(real)), -1))
            f = [np.where(head >= 0, x[np.maximum(head, 0)], y) for x, y in zip((ri, rt, ra), last[2:] if last else (0, 0, 0), strict=True)]
            lead[real] = (ri == f[0]) & (rt == f[1]) & (ra == f[2])
            last = (int(rk[-1]), int(rk2[-1]), int(f[0][-1]), int(f[1][-1]), int(f[2][-1]))
        keep = ~lead
        yield pa.RecordBatch.from_arrays([pa.array(ids[keep]), pa.array(th[keep]), pa.array(at[keep].astype(np.int32)), pa.array(np.maximum(many[keep], 1).astype(np.int32))], names=["doc_id", "th", "at", "many"])


def _routes(keyed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(shard, part, k): the phrases of every shard; (u, shard, part, o): the documents that go there, by owner."""
    rows = keyed.select("u", "text").mapInArrow(lambda b: _emit_phrases(b, CHUNK), "k long, u long, o long, kind long").repartition("k").sortWithinPartitions("k", "u")
    found = materialize(rows.mapInArrow(_confirm, "u long, o long, k long"), "repeat-phrases")
    owned, follow = found.where("k IS NOT NULL").select("o", "k"), found.where("k IS NULL").select("u", "o")
    follow = follow.unionByName(owned.select(F.col("o").alias("u"), "o"))
    shards = max(1, -(-owned.count() // SHARD_PHRASES))
    # Owners with more phrases than an automaton should hold have shards of their own, by a hash of the phrase.
    many = owned.groupBy("o").agg(F.ceil(F.count(F.lit(1)) / F.lit(SHARD_PHRASES)).alias("own")).where("own > 1")
    many = materialize(many, "repeat-owners")
    shard = F.pmod("o", F.lit(shards))
    if not many.isEmpty():
        owned, follow = owned.join(many, "o", "left"), follow.join(many, "o", "left")
        one = lambda n: F.when(F.col("own").isNotNull(), F.xxhash64("o", n)).otherwise(F.pmod("o", F.lit(shards)))
        owned = owned.select("k", one(F.pmod(F.xxhash64("k"), F.col("own"))).alias("shard"))
        follow = follow.select("u", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("own", F.lit(1)) - 1)).alias("n"), "o", "own").select("u", one(F.col("n")).alias("shard"), "o")
    else:
        owned, follow = owned.select("k", shard.alias("shard")), follow.select("u", shard.alias("shard"), "o")
    # In a shard, documents that follow one owner stand side by side, so that most repeats are known in one chunk.
    follow = materialize(follow.groupBy("u", "shard").agg(F.min("o").alias("o")), "repeat-routes")
    parts = materialize(follow.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / F.lit(SHARD_DOCS)).alias("parts")), "repeat-shards")
    ways = follow.join(parts, "shard").select("u", "shard", F.pmod(F.xxhash64("u"), F.col("parts")).alias("part"), "o")
    return owned.join(parts, "shard").select("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), "k"), ways


def find_repeats(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, th and all windows that also start earlier, as ranges of their first words (arrays `at` and `many`, which may
    overlap), for documents that have any.

    Earlier is a smaller doc_id (null below all), of rows that share a doc_id the one with the smaller text hash, in one
    text the earlier start. A row that occurs twice counts as one document.
    """
    tune(docs.sparkSession)
    keyed = _keyed(docs, text)
    owned, ways = _routes(keyed)
    no, yes = F.lit(None), F.lit(1)
    compiled = owned.select("shard", "part", F.lit(0).alias("kind"), "k", no.cast("long").alias("o"), no.cast("long").alias("doc_id"), no.cast("long").alias("th"), no.cast("string").alias("text"))
    streamed = keyed.join(ways, "u").select("shard", "part", yes.alias("kind"), no.cast("long").alias("k"), "o", "doc_id", "th", "text")
    rows = compiled.unionByName(streamed).repartition("shard", "part").sortWithinPartitions("shard", "part", "kind", "o")
    windows = rows.mapInArrow(lambda b: _emit_windows(b, CHUNK), "k long, k2 long, doc_id long, th long, at long, many long").repartition("k").sortWithinPartitions("k", "k2", "doc_id", "th", "at")
    later = materialize(windows.mapInArrow(_later, "doc_id long, th long, at int, many int"), "repeat-windows")
    return later.groupBy("doc_id", "th").agg(F.collect_list(F.struct("at", "many")).alias("x")).select("doc_id", "th", F.col("x.at").alias("at"), F.col("x.many").alias("many"))


def strip(texts: pa.Array, removed: list[tuple[np.ndarray, np.ndarray] | None]) -> Iterator[tuple[int, int, bytes]]:
    """(number of words, number removed, kept words joined by single spaces) of each text; removed has ranges of window starts."""
    for lo, hi, data, off in text_chunks(texts):
        starts, ends, row = words(data, off, SPACED)
        bounds = word_bounds(row, hi - lo)
        cover = np.zeros(len(starts) + 1, np.int64)
        for r in range(lo, hi):
            if removed[r] is not None:
                at, many = removed[r]
                np.add.at(cover, bounds[r - lo] + at, 1)
                np.add.at(cover, bounds[r - lo] + at + many - 1 + WINDOW, -1)
        keep = np.cumsum(cover[:-1]) <= 0
        s, e, kr = starts[keep], ends[keep], row[keep]
        more = np.zeros(len(s), bool)  # another kept word of the same text follows
        more[:-1] = kr[1:] == kr[:-1]
        clean = data.copy()
        clean[e[more]] = 32
        edge = np.zeros(len(data) + 2, np.int64)
        edge[s] += 1
        np.add.at(edge, e + more, -1)
        mask = np.cumsum(edge[: len(data)]) > 0
        before = np.concatenate(([0], np.cumsum(mask)))
        kept, raw = before[off], clean[mask].tobytes()
        counts = np.bincount(kr, minlength=hi - lo)
        for r in range(hi - lo):
            n = int(bounds[r + 1] - bounds[r])
            yield n, n - int(counts[r]), raw[kept[r] : kept[r + 1]]


def remove_repeats(docs: DataFrame, text: str = "text", digest: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and the kept text, or with digest its SHA-256; one row per row of docs.

    Null and empty texts have no words. Windows are judged on the input, not on what is left. Rows that share a doc_id but
    not the text are documents of their own, repeated rows one document; other columns of docs are left out, an empty table
    gives no rows.
    """
    found = find_repeats(docs, text)
    last = "kept_sha256" if digest else "kept_text"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ranges = zip(b.column(2), b.column(3), strict=True)
            out = list(strip(b.column(1), [(np.asarray(a.values), np.asarray(n.values)) if a.is_valid else None for a, n in ranges]))
            n, gone, kept = zip(*out) if out else ((), (), ())
            values = [hashlib.sha256(x).hexdigest() if digest else x.decode("utf-8", "replace") for x in kept]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(values, pa.string())], names=["doc_id", "n_words", "n_removed", last])

    joined = _keyed(docs, text).repartition("doc_id", "th").join(found, ["doc_id", "th"], "left").select("doc_id", "text", "at", "many")
    out = joined.mapInArrow(run, plus(joined.select("doc_id").schema, f"n_words long, n_removed long, {last} string"))
    return out.withColumn("doc_id", F.when(F.col("doc_id") != NULL_ID, F.col("doc_id")))
