"""Benchmark decontamination with suffix arrays over the training text.

Documents are read in shards of about SHARD_BYTES. Each shard gets a word-level suffix array; every benchmark suffix is
looked up in it by binary search, as far as a window is long, which gives all places where it occurs verbatim. Places on
one diagonal (document position minus item position) that follow each other make up the longest verbatim match.

A shard never leaves its task, and nothing is shuffled: benchmark windows go to the shards, in blocks of bounded size, one
pass of a narrow map for each block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .scratch import lean, tune
from .wordhash import ALNUM, LOWER, U, text_chunks, word_bounds, word_hashes, words

WINDOW = 10
SHARD_BYTES = 1 << 20
#: Benchmark text (bytes) that goes to the workers at once; a larger benchmark takes several passes.
BLOCK_BYTES = 8 << 20
FOUND = "n_words long, hits array<struct<start:int,end:int>>, matches array<struct<item:string,longest:int,start:int,item_start:int>>"

_INT = pa.int32()
_HITS = pa.list_(pa.struct([("start", _INT), ("end", _INT)]))
_MATCHES = pa.list_(pa.struct([("item", pa.string()), ("longest", _INT), ("start", _INT), ("item_start", _INT)]))


@dataclass
class Windows:
    """Distinct windows of one length: their word hashes, and for each the (item, position) pairs it stands at."""

    hashes: np.ndarray
    first: np.ndarray
    item: np.ndarray
    at: np.ndarray


def windows_of(items: list[tuple[str, str]]) -> tuple[list[str], list[Windows]]:
    """Item names, and their windows by length: WINDOW words, or the whole item where it has fewer."""
    names = [n for n, _ in items]
    by: dict[int, list[tuple[np.ndarray, int, int]]] = {}
    for k, (_, text) in enumerate(items):
        for _, _, data, off in text_chunks(pa.array([text])):
            data = LOWER[data]
            starts, ends, _ = words(data, off, ALNUM)
            h = word_hashes(data, starts, ends)
            w = min(WINDOW, len(h))
            for j in range(len(h) - w + 1 if w else 0):
                by.setdefault(w, []).append((h[j : j + w], k, j))
    out = []
    for rows in by.values():
        all_hashes = np.array([r[0] for r in rows], U)
        unique, back = np.unique(all_hashes, axis=0, return_inverse=True)
        order = np.argsort(back.ravel(), kind="stable")
        first = np.searchsorted(back.ravel()[order], np.arange(len(unique) + 1))
        out.append(Windows(unique, first, np.array([rows[i][1] for i in order]), np.array([rows[i][2] for i in order])))
    return names, out


def suffix_array(ids: np.ndarray, depth: int) -> np.ndarray:
    """Positions of ids (at least 0) in the order of the suffixes there, by their first `depth` values and more; ties
    beyond that by position. Prefix doubling: after each round only suffixes that are still equal are ordered further."""
    n = len(ids)
    following = np.append(ids[1:], 0)
    key = ids.astype(np.int64) * (int(ids.max(initial=0)) + 1) + following
    sa = np.argsort(key, kind="stable")
    new = np.ones(n, bool)
    new[1:] = key[sa[1:]] != key[sa[:-1]]
    start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.zeros(n + 1, np.int64)  # behind the end: the least rank
    rank[sa] = start + 1
    step = 2
    while step < depth:
        alone = new & np.append(new[1:], True)
        slots = np.flatnonzero(~alone)
        if not len(slots):
            break
        own = sa[slots]
        group, after = rank[own], rank[np.minimum(own + step, n)]
        order = np.lexsort((after, group))
        sa[slots] = own = own[order]
        group, after = group[order], after[order]
        cut = np.ones(len(slots), bool)
        cut[1:] = (group[1:] != group[:-1]) | (after[1:] != after[:-1])
        new[slots] = cut
        start = np.maximum.accumulate(np.where(cut, slots, 0))
        rank[own] = start + 1
        step *= 2
    return sa


def interval(sa: np.ndarray, ids: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of queries the range of sa whose suffixes begin with it; ids has queries.shape[1] zeros at its end."""
    n, w = len(sa), queries.shape[1]
    ends = []
    for upper in (False, True):
        lo, hi = np.zeros(len(queries), np.int64), np.full(len(queries), n)
        while (lo < hi).any():
            open_ = lo < hi
            mid = (lo + hi) // 2
            have = ids[sa[np.minimum(mid, n - 1)][:, None] + np.arange(w)]
            differs = have != queries
            k = np.where(differs.any(1), differs.argmax(1), w)
            at = np.minimum(k, w - 1)
            rows = np.arange(len(queries))
            less = np.where(k < w, have[rows, at] < queries[rows, at], upper)
            lo = np.where(open_ & less, mid + 1, lo)
            hi = np.where(open_ & ~less, mid, hi)
        ends.append(lo)
    return ends[0], ends[1]


def search_shard(h: np.ndarray, row: np.ndarray, n_rows: int, groups: list[Windows]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word position, window length, occurrence) for each place where a window occurs; occurrence is (group, window)."""
    none = np.zeros(0, np.int64)
    if not len(h):
        return none, none, np.zeros((0, 2), np.int64)
    known, ids = np.unique(h, return_inverse=True)
    # One zero between rows keeps suffixes of one text from running into the next.
    gap = row + np.arange(len(h))
    line = np.zeros(len(h) + n_rows + WINDOW, np.int64)
    line[gap] = ids + 1
    back = np.full(len(line), -1)
    back[gap] = np.arange(len(h))
    sa = suffix_array(line[: len(h) + n_rows], WINDOW)
    places, lengths, which = [none], [none], [np.zeros((0, 2), np.int64)]
    for g, group in enumerate(groups):
        at = np.minimum(np.searchsorted(known, group.hashes), len(known) - 1)
        there = np.flatnonzero((known[at] == group.hashes).all(1))
        if not len(there):
            continue
        lo, hi = interval(sa, line, at[there] + 1)
        many = hi - lo
        nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        found = back[sa[np.repeat(lo, many) + nth]]
        places.append(found)
        lengths.append(np.full(len(found), group.hashes.shape[1]))
        which.append(np.stack([np.full(len(found), g), np.repeat(there, many)], 1))
    return np.concatenate(places), np.concatenate(lengths), np.concatenate(which)


def longest(places: np.ndarray, lengths: np.ndarray, which: np.ndarray, row: np.ndarray, bounds: np.ndarray, names: list[str], groups: list[Windows]) -> dict[int, list[dict]]:
    """For each row with matches, per item its longest verbatim match: item, length and both positions in words."""
    r, item, pos, at, length = [], [], [], [], []
    for p, n, (g, w) in zip(places.tolist(), lengths.tolist(), which.tolist(), strict=True):
        group = groups[g]
        for x in range(group.first[w], group.first[w + 1]):
            r.append(int(row[p]))
            item.append(int(group.item[x]))
            pos.append(p)
            at.append(int(group.at[x]))
            length.append(n)
    best: dict[tuple[int, str], tuple[int, int, int]] = {}
    order = sorted(range(len(r)), key=lambda i: (r[i], item[i], pos[i] - at[i], pos[i]))
    start = None
    for n, i in enumerate(order):
        before = order[n - 1] if n else None
        joined = before is not None and (r[i], item[i], pos[i] - at[i]) == (r[before], item[before], pos[before] - at[before]) and pos[i] == pos[before] + 1
        if not joined:
            start = i
        got = (pos[i] + length[i] - pos[start], -(pos[start] - int(bounds[r[i]])), -at[start])
        key = (r[i], names[item[i]])
        best[key] = max(best.get(key, got), got)
    out: dict[int, list[dict]] = {}
    for (k, name), (n, p, a) in sorted(best.items()):
        out.setdefault(k, []).append({"item": name, "longest": n, "start": -p, "item_start": -a})
    return out


def _merge(old: list[dict] | None, new: list[dict]) -> list[dict]:
    by = {m["item"]: m for m in old or []}
    for m in new:
        if m["item"] not in by or m["longest"] > by[m["item"]]["longest"]:
            by[m["item"]] = m
    return [by[k] for k in sorted(by)]


def _ranges(mask: np.ndarray) -> list[dict]:
    edge = np.diff(np.concatenate(([0], mask.astype(np.int8), [0])))
    return [{"start": int(s), "end": int(e)} for s, e in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)]


def _pass(docs: DataFrame, items: list[tuple[str, str]], text: str) -> DataFrame:
    """One block of the benchmark: adds to hits and matches."""
    columns = docs.columns
    at, hits_at, matches_at, n_at = (columns.index(c) for c in (text, "hits", "matches", "n_words"))
    block = docs.sparkSession.sparkContext.broadcast(windows_of(items))  # at most BLOCK_BYTES of text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, groups = block.value
        for b in batches:
            counts, hits, matches = [np.zeros(0, np.int64)], [], []
            old_hits, old_matches = b.column(hits_at).to_pylist(), b.column(matches_at).to_pylist()
            for lo, hi, data, off in text_chunks(b.column(at), SHARD_BYTES):
                data = LOWER[data]
                starts, ends, row = words(data, off, ALNUM)
                bounds = word_bounds(row, hi - lo)
                counts.append(np.diff(bounds))
                places, lengths, which = search_shard(word_hashes(data, starts, ends), row, hi - lo, groups)
                cover = np.zeros(len(starts) + 1, np.int64)
                np.add.at(cover, places, 1)
                np.add.at(cover, places + lengths, -1)
                mask = np.cumsum(cover[:-1]) > 0
                found = longest(places, lengths, which, row, bounds, names, groups)
                for k in range(hi - lo):
                    h, m = old_hits[lo + k] or [], old_matches[lo + k] or []
                    if k in found:
                        own = mask[bounds[k] : bounds[k + 1]].copy()
                        for x in h:
                            own[x["start"] : x["end"]] = True
                        h, m = _ranges(own), _merge(m, found[k])
                    hits.append(h)
                    matches.append(m)
            out = list(b.columns)
            out[n_at], out[hits_at], out[matches_at] = pa.array(np.concatenate(counts)), pa.array(hits, _HITS), pa.array(matches, _MATCHES)
            yield pa.RecordBatch.from_arrays(out, names=columns)

    return docs.mapInArrow(lean(run), docs.schema)


def find_contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """All columns of docs with n_words, hits (word ranges covered by benchmark windows) and matches (per item the longest
    verbatim match and where it is); they replace columns of those names.

    Null and empty texts have no words and no hits. Items without words match nothing; a null item_id is named ''.
    """
    tune(docs.sparkSession)
    keep = [c for c in docs.columns if c not in ("n_words", "hits", "matches")]
    out = docs.select(*(F.col(f"`{c}`") for c in keep))
    for field in StructType.fromDDL(FOUND).fields:
        out = out.withColumn(field.name, F.lit(None).cast(field.dataType))
    items, size, passed = [], 0, False
    for r in benchmark.where(F.length("text") > 0).select(F.coalesce(F.col("item_id").cast("string"), F.lit("")), "text").toLocalIterator():
        items.append((r[0], r[1]))
        size += len(r[1])
        if size >= BLOCK_BYTES:
            out, items, size, passed = _pass(out, items, text), [], 0, True
    return _pass(out, items, text) if items or not passed else out


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated, one row per row of docs.

    Null and empty texts have no words, repeated rows count each; an empty benchmark contaminates nothing, an empty table of
    documents gives no rows. Rows of one item_id are one item.
    """
    found = find_contamination(docs.select("doc_id", "text"), benchmark)
    hit = F.aggregate("hits", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    items = F.transform("matches", lambda m: m["item"])
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("matches").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort(items), ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, with their columns as they were, in which no benchmark window occurs."""
    return find_contamination(docs, benchmark).where(F.size("hits") == 0).select(*(F.col(f"`{c}`") for c in docs.columns))
