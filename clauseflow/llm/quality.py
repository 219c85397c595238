"""Quality rules whose cut-offs adapt to each language and source.

Counts per document come from one vectorised pass, written once without the texts. Each (lang, source) group then gets a
mergeable quantile sketch per measure: a histogram over logarithmic bins with `SUB` linear steps each, so two sketches
merge by adding counts and a quantile is off by at most 1/SUB of its value. Sketches are built by a partial aggregation
(rows of a hot group are counted before they are shuffled); those of groups with few documents are replaced by the merged
sketch of their language, and those of small languages by that of all documents. Read out as fences, they are joined back
to every document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import materialize, plus, tune
from .wordhash import SPACED, U, mix, text_chunks, window_hashes, word_bounds, word_hashes, words

SUB = 32
#: Measures, all integers per document: symbols and repeated lines in thousandths, word length in hundredths of a
#: character; and for each the percentile that stands for the upper end of ordinary documents. Lines repeat in few
#: documents, good ones among them, so nine tenths of a group say nothing about how many repeats are ordinary.
MEASURES = {"symbols": 90, "duplicates": 99, "length": 90}
#: Fence: that percentile plus this many times its distance from the median.
SPREAD = 2
#: Documents that a group's own sketch needs to have seen.
LEAST_GROUP = 50
BASE_MIN_WORDS, BASE_REPEAT_PERCENT, WINDOW = 10, 20, 5

COUNTS = "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long"
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _repeats(row: np.ndarray, h: np.ndarray, earlier_only: bool) -> np.ndarray:
    """Flags entries whose (row, hash) occurs more than once; with earlier_only not the first of them."""
    key = mix(h + row.astype(U) * U(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    flag = np.zeros(len(key), bool)
    flag[order[1:][same]] = True
    if not earlier_only:
        flag[order[:-1][same]] = True
    return flag


def count_texts(texts: pa.Array) -> list[np.ndarray]:
    """The columns of COUNTS for an array of texts."""
    parts: list[list[np.ndarray]] = []
    for lo, hi, data, off in text_chunks(texts):
        n = hi - lo
        starts, ends, row = words(data, off, SPACED)
        bounds = word_bounds(row, n)
        lead = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
        chars = np.concatenate(([0], np.cumsum(lead[ends] - lead[starts])))
        symbols = np.concatenate(([0], np.cumsum(_SYMBOL[data])))
        # lines: cut at each newline and at each text's edges
        cut = np.union1d(np.flatnonzero(data == 10) + 1, off[1:-1])
        cut = cut[(cut > 0) & (cut < len(data))] if len(data) else cut[:0]
        l0 = np.concatenate(([0], cut)).astype(np.int64) if len(data) else np.zeros(0, np.int64)
        l1 = np.concatenate((cut, [len(data)])).astype(np.int64) if len(data) else l0
        l1 = np.where((l1 > l0) & (data[l1 - 1] == 10), l1 - 1, l1) if len(data) else l1
        worded = np.searchsorted(starts, l1) > np.searchsorted(starts, l0)
        l0, l1 = l0[worded], l1[worded]
        line_row = np.searchsorted(off, l0, side="right") - 1
        dup = _repeats(line_row, word_hashes(data, l0, l1) + (l1 - l0).astype(U), True) if len(l0) else np.zeros(0, bool)
        at, w = window_hashes(word_hashes(data, starts, ends), row, WINDOW)
        again = at[_repeats(row[at], w, False)]
        cover = np.zeros(len(starts) + 1, np.int64)
        np.add.at(cover, again, 1)
        np.add.at(cover, again + WINDOW, -1)
        covered = np.concatenate(([0], np.cumsum(np.cumsum(cover[:-1]) > 0)))
        b0, b1 = bounds[:-1], bounds[1:]
        parts.append([
            b1 - b0, chars[b1] - chars[b0], symbols[off[1:]] - symbols[off[:-1]],
            np.bincount(line_row, minlength=n), np.bincount(line_row[dup], minlength=n), covered[b1] - covered[b0],
        ])
    return [np.concatenate(c).astype(np.int64) if parts else np.zeros(0, np.int64) for c in (zip(*parts) if parts else [[]] * 6)]


def with_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs without the text column, with the columns of COUNTS (they replace columns of those names)."""
    names = [x.split()[0] for x in COUNTS.split(", ")]
    keep = [c for c in docs.columns if c != text and c not in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counted = count_texts(b.column(len(keep)))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], *map(pa.array, counted)], names=[*keep, *names])

    tune(docs.sparkSession)
    schema = plus(docs.select(*(F.col(f"`{c}`") for c in keep)).schema, COUNTS)
    return docs.select(*(F.col(f"`{c}`") for c in keep), F.col(text)).mapInArrow(run, schema)


def bin_of(v: Column) -> Column:
    """Lower edge of a value's sketch bin: exact below 2 * SUB, then SUB steps for each power of two."""
    shift = F.greatest(F.length(F.bin(v)) - F.lit(SUB.bit_length()), F.lit(0))
    return F.expr("1L") * F.call_function("shiftleft", F.call_function("shiftright", v, shift), shift)


def measures() -> dict[str, Column]:
    words_, lines = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("n_lines"), F.lit(1))
    return {
        "symbols": F.floor(F.lit(1000) * F.col("n_symbols") / words_),
        "duplicates": F.floor(F.lit(1000) * F.col("n_dup_lines") / lines),
        "length": F.floor(F.lit(100) * F.col("word_chars") / words_),
    }


def sketches(counted: DataFrame, group: list[str]) -> DataFrame:
    """(*group, measure, bin, n): the sketches of the documents that pass the base rules. A group's has at most SUB bins for
    each power of two and measure, however many documents it has seen."""
    long = counted.where(~F.col("base_failed")).select(
        *group, F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), bin_of(c.cast("long")).alias("bin")) for m, c in measures().items()))).alias("x")
    )
    return long.groupBy(*group, "x.measure", "x.bin").agg(F.count(F.lit(1)).alias("n"))


def merge(sketch: DataFrame, group: list[str]) -> DataFrame:
    """The sketches of coarser groups."""
    return sketch.groupBy(*group, "measure", "bin").agg(F.sum("n").alias("n"))


def fences(sketch: DataFrame, group: list[str]) -> DataFrame:
    """One row per group: total, the documents it has seen, and a struct `fence` with a field per measure."""
    bins = sketch.groupBy(*group, "measure").agg(F.array_sort(F.collect_list(F.struct("bin", "n"))).alias("bins"), F.sum("n").alias("total"))

    def quantile(percent: Column) -> Column:
        """The bin of the document at this rank, rounded up."""
        need = F.floor((F.col("total") * percent + 99) / 100)
        found = F.aggregate(
            "bins", F.struct(F.lit(0).cast("long").alias("seen"), F.lit(-1).cast("long").alias("at")),
            lambda a, b: F.struct((a["seen"] + b["n"]).alias("seen"), F.when((a["at"] < 0) & (a["seen"] + b["n"] >= need), b["bin"]).otherwise(a["at"]).alias("at")),
        )
        return found["at"]

    mid, high = quantile(F.lit(50)), quantile(F.element_at(F.create_map(*(F.lit(v) for kv in MEASURES.items() for v in kv)), F.col("measure")))
    each = bins.select(*group, "measure", "total", (high + SPREAD * (high - mid)).alias("top"))
    return each.groupBy(*group).agg(F.max("total").alias("total"), F.struct(*(F.max(F.when(F.col("measure") == m, F.col("top"))).alias(m) for m in MEASURES)).alias("fence"))


def group_fences(counted: DataFrame, group: list[str], least: int = LEAST_GROUP) -> DataFrame:
    """(g_<column>..., fence, level): for each group the fences of the finest sketch that has seen least documents: its own,
    or with one column after the other left out from the end; that of all documents in any case."""
    own = materialize(sketches(counted, group), "quality-sketches")
    out = fences(own, group).select(*group, F.struct(F.col("total"), F.col("fence")).alias(f"at_{len(group)}"))
    for n in range(len(group) - 1, -1, -1):
        upper = fences(merge(own, group[:n]), group[:n]).select(*(F.col(g).alias(f"u_{g}") for g in group[:n]), F.struct("total", "fence").alias(f"at_{n}"))
        on = F.lit(True)
        for g in group[:n]:
            on = on & F.col(g).eqNullSafe(F.col(f"u_{g}"))
        # Of all documents together there is one row.
        out = (out.join(upper, on) if n else out.crossJoin(F.broadcast(upper))).drop(*(f"u_{g}" for g in group[:n]))
    fence, level = F.col("at_0.fence"), F.lit(0)
    for n in range(1, len(group) + 1):
        enough = F.col(f"at_{n}.total") >= least
        fence, level = F.when(enough, F.col(f"at_{n}.fence")).otherwise(fence), F.when(enough, n).otherwise(level)
    return out.select(*(F.col(g).alias(f"g_{g}") for g in group), fence.alias("fence"), level.alias("level"))


def quality(docs: DataFrame, group: tuple[str, ...] = ("lang", "source"), least: int = LEAST_GROUP) -> DataFrame:
    """doc_id, the group's columns, the counts, base_failed, fence (a field per measure), level and kept, one row per row of docs.

    Null texts count as empty; they and texts under ten words fail the base rules. Null languages and sources form
    groups of their own. level says whose fences apply: 2 the group's, 1 its language's, 0 all documents'. A group whose
    documents all fail the base rules has no fence: nothing is kept there anyway. Rows that repeat count each; other
    columns of docs are left out, an empty table gives no rows.
    """
    base = with_counts(docs.select("doc_id", "text", *group)).withColumn(
        "base_failed", (F.col("n_words") < BASE_MIN_WORDS) | (100 * F.col("n_repeat_words") > BASE_REPEAT_PERCENT * F.col("n_words"))
    )
    base = materialize(base, "quality-counts")
    found = materialize(group_fences(base, list(group), least), "quality-fences")
    on = F.lit(True)
    for g in group:
        on = on & F.col(g).eqNullSafe(F.col(f"g_{g}"))
    joined = base.join(found, on, "left").drop(*(f"g_{g}" for g in group))
    over = F.lit(False)
    for m, c in measures().items():
        # Compared as sketches see values, so that a group of equal values lies on its fence and not over it.
        over = over | F.coalesce(bin_of(c.cast("long")) > F.col(f"fence.{m}"), F.lit(False))
    return joined.withColumn("kept", ~F.col("base_failed") & ~over)
