"""Language identification by compression.

Each language gets a raw-content zstandard dictionary made of text in that language. A text is compressed once per
language, and the language whose dictionary leaves the fewest bytes wins: words and endings that the language shares with
the text become references into its dictionary. Before that, letters are lowered and runs of anything else become one
space, so that markup and numbers don't count. Letters are what Unicode calls letters, with the marks that belong to them.

A text is rejected where the two smallest sizes are closer than what is usual: `calibrate` takes, for each class of
lengths, the margin that all but a few of the texts of learned languages reach, from all learning rows outside the dictionaries.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import lean, plus, tune

UNDETERMINED = "und"
#: A dictionary is learned from about this many documents of at most the second value (in bytes), and from longer ones where
#: these don't fill it: from about the third value at first, then from ever more.
MAX_DOCS_PER_LANG, MAX_DOC_BYTES, LONG_DOCS = 200, 4096, 32
#: Bytes of normalised text that a dictionary holds.
DICT_BYTES = 32 << 10
#: Languages that are drawn and loaded at a time; every text is compressed once for each language there is.
BLOCK = 64
#: Of each class of lengths with at least so many learning rows, so many in a thousand may have a smaller margin than that of the class.
LEAST_CLASS, PER_MILLE = 100, 5
LEVEL, MIN_MATCH = 3, 3


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


@lru_cache(1)
def _classes() -> tuple[re.Pattern, re.Pattern]:
    """Patterns for runs of what is neither letter nor mark, and for a letter, from the categories of all code points."""
    def ranges(kinds: str) -> str:
        out, start = [], None
        for c in range(sys.maxunicode + 2):
            inside = c <= sys.maxunicode and unicodedata.category(chr(c))[0] in kinds
            if inside and start is None:
                start = c
            elif not inside and start is not None:
                out.append(f"\\U{start:08x}-\\U{c - 1:08x}")
                start = None
        return "".join(out)

    return re.compile(f"[^{ranges('LM')}]+"), re.compile(f"[{ranges('L')}]")


def normalised(text: str) -> bytes:
    return _classes()[0].sub(" ", text.lower()).encode("utf-8", "replace")


def has_letter(text: str) -> bool:
    return _classes()[1].search(text) is not None


class Dictionaries(dict):
    """Dictionary by language; longer: about how many long documents of a language `learn` drew."""

    longer: dict[str, int] = {}


def learn(docs: DataFrame, max_docs: int = MAX_DOCS_PER_LANG) -> dict[str, bytes]:
    """A dictionary per language, from a bounded sample of the learning rows that a hash of doc_id picks.

    A pass for counts per language, then one for every BLOCK languages: the texts of about max_docs short documents of
    each. Languages whose dictionaries these don't fill are filled up from longer documents.
    """
    rows = docs.where(F.col("lang").isNotNull() & (F.length("text") > 0) & ~F.coalesce(held_out(F.col("doc_id")), F.lit(True)))
    short = F.octet_length("text") <= MAX_DOC_BYTES
    counts = rows.groupBy("lang").agg(F.count_if(short).alias("s"), F.count_if(~short).alias("l")).orderBy("lang").collect()
    # Letters only, as far as a dictionary can hold them.
    start = F.substring(F.regexp_replace("text", r"[^\p{L}\p{M}]+", " "), 1, DICT_BYTES)
    out, out_longer = Dictionaries(), {}
    for lo in range(0, len(counts), BLOCK):
        block = counts[lo : lo + BLOCK]
        own = _drawn(rows.where(short), F.col("text"), {r["lang"]: r["s"] for r in block if r["s"]}, max_docs)
        out |= {lang: b"\n".join(x)[-DICT_BYTES:] for lang, x in own.items()}
        left, want = {r["lang"]: r["l"] for r in block if r["l"] and len(out.get(r["lang"], b"")) < DICT_BYTES}, LONG_DOCS
        while left:
            more = {lang: _filled(x, own.get(lang, [])) for lang, x in _drawn(rows.where(~short), start, left, want).items()}
            out |= more
            out_longer |= dict.fromkeys(left, want)
            left = {lang: n for lang, n in left.items() if n > want and len(more.get(lang, b"")) < DICT_BYTES}
            want *= 8
    out.longer = out_longer
    return out


def _share(counts: dict[str, int], want: int) -> Column:
    """The share, in millionths, of a language's rows that about want of its rows are; counts has their numbers."""
    return F.element_at(F.create_map(*(F.lit(v) for lang, n in counts.items() for v in (lang, min(1_000_000, 1_000_000 * want // n)))), F.col("lang"))


def _draw() -> Column:
    return F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))


def _drawn(rows: DataFrame, text: Column, counts: dict[str, int], want: int) -> dict[str, list[bytes]]:
    """Normalised texts of about want rows of each language in counts, which has their numbers of rows, in a mixed order."""
    if not counts:
        return {}
    texts: dict[str, list[tuple[int, bytes]]] = {}
    for r in rows.where(_draw() < _share(counts, want)).select("lang", "doc_id", text.alias("text")).collect():
        texts.setdefault(r["lang"], []).append((hash((r["doc_id"] * 0x9E3779B97F4A7C15) & (2**61 - 1)), normalised(r["text"])))
    return {lang: [t for _, t in sorted(own)] for lang, own in texts.items()}


def calibrate(docs: DataFrame, dictionaries: dict[str, bytes], max_docs: int = MAX_DOCS_PER_LANG) -> dict[int, int]:
    """Least margin in bytes for each class of lengths, the number of bits of a normalised text's length.

    From all learning rows that `learn` didn't draw and whose language is found. Classes with fewer than LEAST_CLASS of them ask
    for one byte.
    """
    names = sorted(dictionaries)
    if len(names) < 2:
        return {}
    short = F.octet_length("text") <= MAX_DOC_BYTES
    rows = docs.where(F.col("lang").isin(names) & (F.length("text") > 0) & ~F.coalesce(held_out(F.col("doc_id")), F.lit(True)))
    counts = rows.groupBy("lang").agg(F.count_if(short).alias("s"), F.count_if(~short).alias("l")).collect()
    used = F.lit(False)
    if own := {r["lang"]: r["s"] for r in counts if r["s"]}:
        used = used | (short & (_draw() < _share(own, max_docs)))
    for want in sorted(set(longer.values())) if (longer := getattr(dictionaries, "longer", {})) else []:
        if own := {r["lang"]: r["l"] for r in counts if r["l"] and longer.get(r["lang"]) == want}:
            used = used | (~short & F.coalesce(_draw() < _share(own, want), F.lit(False)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded, packers = -1, []
        for b in batches:
            raws = [(lang, raw) for lang, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if (raw := normalised(t)).strip()]
            packed = np.zeros((len(raws), len(names)), np.int32)
            for lo in range(0, len(names), BLOCK):
                if loaded != lo:
                    loaded, packers = lo, [packer(dictionaries[x]) for x in names[lo : lo + BLOCK]]
                for i, (_, raw) in enumerate(raws):
                    packed[i, lo : lo + len(packers)] = [len(p.compress(raw)) for p in packers]
            found = [(len(raw).bit_length(), int(np.subtract(*np.partition(row, 1)[1::-1]))) for (lang, raw), row in zip(raws, packed, strict=True) if names[int(row.argmin())] == lang]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int32()) for i in (0, 1)], names=["bits", "margin"])

    tune(docs.sparkSession)
    margins = rows.where(~F.coalesce(used, F.lit(False))).select("lang", "text").mapInArrow(lean(run), "bits int, margin int").groupBy("bits", "margin").agg(F.count(F.lit(1)).alias("n"))
    # What is ordered has a row for each margin of a class; one row of each class comes back.
    upto = margins.withColumn("upto", F.sum("n").over(Window.partitionBy("bits").orderBy("margin"))).withColumn("all", F.sum("n").over(Window.partitionBy("bits")))
    least = upto.where((F.col("all") >= LEAST_CLASS) & (F.col("upto") > F.floor(F.col("all") * PER_MILLE / 1000))).groupBy("bits").agg(F.min("margin").alias("least"))
    return {r["bits"]: max(1, r["least"]) for r in least.collect()}


def packer(dictionary: bytes):
    import zstandard as z

    how = z.ZstdCompressionParameters.from_level(LEVEL, min_match=MIN_MATCH, strategy=z.STRATEGY_BTOPT, write_content_size=False, write_dict_id=False)
    return z.ZstdCompressor(dict_data=z.ZstdCompressionDict(dictionary, dict_type=z.DICT_TYPE_RAWCONTENT), compression_params=how)


def _filled(longer: list[bytes], short: list[bytes]) -> bytes:
    """A dictionary of all short texts and, before them, equal pieces of the longer ones, as long as it takes to fill it."""
    room, piece = DICT_BYTES - len(b"\n".join(short)), MAX_DOC_BYTES
    while piece < DICT_BYTES and sum(len(t[:piece]) for t in longer) < room:
        piece *= 2
    return b"\n".join([*(t[:piece] for t in longer), *short])[-DICT_BYTES:]


def classify(docs: DataFrame, dictionaries: dict[str, bytes], text: str = "text", margins: dict[int, int] | None = None) -> DataFrame:
    """All columns of docs, with lang_pred, score and rejected (which replace columns of these names).

    Null texts and texts without a letter are `und`, score 0 and rejected, as is every text when no language was learned. The
    language whose dictionary leaves the fewest bytes is predicted, of equal ones the first by name. rejected: the next size
    is less than the least margin of the text's length larger (margins as from `calibrate`; one byte where they say nothing).
    The score is the winner's weight when each language weighs half as much for every byte that its dictionary needs more.
    """
    names = sorted(dictionaries)
    keep = [c for c in docs.columns if c not in ("lang_pred", "score", "rejected")]
    at, least = keep.index(text), margins or {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded, packers = -1, []
        for b in batches:
            texts = [v.as_py() or "" for v in b.column(at)]
            raws = [normalised(t) if has_letter(t) else b"" for t in texts]
            packed = np.zeros((len(raws), len(names)), np.int32)
            for lo in range(0, len(names), BLOCK):
                if loaded != lo:
                    loaded, packers = lo, [packer(dictionaries[x]) for x in names[lo : lo + BLOCK]]
                for i, raw in enumerate(raws):
                    if raw:
                        packed[i, lo : lo + len(packers)] = [len(p.compress(raw)) for p in packers]
            preds, scores, rejected = [], [], []
            for raw, row in zip(raws, packed, strict=True):
                pred, score, narrow = UNDETERMINED, 0.0, True
                if names and raw:
                    sizes = row.tolist()
                    best = min(sizes)
                    pred, score = names[sizes.index(best)], 1 / sum(2.0 ** max(best - n, -60) for n in sizes)
                    narrow = len(sizes) > 1 and sorted(sizes)[1] - best < least.get(len(raw).bit_length(), 1)
                preds.append(pred)
                scores.append(score)
                rejected.append(narrow)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(preds, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], names=[*keep, "lang_pred", "score", "rejected"])

    tune(docs.sparkSession)
    only = docs.select(*(F.col(f"`{c}`") for c in keep))
    return only.mapInArrow(lean(run), plus(only.schema, "lang_pred string, score double, rejected boolean"))


def identify(docs: DataFrame, max_docs: int = MAX_DOCS_PER_LANG) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected for every row of docs; a null doc_id counts as not held out.

    Repeated rows count each; other columns of docs are left out, an empty table gives no rows.
    """
    learned = learn(docs, max_docs)
    found = classify(docs.select("doc_id", "text"), learned, margins=calibrate(docs, learned, max_docs))
    return found.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")
