"""Secret scans: three fixed forms, and whatever else a conditional random field takes for a credential.

Positions are code points, ends exclusive. Every token of every text is scored by lookup, plain words by a bound that holds
for all words of their size; then chains are scored in full and decoded around the tokens where a secret may begin, go on
or end, which finds what decoding whole texts would find (`crf.Field.reach` says why). The field is learned once, on the
driver, and broadcast.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import crf
from .scratch import lean, plus, tune
from .wordhash import LOWER, SPACED, text_chunks, word_bounds, word_hashes, words

# The three forms and their least lengths; letters in front of an assignment count in either case.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]{24,}")
LEAST_VALUE, LEAST_ACCESS = 6, 20
_NAMES = ("password", "passwd", "secret", "token", "api_key", "apikey")
MODEL = "model"
MASK = "[SECRET]"
#: Bytes of texts whose tokens are scored at once.
TEXT_BYTES = 1 << 18
SPANS = "array<struct<kind:string,start:int,end:int>>"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's rank, end) of the fixed forms. HEX can ask for 24 at once, as runs are maximal either way."""
    out, low = [], text.lower()
    if any(n in low for n in _NAMES):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def _windows(n: int, lively: np.ndarray, reach: int) -> list[range]:
    """Token ranges within reach of the lively tokens, merged."""
    out: list[range] = []
    for i in lively:
        lo, hi = max(0, int(i) - reach), min(n, int(i) + reach + 1)
        if out and lo <= out[-1].stop:
            out[-1] = range(out[-1].start, hi)
        else:
            out.append(range(lo, hi))
    return out


class _Tokens:
    """The tokens of one text, decoded when asked for."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        self.data, self.starts, self.ends = data, starts, ends

    def __len__(self) -> int:
        return len(self.starts)

    def __getitem__(self, i: int) -> str:
        return self.data[self.starts[i] : self.ends[i]].tobytes().decode("utf-8", "replace")


def decode(tokens: Sequence[str], bounds: np.ndarray, about: str, field: crf.Field) -> list[tuple[int, list[int]]]:
    """(first token, tags) of stretches of a text; all its other tokens are O. bounds: scores of which B's and I's may be too
    high against O's."""
    m, reach = field.reach()
    inside = (field.move - field.move[crf.O, crf.O])[1:, 1:].max()
    lively = np.flatnonzero(bounds[:, 1:].max(1) - bounds[:, 0] + inside > -m)
    return [(span.start, field.decode(field.scores(tokens, about, span), span.stop < len(tokens))) for span in _windows(len(tokens), lively, reach)]


def model_spans(tokens: Sequence[str], at: np.ndarray, bounds: np.ndarray, about: str, field: crf.Field) -> list[tuple[int, int]]:
    """Spans of the decoded secrets, without the quotes and marks around them; at: code point of each token's start."""
    out = []
    for start, tags in decode(tokens, bounds, about, field):
        i = 0
        while i < len(tags):
            if tags[i] == crf.O:
                i += 1
                continue
            j = i + 1
            while j < len(tags) and tags[j] == crf.I:
                j += 1
            first, last = tokens[start + i], tokens[start + j - 1]
            skip = len(first) - len(first.lstrip(crf._WRAP))
            inner = first.rstrip(crf._WRAP)
            if "=" in inner[:-1].rstrip("="):
                skip = inner[:-1].rstrip("=").rindex("=") + 1
                skip += len(first[skip:]) - len(first[skip:].lstrip(crf._WRAP))
            lo, hi = int(at[start + i]) + skip, int(at[start + j - 1]) + len(last.rstrip(crf._WRAP))
            if hi > lo:
                out.append((lo, hi))
            i = j
    return out


# Byte classes: ASCII letters of both cases, bytes beyond ASCII, and marks that may end a plain word.
_LOW, _UP, _FAR, _MARK = (np.zeros(256, bool) for _ in range(4))
_LOW[97:123] = _UP[65:91] = _FAR[128:] = True
_MARK[list(b".,;!")] = True
_TELLING = re.compile(b"|".join(k.encode() for k in crf.KEYWORDS))


def _bounds(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, row: np.ndarray, tables: crf.Tables, about: list[str]) -> np.ndarray:
    """Scores of all tokens of a chunk. Plain words, letters with at most some marks behind them and no keywords, get the bounds
    of their size; every other distinct token is looked at once."""
    count = lambda flag: (c := np.concatenate(([0], np.cumsum(flag))))[ends] - c[starts]
    low, up, far, mark = (count(x[data]) for x in (_LOW, _UP, _FAR, _MARK))
    letter = _LOW[data] | _UP[data] | _FAR[data]
    inner = np.zeros(len(data), bool)
    inner[:-1] = _MARK[data[:-1]] & letter[1:]
    case = (up == 0) | ((up == 1) & _UP[data[starts]]) | ((up == low + up) & (far == 0))
    plain = (low + up + far + mark == ends - starts) & (low + up + far > 0) & (count(inner) == 0) & (case | (far > 0))
    small = LOWER[data]
    for found in _TELLING.finditer(small.tobytes()):
        plain[np.searchsorted(starts, found.start(), side="right") - 1] = False
    pem = np.concatenate([word_hashes(w, np.array([0]), np.array([len(w)])) for w in (np.frombuffer(x.encode(), np.uint8) for x in crf.PEM_WORDS)])
    hashes = word_hashes(small, starts, ends)
    plain &= ~np.isin(hashes, pem)
    points = count(_LOW[data] | _UP[data] | (data >= 0xC0))
    info = tables.plain[(far > 0).astype(int), np.searchsorted(crf.SIZES[:-1], points)]
    rest = np.flatnonzero(~plain)
    if len(rest):
        _, example, back = np.unique(word_hashes(data, starts[rest], ends[rest]), return_index=True, return_inverse=True)
        tokens = _Tokens(data, starts[rest], ends[rest])
        info[rest] = np.array([tables.token(tokens[i]) for i in example.tolist()])[back]
    return tables.scores(info, row, np.array([tables.about[a] for a in about])[row])


def batch_spans(texts: pa.Array, tables: crf.Tables) -> list[list[dict]]:
    out: list[list[dict]] = []
    names = (*KINDS, MODEL)
    for lo, hi, data, off in text_chunks(texts, TEXT_BYTES):
        starts, ends, row = words(data, off, SPACED)
        bounds = word_bounds(row, hi - lo)
        lead = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
        digit = np.concatenate(([0], np.cumsum((data >= 48) & (data < 58))))
        figures = np.concatenate(([0], np.cumsum(digit[ends] > digit[starts])))
        about = [crf.about_text(int(z - a), int(figures[z] - figures[a])) for a, z in zip(bounds[:-1], bounds[1:])]
        scores = _bounds(data, starts, ends, row, tables, about) if len(starts) else np.zeros((0, 3))
        for k in range(hi - lo):
            a, z = bounds[k], bounds[k + 1]
            spans = base_spans(data[off[k] : off[k + 1]].tobytes().decode("utf-8", "replace"))
            found = model_spans(_Tokens(data, starts[a:z], ends[a:z]), lead[starts[a:z]] - lead[off[k]], scores[a:z], about[k], tables.field) if z > a else []
            spans = sorted(spans + _apart(found, spans))
            out.append([{"kind": names[r], "start": s, "end": e} for s, r, e in spans])
    return out


def _apart(found: list[tuple[int, int]], base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The spans found, by start, that overlap no base span (by start): among those that begin before a span ends, the one
    that ends last must end before it begins."""
    out, i, reach = [], 0, 0
    for s, e in found:
        while i < len(base) and base[i][0] < e:
            reach = max(reach, base[i][2])
            i += 1
        if reach <= s:
            out.append((s, 3, e))
    return out


def find_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns of docs with `secrets` (replacing a column of that name), the spans by start, then kind.

    Fixed forms may overlap each other; the model's spans (kind `model`) overlap no fixed form. Null and empty texts have
    none.
    """
    keep = [c for c in docs.columns if c != "secrets"]
    at = keep.index(text)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = learned.value.tables()
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(batch_spans(b.column(at), tables), kind)], names=[*keep, "secrets"])

    tune(docs.sparkSession)
    learned = docs.sparkSession.sparkContext.broadcast(crf.trained())  # some thousand weights
    only = docs.select(*(F.col(f"`{c}`") for c in keep))
    return only.mapInArrow(lean(run), plus(only.schema, f"secrets {SPANS}"))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the fixed forms, the hash of their list, and the list of all spans, one row per row of docs.

    Null and empty texts have none, repeated rows count each; other columns of docs are left out.
    """
    spans = F.col("secrets")
    base = F.filter(spans, lambda s: s["kind"] != MODEL)

    def count(kind: str) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return find_secrets(docs.select("doc_id", "text")).select("doc_id", *map(count, KINDS), F.sha2(listed(base), 256).alias("base_sha256"), listed(spans).alias("spans"))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with every secret in text replaced by MASK (overlapping spans by one), all other text and columns as they were."""
    spans = F.col("secrets")
    # Walk over the spans: pieces of text in front of each, and where the last span ended.
    walk = F.aggregate(
        spans, F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda a, s: F.when(s["start"] >= a["at"], F.struct(F.concat(a["out"], F.substring(F.col(text), a["at"] + 1, s["start"] - a["at"]), F.lit(MASK)).alias("out"), s["end"].alias("at")))
        .otherwise(F.struct(a["out"].alias("out"), F.greatest(a["at"], s["end"]).alias("at"))),
    )
    masked = F.concat(walk["out"], F.substring(F.col(text), walk["at"] + 1, F.length(F.col(text))))
    found = find_secrets(docs, text).withColumn(text, F.when(F.size(spans) > 0, masked).otherwise(F.col(text)))
    return found.select(*(F.col(f"`{c}`") for c in docs.columns))
