"""How values are shown: numbers, durations, sizes, colours of scores, progress; and small conversions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Upper ends of score bands and their colours; the stages of an analysis, in order.
SCORE_COLOURS = ((20, "#16a34a"), (45, "#0284c7"), (70, "#d97706"))
WORST_COLOUR = "#dc2626"
STAGES = ("normalize", "segment", "prescan", "map", "verify", "reduce")
LEAST_SELECTION, LEAST_ANALYSED, LEAST_PAGE, MOST_INGEST = 150, 80, 50, 300_000
SELECTION_CHARS = 300


def number(n: Column) -> Column:
    """Whole numbers with thousands separators; null is 0."""
    return F.format_number(F.coalesce(n, F.lit(0)), 0)


def _fixed(x: Column, places: int) -> Column:
    return F.format_string(f"%.{places}f", x.cast("double"))


def duration(ms: Column) -> Column:
    n = ms.cast("double")
    short, seconds = F.round(n).cast("long").cast("string"), _fixed(n / 1000, 1)
    minutes = F.concat(F.floor(n / 60_000).cast("string"), F.lit(" 分 "), F.round((n % 60_000) / 1000).cast("long").cast("string"), F.lit(" 秒"))
    return F.when(n.isNull() | (n <= 0), F.lit("—")).when(n < 1000, F.concat(short, F.lit(" 毫秒"))).when(n < 60_000, F.concat(seconds, F.lit(" 秒"))).otherwise(minutes)


def size(n: Column) -> Column:
    kilo, mega = _fixed(n / 1024, 1), _fixed(n / 1024 / 1024, 2)
    return F.when(n.isNull() | (n <= 0), F.lit("0 B")).when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1024 * 1024, F.concat(kilo, F.lit(" KB"))).otherwise(F.concat(mega, F.lit(" MB")))


def moment(at: Column) -> Column:
    return F.coalesce(F.date_format(at, "yyyy/MM/dd HH:mm"), F.lit("—"))


def score_colour(score: Column) -> Column:
    s, out = F.coalesce(score, F.lit(0)), F.lit(WORST_COLOUR)
    for top, colour in reversed(SCORE_COLOURS):
        out = F.when(s <= top, F.lit(colour)).otherwise(out)
    return out


def progress(stage: Column, done: Column, total: Column) -> Column:
    """Per cent of an analysis: stages share 80, the mapping one grows with its batches, at most 96; null for unknown stages."""
    at = F.array_position(F.array(*map(F.lit, STAGES)), stage) - 1
    part = F.when((stage == "map") & (total > 0), F.least(done / total, F.lit(1.0))).otherwise(F.lit(0.0))
    return F.when(at >= 0, F.least(F.lit(96.0), (at + F.coalesce(part, F.lit(0.0))) / len(STAGES) * 80))


def as_array(value: Column) -> Column:
    """A single value as an array; null as an empty one."""
    return F.when(value.isNull(), F.slice(F.array(value), 1, 0)).otherwise(F.array(value))


def stable_id(*parts: Column) -> Column:
    """An identifier in UUID form that is the same in every run: from the SHA-256 of the parts."""
    h = F.sha2(F.concat_ws("\x1f", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256)
    return F.regexp_replace(F.substring(h, 1, 32), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def slim(text: Column, most: int) -> tuple[Column, Column]:
    """(text of at most so many characters, whether it was cut)."""
    t = F.coalesce(text, F.lit(""))
    return F.substring(t, 1, most), F.length(t) > most


def analysable(text: Column) -> Column:
    return F.length(F.trim(F.coalesce(text, F.lit("")))) >= LEAST_ANALYSED


def ingest_text(selection: Column, page: Column) -> Column:
    """What a page sends: its selection if that is long, else the page's text; null where that is too short, cut where too long."""
    s, p = F.trim(F.coalesce(selection, F.lit(""))), F.trim(F.coalesce(page, F.lit("")))
    chosen = F.when(F.length(s) > SELECTION_CHARS, s).otherwise(p)
    return F.when(F.length(chosen) >= LEAST_PAGE, F.substring(chosen, 1, MOST_INGEST))
