"""Rows whose keys another table may hold, so that a join moves these and not the whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of 64 bits that are broadcast at most, and keys that share one below that.
WORDS, KEYS = 1 << 20, 4


def _spot(on: list[str], words: int) -> tuple[Column, Column]:
    """A key's word, and the three bits that it sets there."""
    h = f"xxhash64({', '.join(f'`{c}`' for c in on)})"
    bits = (f"shiftleft(1L, cast(shiftrightunsigned({h}, {s}) & 63L AS int))" for s in (0, 6, 12))
    return F.expr(f"pmod(shiftrightunsigned({h}, 18), {words}L)"), F.expr(" | ".join(bits))


def _filter(keys: DataFrame, on: list[str]) -> tuple[DataFrame, Column]:
    words = min(WORDS, keys.count() // KEYS + 1)
    at, mask = _spot(on, words)
    bits = keys.select(at.alias("_at"), mask.alias("_mask")).groupBy("_at").agg(F.bit_or("_mask").alias("_bits"))
    return F.broadcast(bits), (at == F.col("_at")) & (F.col("_bits").bitwiseAND(mask) == mask)  # at most WORDS rows


def narrowed(table: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """All rows of table whose columns `on` are in keys, and about one in fifty of the others: a Bloom filter, for a join to follow.

    keys is read twice, so it should be written somewhere; its columns have table's types. Very many keys let more rows pass, never fewer.
    """
    bits, held = _filter(keys, on)
    return table.join(bits, held, "left_semi")


def parted(table: DataFrame, keys: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows that `narrowed` lets through, all others)."""
    bits, held = _filter(keys, on)
    return table.join(bits, held, "left_semi"), table.join(bits, held, "left_anti")
