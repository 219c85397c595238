"""Words and word windows of many texts at once, as numpy arrays over Arrow's UTF-8 buffers.

A text is split on bytes, which is safe for the separators used here: they are ASCII. Each word gets a 64-bit
polynomial hash, each run of k words a 64-bit hash of its words' hashes. Nulls count as empty texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

U = np.uint64
CHUNK_BYTES, POWERS, LONG_WORD = 1 << 20, 1 << 18, 512
_BASE, _STEP = 0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93 | 1

#: Bytes inside words: all but space and \t..\r; or ASCII letters, digits and everything beyond ASCII.
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _pow(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n, kept between calls."""
    got = _powers.get(base)
    if got is None or len(got[0]) < n:
        size = -(-(n - 1) // POWERS) * POWERS + 1
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            a = np.full(size, b, U)
            a[0] = 1
            both.append(np.multiply.accumulate(a))
        got = _powers[base] = (both[0], both[1])
    return got


def forget_powers() -> None:
    """The tables are made anew when they are needed."""
    _powers.clear()


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def text_chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive rows with about limit bytes; a longer text comes alone and whole."""
    arr = pc.fill_null(texts.cast(pa.large_string()), "")
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if not len(arr):
        return
    _, offsets, data = arr.buffers()
    off = np.frombuffer(offsets, np.int64)[arr.offset : arr.offset + len(arr) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(arr):
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, side="right")) - 1)
        yield lo, hi, raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def words(data: np.ndarray, off: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start byte, end byte, row) of every word."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    isin = inside[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    before = np.concatenate(([False], isin[:-1])) & ~edge[:-1]
    after = np.concatenate((isin[1:], [False])) & ~edge[1:]
    starts = np.flatnonzero(isin & ~before)
    return starts, np.flatnonzero(isin & ~after) + 1, np.searchsorted(off, starts, side="right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomials modulo 2**64 collide on some texts of a kilobyte and more that are made for it: long words get another hash."""
    up, down = _pow(_BASE, len(data) + 1)
    total = np.zeros(len(data) + 1, U)
    np.cumsum((data.astype(U) + U(1)) * up[: len(data)], out=total[1:])
    out = mix((total[ends] - total[starts]) * down[starts])
    for i in np.flatnonzero(ends - starts > LONG_WORD):
        out[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes())
    return out


def run_hashes(h: np.ndarray, first: np.ndarray, last: np.ndarray, step: int = _STEP) -> np.ndarray:
    """Hash of the words first..last-1 for each pair; another step gives an independent one."""
    up, down = _pow(step, len(h) + 1)
    total = np.zeros(len(h) + 1, U)
    np.cumsum(h * up[: len(h)], out=total[1:])
    return mix((total[last] - total[first]) * down[first] + (last - first).astype(U) * U(0xA24BAED4963EE407))


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k values from each position on; shorter at the end."""
    at = np.arange(len(h))
    return run_hashes(h, at, np.minimum(at + k, len(h)))


def window_hashes(h: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of every run of k words within one row."""
    if len(h) < k:
        return np.zeros(0, np.int64), np.zeros(0, U)
    at = np.flatnonzero(row[k - 1 :] == row[: len(row) - k + 1])
    return at, run_hashes(h, at, at + k)


def word_bounds(row: np.ndarray, n_rows: int) -> np.ndarray:
    """First word of each row, and the number of words at the end."""
    return np.searchsorted(row, np.arange(n_rows + 1))
