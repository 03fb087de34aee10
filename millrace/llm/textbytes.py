"""Whole texts as arrays of bytes, words and hashes, for use inside Arrow tasks.

Hashes are 64 bits wide: a polynomial over the bytes of a word, mixed. All functions work
on many texts at once and keep the texts apart.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
#: Bytes of text handled at a time; a longer text is handled alone.
BLOCK = 1 << 21

_powers: dict[str, np.ndarray] = {}


def _power(base: np.uint64, size: int, name: str) -> np.ndarray:
    known = _powers.get(name)
    if known is None or len(known) < size:
        known = np.empty(max(size, BLOCK + 1), np.uint64)
        known[0] = 1
        known[1:] = base
        _powers[name] = known = np.cumprod(known, dtype=np.uint64)
    return known[:size]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of each value over all bits (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums from which ``spans`` reads the hash of any stretch of ``data``."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power(_BASE, len(data), "base"), out=sums[1:])
    return sums


def spans(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Mixed hashes of the stretches [start, end): equal bytes, equal hash, wherever they are."""
    inverse = _power(_INVERSE, len(sums), "inverse")
    return mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64) * _BASE)


def blocks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a column of texts into stretches of some 2 MB: (first row, end row, bytes, offsets).

    NULL counts as empty.
    """
    if not pa.types.is_binary(column.type) and not pa.types.is_large_binary(column.type):
        column = column.cast(pa.large_binary()) if pa.types.is_large_string(column.type) else column.cast(pa.binary())
    column = column.fill_null(b"")
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    _, at, raw = column.buffers()
    if not len(column):
        return
    offsets = np.frombuffer(at, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.empty(0, np.uint8)
    row = 0
    while row < len(column):
        end = int(np.searchsorted(offsets, offsets[row] + BLOCK, side="right")) - 1
        end = min(max(end, row + 1), len(column))
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


@dataclass
class Words:
    """Words of several texts: where each starts and ends, and the text it is in."""

    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    first: np.ndarray  # index of each text's first word; one entry more than texts


def words(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Runs of bytes other than blank and tab to carriage return; none crosses a text's end."""
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    texts = len(offsets) - 1
    if not inside.any():
        none = np.empty(0, np.int64)
        return Words(none, none, none, np.zeros(texts + 1, np.int64))
    fresh = np.zeros(len(data) + 1, bool)
    fresh[offsets] = True
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | fresh[1:-1]
    ends[:-1] &= ~inside[1:] | fresh[1:-1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    first = np.searchsorted(start, offsets, side="left")
    return Words(start, end, np.repeat(np.arange(texts), np.diff(first)), first)


def word_hashes(data: np.ndarray, w: Words) -> np.ndarray:
    return spans(prefix_sums(data), w.start, w.end)


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z as a-z, all else as it is."""
    return np.where((data >= 65) & (data <= 90), data | 32, data).astype(np.uint8)


def shingles(hashes: np.ndarray, w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of every run of ``size`` words; a text of fewer words is one run."""
    n = len(hashes)
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    index = np.arange(n)
    reach = np.minimum(index + size, w.first[w.text + 1])
    whole = (reach - index == size) | (index == w.first[w.text])
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * _power(_BASE, n, "base"), out=sums[1:])
    at = index[whole]
    return spans(sums, at, reach[whole]), w.text[whole]
