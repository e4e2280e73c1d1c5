"""Words and word hashes of whole texts, for use inside tasks over Arrow batches.

Everything works on the UTF-8 bytes of a piece of a batch with numpy; memory follows the largest
text or ``PIECE`` bytes, whichever is more, never the partition.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once.
PIECE = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BASE = 0x9E3779B97F4A7C15


class Texts(NamedTuple):
    """Some rows of a batch: their bytes one after the other, and where each begins (one more than rows)."""

    first_row: int
    data: np.ndarray
    offsets: np.ndarray


class Words(NamedTuple):
    """Byte ranges of the words, and the number of the first word of each text (one more than texts)."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray


def pieces(column: pa.Array) -> Iterator[Texts]:
    """The texts of a column, nulls as empty, in pieces of about ``PIECE`` bytes; a text is never cut."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return
    _, where, raw = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + PIECE, side="right")) - 1)
        yield Texts(row, data[offsets[row] : offsets[last]], offsets[row : last + 1] - offsets[row])
        row = last


def find_words(texts: Texts) -> Words:
    """Runs of bytes other than space and 09 to 0D; a word ends with its text."""
    inside = ~SPACE[texts.data]
    begins, closes = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    edges = texts.offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(inside))]
    begins[edges] = inside[edges]
    closes[edges - 1] = inside[edges - 1]
    start = np.flatnonzero(begins)
    return Words(start, np.flatnonzero(closes) + 1, np.searchsorted(start, texts.offsets))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def range_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range, none of which is empty."""
    out = np.empty(len(start), np.uint64)
    length = end - start
    powers = np.full(int(length.max(initial=1)), BASE, np.uint64)
    powers[0] = 1
    powers = np.cumprod(powers, dtype=np.uint64)
    total = np.cumsum(length)
    row = 0
    while row < len(start):  # ranges of about PIECE bytes at once
        last = max(row + 1, int(np.searchsorted(total, (total[row - 1] if row else 0) + PIECE, side="right")))
        size, zero = length[row:last], total[row] - length[row]
        at = total[row:last] - size - zero  # where each range begins among the taken bytes
        within = np.arange(int(size.sum())) - np.repeat(at, size)
        taken = data[np.repeat(start[row:last], size) + within].astype(np.uint64)
        out[row:last] = np.add.reduceat((taken + np.uint64(1)) * powers[within], at)
        row = last
    return mix(out + length.astype(np.uint64))


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` words; with fewer words, one of them all; none without words."""
    if not len(words):
        return words
    size = min(size, len(words))
    n = len(words) - size + 1
    h = words[:n]
    for k in range(1, size):
        h = mix(h * np.uint64(BASE) + words[k : k + n])
    return mix(h + np.uint64(size))
