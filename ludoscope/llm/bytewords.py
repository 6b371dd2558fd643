"""Words of whole texts, found and hashed in numpy on UTF-8 bytes.

Every separator class used here is ASCII, so classes of bytes describe classes of characters exactly,
and a multi-byte character never holds a separator. Only A-Z are lower-cased.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

PIECE_BYTES = 2 << 20  # rows are worked on in pieces of this size, or alone if they are longer
CHUNK_BYTES = 1 << 20  # words are hashed in chunks of this size, cut between words

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_codes = np.arange(256)
SPACE = (_codes == 0x20) | ((_codes >= 0x09) & (_codes <= 0x0D))
#: Separators of the two kinds of words, for lower-cased bytes.
BY_SPACE = SPACE
BY_SYMBOL = (_codes <= 0x2F) | ((_codes >= 0x3A) & (_codes <= 0x60)) | ((_codes >= 0x7B) & (_codes <= 0x7F))

_BASE = 0x9E3779B97F4A7C15 | 1
_LETTER = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers_up_to(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over all 64 output bits (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """Words of a piece: byte ranges, 64-bit hashes, and for each text the range of its words."""

    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    bounds: np.ndarray  # of text i: bounds[i] to bounds[i + 1]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column and the n + 1 offsets of its texts; a null is an empty text."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data or b"", np.uint8), offsets


def pieces(column: pa.Array, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges (from, to, bytes, offsets) of whole texts, each at most ``limit`` bytes or one row."""
    data, offsets = utf8(column)
    n, i = len(column), 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> Words:
    """Words of the texts in ``data``; no word reaches over the end of its text."""
    low = LOWER[data]
    inside = ~separators[low]
    if not len(data):
        none = np.zeros(0, np.int64)
        return Words(none, none, np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64))
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    firsts = offsets[:-1][offsets[:-1] < offsets[1:]]
    before[firsts] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    after[offsets[1:][offsets[:-1] < offsets[1:]] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return Words(starts, ends, range_hashes(low, starts, ends), np.searchsorted(starts, offsets))


def range_hashes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges whose starts and ends both ascend."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + CHUNK_BYTES, "right")))
        at, to = starts[i], ends[j - 1]
        power, inverse = _powers_up_to(to - at)
        sums = np.zeros(to - at + 1, np.uint64)
        np.cumsum(_LETTER[low[at:to]] * power[: to - at], out=sums[1:])
        out[i:j] = (sums[ends[i:j] - at] - sums[starts[i:j] - at]) * inverse[starts[i:j] - at]
        i = j
    return mix(out)


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words of one text; of a shorter text, of the whole sequence."""
    if not len(hashes):
        return hashes
    size = min(size, len(hashes))
    total = np.full(len(hashes) - size + 1, size, np.uint64)
    for k in range(size):
        total = total * np.uint64(0xD1342543DE82EF95) + hashes[k : len(hashes) - size + 1 + k]
        total ^= total >> np.uint64(29)
    return mix(total)
