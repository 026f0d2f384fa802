"""Vectorised work on the bytes of Arrow text columns: words, hashes of spans, and slices of bounded memory."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once; a longer text is a slice of its own.
SLICE_BYTES = 1 << 19

#: False for the white space that separates words: space and 0x09 to 0x0D.
WORD_BYTE = np.ones(256, bool)
WORD_BYTE[[9, 10, 11, 12, 13, 32]] = False
#: A-Z to a-z, other bytes as they are.
LOWER_BYTE = np.arange(256, dtype=np.uint8)
LOWER_BYTE[65:91] += 32


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary array; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, places, data = column.buffers()
    offsets = np.frombuffer(places, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES, texts: int = 1 << 16) -> Iterator[tuple[int, int]]:
    """Ranges of texts [lo, hi) of at most so many bytes, or of one text, and of at most so many texts."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        hi = min(hi, n, lo + texts)
        yield lo, hi
        lo = hi


def each_slice(column: pa.Array, most: int = SLICE_BYTES, texts: int = 1 << 16) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(lo, hi, bytes, offsets) of each slice of a column."""
    data, offsets = text_bytes(column)
    for lo, hi in slices(offsets, most, texts):
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): places of the words, and for each text its first word (one more entry at the end)."""
    inside = WORD_BYTE[data]
    before, after = np.empty_like(inside), np.empty_like(inside)
    before[1:], before[:1] = inside[:-1], False
    after[:-1], after[-1:] = inside[1:], False
    n = len(data)
    edges = offsets[(offsets > 0) & (offsets < n)]
    before[edges] = False
    after[edges - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


class SpanHash:
    """64-bit hash of any span of bytes from two prefix sums: a random number for each byte value, times powers of an odd base."""

    def __init__(self, seed: int) -> None:
        rng = np.random.default_rng(seed)
        self.table = rng.integers(1, 2**64 - 1, 256, np.uint64, endpoint=True)
        self.base = int(rng.integers(2**62, 2**63)) * 2 + 1
        self._size = 0

    def _powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self._size:
            self._size = max(n, 1 << 16)
            out = []
            for b in (self.base, pow(self.base, -1, 1 << 64)):
                p = np.full(self._size, b % (1 << 64), np.uint64)
                p[0] = 1
                out.append(np.multiply.accumulate(p))
            self._up, self._down = out
        return self._up, self._down

    def prefix(self, data: np.ndarray) -> np.ndarray:
        _, down = self._powers(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.table[data] * down[: len(data)], out=sums[1:])
        return sums

    def spans(self, prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        up, _ = self._powers(len(prefix))
        return (prefix[ends] - prefix[starts]) * up[starts]

    def windows(self, prefix: np.ndarray, length: int) -> np.ndarray:
        """Hash of each run of ``length`` bytes."""
        n = len(prefix) - length
        if n <= 0:
            return np.zeros(0, np.uint64)
        up, _ = self._powers(len(prefix))
        return (prefix[length:] - prefix[:-length]) * up[:n]


@lru_cache(maxsize=8)
def span_hash(seed: int) -> SpanHash:
    """One for each worker and seed."""
    return SpanHash(seed)


def sorted_distinct(group: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (group, value) pairs in order; group is ascending already."""
    order = np.lexsort((values, group))
    g, v = group[order], values[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (v[1:] != v[:-1])
    return g[new], v[new]
