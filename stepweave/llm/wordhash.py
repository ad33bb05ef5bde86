"""Words of whole texts as 64-bit hashes, many documents at a time, straight from an Arrow buffer.

A word's hash is a polynomial in its bytes, modulo 2^64, over a table of fixed random numbers, then mixed with its
length. Words longer than LONG bytes are hashed one by one by xxh3, as a polynomial with an even modulus is weak there.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

#: Bytes of text handled at once; a longer document is handled alone.
CHUNK = 1 << 18
LONG = 256

_BASE = 0x9E3779B97F4A7C15 | 5
_INVERSE = pow(_BASE, -1, 1 << 64)
_TABLE = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER_TABLE = _TABLE.copy()
_LOWER_TABLE[65:91] = _TABLE[97:123]

#: [^\x20\x09-\x0D]
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base^0 ... base^(n-1) modulo 2^64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, CHUNK + 1), base, dtype=np.uint64)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if n <= 4 * CHUNK:
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: each bit of x moves all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def binary_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and their n + 1 offsets; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_string(column.type):
        column = column.cast(pa.binary())
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, dtype=np.int64)
    return (np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)), offsets


@dataclass
class Words:
    """Words of the documents first ... last - 1 of a batch."""

    first: int
    last: int
    seg: np.ndarray  # bytes
    starts: np.ndarray  # of each word in seg
    ends: np.ndarray
    bounds: np.ndarray  # words of document first + d: bounds[d] ... bounds[d + 1] - 1
    lower: bool
    sums: np.ndarray

    def hashes(self) -> np.ndarray:
        return self._hash(self.starts, self.ends)

    def prefix_hashes(self, n: int) -> np.ndarray:
        """Of each word's first n bytes (of all, if fewer)."""
        return self._hash(self.starts, np.minimum(self.starts + n, self.ends))

    def _hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if not len(starts):
            return np.zeros(0, dtype=np.uint64)
        size = (ends - starts).astype(np.uint64)
        h = (self.sums[ends] - self.sums[starts]) * powers(_INVERSE, len(self.seg) + 1)[starts]
        h = mix(h + size * np.uint64(0xD1B54A32D192ED03))
        for i in np.flatnonzero(size > LONG):
            word = self.seg[starts[i] : ends[i]].tobytes()
            h[i] = xxhash.xxh3_64_intdigest(word.lower() if self.lower else word)
        return h

    def per_doc(self) -> np.ndarray:
        """The document, counted from 0, of each word."""
        return np.repeat(np.arange(self.last - self.first), np.diff(self.bounds))


def words_of(data: np.ndarray, offsets: np.ndarray, lower: bool = False, word_bytes: np.ndarray = NOT_SPACE) -> Iterator[Words]:
    """Runs of word_bytes in each document, in chunks of whole documents. lower: A-Z count as a-z."""
    n, first = len(offsets) - 1, 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + CHUNK, side="right")) - 1
        last = min(n, max(last, first + 1))
        seg, off = data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        size = len(seg)
        inside = word_bytes[seg]
        before, after = np.zeros(size, dtype=bool), np.zeros(size, dtype=bool)
        if size:
            before[1:], after[:-1] = inside[:-1], inside[1:]
            edges = off[(off > 0) & (off < size)]
            before[edges], after[edges - 1] = False, False
        starts = np.flatnonzero(inside & ~before)
        ends = np.flatnonzero(inside & ~after) + 1
        sums = np.zeros(size + 1, dtype=np.uint64)
        np.cumsum((_LOWER_TABLE if lower else _TABLE)[seg] * powers(_BASE, size), out=sums[1:])
        yield Words(first, last, seg, starts, ends, np.searchsorted(starts, off), lower, sums)
        first = last


_GRAM = 0xC2B2AE3D27D4EB4F | 5
_GRAM2 = 0x165667B19E3779F9 | 5


def grams(h: np.ndarray, n: int, second: bool = False) -> np.ndarray:
    """A hash of each n consecutive word hashes (len(h) - n + 1 of them), whatever documents they cross.

    second: another hash of the same words, independent of the first."""
    if len(h) < n:
        return np.zeros(0, dtype=np.uint64)
    base = _GRAM2 if second else _GRAM
    if second:
        h = mix(h ^ np.uint64(0xA0761D6478BD642F))
    if n <= 8:
        out = np.zeros(len(h) - n + 1, dtype=np.uint64)
        for i in range(n):
            out = out * np.uint64(base) + h[i : len(h) - n + 1 + i]
        return mix(out)
    sums = np.zeros(len(h) + 1, dtype=np.uint64)
    np.cumsum(h * powers(base, len(h)), out=sums[1:])
    return mix((sums[n:] - sums[:-n]) * powers(pow(base, -1, 1 << 64), len(h) + 1)[: len(h) - n + 1])
