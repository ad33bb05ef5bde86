"""Count-min sketches over 64-bit keys, merged on the executors.

Each task counts its own keys and hands over, for each row of the sketch, only the cells that it has touched, in slices
of the table; the slices are merged by key. The sketch never counts too few, so a key that occurs twice is always found.
What goes to the driver and is broadcast is one bit (or one byte) a cell: its size is set by the width alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from stepweave.llm.shared import give_back
from stepweave.llm.wordhash import mix

DEPTH = 2
#: Cells of a slice; a slice is merged in one task.
SLICE = 1 << 18
_SEEDS = (np.uint64(0x8EBC6AF09C88C6E3), np.uint64(0x589965CC75374CC3))
#: Cells in each row of the bits that mark very frequent keys: more of them fold into these.
HOT_WIDTH = 1 << 22
_PARTIAL = "slice int, cells binary, counts binary"


def width_for(keys: int, least: int = 1 << 20, most: int = 1 << 26) -> int:
    """Cells in each row for so many keys: four a key, as a power of two, between the bounds.

    Above the upper bound (8 MB a row as bits) the sketch fills up: it lets more keys through, and still loses none."""
    return int(min(most, max(least, 1 << int(np.ceil(np.log2(max(1, 4 * keys)))))))


def cells_of(keys: np.ndarray, row: int, width: int) -> np.ndarray:
    return (mix(keys ^ _SEEDS[row]) & np.uint64(width - 1)).astype(np.int64)


class _Partial:
    """Counts of a task, up to 255 a cell."""

    def __init__(self, width: int, depth: int, gather: int = 1 << 20) -> None:
        self.width, self.depth, self.gather = width, depth, gather
        self.held: list[np.ndarray] = []
        self.n = 0

    def add(self, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held.append(keys)
        self.n += len(keys)
        if self.n >= self.gather:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.n:
            return
        keys = np.concatenate(self.held)
        self.held, self.n = [], 0
        for row in range(self.depth):
            cells, counts = np.unique(cells_of(keys, row, self.width), return_counts=True)
            counts = np.minimum(counts, 255).astype(np.uint8)
            per_row = max(1, self.width // SLICE)
            part = cells // SLICE
            cuts = np.searchsorted(part, np.arange(per_row + 1))
            rows, places, numbers = [], [], []
            for i in range(per_row):
                own, n = cells[cuts[i] : cuts[i + 1]] % SLICE, counts[cuts[i] : cuts[i + 1]]
                if not len(own):
                    continue
                rows.append(row * per_row + i)
                if 5 * len(own) < min(SLICE, self.width):
                    places.append(own.astype(np.uint32).tobytes())
                    numbers.append(n.tobytes())
                else:  # a byte for every cell of the slice is less
                    every = np.zeros(min(SLICE, self.width), dtype=np.uint8)
                    every[own] = n
                    places.append(b"")
                    numbers.append(every.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array(places, pa.binary()), pa.array(numbers, pa.binary())], names=["slice", "cells", "counts"])


def _merged(df: DataFrame, keys_of: Callable[[pa.RecordBatch], Iterator[np.ndarray]], width: int, depth: int, out: str, finish) -> DataFrame:
    def count(batches):
        partial = _Partial(width, depth)
        for batch in batches:
            for keys in keys_of(batch):
                yield from partial.add(keys)
        yield from partial.flush()

    def merge(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, cells, counts in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                at = total.get(part)
                if at is None:
                    at = total[part] = np.zeros(min(SLICE, width), dtype=np.uint32)
                counts = np.frombuffer(counts, dtype=np.uint8)
                if cells:
                    at[np.frombuffer(cells, dtype=np.uint32)] += counts
                else:
                    at += counts
        for part, counts in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([finish(counts)], pa.binary())], names=["slice", "cells"])

    return df.mapInArrow(count, _PARTIAL).repartition("slice").mapInArrow(merge, out)


def repeated_cells(df: DataFrame, keys_of, width: int, hot: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """Bits of cells, packed, DEPTH rows one after another: counted twice or more; counted hot times or more, of min(width, HOT_WIDTH) cells a row."""

    size = min(SLICE, width) // 8

    def finish(counts: np.ndarray) -> bytes:
        return pa.compress(np.packbits(counts >= 2).tobytes() + np.packbits(counts >= hot).tobytes(), codec="zstd", asbytes=True)

    per_row, hot_per_row = max(1, width // SLICE), max(1, min(width, HOT_WIDTH) // SLICE)
    found, often = np.zeros(DEPTH * width // 8, dtype=np.uint8), np.zeros(DEPTH * min(width, HOT_WIDTH) // 8, dtype=np.uint8)
    rows = _merged(df, keys_of, width, DEPTH, "slice int, cells binary", finish).toArrow()
    for part, cells in zip(rows.column(0).to_pylist(), rows.column(1), strict=True):
        both = np.frombuffer(pa.decompress(cells.as_buffer(), decompressed_size=2 * size, codec="zstd"), dtype=np.uint8)
        found[part * size : (part + 1) * size] = both[:size]
        at = (part // per_row) * hot_per_row + part % per_row % hot_per_row
        often[at * size : (at + 1) * size] |= both[size:]
    del rows
    give_back()
    return found, often


def levels(df: DataFrame, keys_of, width: int = 1 << 21) -> np.ndarray:
    """A byte a cell: the rounded logarithm of its count. It orders keys from rare to frequent, for all tasks alike."""

    def finish(counts: np.ndarray) -> bytes:
        return np.round(8 * np.log2(counts.astype(np.float64) + 1)).clip(0, 255).astype(np.uint8).tobytes()

    size = min(SLICE, width)
    found = np.zeros(width, dtype=np.uint8)
    for part, cells in _merged(df, keys_of, width, 1, "slice int, cells binary", finish).collect():
        found[part * size : (part + 1) * size] = np.frombuffer(bytes(cells), dtype=np.uint8)
    return found


def test_bits(bits: np.ndarray, keys: np.ndarray, width: int) -> np.ndarray:
    """Whether every row of the sketch has the bit of each key."""
    found = np.ones(len(keys), dtype=bool)
    for row in range(DEPTH):
        at = cells_of(keys, row, width) + row * width
        found &= (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
    return found
