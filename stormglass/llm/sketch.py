"""Count-min sketches that partitions build and a shuffle merges, reduced to "counted so often".

A sketch has ``depth`` rows of 2**log2_cells counters.  Every partition counts its own
texts' keys and sends its non-zero cells, packed by shard of SHARD_CELLS cells; the
partitions' counters of one shard are added in one task.  All that is asked of the sum is
whether a cell was counted at least once, or twice, so one bit a cell is broadcast: 2**log2_cells *
depth / 8 bytes, whatever the corpus.  Estimates never fall below the true count.  Over a
corpus with many more keys than cells most estimates are too high; results do not
depend on that, only the work that the filter saves does.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import mix, slices

SHARD_BITS = 16
#: Keys that a task holds before it sends its counters on.
HELD_KEYS = 1_000_000
#: Shards, of 64 kB each, that one task adds up.
SHARDS_OF_TASK = 128


@dataclass
class Cells:
    """The merged sketch: which cells were counted often enough."""

    log2_cells: int
    bits: np.ndarray  # depth, bytes

    def maybe(self, keys: np.ndarray) -> np.ndarray:
        """False only for keys that were not counted so often."""
        left = np.arange(len(keys))
        for row, bits in enumerate(self.bits):
            cell = cells_of(keys[left], row, self.log2_cells)
            left = left[(bits[cell >> np.uint64(3)] >> (7 - (cell & np.uint64(7))).astype(np.uint8) & 1).astype(bool)]
        out = np.zeros(len(keys), bool)
        out[left] = True
        return out


def cells_of(keys: np.ndarray, row: int, log2_cells: int) -> np.ndarray:
    return mix(keys, row + 11) >> np.uint64(64 - log2_cells)


def _packed(keys: list[np.ndarray], depth: int, log2_cells: int) -> Iterator[pa.RecordBatch]:
    """Counters of some keys: for each row and shard the cells counted once, and those counted more often."""
    held = np.concatenate([np.zeros(0, np.uint64), *keys])
    for row in range(depth if len(held) else 0):
        cells = np.sort(cells_of(held, row, log2_cells))
        starts = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]])
        often = np.diff(np.append(starts, len(cells))) > 1
        cells = cells[starts]
        shard = (cells >> np.uint64(SHARD_BITS)).astype(np.int64)
        low = (cells & np.uint64(2**SHARD_BITS - 1)).astype(np.uint16)
        names, at = np.unique(shard, return_index=True)
        ends = np.append(at[1:], len(cells))
        once = [low[a:b][~often[a:b]].tobytes() for a, b in zip(at, ends, strict=True)]
        more = [low[a:b][often[a:b]].tobytes() for a, b in zip(at, ends, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(names), row), pa.int32()), pa.array(names, pa.int32()), pa.array(once, pa.binary()), pa.array(more, pa.binary())], names=["row", "shard", "once", "more"])


def _merge(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Adds up the counters of the shards that were dealt to a task; gives a bit for each cell."""
    sums: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        for row, shard, once, more in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            counts = sums.setdefault((row, shard), np.zeros(2**SHARD_BITS, np.uint8))
            at = np.frombuffer(once, np.uint16)
            counts[at] = np.minimum(counts[at] + 1, 2)
            counts[np.frombuffer(more, np.uint16)] = 2
    # One row a task: the driver gets few large values, not many small ones.
    bits = b"".join(np.packbits(c >= least).tobytes() for c in sums.values())
    yield pa.RecordBatch.from_arrays([pa.array([[r for r, _ in sums]], pa.list_(pa.int32())), pa.array([[s for _, s in sums]], pa.list_(pa.int32())), pa.array([bits], pa.binary())], names=["rows", "shards", "bits"])


def count_keys(rows: DataFrame, keys_of: Callable[[], Callable[[object], np.ndarray]], log2_cells: int, depth: int, least: int) -> Cells:
    """Count the keys of the rows of a one-column DataFrame; ``least`` is 1 or 2.

    ``keys_of()`` makes, in each task, the function that gives a value's distinct keys (uint64).
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, held, size = keys_of(), [], 0
        for (values,) in slices(batches):
            for value in values:
                held.append(keys(value))
                size += len(held[-1])
                if size > HELD_KEYS:
                    yield from _packed(held, depth, log2_cells)
                    held, size = [], 0
        yield from _packed(held, depth, log2_cells)

    parts = rows.mapInArrow(count, "row int, shard int, once binary, more binary")
    tasks = max(1, depth * 2 ** (log2_cells - SHARD_BITS) // SHARDS_OF_TASK)
    merged = parts.repartition(tasks, "row", "shard").mapInArrow(lambda batches: _merge(batches, least), "rows array<int>, shards array<int>, bits binary")
    width = 2 ** (SHARD_BITS - 3)
    bits = np.zeros((depth, max(1, 2 ** (log2_cells - SHARD_BITS)) * width), np.uint8)
    for rows_of, shards, packed in merged.collect():
        for row, shard, part in zip(rows_of, shards, np.frombuffer(packed, np.uint8).reshape(-1, width), strict=True):
            bits[row, shard * width : (shard + 1) * width] = part
    return Cells(log2_cells, bits)
