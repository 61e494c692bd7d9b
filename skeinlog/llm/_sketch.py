"""A counting sketch of 64-bit hashes: one row of cells, of a fixed size, summed over all tasks.

Its estimates are never too low. Operators use it to tell very frequent hashes from the rest, for the order of
work only: no result depends on an estimate.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from skeinlog.llm._memory import released
from skeinlog.llm._tables import frugal

CELLS = 1 << 21
_CHUNK = 1 << 11


def cell(h: np.ndarray, cells: int = CELLS) -> np.ndarray:
    return (h >> np.uint64(20)).astype(np.int64) & (cells - 1)


def bitmap(rows: DataFrame, column: str, bits: int) -> np.ndarray:
    """A set of 64-bit hashes as a bitmap of a fixed size (bits is a power of two): what it does not hold is not in the set."""

    def mark(batches):
        flags = np.zeros(bits, bool)
        for batch in batches:
            flags[cell(batch.column(0).to_numpy().view(np.uint64), bits)] = True
        packed = np.packbits(flags, bitorder="little")
        yield from _emit({i: packed[i * _CHUNK : (i + 1) * _CHUNK] for i in range(len(packed) // _CHUNK)}, skip_empty=True)

    def either(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = np.frombuffer(blob, np.uint8)
                sums[i] = sums[i] | part if i in sums else part.copy()
        yield from _emit(sums)

    schema = "chunk int, counts binary"
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    with frugal(rows.sparkSession):
        table = rows.select(column).mapInArrow(released(mark), schema).repartition(n, "chunk").mapInArrow(released(either), schema).toArrow()
    out = np.zeros(bits // 8, np.uint8)
    for i, blob in zip(table.column(0).to_pylist(), table.column(1).to_pylist(), strict=True):
        out[i * _CHUNK : (i + 1) * _CHUNK] = np.frombuffer(blob, np.uint8)
    return out


def holds(packed: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = cell(h, len(packed) * 8)
    return (packed[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def build(rows: DataFrame, hashes: Callable[[pa.RecordBatch], Iterator[np.ndarray]], cells: int = CELLS) -> np.ndarray:
    """Counts over all hashes that ``hashes`` yields from the batches of ``rows``.

    Tasks send their cells in chunks; chunks are summed as a stream, so memory doesn't grow with the number of tasks.
    The driver receives ``cells`` numbers.
    """

    def count(batches):
        total = np.zeros(cells, np.uint32)
        for batch in batches:
            for h in hashes(batch):
                np.add.at(total, cell(h, cells), 1)
        # most chunks hold small numbers only, which go as single bytes
        yield from _emit({i: c.astype(np.uint8) if c.max() < 256 else c.astype(np.int64) for i, c in enumerate(total.reshape(-1, _CHUNK))}, skip_empty=True)

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = np.frombuffer(blob, np.uint8 if len(blob) == _CHUNK else np.int64)
                sums[i] = sums[i] + part if i in sums else part.astype(np.int64)
        yield from _emit(sums)

    schema = "chunk int, counts binary"
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    with frugal(rows.sparkSession):
        table = rows.mapInArrow(released(count), schema).repartition(n, "chunk").mapInArrow(released(add), schema).toArrow()
    out = np.zeros(cells, np.int64)
    for i, blob in zip(table.column(0).to_pylist(), table.column(1).to_pylist(), strict=True):
        out[i * _CHUNK : (i + 1) * _CHUNK] = np.frombuffer(blob, np.int64)
    return out


def _emit(chunks: dict[int, np.ndarray], skip_empty: bool = False) -> Iterator[pa.RecordBatch]:
    items = [(i, c) for i, c in chunks.items() if not skip_empty or c.any()]
    for at in range(0, len(items), 256):
        part = items[at : at + 256]
        yield pa.RecordBatch.from_arrays(
            [pa.array([i for i, _ in part], pa.int32()), pa.array([c.tobytes() for _, c in part], pa.binary())], names=["chunk", "counts"]
        )
