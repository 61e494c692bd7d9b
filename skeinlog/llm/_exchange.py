"""Keys between blocks of texts and the parts of a table.

A part is a range of 64-bit hashes. A block sends its sorted keys in slices, one row per (block, part) with arrays in binary
cells, so that rows are few and keys that a block holds several times have been combined before the shuffle. Parts are read as
streams sorted by part; a task holds one part's distinct keys and one row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from skeinlog.llm._memory import released

#: A part's rows are combined whenever this many entries have come together.
COMBINE = 1_000_000


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct values in order, a place of each, and which of them stands at each place."""
    order = np.argsort(values)
    ordered = values[order]
    new = np.ones(len(values), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    which = np.empty(len(values), np.int64)
    which[order] = np.cumsum(new) - 1
    return ordered[new], order[new], which


def within(keys: np.ndarray, part: int, parts: int) -> np.ndarray:
    """Which keys lie in one of ``parts`` (a power of two) ranges of hashes."""
    return keys >> np.uint64(65 - parts.bit_length()) == np.uint64(part) if parts > 1 else np.ones(len(keys), bool)


def sliced(keys: np.ndarray, bits: int, columns: list[np.ndarray]) -> tuple[np.ndarray, list[pa.Array]]:
    """Sorted keys cut into the parts they belong to (their highest bits): part numbers, and the columns in slices."""
    parts, starts = np.unique(keys >> np.uint64(64 - bits), return_index=True)
    out = []
    for c in columns:
        offsets = (np.append(starts, len(c)) * c.itemsize).astype(np.int32)
        out.append(pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(c))]))
    return parts.astype(np.int64), out


def merge(batches: Iterator[pa.RecordBatch], kinds: list, summed: list[bool]) -> Iterator[tuple[int, np.ndarray, list[np.ndarray]]]:
    """Over rows sorted by part: each part's distinct keys, with their columns summed or taken from the first row. Holds one part."""
    part, kept, size = None, [], 0

    def combined():
        keys, *columns = (np.concatenate(c) for c in zip(*kept, strict=True))
        u, first, which = np.unique(keys, return_index=True, return_inverse=True)
        out = []
        for c, kind, add in zip(columns, kinds, summed, strict=True):
            if len(c) == len(keys):
                c = np.bincount(which, weights=c, minlength=len(u)).astype(kind) if add else c[first]
            out.append(c)
        return u, *out

    for batch in batches:
        for i in range(batch.num_rows):
            p = batch.column(0)[i].as_py()
            if part is not None and p != part:
                u, *columns = combined()
                yield part, u, columns
                kept, size = [], 0
            part = p
            kept.append(tuple(np.frombuffer(batch.column(j)[i].as_buffer(), kind) for j, kind in enumerate([np.uint64, *kinds], 1)))
            size += len(kept[-1][0])
            if size > COMBINE + 2 * len(kept[0][0]) and len(kept) > 1:
                kept = [combined()]
                size = len(kept[0][0])
    if part is not None:
        u, *columns = combined()
        yield part, u, columns


def row_of(part: int, arrays: list[np.ndarray], *more: pa.Array, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), *(pa.array([np.ascontiguousarray(a).tobytes()], pa.binary()) for a in arrays), *more], names=names)


def by_part(rows: DataFrame, run: Callable, schema: str, *order: str) -> DataFrame:
    """``run`` over rows dealt by part and sorted by it, and then by ``order``."""
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(partitions, "part").sortWithinPartitions("part", *order).mapInArrow(released(run), schema)


def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows (part, block, kind, keys, x, y) sorted by (part, block), a part's own rows (negative blocks) first: the values
    of the keys that blocks ask for, 0 for those that a part doesn't hold. Holds one part."""
    part, held = None, {}
    for batch in batches:
        out: list[list] = [[], [], [], [], []]
        for i in range(batch.num_rows):
            p, block, kind = (batch.column(j)[i].as_py() for j in range(3))
            keys, x, y = (None if not (v := batch.column(j)[i]).is_valid else np.frombuffer(v.as_buffer(), t) for j, t in ((3, np.uint64), (4, np.float64), (5, np.float64)))
            if p != part:
                part, held = p, {}
            if block < 0:
                held[kind] = keys, x, y
                continue
            have, *values = held.get(kind, (np.zeros(0, np.uint64), np.zeros(0), np.zeros(0)))
            answers = [np.zeros(len(keys)) for _ in values]
            if len(have):
                at = np.minimum(np.searchsorted(have, keys), len(have) - 1)
                hit = have[at] == keys
                answers = [np.where(hit, v[at], 0.0) if v is not None else np.zeros(0) for v in values]
            for column, value in zip(out, (block, part, kind, *(a.tobytes() for a in answers)), strict=True):
                column.append(value)
        if out[0]:
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=["block", "part", "kind", "x", "y"])
