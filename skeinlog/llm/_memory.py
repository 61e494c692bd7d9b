"""Arrow maps whose workers give back what a task took.

Spark keeps its Python workers for later tasks, and these keep what their allocators once had. An executor's memory then
holds the peak of every stage that came before; so tasks clear the module caches and hand free pages back as they end.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import pyarrow as pa

_CACHES: list[Callable[[], None]] = []


def cleared_after_tasks(clear: Callable[[], None]) -> None:
    """Have a module's cache emptied at the end of each task."""
    _CACHES.append(clear)


def release() -> None:
    for clear in _CACHES:
        clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # an allocator that has no such call
        pass


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, after which the worker's memory is released."""

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped
