"""Arrow batches inside tasks."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa

Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def give_back() -> None:
    """What this process has freed, to the system: Arrow's unused memory and, where the C library can, its own."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidy(run: Run) -> Run:
    """``run``, after which the worker, which Spark keeps for later tasks, gives its unused memory back."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return tidied


def by_bytes(batch: pa.RecordBatch, column: int, most: int = 1 << 21, rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most ``rows`` rows, cut where the text in ``column`` passes ``most`` bytes."""
    low, size = 0, 0
    for i, t in enumerate(batch.column(column)):
        size += len(t.as_buffer()) if t.is_valid else 0
        if size > most or i - low + 1 >= rows:
            yield batch.slice(low, i - low + 1)
            low, size = i + 1, 0
    if low < batch.num_rows:
        yield batch.slice(low)
