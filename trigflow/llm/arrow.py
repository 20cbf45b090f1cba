"""Small helpers for Arrow batches inside tasks."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute

#: Rows of long texts are handled in slices of about this many bytes.
SLICE_BYTES = 4 << 20


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column, NULL as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def slices(batch: pa.RecordBatch, column: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of a batch whose ``column`` holds about ``limit`` bytes, one row at least."""
    start = size = 0
    for i, n in enumerate(pa.compute.binary_length(batch.column(column)).to_pylist()):
        if size and size + (n or 0) > limit:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n or 0
    if start < batch.num_rows:
        yield batch.slice(start)


def sliced(work: Callable[[pa.RecordBatch], pa.RecordBatch], column: int) -> Callable:
    """A function for ``mapInArrow`` that applies ``work`` to bounded slices."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, column):
                yield work(piece)
        give_back()

    return run


def give_back() -> None:
    """Frees what a task's allocators hold unused: workers idle for a minute beside the stages that follow."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
