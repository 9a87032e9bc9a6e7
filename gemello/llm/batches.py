"""Arrow batches in small slices, and what a worker gives back when its task ends."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import pyarrow as pa

ROWS = 256


def slices(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """The same rows by slices that share the batches' memory, so that a worker holds the Python objects of few rows at a time."""
    b = None
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
    del b
    release()


def release() -> None:
    """Give memory that is free back to the system: workers stay for the next task, and idle ones count against their executor."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # not the GNU library
        pass
