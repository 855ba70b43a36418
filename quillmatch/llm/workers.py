"""Memory of Python workers."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import pyarrow as pa


def give_back() -> None:
    """Hands freed memory back to the system, where the C library can: Spark keeps a worker for the stages that come next."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def sparing(fn: Callable[..., Iterator]) -> Callable[..., Iterator]:
    """fn, a function from batches to batches, that gives its memory back at the end of a task."""

    @functools.wraps(fn)
    def run(batches: Iterator) -> Iterator:
        try:
            yield from fn(batches)
        finally:
            give_back()

    return run
