"""Cutting Arrow batches into pieces of bounded bytes, for helpers that run inside tasks."""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa

CHUNK_BYTES = 1 << 19


def give_back() -> None:
    """Freed memory goes back to the machine."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def frees_memory(f: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """For functions over batches: when a task ends, freed memory goes back to the machine, so that idle workers hold
    none of what the next stages need."""

    @functools.wraps(f)
    def run(batches: Iterator) -> Iterator:
        try:
            yield from f(batches)
        finally:
            give_back()

    return run


def by_bytes(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, list[str]]]:
    """Runs of consecutive texts of about ``limit`` bytes: (place of the first, texts; null as empty).

    A text over the limit makes a run of its own; no text is cut here.
    """
    start, size, run = 0, 0, []
    for place, text in enumerate(texts):
        value = text.as_py() or ""
        if run and size + len(value) > limit:
            yield start, run
            start, size, run = place, 0, []
        run.append(value)
        size += len(value)
    if run:
        yield start, run
