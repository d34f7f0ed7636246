"""Adding up fixed-size tables of counters over all tasks."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .chunks import frees_memory

ROWS = "block int, counts binary"


def _row(block: int, counts: np.ndarray) -> pa.RecordBatch:
    data = zlib.compress(counts.astype("<i8").tobytes(), 1)
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([data], pa.binary())], ["block", "counts"])


def block_rows(counts: np.ndarray, n_blocks: int) -> Iterator[pa.RecordBatch]:
    """A task's counters as at most ``n_blocks`` packed rows; for the end of a ``mapInArrow``."""
    for block, part in enumerate(counts.reshape(n_blocks, -1)):
        if part.any():
            yield _row(block, part)


@frees_memory
def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, data in zip(batch.column("block").to_pylist(), batch.column("counts")):
            counts = np.frombuffer(zlib.decompress(data.as_py()), dtype="<i8")
            sums[block] = counts.copy() if block not in sums else sums[block] + counts
    for block, counts in sums.items():
        yield _row(block, counts)


def total(parts: DataFrame, size: int, n_blocks: int) -> np.ndarray:
    """The sum of all tasks' ``block_rows``: ``size`` counters, whatever the corpus.

    Blocks are added up as a stream, one sum in memory per block; only the sums reach the driver.
    """
    out = np.zeros((n_blocks, size // n_blocks), dtype=np.int64)
    for row in parts.repartition(n_blocks, "block").mapInArrow(_add, ROWS).collect():
        out[row.block] = np.frombuffer(zlib.decompress(row["counts"]), dtype="<i8")
    return out.reshape(-1)
