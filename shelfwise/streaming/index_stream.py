"""Index updates from a stream of organized files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.library import keyed_batch
from ..session import written
from ..sources.writers import BUCKETS, upsert_index


def dedupe_stream(stream: DataFrame, key: Sequence[str], time: str, delay: str) -> DataFrame:
    """One row per key within the watermark, the first that a batch meets; a time without zone is taken as UTC."""
    typed = stream.withColumn(time, F.col(time).cast("timestamp"))
    return typed.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(key))


def stream_index(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    time: str = "ts",
    delay: str = "1 hour",
    library: str | None = None,
    buckets: int = BUCKETS,
):
    """Upsert a stream of organized files into an index, all available data first.

    Copies of a file (same key and path) that arrive within ``delay`` are dropped by the state store before any batch.
    A batch is written once, its latest time is the stamp, and it reads and rewrites only the buckets that hold its keys; with
    many small batches take more ``buckets``.  A batch that is repeated after a failure changes nothing.
    """
    keyed = keyed_batch(stream).drop("error", "dedupe_confidence")
    unique = dedupe_stream(keyed, ["resource_key", "library_file"], time, delay).drop("resource_key")

    def apply(batch: DataFrame, batch_id: int) -> None:
        staged = written(batch)
        now = staged.agg(F.max(time)).first()[0]
        if now is not None:
            upsert_index(staged.sparkSession, path, staged, F.lit(str(now)).cast("timestamp"), library, buckets)

    return (
        unique.writeStream.foreachBatch(apply)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
