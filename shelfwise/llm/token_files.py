"""Token ids of candidate texts as Arrow files of equal-length sequences, and random access to them.

A file holds record batches of ``BATCH_SEQUENCES`` rows, each a fixed-size list of
token ids (16 bits where the vocabulary fits, else 32) and one of mask bits.  Every batch but the last of a file is
full, so the place of any token follows by division and a memory-mapped
reader hands out sequences without copying.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .chunks import by_bytes, frees_memory
from .tables import new_folder, written

SEQUENCE = 1024
BATCH_SEQUENCES = 256
INDEX = "ordinal long, shard int, file string, shard_offset long, n_tokens long"


def _schema(length: int, narrow: bool) -> pa.Schema:
    kind = pa.uint16() if narrow else pa.uint32()
    return pa.schema([("token_ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])


class _Writer:
    """Cuts a stream of ids into sequences and writes them batch by batch; the last one is padded under mask 0."""

    def __init__(self, sink, length: int, narrow: bool):
        self.length, self.full = length, length * BATCH_SEQUENCES
        self.schema, self.kind = _schema(length, narrow), np.uint16 if narrow else np.uint32
        self.out = pa.ipc.new_file(sink, self.schema)
        self.parts: list[bytes] = []
        self.held = 0

    def add(self, ids: bytes) -> None:
        self.parts.append(ids)
        self.held += len(ids) // 4
        if self.held >= self.full:
            data = np.frombuffer(b"".join(self.parts), dtype="<u4")
            whole = len(data) // self.full * self.full
            for at in range(0, whole, self.full):
                self._write(data[at : at + self.full], self.full)
            self.parts, self.held = [data[whole:].tobytes()], len(data) - whole

    def _write(self, ids: np.ndarray, used: int) -> None:
        mask = np.zeros(len(ids), dtype=bool)
        mask[:used] = True
        lists = [
            pa.FixedSizeListArray.from_arrays(pa.array(ids.astype(self.kind)), self.length),
            pa.FixedSizeListArray.from_arrays(pa.array(mask), self.length),
        ]
        self.out.write_batch(pa.RecordBatch.from_arrays(lists, schema=self.schema))

    def close(self) -> None:
        if self.held:
            data = np.frombuffer(b"".join(self.parts), dtype="<u4")
            padded = np.zeros(-(-len(data) // self.length) * self.length, dtype=np.uint32)
            padded[: len(data)] = data
            self._write(padded, len(data))
        self.out.close()


def write_token_files(
    candidates: DataFrame, tokenizer: str, folder: str, *, end_id: int = 1, length: int = SEQUENCE
) -> DataFrame:
    """Writes every candidate's ``text`` as ids plus ``end_id``, in ascending ``ordinal`` order; returns the index.

    Candidates are dealt out by ranges of ``ordinal`` (no single task sees all) and
    each task writes one file of its own name, so a repeated or speculative attempt never touches
    another's file; the index keeps only files of attempts that succeeded.  Ascending
    ``shard`` is ascending ``ordinal``; a file's last sequence is padded.  Null
    ``ordinal`` comes first, equal ordinals follow by text, null text is an
    empty text (just ``end_id``); other columns are not read.  No candidates: no
    files and an empty index.  Index: ``ordinal``, ``shard``, ``file``, ``shard_offset``
    (place of the first id in its file), ``n_tokens`` (with the end id).
    """
    dealt = (
        candidates.select(F.col("ordinal").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
        .repartitionByRange("ordinal")
        .sortWithinPartitions("ordinal", "text")
    )

    @frees_memory
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        from .token_pieces import encoder

        system, path = fs.FileSystem.from_uri(folder)
        shard = TaskContext.get().partitionId()
        file = f"part-{shard:06d}-{uuid.uuid4().hex}.arrow"
        pieces, writer, sink, at = None, None, None, 0
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            if writer is None:
                system.create_dir(path, recursive=True)
                sink = system.open_output_stream(f"{path}/{file}")
                pieces = encoder(tokenizer, drops_space=True)
                writer = _Writer(sink, length, narrow=pieces.tokenizer.get_vocab_size() <= 1 << 16 and end_id < 1 << 16)
            ordinals, texts = batch.column("ordinal"), batch.column("text")
            for first, run in by_bytes(texts):
                counts = []
                for ids in pieces.encode(run):
                    writer.add(ids)
                    writer.add(end)
                    counts.append(len(ids) // 4 + 1)
                n = np.array(counts, dtype=np.int64)
                offsets = at + np.cumsum(n) - n
                at += int(n.sum())
                yield pa.RecordBatch.from_arrays(
                    [
                        ordinals.slice(first, len(run)),
                        pa.array(np.full(len(run), shard, dtype=np.int32)),
                        pa.array([file] * len(run)),
                        pa.array(offsets),
                        pa.array(n),
                    ],
                    ["ordinal", "shard", "file", "shard_offset", "n_tokens"],
                )
        if writer is not None:
            writer.close()
            sink.close()

    return written(dealt.mapInArrow(write, INDEX), "token-index")


class TokenFile:
    """Random access to the ids and masks of one file; local files are memory-mapped."""

    def __init__(self, folder: str, file: str):
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(folder)
        name = f"{path}/{file}"
        local = isinstance(system, fs.LocalFileSystem)
        self.source = pa.memory_map(name) if local else system.open_input_file(name)
        self.reader = pa.ipc.open_file(self.source)
        self.length = self.reader.schema.field("token_ids").type.list_size
        self.full = self.length * BATCH_SEQUENCES
        self.place, self.batch = -1, None

    def _load(self, place: int) -> pa.RecordBatch:
        if place != self.place:
            self.batch, self.place = self.reader.get_batch(place), place
        return self.batch

    def sequence(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of the k-th sequence."""
        batch = self._load(k // BATCH_SEQUENCES)
        at = (k % BATCH_SEQUENCES) * self.length
        ids = batch.column("token_ids").flatten().to_numpy()[at : at + self.length]
        return ids, batch.column("mask").flatten()[at : at + self.length].to_numpy(zero_copy_only=False)

    def ids(self, start: int, n: int) -> Iterator[np.ndarray]:
        """The ids from place ``start`` on, in runs that lie in one batch each."""
        while n > 0:
            place, at = divmod(start, self.full)
            run = self._load(place).column("token_ids").flatten().to_numpy()[at : at + n]
            yield run
            start, n = start + len(run), n - len(run)

    def close(self) -> None:
        self.batch = None
        self.source.close()


def read_token_digests(index: DataFrame, folder: str) -> DataFrame:
    """Per index row what its file holds: ``start`` (ids before it over all files), ``n_tokens``, ``ids_crc32``.

    Files are opened by the tasks that read the index; the sum of ids per file is the only
    thing grouped (one row per file).  An empty index gives no rows.
    """
    sizes = index.groupBy("shard").agg(F.sum("n_tokens").alias("_size"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select(F.col("shard").alias("_shard"), F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_base"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, opened = None, None
        for batch in batches:
            sums = []
            rows = zip(*(batch.column(c).to_pylist() for c in ("file", "shard_offset", "n_tokens")))
            for file, offset, n in rows:
                if file != name:
                    if opened:
                        opened.close()
                    name, opened = file, TokenFile(folder, file)
                crc = 0
                for run in opened.ids(offset, n):
                    crc = zlib.crc32(run.astype("<u4"), crc)
                sums.append(crc)
            columns = [batch.column(c) for c in ("ordinal", "shard", "shard_offset", "n_tokens")]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(sums, pa.int64())], ["ordinal", "shard", "shard_offset", "n_tokens", "ids_crc32"]
            )
        if opened:
            opened.close()

    schema = "ordinal long, shard int, shard_offset long, n_tokens long, ids_crc32 long"
    read = index.mapInArrow(digest, schema)
    return read.join(bases, F.col("shard") == F.col("_shard")).select(
        "ordinal", (F.col("_base") + F.col("shard_offset")).alias("start"), "n_tokens", "ids_crc32"
    )


def token_folder(spark: SparkSession) -> str:
    """A new folder for token files in the shared folder."""
    return new_folder(spark, "tokens")
