"""Best-fit packing of candidate texts into bins of equal capacity under source and copy conflicts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY = 2048
SHARD_ROWS = 8192
STEP = 512
RESULT = "ordinal long, cluster_key long, copy int, piece int, start long, length long, bin long, bin_start long"


class Bins:
    """Open bins in ascending order of room left; each carries a bitmap of its sources and one of its copy clusters."""

    def __init__(self, capacity: int, n_items: int, n_sources: int, n_clusters: int):
        self.capacity = capacity
        self.room = np.empty(0, dtype=np.int64)
        self.order = np.empty(0, dtype=np.int64)
        self.sources = np.zeros((n_items, n_sources // 64 + 1), dtype=np.uint64)
        self.clusters = np.zeros((n_items, n_clusters // 64 + 1), dtype=np.uint64)
        self.used = np.zeros(n_items, dtype=np.int64)
        self.n = 0

    def _place_of(self, length: int, source: tuple, cluster: tuple | None) -> int:
        """The first bin from the successor of ``length`` on that shares no bit, or -1."""
        at = int(np.searchsorted(self.room, length))
        while at < len(self.order):
            bins = self.order[at : at + STEP]
            free = (self.sources[bins, source[0]] & source[1]) == 0
            if cluster:
                free &= (self.clusters[bins, cluster[0]] & cluster[1]) == 0
            hit = int(free.argmax())
            if free[hit]:
                return at + hit
            at += STEP
        return -1

    def put(self, length: int, source: int, cluster: int, least: int) -> tuple[int, int]:
        """Bin and place in it for an item; ``cluster`` -1 conflicts with nothing; ``least`` is the smallest item still to come."""
        s = (source // 64, np.uint64(1 << (source % 64)))
        c = (cluster // 64, np.uint64(1 << (cluster % 64))) if cluster >= 0 else None
        at = self._place_of(length, s, c)
        if at < 0:
            bin_, left = self.n, self.capacity - length
            self.n += 1
        else:
            bin_, left = int(self.order[at]), int(self.room[at]) - length
            self.order, self.room = np.delete(self.order, at), np.delete(self.room, at)
        start = int(self.used[bin_])
        self.used[bin_] += length
        self.sources[bin_, s[0]] |= s[1]
        if c:
            self.clusters[bin_, c[0]] |= c[1]
        if left >= least:
            to = int(np.searchsorted(self.room, left))
            self.order, self.room = np.insert(self.order, to, bin_), np.insert(self.room, to, left)
        return bin_, start


def best_fit(length: np.ndarray, source: np.ndarray, cluster: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and place in it of items given in descending order of length; ``cluster`` -1 for none."""
    sources, n_sources = pd.factorize(source)[0], len(np.unique(source))
    codes = pd.factorize(cluster)[0]
    often = np.bincount(codes, minlength=1)[codes] > 1 if len(codes) else np.empty(0, dtype=bool)
    shared = np.where(often & (cluster != -1), codes, -1)
    kept, dense = np.unique(shared[shared >= 0], return_inverse=True)
    final = np.full(len(length), -1, dtype=np.int64)
    final[shared >= 0] = dense
    bins = Bins(capacity, len(length), n_sources, len(kept))
    least = int(length.min()) if len(length) else 0
    places = [bins.put(int(n), int(s), int(c), least) for n, s, c in zip(length, sources, final)]
    return np.array([p[0] for p in places], dtype=np.int64), np.array([p[1] for p in places], dtype=np.int64)


def pack_candidates(candidates: DataFrame, *, capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Where every word of every candidate goes: rows of ``ordinal``, ``cluster_key``, ``copy``, ``piece``, ``start``, ``length``, ``bin``, ``bin_start``.

    Reads ``ordinal``, ``source``, ``size`` (words) and ``cluster`` (string; candidates with equal clusters are copies, null has none).
    A candidate longer than ``capacity`` is cut; full pieces fill bins of their own, the rest
    is packed.  In a bin no two candidates have the same source or the same cluster (null source is a source of its own).
    Largest first, each goes to the bin with the least room that still holds it and conflicts with nothing; the
    search goes on over the next larger room until there is one, else a new bin opens.

    Candidates are dealt to shards of about ``shard_rows`` by a hash of their values, and each shard
    is packed in one task, so no task's work grows with the input; a bin never spans shards, which wastes
    the last open bins of each.  ``cluster_key`` is the 64-bit hash of the cluster (-1 for none) and ``copy`` counts from zero the rows
    of equal ordinal, cluster, source and size, so every packed row can be told apart.  A null or zero ``size`` gives one row of length 0 without a bin; equal rows are packed each.
    No candidates: no rows.
    """
    # no nulls reach pandas, which would turn whole numbers into floating point
    slim = candidates.select(
        F.coalesce(F.col("ordinal").cast("long"), F.lit(0)).alias("ordinal"),
        F.col("ordinal").isNull().alias("no_ordinal"),
        F.col("source").cast("string"),
        F.coalesce("size", F.lit(0)).cast("long").alias("size"),
        F.when(F.col("cluster").isNotNull(), F.xxhash64("cluster")).otherwise(F.lit(-1)).alias("cluster"),
    )
    n_shards = max(1, -(-slim.count() // shard_rows))
    dealt = slim.withColumn("shard", F.pmod(F.xxhash64("ordinal", "cluster", "source", "size"), F.lit(n_shards)).cast("int"))

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["no_ordinal", "ordinal", "cluster", "source", "size"], kind="stable").reset_index(drop=True)
        size = rows["size"].to_numpy(np.int64)
        full, rest = size // capacity, size % capacity
        shard = int(rows["shard"].iloc[0])
        cluster = rows["cluster"].to_numpy(np.int64)
        source = pd.factorize(rows["source"].fillna("\0null"))[0]
        at = np.flatnonzero(rest)
        at = at[np.argsort(-rest[at], kind="stable")]
        bins, starts = best_fit(rest[at], source[at], cluster[at], capacity)
        n_full = int(full.sum())
        row = np.repeat(np.arange(len(rows)), full)
        piece = np.arange(n_full) - np.repeat(np.cumsum(full) - full, full)
        none = np.flatnonzero(size == 0)
        out = pd.DataFrame(
            {
                "row": np.concatenate([row, at, none]),
                "piece": np.concatenate([piece, full[at], np.zeros(len(none), dtype=np.int64)]),
                "length": np.concatenate([np.full(n_full, capacity), rest[at], np.zeros(len(none), dtype=np.int64)]),
                "bin": np.concatenate([np.arange(n_full) + len(at), bins, np.full(len(none), -1)]),
                "bin_start": np.concatenate([np.zeros(n_full, dtype=np.int64), starts, np.zeros(len(none), dtype=np.int64)]),
            }
        )
        ordinals = rows["ordinal"].to_numpy(np.int64)[out["row"]]
        out["ordinal"] = pd.Series(ordinals, dtype="Int64").mask(rows["no_ordinal"].to_numpy()[out["row"]])
        out["start"] = out["piece"] * capacity
        out["cluster_key"] = cluster[out["row"]]
        out["copy"] = rows.groupby(["no_ordinal", "ordinal", "cluster", "source", "size"], dropna=False).cumcount().to_numpy()[out["row"]]
        ids = (np.int64(shard) << 32) + out["bin"].astype("int64")
        out["bin"] = ids.astype("Int64").mask(out["bin"] < 0)
        out["bin_start"] = out["bin_start"].astype("Int64").mask(out["length"] == 0)
        return out[["ordinal", "cluster_key", "copy", "piece", "start", "length", "bin", "bin_start"]]

    return dealt.groupBy("shard").applyInPandas(pack, RESULT)
