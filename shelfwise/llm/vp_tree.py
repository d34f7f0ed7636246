"""Vantage-point trees per shard, searched with relaxed triangle-inequality pruning.

The library's records hold no vectors, so this operator is general: ``vectors`` with
``vec_id`` (long) and ``embedding`` (array of float).

The largest inner product is the smallest Euclidean distance once every vector gets one more
component that lifts it to the largest norm M (queries get zero there): d^2 = |q|^2 + M^2 - 2 q.x.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import written

SHARD_ROWS = 16_384
QUERY_BLOCK = 2_048
LEAF = 256
KEPT = 1 << 20


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id`` and the embedding as doubles, without vectors that are null or zero or hold null or non-finite components.

    Rows without an id or with an id seen before under the same components stay; a null id takes no part.
    """
    doubles = F.col("embedding").cast("array<double>")
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    clean = vectors.select("vec_id", doubles.alias("embedding")).where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
    return clean.where(good & F.exists("embedding", lambda x: x != 0))


class VpTree:
    """A tree over the distinct vectors of one shard: inner nodes are (vantage point, radius), leaves hold up to LEAF vectors.

    The far side of a node is visited while ``gap <= slack * current radius``.  With
    slack 1 nothing that could be among the k best is left out.
    """

    def __init__(self, ids: np.ndarray, rows: np.ndarray, lift: float):
        rows = np.ascontiguousarray(rows)
        _, at, vector = np.unique(rows.view(f"V{rows.shape[1] * rows.itemsize}").ravel(), return_index=True, return_inverse=True)
        self.rows, self.lift = rows[at], lift
        square = np.einsum("ij,ij->i", self.rows, self.rows)
        self.points = np.concatenate([self.rows, np.sqrt(np.maximum(lift * lift - square, 0.0))[:, None]], axis=1)
        self.nodes: list = []
        self.leaves: list = []
        self.root = self._build(np.argsort(at, kind="stable"))
        # vectors lie as the leaves hold them, each with its ids in ascending order
        order = np.concatenate(self.leaves)
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        self.rows = self.rows[order]
        by_vector = np.lexsort((ids, place[vector]))
        self.ids, self.vector = ids[by_vector], place[vector][by_vector]
        self.sizes = np.bincount(self.vector, minlength=len(order))
        self.first = np.cumsum(self.sizes) - self.sizes
        self.ends = np.cumsum([len(x) for x in self.leaves])
        self.by_id = np.argsort(self.ids, kind="stable")

    def _leaf(self, members: np.ndarray) -> tuple:
        self.leaves.append(members)
        return ("leaf", len(self.leaves) - 1)

    def _build(self, members: np.ndarray) -> int:
        place = len(self.nodes)
        self.nodes.append(None)
        if len(members) <= LEAF:
            self.nodes[place] = self._leaf(members)
            return place
        # the vantage point: the farthest from the first row, which spreads distances well
        first = self.points[members[0]]
        point = members[int(np.argmax(np.linalg.norm(self.points[members] - first, axis=1)))]
        away = np.linalg.norm(self.points[members] - self.points[point], axis=1)
        radius = float(np.median(away))
        near = away <= radius
        if near.all() or not near.any():  # all equally far: no radius parts them
            self.nodes[place] = self._leaf(members)
            return place
        inner = self._build(members[near])
        outer = self._build(members[~near])
        self.nodes[place] = ("node", self.points[point], radius, inner, outer)
        return place

    def _own(self, query_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs (query place, vector) where the vector has the query's id alone; and per query how many rows have its id."""
        known = self.ids[self.by_id]
        low = np.searchsorted(known, query_ids, "left")
        times = np.searchsorted(known, query_ids, "right") - low
        query = np.repeat(np.arange(len(query_ids)), times)
        row = self.by_id[_ranges(low, times)]
        pair, held = np.unique(query * len(self.rows) + self.vector[row], return_counts=True)
        alone = held == self.sizes[pair % len(self.rows)]
        return pair[alone] // len(self.rows), pair[alone] % len(self.rows), times

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, slack: float) -> tuple[np.ndarray, ...]:
        """Per query up to k rows, best first: (query place, id, score), scores summed in component order.

        A leaf is scored for all its queries at once; vectors whose rough score may be among the k best are kept, and only
        those are scored in component order at the end.
        """
        best = np.full((len(queries), k), -np.inf)  # the k best rough scores so far
        floor = np.full(len(queries), -np.inf)
        points = np.concatenate([queries, np.zeros((len(queries), 1))], axis=1)
        square = np.einsum("ij,ij->i", queries, queries) + self.lift * self.lift
        room = 1e-9 * (1.0 + np.sqrt(square) * self.lift)
        own_query, own_vector, times = self._own(query_ids)
        own_leaf = np.searchsorted(self.ends, own_vector, "right")
        home = np.full(len(queries), -1)  # the leaf that a query lies in
        kept: list = []
        held = 0

        def leaf(number: int, which: np.ndarray) -> None:
            nonlocal held, kept
            low, high = int(self.ends[number]) - len(self.leaves[number]), int(self.ends[number])
            for start in range(low, high, LEAF):
                rows = self.rows[start : min(start + LEAF, high)]
                rough = queries[which] @ rows.T
                here = (own_leaf == number) & (own_vector >= start) & (own_vector < start + len(rows))
                if here.any():
                    line = np.full(len(queries), -1)
                    line[which] = np.arange(len(which))
                    asked = here & (line[own_query] >= 0)
                    rough[line[own_query[asked]], own_vector[asked] - start] = -np.inf
                better = np.flatnonzero(rough.max(axis=1) >= floor[which] - room[which])
                if not len(better):
                    continue
                q, rough = which[better], rough[better]
                merged = np.concatenate([best[q], rough], axis=1)
                best[q] = np.partition(merged, merged.shape[1] - k, axis=1)[:, -k:]
                floor[q] = best[q].min(axis=1)
                at, column = np.nonzero((rough >= (floor[q] - room[q])[:, None]) & (rough > -np.inf))
                kept.append((q[at], start + column, rough[at, column]))
                held += len(at)
                if held > KEPT:
                    kept = [still_near()]
                    held = max(0, len(kept[0][0]) - KEPT // 2)

        def still_near() -> tuple[np.ndarray, ...]:
            query, vector, score = (np.concatenate(x) for x in zip(*kept))
            near = score >= floor[query] - room[query]
            return query[near], vector[near], score[near]

        def descend(place: int, which: np.ndarray) -> None:
            """Every query to the leaf that it lies in."""
            node = self.nodes[place]
            if not len(which):
                return
            if node[0] == "leaf":
                home[which] = node[1]
                leaf(node[1], which)
                return
            inside = np.linalg.norm(points[which] - node[1], axis=1) <= node[2]
            descend(node[3], which[inside])
            descend(node[4], which[~inside])

        def visit(place: int, which: np.ndarray) -> None:
            """All leaves but a query's own, unless they lie beyond the distance of its k-th best."""
            node = self.nodes[place]
            if not len(which):
                return
            if node[0] == "leaf":
                rest = which[home[which] != node[1]]
                if len(rest):
                    leaf(node[1], rest)
                return
            away = np.linalg.norm(points[which] - node[1], axis=1)
            gap = away - node[2]
            for side, far in ((node[3], gap > 0), (node[4], gap <= 0)):
                # reach is infinite while fewer than k are found
                reach = np.sqrt(np.maximum(square[which] - 2 * floor[which], 0.0))
                open_ = np.abs(gap) <= slack * reach + 1e-7 * (1.0 + np.sqrt(square[which]))
                visit(side, which[~far | open_])

        descend(self.root, np.arange(len(queries)))
        visit(self.root, np.arange(len(queries)))
        if not kept:
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0)
        query, vector, _ = still_near()
        score = _ordered_dots(queries, query, self.rows, vector)
        # of a vector's copies no more than k can be asked for
        copies = np.minimum(self.sizes[vector], k + times[query])
        ids = self.ids[_ranges(self.first[vector], copies)]
        query, score = np.repeat(query, copies), np.repeat(score, copies)
        other = ids != query_ids[query]
        query, score, ids = query[other], score[other], ids[other]
        order = np.lexsort((ids, -score, query))
        query, score, ids = query[order], score[order], ids[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query, "left")
        return query[rank < k], ids[rank < k], score[rank < k]


def _ranges(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each first one on, so many as its size, one run after another."""
    return np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


def _ordered_dots(queries: np.ndarray, query: np.ndarray, rows: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Inner products of pairs, added component by component, so equal vectors score equal wherever they lie."""
    out = np.zeros(len(query))
    for d in range(rows.shape[1]):
        out += queries[query, d] * rows[row, d]
    return out


def _packed(frame: pd.DataFrame, key: str) -> pd.DataFrame:
    """One row for a group: its ids and its vectors as bytes.  Vectors of another length than the most common are apart."""
    rows = np.stack(frame["embedding"].to_numpy()).astype("<f8")
    return pd.DataFrame(
        {key: [frame[key].iloc[0]], "width": [rows.shape[1]], "ids": [frame["vec_id"].to_numpy("<i8").tobytes()], "rows": [rows.tobytes()]}
    )


def _blocks(vectors: DataFrame, key: str, n: int) -> DataFrame:
    """Rows dealt evenly to ``n`` blocks per vector length by a hash of the id, each block one packed row."""
    keyed = vectors.withColumn("width", F.size("embedding")).withColumn(
        key, F.pmod(F.xxhash64("vec_id", F.lit(key)), F.lit(n)).cast("int")
    )
    return keyed.groupBy("width", key).applyInPandas(
        lambda f: _packed(f, key), f"{key} int, width int, ids binary, rows binary"
    )


def nearest(
    vectors: DataFrame, queries: DataFrame, *, k: int = 20, slack: float = 1.0, shard_rows: int = SHARD_ROWS
) -> DataFrame:
    """The ``k`` vectors with the largest inner product for every query, its own id left out.

    ``query_id``, ``rank`` (from 1), ``vec_id``, ``score`` (double).  Ties go to the smaller id.  Every
    usable vector is in a tree; shards of about ``shard_rows`` rows and blocks of queries are dealt by a hash of the id, so
    copies of one vector spread like any others.  Each (shard, block) cell returns at most k
    rows per query, and the cells of a query are merged by rank.  ``slack`` 1 is exact;
    smaller values visit fewer far sides.  Null, zero and non-finite
    vectors take no part; only vectors of a query's length are compared with it; repeated rows are
    ranked as often as they occur, and a repeated query id is asked once, with its smallest vector.  No vectors or no
    queries: no rows.
    """
    clean = written(usable(vectors), "vectors")
    asked = usable(queries).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    stats = clean.agg(F.count("*").alias("n"), F.max(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)).alias("m")).first()
    if not stats.n:
        empty = "query_id long, rank int, vec_id long, score double"
        return vectors.sparkSession.createDataFrame([], empty)
    lift = float(np.sqrt(stats.m)) * (1 + 1e-12)
    n_shards = max(1, -(-stats.n // shard_rows))
    n_blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    shards = written(_blocks(clean, "shard", n_shards), "vp-shards")
    blocks = written(_blocks(asked, "block", n_blocks), "vp-queries")
    spread = blocks.select(
        "block",
        F.col("width").alias("q_width"),
        F.col("ids").alias("q_ids"),
        F.col("rows").alias("q_rows"),
        F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))).alias("q_shard"),
    )
    cells = shards.join(spread, (F.col("shard") == F.col("q_shard")) & (F.col("width") == F.col("q_width")))
    cells = cells.repartition(max(1, n_shards * n_blocks), "shard", "block")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, tree = None, None
        for batch in batches:
            for cell in batch.to_pylist():
                width = cell["width"]
                if held != (cell["shard"], width):
                    held = (cell["shard"], width)
                    rows = np.frombuffer(cell["rows"], dtype="<f8").reshape(-1, width)
                    tree = VpTree(np.frombuffer(cell["ids"], dtype="<i8"), rows, lift)
                q_ids = np.frombuffer(cell["q_ids"], dtype="<i8")
                q_rows = np.frombuffer(cell["q_rows"], dtype="<f8").reshape(-1, width)
                at, ids, scores = tree.search(q_ids, q_rows, k, slack)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(q_ids[at]), pa.array(ids), pa.array(scores)], ["query_id", "vec_id", "score"]
                )

    found = cells.select("shard", "width", "ids", "rows", "q_ids", "q_rows").mapInArrow(
        search, "query_id long, vec_id long, score double"
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int"), "vec_id", "score")
