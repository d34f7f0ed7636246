"""Merkle manifest of catalog records: trees of digests kept as aligned subtrees in van Emde Boas order.

Every record is a leaf.  The records of one class (``stage``) make a tree in which each run of eight
digests is hashed into the next level; the roots of the classes make one more tree, whose root stands for the whole
table.  A tree is stored in aligned subtrees of ``HEIGHT`` hash levels, one row each, and the roots of these
blocks are the leaves of the next tier of blocks, up to a single one.  Inside a block the digests lie in van Emde Boas order: the
subtree is split at half its height, the upper half comes first, then every lower
subtree, each laid out in the same way.  ``address`` finds a digest's place by arithmetic alone; the block is
built and its siblings are fetched through it.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import cache, reduce
from hashlib import sha256
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import written

FAN = 8
HEIGHT = 4
FIELDS = ("ordinal", "source", "stage", "size", "text")
BLOCK = "tree string, block long, levels int, n_members int, cells binary, root binary"
PATHS = "tree string, block long, lefts array<string>, rights array<string>, subroot string, root string"
PROOF = "ordinal long, leaf string, subroot string, root string, proof string, folded_root string, verified boolean"
SHELVES = "tree string, lefts array<string>, rights array<string>, root string"
_TEXTS = pa.list_(pa.string())
_BLOCK = pa.schema(
    [("tree", pa.string()), ("block", pa.int64()), ("levels", pa.int32()), ("n_members", pa.int32()), ("cells", pa.binary()), ("root", pa.binary())]
)
_PATHS = pa.schema([("tree", pa.string()), ("block", pa.int64()), ("lefts", _TEXTS), ("rights", _TEXTS), ("subroot", pa.string()), ("root", pa.string())])
_SHELVES = pa.schema([("tree", pa.string()), ("lefts", _TEXTS), ("rights", _TEXTS), ("root", pa.string())])
_PROOF = pa.schema([(c, pa.string() if c not in ("ordinal", "verified") else pa.int64() if c == "ordinal" else pa.bool_()) for c in
    ("ordinal", "leaf", "subroot", "root", "proof", "folded_root", "verified")])


class Manifest(NamedTuple):
    """Numbered leaves and the blocks of every tier of the class trees; the classes' roots and their one tree likewise."""

    leaves: DataFrame
    tiers: list[DataFrame]
    shelves: DataFrame
    top: list[DataFrame]
    height: int


# ---------------------------------------------------------------- digests and addresses
def leaf_digest(*fields: Column) -> Column:
    """SHA-256 in lower-case hex over all fields: ``-`` for null, else its UTF-8 byte count, a colon and the value."""

    def part(field: Column) -> Column:
        value = field.cast("string")
        return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))

    return F.sha2(F.concat(*[part(f) for f in fields]), 256)


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def n_cells(levels: int) -> int:
    """Nodes of a full subtree with that many levels of nodes."""
    return (FAN**levels - 1) // (FAN - 1)


def address(levels: int, depth: int, index):
    """Place of the ``index``-th node at ``depth`` (root: 0) in a subtree of ``levels`` levels of nodes."""
    if levels == 1:
        return index * 0
    low = levels // 2
    top = levels - low
    if depth < top:
        return address(top, depth, index)
    width = FAN ** (depth - top)
    return n_cells(top) + index // width * n_cells(low) + address(low, depth - top, index % width)


@cache
def places(levels: int, depth: int) -> np.ndarray:
    return address(levels, depth, np.arange(FAN**depth, dtype=np.int64))


class Block:
    """An aligned subtree with ``height`` levels of hashing over its members, the digests of the tier below."""

    def __init__(self, height: int, n_members: int, cells: np.ndarray):
        self.height, self.levels, self.cells = height, height + 1, cells
        self.counts = [n_members]
        for _ in range(height):
            self.counts.append(-(-self.counts[-1] // FAN))
        self.counts.reverse()

    @classmethod
    def build(cls, height: int, members: Sequence[bytes]) -> Block:
        block = cls(height, len(members), np.zeros((n_cells(height + 1), 32), dtype=np.uint8))
        block._put(height, members)
        for depth in range(height - 1, -1, -1):
            block._put(depth, [sha256(run.encode()).digest() for run in block.runs(depth + 1)])
        return block

    def _put(self, depth: int, digests: Sequence[bytes]) -> None:
        self.cells[places(self.levels, depth)[: len(digests)]] = np.frombuffer(b"".join(digests), dtype=np.uint8).reshape(-1, 32)

    def runs(self, depth: int) -> list[str]:
        """Hex text of every run of siblings at a depth."""
        level = self.cells[places(self.levels, depth)[: self.counts[depth]]].tobytes().hex()
        return [level[at : at + 64 * FAN] for at in range(0, len(level), 64 * FAN)]

    def root(self) -> bytes:
        return self.cells[0].tobytes()

    def paths(self, lefts: list[str], rights: list[str]) -> list[tuple[list[str], list[str]]]:
        """For every member the siblings before and after it, level by level, with the given ones above the block."""
        found = [(lefts, rights)]
        for depth in range(1, self.levels):
            runs, below = self.runs(depth), []
            for index in range(self.counts[depth]):
                parent, place = divmod(index, FAN)
                run, above = runs[parent], found[parent]
                below.append(([run[: 64 * place], *above[0]], [run[64 * place + 64 :], *above[1]]))
            found = below
        return found


def fold(leaf: str, lefts: Sequence[str], rights: Sequence[str]) -> str:
    """The root that a leaf and the siblings on its way up lead to."""
    for left, right in zip(lefts, rights):
        leaf = digest(left + leaf + right)
    return leaf


# ---------------------------------------------------------------- numbering
def _numbered(rows: DataFrame, *order: str) -> DataFrame:
    """Adds ``pos``, the place in the ``tree`` counting ``copies`` of every row before, and ``levels``, the tree's height.

    Rows are sorted over all tasks by ranges and written with the task they fell into and their place in
    it; every tree's part in a task is then moved on by its parts before, a table of one row per task and tree.
    """
    keys = [F.asc_nulls_first(c) for c in ("tree", *order)]

    def place(batches):
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            copies = batch.column("copies").to_numpy()
            starts = at + np.cumsum(copies) - copies
            at += int(copies.sum())
            parts = pa.array(np.full(len(copies), part, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns, parts, pa.array(starts)], [*batch.schema.names, "part", "at"])

    schema = T.StructType([*rows.schema.fields, T.StructField("part", T.IntegerType()), T.StructField("at", T.LongType())])
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = written(dealt.mapInArrow(place, schema), "manifest-leaves")
    sizes = placed.groupBy("part", "tree").agg(F.min("at").alias("_first"), F.sum("copies").alias("_size"))
    before = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    spans = sizes.select(
        F.col("part").alias("_part"),
        F.col("tree").alias("_tree"),
        (F.coalesce(F.sum("_size").over(before), F.lit(0)) - F.col("_first")).alias("_move"),
        F.sum("_size").over(Window.partitionBy("tree")).alias("_n"),
    )
    joined = placed.join(spans, (F.col("part") == F.col("_part")) & (F.col("tree") == F.col("_tree")))
    levels = reduce(lambda a, b: a + b, [(F.col("_n") > F.lit(FAN**k)).cast("int") for k in range(21)])
    return joined.select(*rows.columns, (F.col("at") + F.col("_move")).alias("pos"), levels.alias("levels"))


def _in_blocks(rows: DataFrame, height: int) -> DataFrame:
    """Rows once per block that holds one of their copies."""
    step = F.lit(FAN**height)
    first, last = F.floor(F.col("pos") / step), F.floor((F.col("pos") + F.col("copies") - 1) / step)
    return rows.withColumn("block", F.explode(F.sequence(first, last)))


def _members(table: pa.Table, height: int) -> list[int]:
    """The row that stands at each place of a block, in order."""
    step = FAN**height
    base = table.column("block")[0].as_py() * step
    pos, copies = table.column("pos").to_numpy(), table.column("copies").to_numpy()
    inside = np.minimum(pos + copies, base + step) - np.maximum(pos, base)
    order = np.argsort(pos, kind="stable")
    return np.repeat(order, inside[order]).tolist()


# ---------------------------------------------------------------- building
def _tiers(leaves: DataFrame, height: int) -> list[DataFrame]:
    """Blocks tier by tier; each tier has about a 4,096th of the rows of the one below."""
    most = leaves.agg(F.max("levels")).first()[0]
    rows, tiers = leaves.select("tree", "pos", "copies", "leaf", "levels"), []
    for tier in range(0 if most is None else max(1, -(-most // height))):
        done = tier * height

        def build(table: pa.Table) -> pa.Table:
            levels = table.column("levels")[0].as_py()
            digests = table.column("leaf").to_pylist()
            members = [digests[k] for k in _members(table, height)]
            block = Block.build(min(height, levels - done), members)
            one = {"levels": levels, "n_members": len(members), "cells": block.cells.tobytes(), "root": block.root()}
            key = {"tree": table.column("tree")[0].as_py(), "block": table.column("block")[0].as_py()}
            return pa.Table.from_pylist([key | one], _BLOCK)

        built = written(_in_blocks(rows, height).groupBy("tree", "block").applyInArrow(build, BLOCK), "manifest-blocks")
        tiers.append(built)
        higher = built.where(F.col("levels") > done + height)
        rows = higher.select("tree", F.col("block").alias("pos"), F.lit(1).cast("long").alias("copies"), F.col("root").alias("leaf"), "levels")
    return tiers


def _tops(tiers: list[DataFrame], tier: int, height: int) -> DataFrame:
    """Blocks of a tier that hold the root of their tree."""
    return tiers[tier].where(F.col("levels").between(tier * height + (tier > 0), (tier + 1) * height))


def build_manifest(candidates: DataFrame, *, shelf: str = "stage", leaf: str = "leaf", presented: str | None = None, height: int = HEIGHT) -> Manifest:
    """The stored trees over candidates that carry their ``leaf``, a digest in hex such as ``leaf_digest`` of ``FIELDS``.

    ``shelf`` names the class that makes a tree: null is a class of its own and comes first, the others follow by UTF-8 bytes.
    Inside a tree leaves ascend by ``ordinal`` (null first), equal ordinals by leaf; repeated rows are leaves each.
    ``presented`` names the leaf of a record as it is handed in for proof (null: unchanged).  Other columns are not
    read.  No candidates: no tiers.  Only digests are shuffled; a class of any size is cut into blocks of 4,096 leaves,
    and repeated rows are counted before they meet.  All trees are tables in the shared folder.
    """
    slim = candidates.select(
        F.coalesce(F.concat(F.lit("="), F.col(shelf).cast("string")), F.lit("")).alias("tree"),
        F.col("ordinal").cast("long").alias("ordinal"),
        F.unhex(F.col(leaf)).alias("leaf"),
        (F.unhex(F.col(presented)) if presented else F.lit(None).cast("binary")).alias("presented"),
    )
    counted = slim.groupBy(*slim.columns).agg(F.count(F.lit(1)).alias("copies"))
    leaves = _numbered(counted, "ordinal", "leaf", "presented")
    tiers = _tiers(leaves, height)
    if not tiers:
        return Manifest(leaves, [], leaves, [], height)
    roots = [_tops(tiers, k, height).select(F.lit("").alias("tree"), F.col("tree").alias("shelf"), F.col("root").alias("leaf")) for k in range(len(tiers))]
    shelves = _numbered(reduce(DataFrame.unionByName, roots).withColumn("copies", F.lit(1).cast("long")), "shelf")
    return Manifest(leaves, tiers, shelves, _tiers(shelves, height), height)


# ---------------------------------------------------------------- proofs
def _opened(row: dict) -> Block:
    cells = np.frombuffer(row["cells"], dtype=np.uint8).reshape(-1, 32)
    levels = next(k for k in range(1, 22) if n_cells(k) == len(cells))
    return Block(levels - 1, row["n_members"], cells)


def _paths(tiers: list[DataFrame], above: DataFrame, height: int) -> DataFrame:
    """Path of every block of the lowest tier; ``above`` has that of every tree's root."""

    def members(table: pa.Table) -> pa.Table:
        row = table.to_pylist()[0]
        first = row["block"] * FAN**height
        same = {"tree": row["tree"], "subroot": row["subroot"], "root": row["root_of_all"]}
        paths = _opened(row).paths(row["lefts"], row["rights"])
        return pa.Table.from_pylist([same | {"block": first + k, "lefts": a, "rights": b} for k, (a, b) in enumerate(paths)], _PATHS)

    paths = None
    for tier in range(len(tiers) - 1, -1, -1):
        tops = _tops(tiers, tier, height).select("tree", "block", F.lower(F.hex("root")).alias("subroot")).join(above, "tree")
        known = tops.select("tree", "block", "lefts", "rights", "subroot", F.coalesce("root", "subroot").alias("root"))
        paths = known if paths is None else known.unionByName(paths)
        if tier:
            blocks = tiers[tier].withColumnRenamed("root", "digest").join(paths.withColumnRenamed("root", "root_of_all"), ["tree", "block"])
            paths = written(blocks.groupBy("tree", "block").applyInArrow(members, PATHS), "manifest-paths")
    return paths


def _beside(rows: DataFrame, tiers: list[DataFrame], above: DataFrame, height: int, make, schema: str) -> DataFrame:
    """``make`` of the rows of every block of the lowest tier, the paths of its places and the block's path row."""

    def whole(rows: pa.Table, blocks: pa.Table) -> pa.Table:
        block = blocks.to_pylist()[0]
        return make(rows, list(zip(_members(rows, height), _opened(block).paths(block["lefts"], block["rights"]))), block)

    blocks = tiers[0].drop("root", "levels").join(_paths(tiers, above, height), ["tree", "block"])
    return _in_blocks(rows, height).groupBy("tree", "block").cogroup(blocks.groupBy("tree", "block")).applyInArrow(whole, schema)


def _shelf_paths(rows: pa.Table, paths: list, block: dict) -> pa.Table:
    names = rows.column("shelf").to_pylist()
    return pa.Table.from_pylist([{"tree": names[k], "lefts": a, "rights": b, "root": block["root"]} for k, (a, b) in paths], _SHELVES)


def _proofs(rows: pa.Table, paths: list, block: dict) -> pa.Table:
    ordinals, leaves, given = (rows.column(c).to_pylist() for c in ("ordinal", "leaf", "presented"))
    out: dict[str, list] = {name: [] for name in _PROOF.names}
    for k, (lefts, rights) in paths:
        folded = fold((given[k] or leaves[k]).hex(), lefts, rights)
        proof = "".join([side for pair in zip(lefts, rights) for side in pair])
        values = (ordinals[k], leaves[k].hex(), block["subroot"], block["root"], proof, folded, folded == block["root"])
        for name, value in zip(out, values):
            out[name].append(value)
    return pa.table(out, schema=_PROOF)


def prove(manifest: Manifest) -> DataFrame:
    """Per leaf its inclusion proof and what it proves: ``ordinal``, ``leaf``, ``subroot``, ``root``, ``proof``, ``folded_root``, ``verified``.

    ``proof``: the siblings' digests, level by level from the leaf over its class's root to the root of all, left to
    right, as one hex text.  ``folded_root``: what the presented leaf (else the leaf) leads to with
    these siblings; ``verified`` when that is ``root``.  Blocks are read from the top tier down, each handing its path to the
    blocks under it; leaves meet their block in groups of at most 4,096.  A manifest without leaves gives no rows.
    """
    spark = manifest.leaves.sparkSession
    if not manifest.tiers:
        return spark.createDataFrame([], PROOF)
    none = F.array().cast("array<string>")
    start = spark.range(1).select(F.lit("").alias("tree"), none.alias("lefts"), none.alias("rights"), F.lit(None).cast("string").alias("root"))
    shelves = written(_beside(manifest.shelves, manifest.top, start, manifest.height, _shelf_paths, SHELVES), "manifest-shelves")
    return _beside(manifest.leaves, manifest.tiers, shelves, manifest.height, _proofs, PROOF)
