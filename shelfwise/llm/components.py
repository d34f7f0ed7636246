"""Connected components of a graph given as edges, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import written


def _oriented(edges: DataFrame) -> DataFrame:
    """Each edge once, from its larger to its smaller node."""
    return edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node moves to the smallest node around it."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    smallest = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.where("v > u").join(smallest, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node itself, moves to the smallest of them."""
    smallest = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(smallest, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(smallest.select(F.col("u").alias("a"), F.col("m").alias("b")))


def component_stars(edges: DataFrame) -> DataFrame:
    """``u``, ``v``: every node that is not the smallest of its component, with the smallest.

    ``edges``: ``a``, ``b`` (long, not null), in any direction and number; loops are ignored.  Neighbours are only ever
    reduced to their smallest with a combine before the shuffle, so a node
    with very many neighbours is never gathered.  Each round is a written table; rounds grow with the
    logarithm of the longest path.
    """
    now = written(_oriented(edges), "stars")
    mark = None
    while True:
        row = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (row.n, row.h) == mark or not row.n:
            return now
        mark = (row.n, row.h)
        now = written(_oriented(_small_star(_oriented(_large_star(now)))), "stars")
