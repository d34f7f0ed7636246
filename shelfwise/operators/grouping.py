"""Numbering, first-of-group and top-k that hold when one group is huge.

A plain ``row_number() over (partition by g)`` sends a whole group to one task.
Here a group is cut into blocks of the unique integer ``ordinal`` first, so a
task sees at most ``block`` rows of it, and block offsets come from a small
pre-aggregated table.  ``top_k`` needs none of that: Spark limits every group
inside each input partition before it shuffles.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

BLOCK = 1 << 20


def numbered(
    df: DataFrame, group: Sequence[str], ordinal: str = "ordinal", name: str = "n", block: int = BLOCK
) -> DataFrame:
    """``row_number`` per group in ordinal order, no task holding more than ``block`` rows of a group."""
    keyed = df.withColumn("_block", F.floor(F.col(ordinal) / F.lit(block)))
    keys = [*group, "_block"]
    sizes = keyed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"))
    spans = sizes.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.coalesce(
            F.sum("_size").over(
                Window.partitionBy(*group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
            ),
            F.lit(0),
        ).alias("_offset"),
    )
    local = keyed.withColumn("_local", F.row_number().over(Window.partitionBy(*keys).orderBy(ordinal)))
    on = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    out = local.join(spans, on, "inner")
    return out.withColumn(name, F.col("_local") + F.col("_offset")).select(*df.columns, name)


def running_sum(
    df: DataFrame, group: Sequence[str], ordinal: str, value: Column, name: str, block: int = BLOCK, inclusive: bool = False
) -> DataFrame:
    """Sum of ``value`` over the rows of the group before each row in the order of ``ordinal``, or up to it.

    As in ``numbered`` no task holds more than ``block`` steps of the ordinal; rows of equal ordinal may come in any order.
    """
    keyed = df.withColumns({"_value": value, "_block": F.floor(F.col(ordinal) / F.lit(block))})
    keys = [*group, "_block"]
    before = Window.partitionBy(*group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = keyed.groupBy(*keys).agg(F.sum("_value").alias("_sum"))
    spans = sums.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*keys).orderBy(ordinal).rowsBetween(Window.unboundedPreceding, Window.currentRow if inclusive else -1)
    local = keyed.withColumn("_local", F.coalesce(F.sum("_value").over(inside), F.lit(0)))
    out = local.join(spans, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
    return out.withColumn(name, F.col("_local") + F.col("_offset")).select(*df.columns, name)


def ranked(
    df: DataFrame,
    group: Sequence[str],
    score: str,
    ordinal: str = "ordinal",
    name: str = "rank",
) -> DataFrame:
    """``row_number`` per group by score descending, then ordinal, whatever the scores are.

    The keys alone are sorted over all tasks by sampled ranges of (group, score, ordinal), so a group of any size is cut where its
    rows lie, and written with the task they fell into.  Places are counted inside a task's part of a group and moved on
    by the parts before it, a table of one row per task and group.  ``ordinal`` is unique, and each row fetches its rank by it once.
    """
    keys = list(group)
    order = [*[F.asc_nulls_first(k) for k in keys], F.desc(score), F.asc(ordinal)]
    slim = df.select(*keys, score, ordinal).repartitionByRange(*order)
    placed = written(slim.withColumn("_part", F.spark_partition_id()))
    sizes = placed.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    spans = sizes.select(*[F.col(k).alias(f"_k_{k}") for k in (*keys, "_part")], F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    local = placed.withColumn("_local", F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(F.desc(score), ordinal)))
    moved = local.join(spans, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in (*keys, "_part")])
    ranks = moved.select(F.col(ordinal).alias("_k_ordinal"), (F.col("_local") + F.col("_offset")).alias(name))
    return df.drop(name).join(ranks, F.col(ordinal) == F.col("_k_ordinal")).drop("_k_ordinal")


def top_k(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, name: str = "rank") -> DataFrame:
    """Best ``k`` rows per group; planned as a group limit before and after the shuffle."""
    place = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn(name, place).where(F.col(name) <= k)


def first_of(
    df: DataFrame, key: Sequence[str], ordinal: str | Sequence[str] = "ordinal", copies: str = "copies"
) -> DataFrame:
    """First row per key in the order of ``ordinal`` (one column or several), with the number of rows of that key.

    One aggregate reads the rows once; each task keeps one row per key before
    the shuffle, so a key held by a third of all rows costs no more than any
    other.  Rows without a key are one group.
    """
    order = [ordinal] if isinstance(ordinal, str) else list(ordinal)
    rest = [c for c in df.columns if c not in key]
    row = F.min_by(F.struct(*rest), F.struct(*order)) if rest else F.lit(None)
    found = df.groupBy(*key).agg(row.alias("_row"), F.count(F.lit(1)).alias(copies))
    return found.select(*[c if c in key else F.col(f"_row.{c}").alias(c) for c in df.columns], copies)


def with_group_value(
    df: DataFrame, small: DataFrame, keys: Sequence[str], how: str = "left", salts: int = 16
) -> DataFrame:
    """Join a per-group table to rows of possibly hot groups.

    No broadcast hint: Spark broadcasts ``small`` when its measured size is
    under the threshold.  Above it the rows of every key are spread over
    ``salts`` shuffle keys and the one small row per key is repeated as often.
    A null key meets a null key.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*_hashable(df)), F.lit(salts)).cast("int"))
    spread = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    named = spread.withColumnsRenamed({k: f"_k_{k}" for k in (*keys, "_salt")})
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys] + [F.col("_salt") == F.col("_k__salt")]
    return salted.join(named, same, how).drop("_salt", *[f"_k_{k}" for k in (*keys, "_salt")])


def _hashable(df: DataFrame) -> list[str]:
    """Cheap columns to spread rows by: the ordinal where there is one."""
    if "ordinal" in df.columns:
        return ["ordinal"]
    plain = [n for n, t in df.dtypes if not t.startswith(("map", "variant", "array", "struct"))]
    return plain[:8]
