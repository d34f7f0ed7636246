"""Union of sources in priority order, and fallback to later sources."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .grouping import first_of, with_group_value

SOURCE_STEP = 1 << 56


def union_sources(*sources: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """Concatenate sources; the place of a source is the high part of the ordinal,
    so earlier sources win ties and first-wins deduplication."""
    out = None
    for place, source in enumerate(sources):
        ranked = source.withColumns(
            {"source_priority": F.lit(place), ordinal: F.col(ordinal) + F.lit(place * SOURCE_STEP)}
        )
        out = ranked if out is None else out.unionByName(ranked, allowMissingColumns=True)
    return out


def dedupe_first(df: DataFrame, key: Sequence[str], ordinal: str = "ordinal") -> DataFrame:
    """First row per key with the number of copies (see ``grouping.first_of``)."""
    return first_of(df, key, ordinal)


def _counts(df: DataFrame, key: str, name: str, counts: Column) -> DataFrame:
    return df.groupBy(key).agg(F.count_if(counts).alias(name))


def source_first(
    local: DataFrame,
    site: DataFrame,
    web: DataFrame,
    enough_local: int = 5,
    enough: int = 8,
    key: str = "intent_id",
    min_score: float | None = None,
    score: str = "score",
    always_site: bool = False,
) -> DataFrame:
    """Local rows always; site rows of requests whose local rows are too few; web
    rows of requests still short after that.

    Counting is a map-side combine per source.  Later sources lose the
    satisfied requests in a join on a table of one row per request; what passes
    through is never gathered per request.  ``min_score`` counts only rows that
    reach it.
    """
    good = F.lit(True) if min_score is None else F.col(score) >= min_score
    n_local = _counts(local, key, "n_local", good)
    n_site = _counts(site, key, "n_site", good)
    need = n_local.join(n_site, key, "full_outer").fillna(0, ["n_local", "n_site"])
    open_site = F.lit(True) if always_site else (F.col("n_local") < enough_local) | (F.col("n_local") < enough)
    used_site = F.when(open_site, F.col("n_site")).otherwise(F.lit(0))
    plan = need.select(key, open_site.alias("_site"), (F.col("n_local") + used_site < enough).alias("_web"))

    def passing(rows: DataFrame, flag: str) -> DataFrame:
        joined = with_group_value(rows, plan.select(key, flag), [key])
        return joined.where(F.coalesce(flag, F.lit(True))).drop(flag)

    return union_sources(local, passing(site, "_site"), passing(web, "_web"))


def gate_by_count(rows: DataFrame, enough: int, key: str = "intent_id") -> DataFrame:
    """Per request: rows so far and whether they are enough."""
    counted = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("enough", F.col("n") >= enough)
