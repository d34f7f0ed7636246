"""Filters and predicates on records, items, routes and options."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions.match import contains_any
from ..functions.text import as_col, blank_to_null, grade_to_chinese
from ..functions.urls import suffix
from .grouping import with_group_value


def filter_records(
    records: DataFrame, query: str | None = None, limit: int | None = None, ordinal: str = "ordinal", **fields: str | None
) -> DataFrame:
    """Query as a case-folded part of the record, every field filter as a part of its field."""
    tests = []
    if query and query.strip():
        shown = [F.array_join(n, " ") if t == "array<string>" else F.col(n).cast("string")
                 for n, t in records.dtypes if n != ordinal and (t == "array<string>" or "<" not in t)]
        tests.append(F.contains(F.lower(F.concat_ws(" ", *shown)), F.lit(query.strip().lower())))
    tests += [F.contains(F.coalesce(F.col(n), F.lit("")), F.lit(v)) for n, v in fields.items() if v]
    rows = records.where(reduce(and_, tests)) if tests else records
    return rows.orderBy(ordinal).limit(limit) if limit else rows


def tag_matches(actual: Column, expected: Column) -> Column:
    """Equal, equal as Chinese grades, or either is part of the other."""
    return (
        (actual == expected)
        | (grade_to_chinese(actual) == grade_to_chinese(expected))
        | F.contains(actual, expected)
        | F.contains(expected, actual)
    )


def filter_by_tags(items: DataFrame, expected_version: Column | str | None, group: Sequence[str], tag: str = "version") -> DataFrame:
    """Drop items whose version tag contradicts the wanted one; untagged items
    stay; a group left empty keeps everything.

    Only the version drops items: grade, volume and stage mismatches are left
    to ranking.  Whether a group kept anything is a map-side combined flag, so
    a hot group is never gathered.
    """
    if expected_version is None:
        return items
    wanted = F.lit(expected_version) if isinstance(expected_version, str) else expected_version
    actual = blank_to_null(tag)
    keep = wanted.isNull() | actual.isNull() | tag_matches(actual, wanted)
    flagged = items.withColumn("_keep", keep)
    survived = flagged.groupBy(*group).agg(F.bool_or("_keep").alias("_any"))
    joined = with_group_value(flagged, survived, group, "inner")
    return joined.where(F.col("_keep") | ~F.col("_any")).select(*items.columns)


def select_routes(
    routes: DataFrame,
    route_id: str | None = None,
    catalog: str | None = None,
    sub_catalog: str | None = None,
    type: str | None = None,  # noqa: A002
    title: str | None = None,
    limit: int = 0,
    ordinal: str = "ordinal",
) -> DataFrame:
    """Equality on id, catalog, sub-catalog and type, containment on title; ``limit`` 0 keeps all."""
    wanted = {"route_id": route_id, "catalog": catalog, "sub_catalog": sub_catalog, "type": type}
    for name, value in wanted.items():
        if value:
            routes = routes.where(F.col(name) == value)
    if title:
        routes = routes.where(F.contains("title", F.lit(title)))
    return routes.orderBy(ordinal).limit(limit) if limit > 0 else routes


def should_skip(
    requires_auth: Column,
    warnings: Column,
    allow_auth: bool = False,
    auth_context: bool = False,
    risk_terms: Sequence[str] = L.SKIP_RISK_TERMS,
) -> Column:
    """Reason not to fetch an option, else null."""
    auth = F.coalesce(requires_auth, F.lit(False))
    return (
        F.when(auth & F.lit(not allow_auth), F.lit("需要登录或授权访问"))
        .when(auth & F.lit(not auth_context), F.lit("需要授权上下文"))
        .when(F.exists(warnings, lambda w: contains_any(w, risk_terms)), F.lit("候选存在风险提示"))
    )


def block_library_suffix(files: DataFrame, file: str = "library_file", blocked: Sequence[str] = L.BLOCKED_SUFFIXES) -> DataFrame:
    return files.where(~suffix(file).isin(list(blocked)))


def drop_missing(index: DataFrame, files: DataFrame, include_missing: bool = False, key: str = "library_file") -> DataFrame:
    """Adds ``file_exists``; records without a file are dropped unless wanted.

    Without missing records this is a left semi join: nothing of the listing is shuffled but its key."""
    listing = files.select(F.col(key).alias("_key"))
    if not include_missing:
        return index.join(listing, F.col(key) == F.col("_key"), "left_semi").withColumn("file_exists", F.lit(True))
    marked = listing.distinct().withColumn("_there", F.lit(True))
    joined = index.join(marked, F.col(key) == F.col("_key"), "left")
    return joined.withColumn("file_exists", F.coalesce("_there", F.lit(False))).drop("_key", "_there")


def visible_levels(ranked: DataFrame, include_low: bool = False, level: str = "quality_level") -> DataFrame:
    return ranked.where(is_visible(F.col(level), include_low))


def is_visible(level: Column | str, include_low: bool = False) -> Column:
    return as_col(level).isin(["excellent", "high", "medium"] + (["low"] if include_low else []))


def page_slice(df: DataFrame, offset: int, limit: int, ordinal: str = "ordinal") -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` by ordinal (top-n per partition, then one merge)."""
    return df.orderBy(ordinal).offset(offset).limit(limit)


