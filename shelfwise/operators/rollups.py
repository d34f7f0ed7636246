"""Facets, coverage, probe matrix, scan and status roll-ups.

All are plain aggregates with a map-side combine: whatever a third of the rows
share, every task sends at most one row per group.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions.text import blank_to_null
from . import details as D

STATUSES = [
    "ok_with_file_items", "ok_no_file_items", "requires_auth", "not_found", "detail_not_found_in_dir",
    "missing_resource_id", "request_failed", "invalid_json", "unknown",
]
GROUP = ["tab_code", "resource_type", "resource_type_name", "catalog", "sub_catalog", "content_type"]
AMBIGUITY_FIELDS = ["grade", "subject", "version", "volume", "resource_type", "provider"]


def facet_counts(df: DataFrame, dims: Sequence[str], group: Sequence[str] = (), drop_blank: bool = False) -> DataFrame:
    """Long rows (dimension, value, n); blank values count as ``unknown`` or are dropped.

    The dimensions are unpivoted before one aggregation, so the table is read once.
    """
    named = df.select(*group, *[blank_to_null(d).alias(d) for d in dims])
    long = named.unpivot(list(group), list(dims), "dimension", "value")
    long = long.where(F.col("value").isNotNull()) if drop_blank else long.fillna({"value": "unknown"})
    return long.groupBy(*group, "dimension", "value").agg(F.count(F.lit(1)).alias("n"))


def ordered_facets(counts: DataFrame) -> DataFrame:
    return counts.orderBy("dimension", F.desc("n"), "value")


def route_coverage(routes: DataFrame) -> DataFrame:
    """Counts of seven route facets in one pass; commands are an array facet,
    sub-catalogs count only where set."""
    facets = {
        "catalogs": F.coalesce(blank_to_null("catalog"), F.lit("unknown")),
        "sub_catalogs": blank_to_null("sub_catalog"),
        "types": F.coalesce(blank_to_null("type"), F.lit("unknown")),
        "resource_families": F.coalesce(blank_to_null("resource_family"), F.lit("unknown")),
        "scan_strategies": F.coalesce(blank_to_null("scan_strategy"), F.lit("unknown")),
        "search_tab_codes": F.coalesce(blank_to_null("search_tab_code"), F.lit("unknown")),
    }
    pairs = [F.struct(F.lit(n).alias("dimension"), v.alias("value")) for n, v in facets.items()]
    commands = F.transform(
        "supported_commands", lambda c: F.struct(F.lit("supported_commands").alias("dimension"), c.alias("value"))
    )
    rows = routes.select(F.explode(F.concat(F.array(*pairs), commands)).alias("_f")).select("_f.*")
    return rows.where(F.col("value").isNotNull()).groupBy("dimension", "value").agg(F.count(F.lit(1)).alias("n"))


def ambiguous_dimensions(
    df: DataFrame, filters: Mapping[str, object] | None = None, dims: Sequence[str] = AMBIGUITY_FIELDS, group: Sequence[str] = ()
) -> DataFrame:
    """Dimensions without a filter that hold more than one value, with that number."""
    open_dims = [d for d in dims if not (filters or {}).get(d)]
    facets = facet_counts(df, open_dims, group, drop_blank=True)
    counted = facets.groupBy(*group, "dimension").agg(F.count(F.lit(1)).alias("n_values"))
    return counted.where(F.col("n_values") > 1)


def status_counts(df: DataFrame, status: str, group: Sequence[str] = ()) -> DataFrame:
    return facet_counts(df.withColumn("status", F.col(status)), ["status"], group)


def probe_matrix(probes: DataFrame, group: Sequence[str] = GROUP, statuses: Sequence[str] = STATUSES, samples: int = 5) -> DataFrame:
    """Per group: probes, status and policy counts, item sums, first ids and a verdict.

    The first ``samples`` distinct ids by ordinal come from a group limit over
    (group, id) first places, not from a collected list of all ids.
    """
    from .grouping import top_k

    named = probes.withColumns({g: F.coalesce(blank_to_null(g), F.lit("")) for g in group})
    counts = {s: F.count_if(F.col("detail_status") == s) for s in statuses}
    summed = named.groupBy(*group).agg(
        F.count(F.lit(1)).alias("search_items_seen"),
        *[c.alias(s) for s, c in counts.items()],
        F.count_if(F.col("detail_access_policy") == "public_detail").alias("public_detail"),
        F.count_if(F.col("detail_access_policy") == "requires_auth_context").alias("requires_auth_context"),
        F.sum("file_item_count").cast("bigint").alias("file_item_count"),
        F.sum("parsed_candidate_count").cast("bigint").alias("parsed_candidate_count"),
    )
    verdict = D.conclusion({s: F.col(s) for s in statuses}, F.col("requires_auth_context"))
    judged = summed.withColumn("conclusion", verdict)
    ids = named.where(blank_to_null("resource_id").isNotNull()).groupBy(*group, "resource_id").agg(F.min("ordinal").alias("_at"))
    first = top_k(ids, group, [F.col("_at")], samples, "_n")
    sample = first.groupBy(*group).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_n", "resource_id"))), lambda s: s["resource_id"]).alias("sample_resource_ids")
    )
    out = judged.join(sample, list(group), "left")
    none = F.array().cast("array<string>")
    return out.withColumn("sample_resource_ids", F.coalesce("sample_resource_ids", none))


def scan_summary(results: DataFrame) -> DataFrame:
    """Totals over route results: one row per probe with route, status, kind and counts."""
    return results.agg(
        F.countDistinct("route_id").alias("routes_scanned"),
        F.count(F.lit(1)).alias("search_items_seen"),
        F.count_if(F.col("detail_status").isin(L.PROBE_OK)).alias("candidates"),
        F.count_if(~F.col("detail_status").isin(L.PROBE_OK)).alias("detail_failures"),
        F.sum("file_item_count").cast("bigint").alias("detail_items_seen"),
        *[F.count_if(F.col("detail_status") == s).alias(s) for s in STATUSES],
    )


def detail_coverage(results: DataFrame, key: Sequence[str] = ("route_id",)) -> DataFrame:
    """The same per route; routes without any detail row do not appear."""
    return (
        results.where(blank_to_null("detail_status").isNotNull())
        .groupBy(*key)
        .agg(
            F.count(F.lit(1)).alias("search_items_seen"),
            F.count_if(F.col("detail_status").isin(L.PROBE_OK)).alias("details_fetched"),
            F.count_if(~F.col("detail_status").isin(L.PROBE_OK)).alias("detail_failures"),
            F.sum("file_item_count").cast("bigint").alias("detail_items_seen"),
            *[F.count_if(F.col("detail_status") == s).alias(s) for s in STATUSES],
        )
    )


def first_accessible(probes: DataFrame, option: Sequence[str] = ("option_id",), attempt: str = "attempt") -> DataFrame:
    """Per option: the first URL that answered, whether any did, and how many were tried."""
    ok = F.col("ok")
    return probes.groupBy(*option).agg(
        F.min_by(F.when(ok, F.col("url")), F.when(ok, F.col(attempt))).alias("source_url"),
        F.bool_or(ok).alias("accessible"),
        F.count(F.lit(1)).alias("attempts"),
    )


def attempt_urls(source_url: Column, url_candidates: Column, download_url: Column, page_url: Column) -> Column:
    """Distinct URLs to try for an option, in order."""
    urls = F.concat(F.array(source_url), F.coalesce(url_candidates, F.array().cast("array<string>")), F.array(download_url, page_url))
    return F.array_distinct(F.filter(urls, lambda u: u.isNotNull() & (u != "")))


def source_runs(candidates: DataFrame, status: str | None = None) -> DataFrame:
    """Candidates per source (and status), with how many are official and downloadable."""
    keys = ["source"] + ([status] if status else [])
    return candidates.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("candidate_count"),
        F.count_if(F.coalesce("official", F.lit(False))).alias("official_count"),
        F.count_if(F.coalesce("downloadable", F.lit(False))).alias("downloadable_count"),
    )
