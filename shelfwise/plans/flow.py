"""Whole pipelines as single lazy plans."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.candidates import detail_candidates, item_candidates, item_identity
from ..operators.content import analyze, attach_analysis
from ..operators.details import attach_details, related_details
from ..operators.filters import filter_by_tags
from ..operators.intents import RequestLexicon, parse_intents, plan_tasks, ranking_profile
from ..operators.library import classify_library, index_outcomes, index_upsert, library_paths
from ..operators.ranking import complete_intents, score_for, select_options, selection_summary
from ..operators.rollups import ambiguous_dimensions, facet_counts
from ..operators.sets import source_first


def ready_intents(requests: DataFrame, lex: RequestLexicon | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(ready intents with ranking profile, tasks, requests that need an answer first)."""
    parsed = parse_intents(requests, lex)
    unclear = parsed.where(F.col("status") == "needs_clarification").select(
        "intent_id", "query", "missing_slots", "clarifying_questions"
    )
    ready = ranking_profile(parsed.where(F.col("status") == "ready"), lex)
    return ready, plan_tasks(parsed, lex), unclear


def request_flow(
    intents: DataFrame,
    local: DataFrame,
    site: DataFrame,
    web: DataFrame,
    files: DataFrame | None = None,
    *,
    k: int = 5,
    enough_local: int = 5,
    enough: int = 8,
    include_low: bool = False,
    analysis: Mapping[str, object] | None = None,
    scoring: Mapping[str, object] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(options, per-request summary) from assigned candidates of three sources."""
    merged = source_first(local, site, web, enough_local, enough)
    analysed = analyze(merged, files, **(analysis or {}))
    scored = score_for(analysed, complete_intents(intents), **(scoring or {}))
    return select_options(scored, k, include_low), selection_summary(scored, k, include_low)


def site_search_flow(
    items: DataFrame,
    details: DataFrame,
    query: Column | str = "",
    filters: Mapping[str, object] | None = None,
    group: Sequence[str] = ("query_id",),
) -> dict[str, DataFrame]:
    """Search items to file candidates: tag filter, identity, detail lookup, files, facets.

    ``items`` has an ordinal, the group columns, ``item`` (variant) and a
    ``version`` tag; ``details`` has ``detail_key`` and ``detail`` (a resource struct).
    """
    kept = filter_by_tags(items, (filters or {}).get("version"), list(group))
    known = item_identity(kept)
    looked_up = attach_details(known, details)
    found = looked_up.where(F.col("detail").isNotNull())
    resources = related_details(found.select("ordinal", F.col("detail_key").alias("detail_id"), "detail.*"))
    files = detail_candidates(resources, filters)
    fallback = item_candidates(looked_up.where(F.col("detail").isNull()), query, filters)
    dims = ["stage", "grade", "subject", "version", "volume", "resource_type", "format", "provider"]
    both = files.unionByName(fallback.select(*[c for c in files.columns if c in fallback.columns]), allowMissingColumns=True)
    return {
        "candidates": both,
        "lookups": looked_up,
        "facets": facet_counts(both, dims),
        "ambiguity": ambiguous_dimensions(both, filters),
    }


def library_chain(
    fetched: DataFrame, files: DataFrame, index: DataFrame, now: Column | str, threshold: float = 0.55, root: str = ""
) -> dict[str, DataFrame]:
    """Fetched files to organized files to the new index."""
    analysed = analyze(fetched, files)
    joined = attach_analysis(fetched, analysed)
    organized = library_paths(classify_library(joined, threshold), threshold, root)
    outcomes = index_outcomes(index, organized)
    fresh, duplicates = index_upsert(index, organized, now, outcomes=outcomes)
    return {"organized": organized, "outcomes": outcomes, "index": fresh, "duplicates": duplicates}
