"""Discovery of promising sources among search results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions.columns import let
from ..functions.infer import DIRECT_SUFFIX, HINT_SUFFIX
from ..functions.match import compact, contains_any, count_hits, hits, labels
from ..functions.text import blank_to_null, stable_id, text_blob
from ..functions.urls import host, path
from ..session import written
from .grouping import with_group_value
from .search import containment_pairs


def known_source(url_host: Column, url_path: Column, sources: Sequence[tuple[str, str, str, str]] = L.KNOWN_SOURCES) -> Column:
    """``struct<adapter,reason>`` of the first rule whose host and path parts occur, else null.

    Rules are literals: no join, however many pages one host has; ``known_sources`` takes a table of them."""
    out = F
    for host_part, path_part, adapter, reason in sources:
        test = F.contains(url_host, F.lit(host_part)) & F.contains(url_path, F.lit(path_part))
        out = out.when(test, F.struct(F.lit(adapter).alias("adapter"), F.lit(reason).alias("reason")))
    return out.otherwise(F.lit(None)) if sources else F.lit(None).cast("struct<adapter:string,reason:string>")


def known_sources(items: DataFrame, rules: DataFrame, url_host: str = "host", url_path: str = "path") -> DataFrame:
    """Adds ``adapter`` and ``reason`` of the first rule of a table whose host and path parts occur in the item's, else null.

    ``rules``: ``rule`` (its rank), ``host_part``, ``path_part``, ``adapter``, ``reason``; a blank part fits everything, a null one
    nothing.  For as many rules as there are: distinct hosts meet distinct host parts on short grams, distinct paths the path parts,
    and what a (host, path) pair holds meets the rules by both parts at once.  Only distinct pairs are judged, so a
    host's number of items costs nothing; items take the answer of their pair over salts.  A null host or path is empty.
    """
    named = {"_host": F.coalesce(F.col(url_host), F.lit("")), "_path": F.coalesce(F.col(url_path), F.lit(""))}
    whole = items.withColumns(named)
    pairs = written(whole.select("_host", "_path").distinct())
    parts = ["host_part", "path_part"]
    given = rules.where("host_part is not null and path_part is not null")
    best = given.groupBy(*parts).agg(F.min("rule").alias("rule"), F.min_by(F.struct("adapter", "reason"), "rule").alias("_told"))
    held = pairs
    for text, part in (("_host", "host_part"), ("_path", "path_part")):
        texts = pairs.select(text).distinct()
        found = containment_pairs(texts, text, given.where(F.col(part) != ""), part)
        held = held.join(found.unionByName(texts.withColumn(part, F.lit(""))), text)
    first = held.join(best, parts).groupBy("_host", "_path").agg(F.min_by("_told", "rule").alias("_known"))
    told = with_group_value(whole, first, ["_host", "_path"])
    kept = [c for c in items.columns if c not in ("adapter", "reason")]
    return told.select(*kept, F.col("_known.adapter").alias("adapter"), F.col("_known.reason").alias("reason"))


def source_discovery(
    items: DataFrame,
    min_score: float = 3.0,
    *,
    resource_terms: Sequence[str] = L.RESOURCE_TERMS,
    direct_formats: Sequence[str] = L.DIRECT_FORMATS,
    video_terms: Sequence[str] = L.VIDEO_TERMS,
    article_terms: Sequence[str] = L.ARTICLE_TERMS,
    risk_terms: Sequence[str] = L.SOURCE_RISK_TERMS,
    auth_terms: Sequence[str] = L.AUTH_WALL_TERMS,
    official_hosts: Sequence[str] = L.OFFICIAL_HOST_HINTS,
    format_rules=L.DISCOVERY_FORMAT_RULES,
    type_rules=L.DISCOVERY_TYPE_RULES,
    sources: Sequence[tuple[str, str, str, str]] = L.KNOWN_SOURCES,
) -> DataFrame:
    """Class, five scores, hints, next action and ``accepted`` per source.

    Needs ``source_url``; title, description, resource_type, format,
    source_name and ``source_warnings`` are read where present.  All scores are
    whole numbers of ten-thousandths, so no rounding depends on binary floats.
    """
    have = items.columns
    fields: list[Column | str] = [c for c in ("title", "description", "resource_type", "format", "source_name") if c in have]
    fields.append("source_url")
    if "source_warnings" in have:
        fields.append(F.array_join("source_warnings", " "))
    url = F.trim("source_url")
    base = let(items, {"source_url": url, "_blob": text_blob(*fields), "_lower": F.lower(url)}).where("source_url <> ''")
    based = let(base, {"host": host("source_url"), "_path": path("source_url")})
    blob, lower = F.col("_blob"), F.col("_lower")
    suffix = blank_to_null(F.regexp_extract(lower, HINT_SUFFIX, 1))
    hinted = let(
        based,
        {
            "_known": known_source(F.col("host"), F.col("_path"), sources),
            "resource_format_hints": F.array_distinct(
                F.concat(compact([suffix]), hits(blob, direct_formats), labels(blob, format_rules))
            ),
            "resource_type_hints": labels(blob, type_rules),
            "_risks": hits(blob, risk_terms),
            "_terms": count_hits(blob, resource_terms),
        },
    )
    terms, risky = F.col("_terms"), F.size("_risks") > 0
    source_type = (
        F.when(risky, "download_risk")
        .when(F.col("_known").isNotNull(), "known_source")
        .when(F.regexp_like(lower, F.lit(DIRECT_SUFFIX)), "resource_page")
        .when(contains_any(blob, video_terms), "video_page")
        .when(terms >= 2, "resource_site")
        .when(terms == 1, "resource_page")
        .when(contains_any(blob, article_terms), "article_page")
        .otherwise("unknown")
    )
    typed = let(hinted, {"source_type": source_type, "_walled": contains_any(blob, auth_terms), "_official": contains_any("host", official_hosts)})
    kind = F.col("source_type")
    action = (
        F.when(kind == "download_risk", "reject")
        .when(kind == "known_source", "use_known_source_skill")
        .when(kind == "resource_page", "extract_direct_candidates")
        .when(kind.isin("video_page", "resource_site"), "profile_site")
        .otherwise("keep_as_web_candidate")
    )
    walled, official = F.col("_walled"), F.col("_official")
    acted = let(
        typed,
        {
            "next_action": action,
            "_authority": F.when(official, 80).otherwise(30),
            "_density": F.least(terms * 20 + F.size("resource_format_hints") * 15, F.lit(100)),
            "_access": F.lit(70) - F.when(walled, 30).otherwise(0) + F.when(kind == "resource_page", 10).otherwise(0),
            "_safety": F.greatest(F.lit(100) - F.size("_risks") * 40, F.lit(0)),
        },
    )
    start = F
    for name, points in L.SOURCE_BASE_SCORE.items():
        start = start.when(kind == name, int(float(points) * 1000))
    thousandths = (
        start.otherwise(2000)
        + F.col("_authority") * 25
        + F.col("_density") * 35
        + F.col("_access") * 20
        + F.col("_safety") * 20
    )
    cents = F.floor((thousandths + 5) / 10)
    cents = F.when(kind == "download_risk", F.least(cents, F.lit(200))).otherwise(cents)
    cents = F.least(cents, F.lit(1000))
    known = F.col("_known")
    accepted = (F.col("next_action") != "reject") & (cents >= int(round(min_score * 100)))
    scored = let(acted, {"_cents": cents.cast("int"), "accepted": accepted}).withColumns(
        {
            "source_id": stable_id("source_url"),
            "source_score": F.col("_cents") / F.lit(100.0),
            "authority_score": F.col("_authority") / F.lit(10.0),
            "resource_density_score": F.col("_density") / F.lit(10.0),
            "accessibility_score": F.col("_access") / F.lit(10.0),
            "risk_score": F.col("_safety") / F.lit(10.0),
            "known_skill": F.coalesce(known["adapter"], F.lit("")),
            "reasons": compact(
                [
                    F.when(official, F.lit("来源域名具备教育或官方属性")),
                    F.when(F.col("_density") >= 50, F.lit("页面包含较多资源信号")),
                    known["reason"],
                ]
            ),
            "warnings": F.concat(
                compact([F.when(walled, F.lit("可能需要登录或付费"))]),
                F.transform("_risks", lambda t: F.concat(F.lit("包含风险词："), t)),
            ),
        }
    )
    return scored.drop(*[c for c in scored.columns if c.startswith("_")])


def top_sources(discovered: DataFrame, k: int = 20, ordinal: str = "ordinal") -> DataFrame:
    """Best ``k`` accepted sources of the whole table, planned as a top-n per partition and one merge."""
    return discovered.where("accepted").orderBy(F.desc("source_score"), ordinal).limit(k)


def discovery_summary(discovered: DataFrame, k: int = 20) -> DataFrame:
    accepted = F.count_if(F.col("accepted"))
    return discovered.agg(
        F.count(F.lit(1)).alias("input"),
        F.least(accepted, F.lit(k)).alias("sources"),
        F.count_if(~F.col("accepted")).alias("rejected"),
        F.count_if(F.col("accepted") & (F.col("source_type") == "known_source")).alias("known_sources"),
        F.count_if(F.col("accepted") & (F.col("next_action") == "profile_site")).alias("profile_candidates"),
    )


def profile_summary(profiles: DataFrame) -> DataFrame:
    return profiles.agg(
        F.count(F.lit(1)).alias("profiled"),
        F.count_if(F.col("crawl_strategy") == "dedicated_source_skill").alias("dedicated_source_recommended"),
        F.count_if(F.col("crawl_strategy") == "generic_extract").alias("generic_extract_recommended"),
    )

