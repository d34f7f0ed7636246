"""Normalization of every source to one candidate schema.

Each operator is one projection (plus an explode where the source nests), so
it fuses with the scan; only first-wins deduplication shuffles.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions.columns import let
from ..functions.infer import (
    detail_format,
    detail_resource_type,
    filter_col,
    infer_context_field,
    infer_format,
    infer_resource_type,
    infer_subject,
    infer_topic,
    item_format,
    link_confidence,
    metadata_confidence,
)
from ..functions.match import compact, contains_any, hits
from ..functions.text import as_col, blank_to_null, clean_inline, clean_text, first_value, stable_id
from ..functions.urls import clean_ref, ext, file_title, host, resolve
from . import details as D
from .grouping import first_of

Filters = Mapping[str, object] | None
UNTITLED = L.UNTITLED_LINK


def load_search_results(df: DataFrame, strict: bool = False) -> DataFrame:
    """Fold aliases of url, title and snippet; drop rows without url (and title, when strict)."""

    def folded(*names: str) -> Column:
        present = [blank_to_null(n) for n in names if n in df.columns]
        return F.coalesce(*present) if present else F.lit(None).cast("string")

    known = {"url", "link", "href", "source_url", "title", "name", "snippet", "description", "summary"}
    folds = {
        "url": folded("url", "link", "href", "source_url"),
        "title": folded("title", "name"),
        "snippet": F.coalesce(folded("snippet", "description", "summary"), F.lit("")),
    }
    others = [c for c in df.columns if c not in known]
    rows = let(df, folds).select(*others, *folds).where(F.col("url").isNotNull())
    return rows.where(F.col("title").isNotNull()) if strict else rows.fillna({"title": ""})


def web_candidates(
    results: DataFrame,
    filters: Filters = None,
    *,
    type_rules=L.WEB_TYPE_RULES,
    subject_rules=L.WEB_SUBJECT_RULES,
    risk_terms: Sequence[str] = L.WEB_RISK_TERMS,
    auth_terms: Sequence[str] = L.AUTH_WALL_TERMS,
    official_hints: Sequence[str] = L.OFFICIAL_HINTS,
) -> DataFrame:
    """Search results (url, title, snippet) to candidates."""
    base = let(results, {"_text": F.concat_ws(" ", "title", "snippet", "url"), "_host": host("url")})
    lowered = let(base, {"_low": F.lower("_text")})
    formatted = let(lowered, {"format": infer_format("_low")})
    text, low, fmt = F.col("_text"), F.col("_low"), F.col("format")
    subject, domain = infer_subject(low, subject_rules)
    typed = let(
        formatted, {"resource_type": infer_resource_type(low, fmt, type_rules, L.WEB_TYPE_BY_FORMAT, "网页")}
    )
    return typed.withColumns(
        {
            "source": F.lit(L.WEB_SOURCE),
            "source_name": F.coalesce(blank_to_null("_host"), F.lit(L.WEB_SOURCE_NAME)),
            "source_url": F.col("url"),
            "resource_id": stable_id("url"),
            "description": F.col("snippet"),
            "stage": infer_context_field(filter_col(filters, "stage"), low),
            "grade": infer_context_field(filter_col(filters, "grade"), low),
            "subject": subject,
            "learning_domain": domain,
            "version": infer_context_field(filter_col(filters, "version"), low),
            "volume": infer_context_field(filter_col(filters, "volume"), low),
            "topic": infer_topic(filter_col(filters, "core_topic", "topic"), low),
            "provider": F.col("_host"),
            "official": contains_any(text, official_hints) | contains_any("_host", official_hints),
            "downloadable": ~fmt.isin("html", "video", "audio"),
            "requires_auth": contains_any(text, auth_terms),
            "size": F.lit(None).cast("long"),
            "source_warnings": F.transform(hits(text, risk_terms), lambda t: F.concat(F.lit("包含风险词："), t)),
            "metadata_confidence": metadata_confidence("title", "url", "snippet", "resource_type", "format"),
        }
    ).drop("_text", "_low", "_host", "url", "snippet")


def link_candidates(
    links: DataFrame,
    filters: Filters = None,
    include_non_generic: bool = False,
    *,
    keys: Sequence[str] = ("page_id",),
    ordinal: str = "ordinal",
    extensions: Sequence[str] = L.LINK_EXTENSIONS,
    type_rules=L.LINK_TYPE_RULES,
    subject_rules=L.LINK_SUBJECT_RULES,
    auth_terms: Sequence[str] = L.LINK_AUTH_TERMS,
    official_hints: Sequence[str] = L.LINK_OFFICIAL_HINTS,
) -> DataFrame:
    """Profile links to candidates, first row per URL.

    ``links`` holds one row per (profile, link): ``source_url`` of the page,
    ``page_title``, ``crawl_strategy``, ``auth_hints``, ``warnings``,
    ``raw_url``, ``raw_format``, ``raw_text`` and a unique long ``ordinal``.
    """
    generic = links if include_non_generic else links.where(F.col("crawl_strategy") == "generic_extract")
    wanted = sorted({"jpg" if e == "jpeg" else e for e in extensions})
    declared = F.regexp_replace(F.lower(clean_text("raw_format", tags_first=False)), "^jpeg$", "jpg")
    cleaned = let(generic, {"_ref": clean_ref(clean_text("raw_url", tags_first=False)), "_declared": declared})
    resolved = let(cleaned, {"_url": F.when(F.col("_ref") != "", resolve("source_url", "_ref"))})
    suffixed = let(resolved, {"_suffix": ext("_url")})
    formatted = let(
        suffixed,
        {
            "format": F.when(F.col("_declared").isin(wanted), F.col("_declared")).when(
                F.col("_suffix").isin(wanted), F.col("_suffix")
            )
        },
    ).where(F.col("_url").isNotNull() & F.col("format").isNotNull())
    unique = first_of(formatted, ["_url"], ordinal)
    titled = let(
        unique,
        {
            "title": F.coalesce(
                F.nullif(clean_text("raw_text", tags_first=False), F.lit("")), file_title("_url", UNTITLED)
            ),
            "origin_title": clean_text("page_title", tags_first=False),
            "_host": host(F.when(F.col("source_url") != "", F.col("source_url")).otherwise(F.col("_url"))),
        },
    )
    origin = F.when(F.col("origin_title") != "", F.col("origin_title")).otherwise(F.col("_host"))
    described = let(titled, {"description": F.concat(F.lit("来自 "), origin)})
    worded = let(described, {"_text": F.concat_ws(" ", "title", "description", "_url", "source_url")})
    with_text = let(worded, {"_low": F.lower("_text")})
    text, low = F.col("_text"), F.col("_low")
    subject, domain = infer_subject(low, subject_rules)
    auth = F.size(F.filter("auth_hints", lambda h: F.trim(h) != "")) > 0
    noted = F.exists("warnings", lambda w: F.contains(w, F.lit("访问限制")))
    warned = F.array_distinct(
        F.concat(
            F.filter("warnings", lambda w: F.trim(w) != ""),
            compact([F.when(auth & ~noted, F.lit("来源页面可能存在登录、付费或授权限制"))]),
        )
    )
    typed = let(
        with_text,
        {"resource_type": infer_resource_type(low, F.col("format"), type_rules, L.LINK_TYPE_BY_FORMAT, "文档")},
    )
    return typed.select(
        *keys,
        ordinal,
        F.lit(L.LINK_SOURCE).alias("source"),
        F.coalesce(blank_to_null("_host"), F.lit(L.LINK_SOURCE_NAME)).alias("source_name"),
        F.col("_url").alias("source_url"),
        stable_id("_url").alias("resource_id"),
        "title",
        "description",
        "resource_type",
        "format",
        infer_context_field(filter_col(filters, "stage"), low).alias("stage"),
        infer_context_field(filter_col(filters, "grade"), low).alias("grade"),
        subject.alias("subject"),
        domain.alias("learning_domain"),
        infer_context_field(filter_col(filters, "version"), low).alias("version"),
        infer_context_field(filter_col(filters, "volume"), low).alias("volume"),
        infer_topic(filter_col(filters, "core_topic", "topic"), low).alias("topic"),
        F.col("_host").alias("provider"),
        (contains_any(text, official_hints) | contains_any("_host", official_hints)).alias("official"),
        F.lit(True).alias("downloadable"),
        (auth | contains_any(text, auth_terms)).alias("requires_auth"),
        F.lit(None).cast("long").alias("size"),
        link_confidence(
            ["title", "_url", "description", "resource_type", "format"],
            F.col("origin_title"),
            F.col("title") == UNTITLED,
        ).alias("metadata_confidence"),
        warned.alias("source_warnings"),
        "crawl_strategy",
        "copies",
    )


def profile_links(profiles: DataFrame, keys: Sequence[str] = ("page_id",), url: str = "url", limit: int | None = None) -> DataFrame:
    """Explode ``site_profile`` rows to the input of ``link_candidates``.

    ``limit`` keeps that many links of each page, as a stored profile does; by
    default every link counts.
    """
    listed = F.col("resource_links") if limit is None else F.slice("resource_links", 1, limit)
    rows = profiles.select(
        *keys,
        F.col(url).alias("source_url"),
        F.col("title").alias("page_title"),
        "crawl_strategy",
        "auth_hints",
        "warnings",
        F.posexplode(listed).alias("pos", "_l"),
    )
    return rows.withColumns(
        {"raw_url": F.col("_l.link"), "raw_format": F.col("_l.ext"), "raw_text": F.col("_l.text")}
    ).drop("_l")


def extraction_summary(profiles: DataFrame, candidates: DataFrame, include_non_generic: bool = False) -> DataFrame:
    """Profiles, links seen, candidates and skipped links in one row."""
    usable = F.lit(True) if include_non_generic else F.col("crawl_strategy") == "generic_extract"
    links = F.size("resource_links")
    seen = profiles.agg(
        F.count(F.lit(1)).alias("profiles"),
        F.coalesce(F.sum(F.when(usable, links)), F.lit(0)).alias("links_seen"),
        F.lit(0).cast("bigint").alias("candidates"),
        F.coalesce(F.sum(F.when(~usable, F.greatest(links, F.lit(1)))), F.lit(0)).alias("unused"),
    )
    return _with_candidates(seen, candidates).select(
        "profiles",
        "links_seen",
        "candidates",
        (F.col("unused") + F.col("links_seen") - F.col("candidates")).alias("skipped"),
    )


def _with_candidates(totals: DataFrame, candidates: DataFrame) -> DataFrame:
    """One row of totals with the number of candidates added to its zero column."""
    zero = F.lit(0).cast("bigint")
    made = candidates.agg(F.count(F.lit(1)).alias("candidates"))
    made = made.select(*[F.col(c) if c == "candidates" else zero.alias(c) for c in totals.columns])
    return totals.union(made).agg(*[F.sum(c).cast("bigint").alias(c) for c in totals.columns])


ITEM_ALIASES = {
    # Field names of search items, in the order they are tried.
    "id": ["id", "resource_id", "resourceId", "content_id", "contentId", "course_id", "courseId"],
    "title": ["title", "name", "content_name", "contentName", "resource_name", "resourceName", "global_title"],
    "description": ["description", "summary", "intro", "content", "snippet", "global_description"],
    "page": ["url", "web_url", "webUrl", "href", "detail_url", "detailUrl", "share_url", "shareUrl"],
    "catalog": ["catalog", "catalog_type", "catalogType", "tab_code", "tabCode", "channel_code", "channelCode"],
    "tab_code": ["tab_code", "tabCode", "channel_code", "channelCode"],
    "sub_catalog": ["sub_catalog", "subCatalog", "sub_catalog_code", "subCatalogCode"],
    "page_content_type": [
        "content_type", "contentType", "resource_type", "resourceType", "resource_type_code", "resourceTypeCode",
    ],
    "content_type": ["content_type", "contentType"],
    "resource_type": [
        "resource_type", "resourceType", "resource_type_code", "resourceTypeCode", "content_type", "contentType",
    ],
    "resource_type_name": ["resource_type_name", "resourceTypeName", "content_type_name", "contentTypeName"],
    "format": ["format", "file_format", "fileFormat", "resource_format", "resourceFormat", "ti_format"],
    "stage": ["stage", "phase", "school_section"],
    "grade": ["grade", "grade_name", "gradeName"],
    "subject": ["subject", "subject_name", "subjectName"],
    "version": ["version", "version_name", "versionName"],
    "volume": ["volume", "book", "book_name", "bookName"],
    "provider": ["provider", "provider_name", "providerName", "source_name", "sourceName"],
}


def item_field(item: str, name: str) -> Column:
    """First non-blank alias of a field of a variant item."""
    return F.coalesce(
        *[blank_to_null(F.try_variant_get(F.col(item), f"$.{alias}", "string")) for alias in ITEM_ALIASES[name]]
    )


def item_tags(item: str) -> Column:
    """``array<struct<dimension,title>>`` of a variant item's tags."""
    tags = F.try_variant_get(
        F.col(item),
        "$.tags",
        "array<struct<dimension_id:string,tag_dimension_id:string,title:string,tag_name:string>>",
    )
    return F.transform(
        F.coalesce(tags, F.array().cast("array<struct<dimension_id:string,tag_dimension_id:string,title:string,tag_name:string>>")),
        lambda t: F.struct(
            F.coalesce(t["dimension_id"], t["tag_dimension_id"]).alias("dimension"),
            clean_inline(F.coalesce(blank_to_null(t["title"]), t["tag_name"])).alias("title"),
        ),
    )


def item_candidates(items: DataFrame, query: Column | str = "", filters: Filters = None, item: str = "item") -> DataFrame:
    """Search items (variant column) to candidates; tag values before filter values."""
    query = F.lit(query) if isinstance(query, str) else query
    named = let(items, {f"_{n}": item_field(item, n) for n in ITEM_ALIASES} | {"_tags": item_tags(item)})
    providers = F.try_variant_get(F.col(item), "$.extra.providers", "array<struct<name:string>>")
    extra_format = F.try_variant_get(F.col(item), "$.extra.format", "string")
    page = D.detail_page(
        F.col("_id"), F.col("_catalog"), F.col("_sub_catalog"), F.col("_page_content_type"), F.col("_page")
    )
    title = F.coalesce(blank_to_null(clean_inline("_title")), F.lit(L.SITE_UNTITLED))
    paged = let(named, {"source_url": page, "title": title})
    formatted = let(
        paged, {"format": item_format(F.coalesce(F.col("_format"), extra_format), F.col("source_url"), clean_inline("_title"))}
    )

    def value(name: str, *filter_names: str) -> Column:
        return F.coalesce(
            F.col(f"_{name}"), D.tag_value(F.col("_tags"), name), filter_col(filters, *(filter_names or (name,)))
        )

    out = formatted.withColumns(
        {
            "source": F.lit(L.SITE_SOURCE),
            "source_name": F.lit(L.SITE_NAME),
            "resource_id": F.concat(
                F.lit(L.SITE_SEARCH_PREFIX), F.coalesce(F.col("_id"), stable_id(F.concat("title", "source_url")))
            ),
            "description": clean_inline("_description"),
            "resource_type": F.coalesce(
                F.col("_resource_type_name"), detail_resource_type(F.col("format"), F.col("title"))
            ),
            "stage": value("stage"),
            "grade": value("grade"),
            "subject": value("subject"),
            "learning_domain": value("subject", "learning_domain", "subject"),
            "version": value("version"),
            "volume": value("volume"),
            "topic": F.coalesce(filter_col(filters, "core_topic"), query),
            "provider": F.coalesce(
                F.col("_provider"), blank_to_null(D.joined_names(providers)), F.lit(L.SITE_NAME)
            ),
            "official": F.lit(True),
            "downloadable": F.lit(False),
            "requires_auth": F.lit(False),
            "size": F.lit(None).cast("long"),
            "source_warnings": F.array(F.lit("搜索结果候选尚未解析详情文件项")),
        }
    ).withColumn(
        "metadata_confidence", metadata_confidence("title", "source_url", "resource_type", "format", "provider")
    )
    return out.drop(*[f"_{n}" for n in ITEM_ALIASES], "_tags")


def item_identity(items: DataFrame, item: str = "item") -> DataFrame:
    """Adds resource_id, tab_code, catalog, sub_catalog, content_type, resource_type and its name."""
    named = let(items, {f"_{n}": item_field(item, n) for n in ITEM_ALIASES})
    page = D.detail_page(
        F.col("_id"), F.col("_catalog"), F.col("_sub_catalog"), F.col("_page_content_type"), F.col("_page")
    )
    paged = let(let(named, {"detail_page": page}), {"_known": D.identity_from_url(F.col("detail_page"))})
    known = F.col("_known")
    kind = F.col("_resource_type")
    special = {"national_lesson": "syncClassroom", "elite_lesson": "qualityCourse", "prepare_lesson": "prepareLesson"}
    catalog = F
    for name, forced in special.items():
        catalog = catalog.when(kind == name, forced)
    catalog = catalog.otherwise(F.coalesce(F.col("_catalog"), blank_to_null(known["catalog"]), F.lit("syncClassroom")))
    content = F.when(kind.isin(*special), kind).otherwise(
        F.coalesce(F.col("_content_type"), kind, known["content_type"], F.lit(""))
    )
    return paged.withColumns(
        {
            "resource_id": F.coalesce(F.col("_id"), known["resource_id"], F.lit("")),
            "catalog": catalog,
            "tab_code": F.coalesce(F.col("_tab_code"), blank_to_null(known["tab_code"]), catalog),
            "sub_catalog": F.coalesce(F.col("_sub_catalog"), known["sub_catalog"], F.lit("")),
            "content_type": content,
            "resource_type": F.coalesce(kind, F.lit("")),
            "resource_type_name": clean_inline("_resource_type_name"),
        }
    ).drop("_known", *[f"_{n}" for n in ITEM_ALIASES])


def detail_candidates(details: DataFrame, filters: Filters = None, key: Sequence[str] = ("detail_id",)) -> DataFrame:
    """One candidate per usable file item of a resource (see ``operators.details``).

    ``details`` is the output of ``related_details``: key, resource ``id``,
    ``title`` and the other resource fields, and ``ti_items``.
    """
    # What all files of a resource share is found before they are opened.  A ``let`` is generated code only without
    # lambdas, so those stand in plain projections.
    tags = F.transform("tag_list", lambda t: F.struct(t["tag_dimension_id"].alias("dimension"), t["tag_name"].alias("title")))
    shared = details.withColumn("_tags", tags).select(
        "*",
        *[D.tag_value(F.col("_tags"), n).alias(f"_{n}") for n in L.TAG_DIMENSIONS.values()],
        D.provider_name("provider_list").alias("_provider"),
        D.joined_titles(F.col("title"), F.col("alternate_title")).alias("_titles"),
    )
    rows = shared.select("*", F.posexplode("ti_items").alias("_pos", "_item")).drop("_tags", "tag_list", "ti_items")
    rows = let(rows, {"_stored": D.stored_path(F.col("_item.ti_storage"))})
    rows = rows.withColumn("url_candidates", D.file_urls(F.col("_stored"), F.col("_item.ti_storages")))
    linked = let(rows, {"source_url": F.get("url_candidates", F.lit(0))}).where(F.col("source_url").isNotNull())
    linked = let(linked, {"_declared": F.coalesce(blank_to_null("_item.ti_format", plain=True), F.col("_item.lc_ti_format"))})
    usable = let(linked, {"format": detail_format(F.col("_declared"), F.col("source_url"))}).where(
        ~F.col("format").isin("folder", "unknown")
    )
    index = F.col("_pos") + 1
    auth = D.requires_auth(F.col("_item.identification"), F.col("url_candidates"))
    tagged = let(usable, {"_auth": auth, "_label": D.file_label(F.col("_item.ti_file_flag"), F.col("format"))})
    out = tagged.select(
        *key,
        index.cast("bigint").alias("item_index"),
        F.lit(L.SITE_SOURCE).alias("source"),
        F.lit(L.SITE_NAME).alias("source_name"),
        "source_url",
        F.concat_ws(":", "id", index.cast("string"), stable_id("source_url")).alias("resource_id"),
        D.candidate_title(F.col("_titles"), F.col("_label"), F.col("id")).alias("title"),
        F.coalesce("description", F.lit("")).alias("description"),
        detail_resource_type(
            F.col("format"),
            F.col("_item.ti_file_flag"),
            F.col("_item.lc_ti_format"),
            F.col("resource_type_code_name"),
            F.col("title"),
        ).alias("resource_type"),
        "format",
        *[
            F.coalesce(F.col(f"_{n}"), filter_col(filters, n)).alias(n)
            for n in ("stage", "grade", "subject", "version", "volume")
        ],
        F.coalesce("_subject", filter_col(filters, "learning_domain")).alias("learning_domain"),
        filter_col(filters, "core_topic", "topic").alias("topic"),
        F.col("_provider").alias("provider"),
        F.lit(True).alias("official"),
        F.lit(True).alias("downloadable"),
        F.col("_auth").alias("requires_auth"),
        F.coalesce(
            D.requirement_value("_item.requirements", "FileSize"),
            D.requirement_value("_item.requirements", "total_size"),
            F.col("_item.ti_size"),
        )
        .try_cast("long")
        .alias("size"),
        F.when(F.col("_auth"), F.array(F.lit(L.SITE_AUTH_WARNING)))
        .otherwise(F.array().cast("array<string>"))
        .alias("source_warnings"),
        "url_candidates",
    )
    return out.withColumn(
        "metadata_confidence", metadata_confidence("title", "source_url", "resource_type", "format", "provider")
    )


def detail_counts(details: DataFrame, candidates: DataFrame) -> DataFrame:
    """File items seen and skipped over all resources, one row."""
    seen = details.agg(
        F.coalesce(F.sum(F.size("ti_items")), F.lit(0)).cast("bigint").alias("items_seen"),
        F.lit(0).cast("bigint").alias("candidates"),
    )
    return _with_candidates(seen, candidates).select(
        "items_seen", "candidates", (F.col("items_seen") - F.col("candidates")).alias("skipped")
    )


def textbook_candidates(records: DataFrame) -> DataFrame:
    """Textbook records to candidates; confidence is the share of six filled fields."""
    passed = [c for c in ("ordinal", "local_file") if c in records.columns]
    return records.select(
        *passed,
        F.lit(L.SITE_SOURCE).alias("source"),
        F.lit(L.SITE_NAME).alias("source_name"),
        F.col("detail_page").alias("source_url"),
        F.col("id").alias("resource_id"),
        "title",
        F.lit("教材").alias("resource_type"),
        F.coalesce(blank_to_null("format"), F.lit("pdf")).alias("format"),
        "stage",
        "grade",
        "subject",
        "version",
        "volume",
        F.lit(None).cast("string").alias("topic"),
        F.coalesce(F.array_join("providers", "/"), F.lit("")).alias("provider"),
        F.lit(True).alias("official"),
        F.lit(True).alias("downloadable"),
        F.lit(True).alias("requires_auth"),
        F.col("size").cast("long").alias("size"),
        metadata_confidence("title", "stage", "grade", "subject", "version", "volume").alias("metadata_confidence"),
    )


def index_candidates(matches: DataFrame) -> DataFrame:
    """Index records with ``match_score`` and ``file_exists`` to candidates.

    Confidence = 0.35 + 0.25 (score >= 35) or 0.1 (score > 0) + 0.35 x class
    confidence + 0.05 (file there), at most 1.
    """

    def unless(field: str, name: str) -> Column:
        return F.when(~F.coalesce(F.col(field), F.lit("")).isin(L.PLACEHOLDERS[name]), F.col(field))

    score = F.col("match_score")
    share = F.coalesce(F.col("classification_confidence"), F.lit(0)).cast("decimal(6,4)")
    total = (
        F.lit("0.35").cast("decimal(4,2)")
        + F.when(score >= 35, F.lit("0.25").cast("decimal(4,2)"))
        .when(score > 0, F.lit("0.10").cast("decimal(4,2)"))
        .otherwise(F.lit("0.00").cast("decimal(4,2)"))
        + share * F.lit("0.35").cast("decimal(4,2)")
        + F.when(F.col("file_exists"), F.lit("0.05").cast("decimal(4,2)")).otherwise(F.lit("0.00").cast("decimal(4,2)"))
    )
    passed = [c for c in ("ordinal", "query_id", "rank", "match_reasons", "match_warnings") if c in matches.columns]
    stem = F.regexp_extract("library_file", r"([^/]+?)(?:\.[^./]*)?$", 1)
    domain = unless("domain_or_subject", "subject")
    return matches.select(
        *passed,
        F.lit(L.LOCAL_SOURCE).alias("source"),
        F.lit(L.LOCAL_SOURCE_NAME).alias("source_name"),
        F.coalesce("source_url", F.lit("")).alias("source_url"),
        F.coalesce(blank_to_null("resource_key"), stable_id("library_file")).alias("resource_id"),
        F.coalesce(blank_to_null("title"), stem).alias("title"),
        F.concat(F.lit("本地资料库已归档资源，匹配分 "), score.cast("string")).alias("description"),
        F.coalesce("resource_type", F.lit("")).alias("resource_type"),
        F.coalesce("format", F.lit("")).alias("format"),
        unless("stage_or_age", "stage").alias("stage"),
        unless("grade_or_phase", "grade").alias("grade"),
        domain.alias("subject"),
        domain.alias("learning_domain"),
        unless("source_or_version", "version").alias("version"),
        F.lit(None).cast("string").alias("volume"),
        unless("topic_or_type", "topic").alias("topic"),
        F.coalesce(blank_to_null("source_or_version"), F.lit(L.LOCAL_PROVIDER)).alias("provider"),
        F.lit(False).alias("official"),
        F.lit(True).alias("downloadable"),
        F.lit(False).alias("requires_auth"),
        F.round(F.least(total, F.lit(1)), 3).cast("double").alias("metadata_confidence"),
        F.col("library_file").alias("local_file"),
        score.alias("match_score"),
    )


def download_candidates(fetched: DataFrame) -> DataFrame:
    """Fetched files with their ``candidate`` struct to candidates; file fields win."""
    inner = fetched.schema["candidate"].dataType.names
    over = ["title", "source_url", "format", "resource_type", "size"]
    taken = {"option_id", "local_file", "sha256", *over}
    cols = [F.col(f"candidate.{n}").alias(n) for n in inner if n not in taken]
    for name in over:
        outer = F.col(name) if name in fetched.columns else F.lit(None)
        if name != "size":
            outer = blank_to_null(outer) if name in fetched.columns else F.lit(None).cast("string")
        cols.append(F.coalesce(outer, F.col(f"candidate.{name}") if name in inner else F.lit(None)).alias(name))
    plain = [F.col(n) for n in ("ordinal", "option_id", "local_file", "sha256") if n in fetched.columns]
    return fetched.select(*plain, *cols)


def build_query(filters: Filters, query: Column | str | None = None, printable: Column | bool = False) -> Column:
    """Search text: a given query, else the ordered distinct filter values."""
    age = filter_col(filters, "learner_age")
    age = F.when(F.regexp_like(age, F.lit(r"^\d+$")), F.concat(age, F.lit("岁"))).otherwise(age)
    parts = [age] + [
        filter_col(filters, k) for k in ("stage", "grade", "subject", "learning_domain", "core_topic", "topic")
    ]
    lists = []
    for key in ("resource_types", "format_preferences"):
        value = (filters or {}).get(key)
        if value is None:
            continue
        lists.append(value if isinstance(value, Column) else F.array(*[F.lit(str(v)) for v in value]))
    flag = printable if isinstance(printable, Column) else F.lit(bool(printable))
    words = F.array_distinct(
        F.concat(compact([blank_to_null(p) for p in parts]), *lists, compact([F.when(flag, F.lit("可打印"))]))
    )
    built = F.array_join(words, " ")
    if query is None:
        return built
    return first_value(as_col(query) if not isinstance(query, str) else F.lit(query), built)
