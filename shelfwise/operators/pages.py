"""Web pages: fields, links, hints, profiles and page classes.

Input is a table (page key, ``url``, ``html``).  Markup is matched once per
page with ``regexp_extract_all``; finer patterns run on the small matches after
``posexplode``.  Nothing here shuffles except the per-host roll-up.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions.match import compact, contains_any, hits, labels
from ..functions.text import as_col, clean_text, squeeze, stable_id, unescape
from ..functions.columns import bind, let
from ..functions.urls import absolute_url, absolute_urls, clean_ref, ext, host, query_value, resolve, unwrap_redirect

SCRIPT = r"(?is)<script[^>]*>(.*?)</script>"
COMMENT = r"(?s)<!--.*?-->"
TITLE = r"(?is)<title[^>]*>(.*?)</title>"
META = (
    r"""(?is)<meta\b[^>]*\bname\s*=\s*["']description["'][^>]*\bcontent\s*=\s*["']([^"']*)["']""",
    r"""(?is)<meta\b[^>]*\bcontent\s*=\s*["']([^"']*)["'][^>]*\bname\s*=\s*["']description["']""",
)
ANCHOR = r"""(?is)<a\b[^>]*\bhref\s*=[^>]*>.*?</a>"""
ANCHOR_HREF = r"""(?is)^<a\b[^>]*?\bhref\s*=\s*["']?([^"'\s>]+)"""
ANCHOR_TEXT = r"(?is)^<a\b[^>]*>(.*)</a>$"
SCRIPT_SRC = r"""(?is)<script[^>]+src=["']([^"']+)["']"""
# What counts as a URL in script or text.
URL_CHARS = r"[A-Za-z0-9._~:/?#\[\]@!$&'()*+,;=%-]"
FULL_URL = rf"https?://{URL_CHARS}+"
QUOTED_PATH = rf"""['"]((?://|/){URL_CHARS}{{3,160}})['"]"""


def markup(html: Column | str) -> Column:
    """HTML without scripts and comments."""
    return F.regexp_replace(F.regexp_replace(as_col(html), SCRIPT, " "), COMMENT, " ")


def page_title(html: Column | str) -> Column:
    return squeeze(unescape(F.regexp_extract(as_col(html), TITLE, 1)))


def meta_description(html: Column | str) -> Column:
    found = [F.regexp_extract(as_col(html), p, 1) for p in META]
    return unescape(F.coalesce(*[F.nullif(v, F.lit("")) for v in found], F.lit("")))


def visible_text(html: Column | str) -> Column:
    return clean_text(markup(html))


def script_text(html: Column | str) -> Column:
    return squeeze(F.array_join(F.regexp_extract_all(as_col(html), F.lit(SCRIPT), F.lit(1)), " "))


def script_sources(html: Column | str, base: Column | str) -> Column:
    """Distinct absolute script sources in order."""
    found = F.regexp_extract_all(as_col(html), F.lit(SCRIPT_SRC), F.lit(1))
    return F.array_distinct(absolute_urls(base, found))


def page_fields(pages: DataFrame, html: str = "html") -> DataFrame:
    """Adds title, description, visible text and script text."""
    return let(
        pages,
        {
            "title": page_title(html),
            "description": meta_description(html),
            "text": visible_text(html),
            "script_text": script_text(html),
        },
    )


def page_links(pages: DataFrame, keys: Sequence[str] = ("page_id",), url: str = "url", html: str = "html") -> DataFrame:
    """One row per anchor with a target: keys, pos, href, absolute link, link text, extension."""
    found = F.regexp_extract_all(markup(html), F.lit(ANCHOR), F.lit(0))
    rows = pages.select(*keys, url, F.posexplode(found).alias("pos", "_anchor"))
    named = let(rows, {"href": F.regexp_extract("_anchor", ANCHOR_HREF, 1)}).where(F.col("href") != "")
    cleaned = let(
        named, {"text": clean_text(F.regexp_extract("_anchor", ANCHOR_TEXT, 1)), "_ref": clean_ref("href")}
    )
    linked = let(cleaned, {"link": resolve(url, "_ref")})
    return linked.select(*keys, url, "pos", "href", "text", "link", ext("link").alias("ext"))


def link_array(html: Column | str, base: Column | str, marked: bool = False) -> Column:
    """The same links as an ``array<struct<href,link,text,ext>>`` for per-page decisions.

    ``marked`` says that scripts and comments are already gone."""
    found = F.regexp_extract_all(as_col(html) if marked else markup(html), F.lit(ANCHOR), F.lit(0))
    base = as_col(base)

    def read(anchor: Column) -> Column:
        href = F.regexp_extract(anchor, ANCHOR_HREF, 1)
        text = clean_text(F.regexp_extract(anchor, ANCHOR_TEXT, 1))
        return F.struct(href.alias("href"), clean_ref(href).alias("ref"), text.alias("text"))

    named = F.filter(F.transform(found, read), lambda a: a["href"] != "")
    linked = F.transform(
        named, lambda a: F.struct(a["href"].alias("href"), resolve(base, a["ref"]).alias("link"), a["text"].alias("text"))
    )
    return F.transform(
        linked,
        lambda a: F.struct(
            a["href"].alias("href"), a["link"].alias("link"), a["text"].alias("text"), ext(a["link"]).alias("ext")
        ),
    )


def result_page_anchors(
    pages: DataFrame, keys: Sequence[str], html: str, title_class: str = "result__a", snippet_class: str = "result__snippet"
) -> DataFrame:
    """Search-result page to (pos, url, title, snippet).

    The page is cut at its result anchors, so the snippet is looked up between
    one anchor and the next, or the end of the page.
    ``title_class=""`` takes every anchor with a target.
    """
    named = rf'[^>]+class="[^"]*{title_class}[^"]*"' if title_class else ""
    anchor = rf'(?s)<a{named}[^>]+href="[^"]+"[^>]*>.*?</a>'
    page = as_col(html)
    marked = pages.select(
        *keys,
        F.regexp_extract_all(page, F.lit(anchor), F.lit(0)).alias("_anchors"),
        F.split(page, anchor).alias("_between"),
    )
    rows = marked.select(*keys, F.posexplode("_anchors").alias("pos", "_a"), "_between")
    after = F.element_at("_between", F.col("pos") + 2)
    rows = let(rows, {"_block": after})
    cls = rf'class="[^"]*{snippet_class}[^"]*"'
    linked = F.regexp_extract("_block", rf"(?s)<a[^>]+{cls}[^>]*>(.*?)</a>", 1)
    boxed = F.regexp_extract("_block", rf"(?s)<div[^>]+{cls}[^>]*>(.*?)</div>", 1)
    return rows.select(
        *keys,
        "pos",
        unwrap_redirect(F.regexp_extract("_a", r'href="([^"]+)"', 1)).alias("url"),
        clean_text(F.regexp_extract("_a", r"(?s)^<a[^>]*>(.*)</a>$", 1)).alias("title"),
        clean_text(F.when(linked != "", linked).otherwise(boxed)).alias("snippet"),
    )


def _first(values: Column, limit: int | None) -> Column:
    return values if limit is None else F.slice(values, 1, limit)


def resource_links(links: DataFrame, extensions: Sequence[str] = L.PROFILE_EXTENSIONS) -> DataFrame:
    """Links whose extension is a file format of interest."""
    wanted = sorted({"jpg" if e == "jpeg" else e for e in extensions})
    return links.where(F.col("ext").isin(wanted))


def source_links(html: Column | str, base: Column | str, extensions: Sequence[str] = L.SITE_EXTENSIONS, limit: int | None = None) -> Column:
    """``array<struct<link,ext>>`` from ``href`` and ``src``; the place of a repeated URL is its first."""
    wanted = sorted({"jpg" if e == "jpeg" else e for e in extensions})
    found = F.regexp_extract_all(as_col(html), F.lit(r"""(?i)(?:href|src)=["']([^"']+)["']"""), F.lit(1))
    typed = F.transform(F.array_distinct(absolute_urls(base, found)), lambda u: F.struct(u.alias("link"), ext(u).alias("ext")))
    return _first(F.filter(typed, lambda s: s["ext"].isin(wanted)), limit)


def api_hints(text: Column | str, base: Column | str, terms: Sequence[str] = L.API_TERMS, limit: int | None = None) -> Column:
    """Distinct absolute URLs in scripts or text that hold an API word."""
    text = as_col(text)
    full = F.regexp_extract_all(text, F.lit(FULL_URL), F.lit(0))
    quoted = F.regexp_extract_all(text, F.lit(QUOTED_PATH), F.lit(1))
    named = F.filter(F.concat(full, quoted), lambda u: bind(F.lower(u), lambda low: contains_any(low, terms)))
    return _first(F.array_distinct(absolute_urls(base, named)), limit)


def link_hints(links: Column, terms: Sequence[str], limit: int | None = None) -> Column:
    """Distinct links (from ``link_array``) whose target or text holds a term."""
    lowered = [t.lower() for t in terms]
    kept = F.filter(links, lambda a: bind(F.lower(F.concat_ws(" ", a["href"], a["text"])), lambda low: contains_any(low, lowered)))
    return _first(F.array_distinct(F.transform(kept, lambda a: a["link"])), limit)


def detail_hints(html: Column | str, base: Column | str, site: str = L.SITE_URL, limit: int | None = None) -> Column:
    """``array<struct<resource_id,catalog,source>>`` from inline keys and detail URLs."""
    html, base = as_col(html), as_col(base)
    inline = F.regexp_extract_all(
        html, F.lit(r"""(?:contentId|resourceId|resource_id|content_id|courseId)[=:]['"]?([A-Za-z0-9_-]{6,})"""), F.lit(1)
    )
    site_host = site.split("//", 1)[1].rstrip("/").replace(".", r"\.")
    absolute = F.regexp_extract_all(
        html, F.lit(rf"""https?://{site_host}/[^/]+/detail\?[^'"\s<>]+"""), F.lit(0)
    )
    quoted = F.regexp_extract_all(html, F.lit(r"""['"]((?:/[^'"]+)?/detail\?[^'"]+)['"]"""), F.lit(1))

    def hint(rid: Column, catalog: Column, source: Column) -> Column:
        blank = F.lit("")
        return F.struct(
            F.coalesce(rid, blank).alias("resource_id"),
            F.coalesce(catalog, blank).alias("catalog"),
            source.alias("source"),
        )

    def from_site(u: Column) -> Column:
        return hint(query_value(u, "contentId", "id"), F.regexp_extract(u, r"^https?://[^/]+/([^/]+)/", 1), u)

    def from_quoted(u: Column) -> Column:
        link = absolute_url(base, u)
        return hint(query_value(link, "contentId", "id"), query_value(link, "catalogType"), link)

    rows = F.concat(
        F.transform(inline, lambda r: hint(r, F.lit(""), F.lit("inline-id"))),
        F.transform(absolute, from_site),
        F.transform(quoted, from_quoted),
    )
    return _first(F.array_distinct(rows), limit)


def page_type(html: Column, url: Column, n_api: Column, n_detail: Column, n_links: Column) -> Column:
    """Page class by words of the whole page and its hints."""
    whole = F.lower(F.concat_ws(" ", html, url))
    return bind(whole, lambda w: _page_type(w, url, n_api, n_detail, n_links))


def _page_type(whole: Column, url: Column, n_api: Column, n_detail: Column, n_links: Column) -> Column:
    return (
        F.when(F.contains(url, F.lit("/detail")) | (n_detail > 0), "detail_or_detail_capable_page")
        .when(F.contains(whole, F.lit("librarylist")), "catalog_config_page")
        .when((n_api > 0) & contains_any(whole, ["root", "webpack", "chunk"]), "spa_route_page")
        .when(n_links > 0, "static_resource_page")
        .when(contains_any(whole, ["search", "resources", "catalog"]), "resource_listing_or_search_page")
        .otherwise("unknown")
    )


def next_actions(api: Column, n_detail: Column, n_links: Column) -> Column:
    """Recommended next steps from the hints of a page."""

    def named(*terms: str) -> Column:
        return F.exists(api, lambda u: bind(F.lower(u), lambda low: contains_any(low, terms)))

    steps = compact(
        [
            F.when(named("librarylist"), F.lit(L.NEXT_ROUTES)),
            F.when(n_detail > 0, F.lit(L.NEXT_DETAILS)),
            F.when(named("search", "aggregate", "combine"), F.lit(L.NEXT_SEARCH)),
            F.when(n_links > 0, F.lit(L.NEXT_ANALYSIS)),
        ]
    )
    return F.when(F.size(steps) > 0, steps).otherwise(F.array(F.lit(L.NEXT_DEEPER)))


def page_profile(pages: DataFrame, url: str = "url", html: str = "html", terms: Sequence[str] = L.SITE_API_TERMS) -> DataFrame:
    """Hints, page class and next steps of every page of a site."""
    hinted = let(
        pages,
        {
            "api_hints": api_hints(html, url, terms),
            "detail_hints": detail_hints(html, url),
            "resource_link_hints": source_links(html, url),
            "script_sources": script_sources(html, url),
        },
    )
    counts = (F.size("api_hints"), F.size("detail_hints"), F.size("resource_link_hints"))
    return hinted.withColumns(
        {
            "page_type": page_type(F.col(html), F.col(url), *counts),
            "next_actions": next_actions(F.col("api_hints"), counts[1], counts[2]),
        }
    )


def site_profile(
    pages: DataFrame,
    url: str = "url",
    html: str = "html",
    *,
    extensions: Sequence[str] = L.PROFILE_EXTENSIONS,
    api_terms: Sequence[str] = L.API_TERMS,
    auth_terms: Sequence[str] = L.PROFILE_AUTH_TERMS,
    risk_terms: Sequence[str] = L.PROFILE_RISK_TERMS,
    pagination_terms: Sequence[str] = L.PAGINATION_TERMS,
    detail_terms: Sequence[str] = L.DETAIL_TERMS,
    listing_terms: Sequence[str] = L.LISTING_TERMS,
    media_terms: Sequence[str] = L.MEDIA_TERMS,
    article_terms: Sequence[str] = L.PROFILE_ARTICLE_TERMS,
    type_rules=L.PROFILE_TYPE_RULES,
) -> DataFrame:
    """Site type, crawl strategy, score 0-10, reasons and warnings per page."""
    wanted = sorted({"jpg" if e == "jpeg" else e for e in extensions})
    marked = let(pages, {"_markup": markup(html)})
    base = let(
        marked,
        {
            "title": page_title(html),
            "description": meta_description(html),
            "text": clean_text("_markup"),
            "script_text": script_text(html),
            "script_hints": script_sources(html, url),
            "_links": link_array("_markup", url, marked=True),
        },
    )
    base = let(base, {"_all": F.concat_ws(" ", "text", "script_text", F.array_join("script_hints", " ")), "_lower": F.lower(html)})
    linked = let(
        base,
        {
            "resource_links": F.filter("_links", lambda a: a["ext"].isin(wanted)),
            "api_hints": api_hints("_all", url, api_terms),
            "pagination_hints": link_hints(F.col("_links"), pagination_terms),
            "detail_link_hints": link_hints(F.col("_links"), detail_terms),
            "auth_hints": hits("_all", auth_terms),
            "_risks": hits("_all", risk_terms),
        },
    )
    lower_html = F.col("_lower")
    n_links, n_api = F.size("resource_links"), F.size("api_hints")
    app_marks = contains_any(lower_html, ['id="root', "id=root", "chunk-", "/js/app"])
    site_type = (
        F.when(F.contains(lower_html, F.lit("m3u8")) | contains_any("text", media_terms), "media_page")
        .when(n_links >= 2, "static_resource_page")
        .when((n_api > 0) & app_marks, "spa_app")
        .when(F.size(link_hints(F.col("_links"), listing_terms)) >= 3, "resource_listing")
        .when(contains_any("text", article_terms) & (n_links == 0), "article_page")
        .otherwise("unknown")
    )
    typed = let(linked, {"site_type": site_type})
    kind, has_auth, risky = F.col("site_type"), F.size("auth_hints") > 0, F.size("_risks") > 0
    strategy = (
        F.when(risky, "reject")
        .when((kind == "static_resource_page") & (n_links > 0), "generic_extract")
        .when((kind == "spa_app") & (n_api > 0), "dedicated_source_skill")
        .when(kind.isin("resource_listing", "media_page") | (has_auth & (n_links == 0)), "profile_deeper")
        .otherwise("keep_as_web_candidate")
    )
    warnings = F.concat(
        F.transform("_risks", lambda t: F.concat(F.lit("包含风险词："), t)),
        compact([F.when(has_auth, F.lit("页面可能存在登录、付费或授权限制"))]),
    )
    planned = let(typed, {"crawl_strategy": strategy, "warnings": warnings, "_whole": F.lower("_all")})
    tenths = (
        reduce(
            lambda chain, item: chain.when(kind == item[0], int(float(item[1]) * 10)), L.SITE_TYPE_SCORE.items(), F
        ).otherwise(20)
        + F.least(n_links, F.lit(5)) * 6
        + F.least(n_api, F.lit(5)) * 4
        + F.when(F.col("crawl_strategy") == "dedicated_source_skill", 10).otherwise(0)
        - F.when(has_auth, 10).otherwise(0)
        - F.least(F.size("warnings"), F.lit(3)) * 15
    )
    reasons = compact(
        [
            F.when(n_links > 0, F.lit("页面包含可直接识别的资源链接")),
            F.when(n_api > 0, F.lit("页面或脚本包含疑似 API 线索")),
            F.when(F.size("pagination_hints") > 0, F.lit("页面包含分页线索")),
            F.when(F.size("detail_link_hints") > 0, F.lit("页面包含详情页线索")),
            F.when(kind == "spa_app", F.lit("页面具有 SPA 前端应用特征")),
        ]
    )
    whole = F.col("_whole")
    formats = F.array_distinct(
        F.concat(
            F.transform("resource_links", lambda a: a["ext"]),
            compact(
                [
                    F.when(F.contains(whole, F.lit("m3u8")) | contains_any("_all", media_terms), F.lit("video")),
                    F.when(contains_any(whole, ["音频", "mp3"]), F.lit("audio")),
                ]
            ),
        )
    )
    return planned.withColumns(
        {
            "source_id": stable_id(url),
            "host": host(url),
            "score": (F.greatest(F.least(tenths, F.lit(100)), F.lit(0)) / F.lit(10.0)),
            "reasons": reasons,
            "resource_format_hints": formats,
            "resource_type_hints": labels(whole, [(n, [t.lower() for t in ts]) for n, ts in type_rules]),
            "link_count": F.size("_links"),
            "form_count": F.regexp_count("_markup", F.lit(r"(?i)<form\b")),
            "script_count": F.size(F.regexp_extract_all(F.col(html), F.lit(SCRIPT_SRC), F.lit(1))),
            "text_length": F.length("text"),
        }
    ).drop("_links", "_all", "_risks", "_markup", "_lower", "_whole")


def page_link_stats(pages: DataFrame, keys: Sequence[str] = ("page_id",), html: str = "html") -> DataFrame:
    """Links, forms, scripts and text length per page, counted without building the links."""
    body = let(pages.select(*keys, html), {"_m": markup(html)})
    return body.select(
        *keys,
        F.size(F.regexp_extract_all("_m", F.lit(ANCHOR), F.lit(0))).cast("bigint").alias("links"),
        F.regexp_count("_m", F.lit(r"(?i)<form\b")).cast("bigint").alias("forms"),
        F.regexp_count(html, F.lit(r"(?i)<script\b")).cast("bigint").alias("scripts"),
        F.length(clean_text("_m")).cast("bigint").alias("text_length"),
    )


def host_rollup(scored: DataFrame, host_col: str = "host", score: str = "score", links: str = "link_count") -> DataFrame:
    """Pages, links, mean and best score per host; sums are combined before the shuffle,
    so one host with a third of all pages is no hot spot.  Scores are added as
    hundredths to keep the mean independent of the order of addition."""
    cents = F.round(F.col(score) * 100).cast("bigint")
    return scored.groupBy(F.col(host_col).alias("host")).agg(
        F.count(F.lit(1)).alias("pages"),
        F.sum(F.col(links).cast("bigint")).alias("links"),
        (F.sum(cents) / F.count(F.lit(1)) / 100).alias("mean_score"),
        F.max(score).alias("max_score"),
    )


