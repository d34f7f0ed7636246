"""Checks on web pages: ``pages`` stands for fetched pages and search results."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfwise.functions import lexicons as L
from shelfwise.operators import candidates as C
from shelfwise.operators import discovery as V
from shelfwise.operators import pages as P
from shelfwise.operators.rollups import source_runs

from . import sqltext as S
from .inputs import table

# The test pages are European: these terms stand in for the Chinese lists.
EXT = ["html"]
API = ["/the", "/de"]
AUTH = ["token"]
RISK = ["%%%"]
MEDIA = ["video", "clip"]
ARTICLE = ["nicht", "que "]
PAGING = ["page=", "/la"]
DETAIL = ["/de", "/the"]
LISTING = ["/a", "/e", "/o"]
TYPES = [("english", ["the "]), ("french", ["que "]), ("german", ["der "]), ("spanish", ["los "])]
RESOURCE = ["/en", "the", "of", ".html", "page="]
ARTICLES = ["que", "der", "los"]
VIDEO = ["tionti", "ungheit"]
SOURCE_RISK = ["###"]
KNOWN = [("example.org", "/en", "adapter-a", "english pages"), ("example.org", "", "adapter-b", "other pages")]
OFFICIAL = ["example.net"]
FORMATS = [("page", [".html"]), ("feed", ["utm_source"])]
WALL = ["ref=x"]
SUBJECTS = [("english", "language", ["the ", "/en"]), (None, "romance", ["que ", "los "])]
FILTERS = {"stage": "en", "grade": "fr", "version": "page=2", "core_topic": "the and/que", "volume": "utm_source"}
WORDS = [("video", MEDIA), ("audio", ["song"]), ("image", ["picture"])]

QUERIES, ORACLE = {}, {}
SCRIPT_OUT = r"(?is)<script[^>]*>.*?</script>"
BODY = rf"""regexp_replace(regexp_replace(html, '{SCRIPT_OUT}', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g')"""
ANCHOR = r"(?is)<a\b[^>]*\bhref\s*=[^>]*>.*?</a>"
TITLE = S.squeeze(S.unescape(r"regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"))
SCRIPT_TEXT = S.squeeze(r"array_to_string(regexp_extract_all(html, '(?is)<script[^>]*>(.*?)</script>', 1), ' ')")
HREF = r"""regexp_extract(a, '(?is)^<a\b[^>]*?\bhref\s*=\s*["'']?([^"''\s>]+)', 1)"""
LINKS_CTE = rf"""
 raw_links AS (SELECT page_id, url, unnest(regexp_extract_all({BODY}, '{ANCHOR}')) AS a,
   generate_subscripts(regexp_extract_all({BODY}, '{ANCHOR}'), 1) - 1 AS pos FROM pages),
 parts AS (SELECT page_id, url, pos, {HREF} AS href,
   {S.clean(r"regexp_extract(a, '(?is)^<a\b[^>]*>(.*)</a>$', 1)")} AS text FROM raw_links),
 links AS (SELECT *, {S.ext('link')} AS ext FROM (
   SELECT *, {S.absolute('url', S.unescape('href'))} AS link FROM parts WHERE href <> ''))
"""


def results(spark, sf):
    """Search results: url, title and the text of the whole body as snippet."""
    pages = table(spark, sf, "pages")
    snippet = P.squeeze(P.clean_text(F.regexp_extract("html", r"(?is)<body[^>]*>(.*)</body>", 1)))
    return pages.select(
        F.col("page_id").alias("ordinal"), F.col("url").alias("link"), P.page_title("html").alias("name"),
        F.lit("").alias("title"), snippet.alias("summary"),
    )


RESULTS_SQL = rf"""SELECT page_id AS ordinal, url, {TITLE} AS title,
  coalesce({S.blank_to_null(S.squeeze(S.clean(r"regexp_extract(html, '(?is)<body[^>]*>(.*)</body>', 1)")))}, '') AS snippet
  FROM pages WHERE {S.blank_to_null('url')} IS NOT NULL"""

QUERIES["search_results"] = lambda spark, sf: C.load_search_results(results(spark, sf)).select("ordinal", "url", "title", "snippet")
ORACLE["search_results"] = f"SELECT ordinal, url, coalesce({S.blank_to_null('title')}, '') AS title, snippet FROM ({RESULTS_SQL})"


def page_anchors(spark, sf):
    return P.result_page_anchors(table(spark, sf, "pages"), ["page_id"], "html", title_class="", snippet_class="ad").select(
        "page_id", F.col("pos").cast("bigint").alias("pos"), "url", "title", "snippet"
    )


QUERIES["page_anchors"] = page_anchors
_ANY = r'(?s)<a[^>]+href="[^"]+"[^>]*>.*?</a>'
ORACLE["page_anchors"] = rf"""
WITH cut AS (SELECT page_id, regexp_extract_all(html, '{_ANY}') AS anchors, string_split_regex(html, '{_ANY}') AS gaps FROM pages),
 rows AS (SELECT page_id, unnest(anchors) AS a, generate_subscripts(anchors, 1) - 1 AS pos, gaps FROM cut),
 blocks AS (SELECT page_id, pos, a, gaps[pos + 2] AS b FROM rows)
SELECT page_id, pos::BIGINT AS pos, {S.unescape("regexp_extract(a, 'href=" + '"([^"]+)"' + "', 1)")} AS url,
 {S.clean(r"regexp_extract(a, '(?s)^<a[^>]*>(.*)</a>$', 1)")} AS title,
 {S.clean(r'''regexp_extract(b, '(?s)<div[^>]+class="[^"]*ad[^"]*"[^>]*>(.*?)</div>', 1)''')} AS snippet
FROM blocks"""


def page_fields(spark, sf):
    return P.page_fields(table(spark, sf, "pages")).select("page_id", "title", "description", "text", "script_text")


QUERIES["page_fields"] = page_fields
ORACLE["page_fields"] = rf"""SELECT page_id, {TITLE} AS title, '' AS description, {S.clean(BODY)} AS text, {SCRIPT_TEXT} AS script_text FROM pages"""

QUERIES["page_links"] = lambda spark, sf: P.page_links(table(spark, sf, "pages")).select(
    "page_id", F.col("pos").cast("bigint").alias("pos"), "href", "link", "text", "ext"
)
ORACLE["page_links"] = f"WITH {LINKS_CTE} SELECT page_id, pos::BIGINT AS pos, href, link, text, ext FROM links"


def resource_links(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", F.col("url").alias("link"), P.ext("url").alias("ext"))
    return P.resource_links(pages, EXT)


QUERIES["resource_links"] = resource_links
ORACLE["resource_links"] = f"SELECT page_id, url AS link, {S.ext('url')} AS ext FROM pages WHERE {S.ext('url')} = 'html'"

# hrefs of the test pages have no file suffix, so words of the page stand in for API paths
QUERIES["api_hints"] = lambda spark, sf: table(spark, sf, "pages").select(
    "page_id", F.array_join(P.api_hints("html", "url", API), "|").alias("hints")
)
_CHARS = r"[A-Za-z0-9._~:/?#\[\]@!$&()*+,;=%-]"
_CHARS_SQL = r"[A-Za-z0-9._~:/?#\[\]@!$&''()*+,;=%-]"
_FULL = rf"regexp_extract_all(html, 'https?://{_CHARS_SQL}+')"
_QUOTED = rf"""regexp_extract_all(html, '[''"]((?://|/){_CHARS_SQL}{{3,160}})[''"]', 1)"""
ORACLE["api_hints"] = rf"""
WITH u AS (SELECT page_id, url, list_filter(list_concat({_FULL}, {_QUOTED}), lambda v: contains(lower(v), '/the') OR contains(lower(v), '/de')) AS us FROM pages),
 e AS (SELECT page_id, url, unnest(us) AS v, generate_subscripts(us, 1) AS i FROM u),
 r AS (SELECT page_id, i, {S.absolute('url', S.unescape('v'))} AS link FROM e),
 f AS (SELECT page_id, link, min(i) AS i FROM r GROUP BY ALL),
 k AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY i) AS n FROM f)
SELECT p.page_id, coalesce(string_agg(link, '|' ORDER BY i), '') AS hints
FROM pages p LEFT JOIN (SELECT * FROM k WHERE n <= 40) k USING (page_id) GROUP BY p.page_id"""


def link_hints(spark, sf):
    links = P.link_array("html", "url")
    pages = table(spark, sf, "pages").select("page_id", links.alias("l"))
    return pages.select(
        "page_id",
        F.array_join(P.link_hints(F.col("l"), PAGING), "|").alias("paging"),
        F.array_join(P.link_hints(F.col("l"), DETAIL), "|").alias("detail"),
    )


def _hint_sql(name, terms):
    return f"""{name} AS (SELECT page_id, string_agg(link, '|' ORDER BY pos) AS v FROM (
        SELECT page_id, link, min(pos) AS pos FROM links WHERE {S.any_of("lower(href || ' ' || text)", terms)} GROUP BY ALL) GROUP BY page_id)"""


QUERIES["link_hints"] = link_hints
ORACLE["link_hints"] = f"""WITH {LINKS_CTE}, {_hint_sql('a', PAGING)}, {_hint_sql('b', DETAIL)}
SELECT p.page_id, coalesce(a.v, '') AS paging, coalesce(b.v, '') AS detail
FROM pages p LEFT JOIN a USING (page_id) LEFT JOIN b USING (page_id)"""


def profiles(spark, sf):
    return P.site_profile(
        table(spark, sf, "pages"), extensions=EXT, api_terms=API, auth_terms=AUTH, risk_terms=RISK,
        pagination_terms=PAGING, detail_terms=DETAIL, listing_terms=LISTING, media_terms=MEDIA,
        article_terms=ARTICLE, type_rules=TYPES,
    )


def site_profile(spark, sf):
    return profiles(spark, sf).select(
        "page_id", "source_id", "host", "title", "site_type", "crawl_strategy", "score",
        F.array_join("reasons", "|").alias("reasons"), F.array_join("warnings", "|").alias("warnings"),
        F.array_join("resource_type_hints", "|").alias("type_hints"),
        F.array_join("resource_format_hints", "|").alias("format_hints"),
        F.array_join("auth_hints", "|").alias("auth_hints"),
        F.size("resource_links").cast("bigint").alias("n_links"), F.size("api_hints").cast("bigint").alias("n_api"),
        F.col("link_count").cast("bigint").alias("links"), F.col("text_length").cast("bigint").alias("text_length"),
    )


_PROFILE_CTE = rf"""{LINKS_CTE},
 base AS (SELECT page_id, url, html, {TITLE} AS title, {S.clean(BODY)} AS text, {SCRIPT_TEXT} AS script_text FROM pages),
 lk AS (SELECT page_id, count(*) AS links, count(*) FILTER (ext = 'html') AS n_links,
   count(DISTINCT link) FILTER ({S.any_of("lower(href || ' ' || text)", LISTING)}) AS n_list,
   count(*) FILTER ({S.any_of("lower(href || ' ' || text)", PAGING)}) AS n_page,
   count(*) FILTER ({S.any_of("lower(href || ' ' || text)", DETAIL)}) AS n_detail FROM links GROUP BY page_id),
 b2 AS (SELECT b.*, text || ' ' || script_text || ' ' AS alltext, coalesce(links, 0) AS links, coalesce(n_links, 0) AS n_links,
   coalesce(n_list, 0) AS n_list, coalesce(n_page, 0) AS n_page, coalesce(n_detail, 0) AS n_detail FROM base b LEFT JOIN lk USING (page_id)),
 b3 AS (SELECT *, len(list_distinct(list_filter(list_concat(regexp_extract_all(alltext, 'https?://{_CHARS_SQL}+'),
     regexp_extract_all(alltext, '[''"]((?://|/){_CHARS_SQL}{{3,160}})[''"]', 1)),
     lambda v: {S.any_of('lower(v)', API)}))) AS n_api,
   {S.hits('alltext', AUTH)} AS auth_hints, {S.hits('alltext', RISK, '包含风险词：')} AS risks FROM b2),
 b4 AS (SELECT *, CASE WHEN contains(lower(html), 'm3u8') OR {S.any_of('text', MEDIA)} THEN 'media_page'
   WHEN n_links >= 2 THEN 'static_resource_page'
   WHEN n_api > 0 AND {S.any_of('lower(html)', ['id="root', 'id=root', 'chunk-', '/js/app'])} THEN 'spa_app'
   WHEN n_list >= 3 THEN 'resource_listing'
   WHEN {S.any_of('text', ARTICLE)} AND n_links = 0 THEN 'article_page' ELSE 'unknown' END AS site_type FROM b3),
 b5 AS (SELECT *, CASE WHEN len(risks) > 0 THEN 'reject'
   WHEN site_type = 'static_resource_page' AND n_links > 0 THEN 'generic_extract'
   WHEN site_type = 'spa_app' AND n_api > 0 THEN 'dedicated_source_skill'
   WHEN site_type IN ('resource_listing', 'media_page') OR (len(auth_hints) > 0 AND n_links = 0) THEN 'profile_deeper'
   ELSE 'keep_as_web_candidate' END AS crawl_strategy,
   list_concat(risks, CASE WHEN len(auth_hints) > 0 THEN ['页面可能存在登录、付费或授权限制'] ELSE [] END) AS warns FROM b4),
 prof AS (SELECT *, greatest(least(CASE site_type WHEN 'static_resource_page' THEN 7.0 WHEN 'resource_listing' THEN 6.5 WHEN 'spa_app' THEN 7.5
     WHEN 'media_page' THEN 6.0 WHEN 'article_page' THEN 3.0 ELSE 2.0 END + least(n_links, 5) * 0.6 + least(n_api, 5) * 0.4
   + CASE WHEN crawl_strategy = 'dedicated_source_skill' THEN 1.0 ELSE 0 END - CASE WHEN len(auth_hints) > 0 THEN 1.0 ELSE 0 END
   - least(len(warns), 3) * 1.5, 10), 0)::DOUBLE AS score FROM b5)"""
QUERIES["site_profile"] = site_profile
ORACLE["site_profile"] = rf"""WITH {_PROFILE_CTE}
SELECT page_id, left(sha1(url), 16) AS source_id, {S.host('url')} AS host, title, site_type, crawl_strategy, score,
 array_to_string(list_filter([CASE WHEN n_links > 0 THEN '页面包含可直接识别的资源链接' END, CASE WHEN n_api > 0 THEN '页面或脚本包含疑似 API 线索' END,
   CASE WHEN n_page > 0 THEN '页面包含分页线索' END, CASE WHEN n_detail > 0 THEN '页面包含详情页线索' END,
   CASE WHEN site_type = 'spa_app' THEN '页面具有 SPA 前端应用特征' END], lambda v: v IS NOT NULL), '|') AS reasons,
 array_to_string(warns, '|') AS warnings, array_to_string({S.labels('lower(alltext)', TYPES)}, '|') AS type_hints,
 array_to_string(list_filter([CASE WHEN n_links > 0 THEN 'html' END, CASE WHEN contains(lower(alltext), 'm3u8') OR {S.any_of('alltext', MEDIA)} THEN 'video' END,
   CASE WHEN contains(lower(alltext), 'mp3') THEN 'audio' END], lambda v: v IS NOT NULL), '|') AS format_hints,
 array_to_string(auth_hints, '|') AS auth_hints, n_links::BIGINT AS n_links, n_api::BIGINT AS n_api, links::BIGINT AS links, length(text)::BIGINT AS text_length
FROM prof"""

QUERIES["host_rollup"] = lambda spark, sf: P.host_rollup(profiles(spark, sf))
ORACLE["host_rollup"] = rf"""WITH {_PROFILE_CTE}
SELECT {S.host('url')} AS host, count(*) AS pages, sum(links)::BIGINT AS links,
 sum(round(score * 100)::BIGINT) / count(*) / 100 AS mean_score, max(score) AS max_score FROM prof GROUP BY 1"""

QUERIES["page_stats"] = lambda spark, sf: P.page_link_stats(table(spark, sf, "pages"))
ORACLE["page_stats"] = rf"""SELECT page_id, len(regexp_extract_all({BODY}, '{ANCHOR}'))::BIGINT AS links,
 len(regexp_extract_all({BODY}, '(?i)<form\b'))::BIGINT AS forms, len(regexp_extract_all(html, '(?i)<script\b'))::BIGINT AS scripts,
 length({S.clean(BODY)})::BIGINT AS text_length FROM pages"""


def page_type(spark, sf):
    return P.page_profile(table(spark, sf, "pages"), terms=API).select(
        "page_id", "page_type", F.array_join("next_actions", "|").alias("next_actions"),
        F.size("api_hints").cast("bigint").alias("n_api"), F.size("detail_hints").cast("bigint").alias("n_detail"),
    )


QUERIES["page_type"] = page_type
ORACLE["page_type"] = rf"""
WITH u AS (SELECT page_id, url, html, list_filter(list_concat({_FULL}, {_QUOTED}), lambda v: {S.any_of('lower(v)', API)}) AS us FROM pages),
 e AS (SELECT page_id, url, unnest(us) AS v FROM u),
 n AS (SELECT page_id, count(DISTINCT {S.absolute('url', S.unescape('v'))}) AS n_api,
   count(*) FILTER (contains(lower({S.absolute('url', S.unescape('v'))}), 'search') OR contains(lower({S.absolute('url', S.unescape('v'))}), 'aggregate')
     OR contains(lower({S.absolute('url', S.unescape('v'))}), 'combine')) AS n_search FROM e GROUP BY page_id),
 d AS (SELECT page_id, len(regexp_extract_all(html, '(?:contentId|resourceId|resource_id|content_id|courseId)[=:][''"]?([A-Za-z0-9_-]{{6,}})'))
   + len(regexp_extract_all(html, '/detail\?')) AS n_detail FROM pages),
 t AS (SELECT p.page_id, lower(html || ' ' || url) AS opening, url, coalesce(n_api, 0) AS n_api, coalesce(n_search, 0) AS n_search, n_detail
   FROM pages p LEFT JOIN n USING (page_id) JOIN d USING (page_id))
SELECT page_id, CASE WHEN contains(url, '/detail') OR n_detail > 0 THEN 'detail_or_detail_capable_page'
  WHEN contains(opening, 'librarylist') THEN 'catalog_config_page'
  WHEN n_api > 0 AND {S.any_of('opening', ['root', 'webpack', 'chunk'])} THEN 'spa_route_page'
  WHEN {S.any_of('opening', ['search', 'resources', 'catalog'])} THEN 'resource_listing_or_search_page' ELSE 'unknown' END AS page_type,
 CASE WHEN n_detail > 0 AND n_search > 0 THEN 'candidates-from-detail|search-resources' WHEN n_detail > 0 THEN 'candidates-from-detail'
  WHEN n_search > 0 THEN 'search-resources' ELSE 'profile_deeper' END AS next_actions, n_api::BIGINT AS n_api, n_detail::BIGINT AS n_detail FROM t"""


# ------------------------------------------------------------------ search results
def web(spark, sf):
    rows = C.load_search_results(results(spark, sf))
    return C.web_candidates(
        rows, FILTERS, type_rules=TYPES, subject_rules=SUBJECTS, risk_terms=RISK, auth_terms=WALL, official_hints=OFFICIAL
    )


def web_candidates(spark, sf):
    return web(spark, sf).select(
        "ordinal", "source_name", "source_url", "resource_id", "title", "description", "resource_type", "format", "stage",
        "grade", "subject", "learning_domain", "version", "volume", "topic", "provider", "official", "downloadable",
        "requires_auth", "metadata_confidence", F.array_join("source_warnings", "|").alias("warnings"),
    )


_WEB_CTE = rf"""r AS ({RESULTS_SQL}), t AS (SELECT *, concat_ws(' ', title, snippet, url) AS x, {S.host('url')} AS h FROM r),
 f AS (SELECT *, lower(url || ' ' || x) AS lx, regexp_extract(lower(url || ' ' || x),
   '\.(pdf|docx?|pptx?|xlsx?|jpe?g|png|gif|webp|mp3|wav|m4a|mp4|mov|avi|zip|rar|7z)(?:[?#]|$)', 1) AS sfx FROM t),
 g AS (SELECT *, CASE WHEN sfx IN ('jpg','jpeg','png','gif','webp') THEN 'image' WHEN sfx IN ('mp3','wav','m4a') THEN 'audio'
   WHEN sfx IN ('mp4','mov','avi') THEN 'video' WHEN sfx <> '' THEN sfx ELSE {S.first_label('lx', L.FORMAT_WORD_RULES, "'html'")} END AS format FROM f),
 w AS (SELECT *, coalesce({S.first_label('lower(x)', TYPES)}, CASE format WHEN 'video' THEN '视频' WHEN 'audio' THEN '音频' WHEN 'image' THEN '图片'
   WHEN 'ppt' THEN '课件' WHEN 'pptx' THEN '课件' WHEN 'pdf' THEN '文档' WHEN 'doc' THEN '文档' WHEN 'docx' THEN '文档' ELSE '网页' END) AS resource_type FROM g)"""


def _ctx(value):
    return f"CASE WHEN contains(lower(x), {S.lit(value.lower())}) THEN {S.lit(value)} END"


QUERIES["web_candidates"] = web_candidates
ORACLE["web_candidates"] = rf"""WITH {_WEB_CTE}
SELECT ordinal, coalesce(nullif(h, ''), '网页搜索') AS source_name, url AS source_url, left(sha1(url), 16) AS resource_id, title, snippet AS description,
 resource_type, format, {_ctx('en')} AS stage, {_ctx('fr')} AS grade,
 CASE WHEN {S.any_of('lower(x)', SUBJECTS[0][2])} THEN 'english' END AS subject,
 CASE WHEN {S.any_of('lower(x)', SUBJECTS[0][2])} THEN 'language' WHEN {S.any_of('lower(x)', SUBJECTS[1][2])} THEN 'romance' END AS learning_domain,
 {_ctx('page=2')} AS version, {_ctx('utm_source')} AS volume,
 CASE WHEN contains(lower(x), 'the')::INT + contains(lower(x), 'and')::INT + contains(lower(x), 'que')::INT >= 1 THEN 'the and/que' END AS topic,
 h AS provider, contains(x, 'example.net') OR contains(h, 'example.net') AS official, format NOT IN ('html', 'video', 'audio') AS downloadable,
 contains(x, 'ref=x') AS requires_auth,
 round(((title <> '')::INT + (url <> '')::INT + (snippet <> '')::INT + (resource_type <> '')::INT + (format <> '')::INT) / 5.0, 2)::DOUBLE AS metadata_confidence,
 CASE WHEN contains(x, '%%%') THEN '包含风险词：%%%' ELSE '' END AS warnings FROM w"""


def link_candidates(spark, sf):
    prof = profiles(spark, sf).withColumn("resource_links", P.link_array("html", "url"))
    rows = C.profile_links(prof).withColumns(
        {
            # the hrefs have no suffix, so a format by length stands in
            "raw_format": F.element_at(F.array(*[F.lit(x) for x in ("pdf", "jpeg", "mp3", "none")]), F.length("raw_text") % 4 + 1),
            "ordinal": F.col("page_id") * (1 << 32) + F.col("pos"),
        }
    )
    return C.link_candidates(
        rows, FILTERS, include_non_generic=True, type_rules=TYPES, subject_rules=SUBJECTS, auth_terms=AUTH, official_hints=OFFICIAL
    ).select(
        "ordinal", "source_name", "source_url", "resource_id", "title", "description", "resource_type", "format", "stage",
        "subject", "learning_domain", "topic", "official", "requires_auth", "metadata_confidence", "copies",
        F.array_join("source_warnings", "|").alias("warnings"),
    )


QUERIES["link_candidates"] = link_candidates
ORACLE["link_candidates"] = rf"""WITH {_PROFILE_CTE},
 l AS (SELECT k.page_id * 4294967296 + k.pos AS ordinal, k.url AS page, k.link, k.text, p.title AS ptitle, p.auth_hints, p.warns,
   ['pdf', 'jpg', 'mp3', 'none'][length(k.text) % 4 + 1] AS format FROM links k JOIN prof p USING (page_id)),
 o AS (SELECT *, count(*) OVER (PARTITION BY link) AS copies, row_number() OVER (PARTITION BY link ORDER BY ordinal) AS n FROM l WHERE format <> 'none'),
 q AS (SELECT *, {S.clean('text')} AS t0, {S.clean('ptitle')} AS ot, {S.host('page')} AS h FROM o WHERE n = 1),
 v AS (SELECT *, CASE WHEN t0 <> '' THEN t0 ELSE '未命名资源' END AS title, '来自 ' || CASE WHEN ot <> '' THEN ot ELSE h END AS description FROM q),
 x AS (SELECT *, concat_ws(' ', title, description, link, page) AS x FROM v),
 y AS (SELECT *, coalesce({S.first_label('lower(x)', TYPES)}, CASE format WHEN 'mp3' THEN '音频' WHEN 'jpg' THEN '图片' ELSE '文档' END) AS resource_type FROM x)
SELECT ordinal::BIGINT AS ordinal, h AS source_name, link AS source_url, left(sha1(link), 16) AS resource_id, title, description, resource_type, format,
 {_ctx('en')} AS stage, CASE WHEN {S.any_of('lower(x)', SUBJECTS[0][2])} THEN 'english' END AS subject,
 CASE WHEN {S.any_of('lower(x)', SUBJECTS[0][2])} THEN 'language' WHEN {S.any_of('lower(x)', SUBJECTS[1][2])} THEN 'romance' END AS learning_domain,
 CASE WHEN contains(lower(x), 'the')::INT + contains(lower(x), 'and')::INT + contains(lower(x), 'que')::INT >= 1 THEN 'the and/que' END AS topic,
 contains(x, 'example.net') OR contains(h, 'example.net') AS official, len(auth_hints) > 0 OR contains(x, 'token') AS requires_auth,
 least(1.0, ((title <> '')::INT + 4) / 5.0 + CASE WHEN ot <> '' THEN 0.08 ELSE 0 END - CASE WHEN title = '未命名资源' THEN 0.2 ELSE 0 END)::DOUBLE AS metadata_confidence,
 copies::BIGINT AS copies, array_to_string(list_concat(warns, CASE WHEN len(auth_hints) > 0 THEN ['来源页面可能存在登录、付费或授权限制'] ELSE [] END), '|') AS warnings
FROM y"""


def known_source(spark, sf):
    pages = table(spark, sf, "pages").select(
        "page_id", V.known_source(P.host("url"), V.path("url"), KNOWN).alias("k")
    )
    return pages.where("k is not null").select("page_id", F.col("k.adapter").alias("adapter"), F.col("k.reason").alias("reason"))


QUERIES["known_source"] = known_source
ORACLE["known_source"] = rf"""SELECT page_id, CASE WHEN contains({S.path('url')}, '/en') THEN 'adapter-a' ELSE 'adapter-b' END AS adapter,
 CASE WHEN contains({S.path('url')}, '/en') THEN 'english pages' ELSE 'other pages' END AS reason FROM pages WHERE contains({S.host('url')}, 'example.org')"""


def source_rules(spark, sf):
    """Every page against a table of rules: the last two labels of each host with the first folder of each path."""
    pages = table(spark, sf, "pages").select("page_id", P.host("url").alias("host"), V.path("url").alias("path"))
    parts = pages.select("page_id", F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1).alias("host_part"), F.regexp_extract("path", "^(/[^/]*)", 1).alias("path_part"))
    rules = parts.groupBy("host_part", "path_part").agg(F.max("page_id").alias("rule"))
    rules = rules.withColumns({"adapter": F.concat_ws("|", "host_part", "path_part"), "reason": F.col("rule").cast("string")})
    return V.known_sources(pages, rules).select("page_id", "adapter", "reason")


QUERIES["source_rules"] = source_rules
ORACLE["source_rules"] = rf"""WITH p AS (SELECT page_id, {S.host('url')} AS host, {S.path('url')} AS path FROM pages),
 r AS (SELECT regexp_extract(host, '([^.]+\.[^.]+)$', 1) AS h, regexp_extract(path, '^(/[^/]*)', 1) AS f, max(page_id) AS rule FROM p GROUP BY 1, 2),
 d AS (SELECT DISTINCT host, path FROM p), m AS (SELECT host, path, arg_min({{'h': h, 'f': f, 'rule': rule}}, rule) AS r FROM d JOIN r ON contains(host, h) AND contains(path, f) GROUP BY 1, 2)
SELECT page_id, concat_ws('|', m.r.h, m.r.f) AS adapter, m.r.rule::VARCHAR AS reason FROM p LEFT JOIN m USING (host, path)"""


def discovered(spark, sf):
    rows = C.load_search_results(results(spark, sf)).select(
        "ordinal", "title", F.col("snippet").alias("description"), F.col("url").alias("source_url"), P.host("url").alias("source_name")
    )
    return V.source_discovery(
        rows, 6.0, resource_terms=RESOURCE, direct_formats=["utm", "html"], video_terms=VIDEO, article_terms=ARTICLES,
        risk_terms=SOURCE_RISK, auth_terms=WALL, official_hosts=OFFICIAL, format_rules=FORMATS, type_rules=TYPES, sources=KNOWN,
    )


_DISC_CTE = rf"""r AS ({RESULTS_SQL}), b AS (SELECT *, {S.host('url')} AS host, {S.path('url')} AS pth,
   lower(concat_ws(' ', {S.blank_to_null('title')}, {S.blank_to_null('snippet')}, {S.blank_to_null(S.host('url'))}, {S.blank_to_null('url')})) AS blob FROM r),
 h AS (SELECT *, contains(host, 'example.org') AS known, {S.count_of('blob', RESOURCE)} AS terms, contains(blob, '###') AS risky,
   list_filter([CASE WHEN contains(blob, 'utm') THEN 'utm' END, CASE WHEN contains(blob, 'html') THEN 'html' END,
     CASE WHEN contains(blob, '.html') THEN 'page' END, CASE WHEN contains(blob, 'utm_source') THEN 'feed' END], lambda v: v IS NOT NULL) AS hints FROM b),
 c AS (SELECT *, CASE WHEN risky THEN 'download_risk' WHEN known THEN 'known_source' WHEN {S.any_of('blob', VIDEO)} THEN 'video_page'
   WHEN terms >= 2 THEN 'resource_site' WHEN terms = 1 THEN 'resource_page' WHEN {S.any_of('blob', ARTICLES)} THEN 'article_page' ELSE 'unknown' END AS source_type FROM h),
 d AS (SELECT *, CASE source_type WHEN 'download_risk' THEN 'reject' WHEN 'known_source' THEN 'use_known_source_skill' WHEN 'resource_page' THEN 'extract_direct_candidates'
   WHEN 'video_page' THEN 'profile_site' WHEN 'resource_site' THEN 'profile_site' ELSE 'keep_as_web_candidate' END AS next_action,
   CASE WHEN contains(host, 'example.net') THEN 8.0 ELSE 3.0 END::DECIMAL(6,2) AS authority,
   least(terms * 2.0 + len(hints) * 1.5, 10.0)::DECIMAL(6,2) AS density,
   (7.0 - CASE WHEN contains(blob, 'ref=x') THEN 3 ELSE 0 END + CASE WHEN source_type = 'resource_page' THEN 1 ELSE 0 END)::DECIMAL(6,2) AS access,
   CASE WHEN risky THEN 6.0 ELSE 10.0 END::DECIMAL(6,2) AS safety FROM c),
 s AS (SELECT *, round(CASE source_type WHEN 'known_source' THEN 8.0 WHEN 'resource_site' THEN 6.5 WHEN 'resource_page' THEN 6.0 WHEN 'video_page' THEN 5.5
     WHEN 'article_page' THEN 3.5 WHEN 'unknown' THEN 2.5 ELSE 0.0 END::DECIMAL(8,4) + authority * 0.25::DECIMAL(4,2) + density * 0.35::DECIMAL(4,2)
     + access * 0.2::DECIMAL(4,2) + safety * 0.2::DECIMAL(4,2), 2) AS raw FROM d),
 disc AS (SELECT *, least(CASE WHEN source_type = 'download_risk' THEN least(raw, 2.0) ELSE raw END, 10.0)::DOUBLE AS source_score FROM s),
 acc AS (SELECT *, next_action <> 'reject' AND source_score >= 6.0 AS accepted FROM disc)"""

QUERIES["source_discovery"] = lambda spark, sf: discovered(spark, sf).select(
    "ordinal", "source_id", "host", "source_type", "next_action", "source_score", "authority_score", "resource_density_score",
    "accessibility_score", "risk_score", "known_skill", "accepted", F.array_join("resource_format_hints", "|").alias("format_hints"),
    F.array_join("resource_type_hints", "|").alias("type_hints"), F.array_join("reasons", "|").alias("reasons"),
    F.array_join("warnings", "|").alias("warnings"),
)
ORACLE["source_discovery"] = rf"""WITH {_DISC_CTE}
SELECT ordinal, left(sha1(url), 16) AS source_id, host, source_type, next_action, source_score, authority::DOUBLE AS authority_score,
 density::DOUBLE AS resource_density_score, access::DOUBLE AS accessibility_score, safety::DOUBLE AS risk_score,
 CASE WHEN known AND contains(pth, '/en') THEN 'adapter-a' WHEN known THEN 'adapter-b' ELSE '' END AS known_skill, accepted,
 array_to_string(hints, '|') AS format_hints, array_to_string({S.labels('blob', TYPES)}, '|') AS type_hints,
 array_to_string(list_filter([CASE WHEN contains(host, 'example.net') THEN '来源域名具备教育或官方属性' END, CASE WHEN density >= 5 THEN '页面包含较多资源信号' END,
  CASE WHEN known AND contains(pth, '/en') THEN 'english pages' WHEN known THEN 'other pages' END], lambda v: v IS NOT NULL), '|') AS reasons,
 array_to_string(list_filter([CASE WHEN contains(blob, 'ref=x') THEN '可能需要登录或付费' END, CASE WHEN risky THEN '包含风险词：###' END], lambda v: v IS NOT NULL), '|') AS warnings
FROM acc"""

QUERIES["top_sources"] = lambda spark, sf: V.top_sources(discovered(spark, sf), 20).select("ordinal", "host", "source_score")
ORACLE["top_sources"] = f"WITH {_DISC_CTE} SELECT ordinal, host, source_score FROM acc WHERE accepted ORDER BY source_score DESC, ordinal LIMIT 20"

QUERIES["discovery_summary"] = lambda spark, sf: V.discovery_summary(discovered(spark, sf), 20).select(
    "input", F.col("sources").cast("bigint").alias("sources"), "rejected", "known_sources", "profile_candidates"
)
ORACLE["discovery_summary"] = rf"""WITH {_DISC_CTE}
SELECT count(*) AS input, least(count(*) FILTER (accepted), 20)::BIGINT AS sources, count(*) FILTER (NOT accepted) AS rejected,
 count(*) FILTER (accepted AND source_type = 'known_source') AS known_sources,
 count(*) FILTER (accepted AND next_action = 'profile_site') AS profile_candidates FROM acc"""

QUERIES["source_runs"] = lambda spark, sf: source_runs(web(spark, sf).withColumn("source", F.col("source_name")))
ORACLE["source_runs"] = rf"""WITH {_WEB_CTE} SELECT coalesce(nullif(h, ''), '网页搜索') AS source, count(*) AS candidate_count,
 count(*) FILTER (contains(x, 'example.net') OR contains(h, 'example.net')) AS official_count,
 count(*) FILTER (format NOT IN ('html', 'video', 'audio')) AS downloadable_count FROM w GROUP BY 1"""
