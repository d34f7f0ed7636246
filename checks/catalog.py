"""Checks on the catalog tree, routes, probes, scans, details and textbooks."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfwise.operators import candidates as C
from shelfwise.operators import catalog as G
from shelfwise.operators import details as D
from shelfwise.operators import filters as X
from shelfwise.operators import rollups as R
from shelfwise.sources.readers import extract_items

from . import inputs as I
from .inputs import NODES_SQL, PROBES_SQL, ROUTES_SQL, table

QUERIES, ORACLE = {}, {}

QUERIES["catalog_tree"] = lambda spark, sf: G.flatten_tree(I.tree_nodes(spark, sf), "id", "up", "name").select(
    "id", "title", "parent", "depth", "path"
)
ORACLE["catalog_tree"] = """
WITH RECURSIVE node AS (
 SELECT 'r' || r_regionkey AS id, NULL::VARCHAR AS up, r_name AS name FROM region UNION ALL
 SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name FROM nation UNION ALL
 SELECT 'c' || c_custkey, 'n' || c_nationkey, c_name FROM customer),
 tree AS (SELECT id, name AS title, '' AS parent, 1 AS depth, name AS path FROM node WHERE up IS NULL UNION ALL
 SELECT n.id, n.name, t.title, t.depth + 1, t.path || '/' || n.name FROM tree t JOIN node n ON n.up = t.id)
SELECT id, title, parent, depth::INT AS depth, path FROM tree"""

QUERIES["catalog_summary"] = lambda spark, sf: G.catalog_summary(G.catalog_rows(I.catalog_nodes(spark, sf)))
ORACLE["catalog_summary"] = f"""WITH {NODES_SQL} SELECT count(*) AS catalogs, count(*) AS resource_catalogs,
 count(*) FILTER (h5_url <> '') AS external_catalogs, count(*) FILTER (catalog = 'tchMaterial') AS textbook_catalogs FROM node"""

QUERIES["routes"] = lambda spark, sf: I.routes(spark, sf).select(
    "ordinal", "route_id", "title", "catalog", "sub_catalog", "type", "page_url", "scan_strategy", "search_tab_code",
    F.array_join("supported_commands", "|").alias("commands"), F.array_join("detail_url_templates", "|").alias("templates"),
    "requires_runtime_validation",
)
ORACLE["routes"] = f"""WITH {ROUTES_SQL} SELECT ordinal, route_id, title, catalog, sub_catalog, type, page_url, scan_strategy, search_tab_code,
 CASE WHEN scan_strategy = 'internal_adapter' THEN 'textbook-candidates' ELSE 'search-resources|candidates-from-detail' END AS commands,
 CASE WHEN scan_strategy = 'internal_adapter' THEN '' ELSE 'https://s-file-1.ykt.cbern.com.cn/zxx/ndrv2/resources/' || catalog || '/details/{{id}}.json|https://s-file-2.ykt.cbern.com.cn/zxx/ndrv2/resources/' || catalog || '/details/{{id}}.json' END AS templates,
 scan_strategy <> 'internal_adapter' AS requires_runtime_validation FROM route""".replace("{{", "{").replace("}}", "}")

QUERIES["route_dedupe"] = lambda spark, sf: G.dedupe_routes(I.routes(spark, sf)).select("route_id", "ordinal", "copies")
ORACLE["route_dedupe"] = f"WITH {ROUTES_SQL} SELECT route_id, min(ordinal) AS ordinal, count(*) AS copies FROM route GROUP BY route_id"

QUERIES["route_coverage"] = lambda spark, sf: R.route_coverage(I.routes(spark, sf))
ORACLE["route_coverage"] = f"""WITH {ROUTES_SQL}, f AS (
 SELECT 'catalogs' AS dimension, catalog AS value FROM route UNION ALL SELECT 'sub_catalogs', sub_catalog FROM route WHERE sub_catalog <> '' UNION ALL
 SELECT 'types', CASE WHEN type = '' THEN 'unknown' ELSE type END FROM route UNION ALL SELECT 'resource_families', resource_family FROM route UNION ALL
 SELECT 'scan_strategies', scan_strategy FROM route UNION ALL SELECT 'search_tab_codes', search_tab_code FROM route UNION ALL
 SELECT 'supported_commands', unnest(CASE WHEN scan_strategy = 'internal_adapter' THEN ['textbook-candidates'] ELSE ['search-resources', 'candidates-from-detail'] END) FROM route)
SELECT dimension, value, count(*) AS n FROM f GROUP BY ALL"""

QUERIES["select_routes"] = lambda spark, sf: X.select_routes(
    I.routes(spark, sf), catalog="qualityCourse", type="questions", title="AUTO", limit=0
).select("ordinal", "route_id", "title")
ORACLE["select_routes"] = f"""WITH {ROUTES_SQL} SELECT ordinal, route_id, title FROM route
 WHERE catalog = 'qualityCourse' AND type = 'questions' AND contains(title, 'AUTO')"""


def order_tabs(spark, sf):
    routes = I.routes(spark, sf)
    asks = table(spark, sf, "nation").select(
        F.col("n_nationkey").cast("string").alias("request_id"),
        F.array(F.col("n_name"), F.lit("AUTO"), F.lit("course")).alias("terms"),
    )
    return G.order_tabs(routes, asks, ["title", "catalog_name", "type", "catalog", "sub_catalog"], k=6).select(
        "request_id", "tab", "hits", F.col("place").cast("bigint").alias("place")
    )


QUERIES["order_tabs"] = order_tabs
ORACLE["order_tabs"] = f"""WITH {ROUTES_SQL}, u AS (SELECT ordinal, search_tab_code AS tab, concat_ws(' ', title, catalog_name, type, catalog, sub_catalog) AS t
   FROM route WHERE scan_strategy = 'search_then_detail'),
 s AS (SELECT n_nationkey::VARCHAR AS request_id, tab, ordinal, contains(t, n_name)::INT + contains(t, 'AUTO')::INT + contains(t, 'course')::INT AS n FROM u CROSS JOIN nation),
 b AS (SELECT request_id, tab, max(n) AS hits, min_by(ordinal, -n * 100000000 + ordinal) AS best_at FROM s GROUP BY ALL),
 r AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY hits DESC, best_at, tab) AS place FROM b)
SELECT request_id, tab, hits::BIGINT AS hits, place::BIGINT AS place FROM r WHERE place <= 6"""

# ---------------------------------------------------------------- probes and scans
QUERIES["probe_matrix"] = lambda spark, sf: R.probe_matrix(I.probes(spark, sf)).select(
    "tab_code", "resource_type", "search_items_seen", "ok_with_file_items", "ok_no_file_items", "requires_auth", "not_found",
    "request_failed", "public_detail", "requires_auth_context", "file_item_count", "parsed_candidate_count", "conclusion",
    F.array_join("sample_resource_ids", "|").alias("samples"),
)
ORACLE["probe_matrix"] = f"""WITH {PROBES_SQL}, ids AS (SELECT tab_code, resource_type, resource_id, min(ordinal) AS first_at FROM probe GROUP BY ALL),
 top AS (SELECT *, row_number() OVER (PARTITION BY tab_code, resource_type ORDER BY first_at) AS n FROM ids),
 smp AS (SELECT tab_code, resource_type, string_agg(resource_id, '|' ORDER BY n) AS samples FROM top WHERE n <= 5 GROUP BY ALL)
SELECT tab_code, resource_type, count(*) AS search_items_seen, count(*) FILTER (detail_status = 'ok_with_file_items') AS ok_with_file_items,
 count(*) FILTER (detail_status = 'ok_no_file_items') AS ok_no_file_items, count(*) FILTER (detail_status = 'requires_auth') AS requires_auth,
 count(*) FILTER (detail_status = 'not_found') AS not_found, count(*) FILTER (detail_status = 'request_failed') AS request_failed,
 count(*) FILTER (detail_access_policy = 'public_detail') AS public_detail, count(*) FILTER (detail_access_policy = 'requires_auth_context') AS requires_auth_context,
 sum(file_item_count)::BIGINT AS file_item_count, sum(parsed_candidate_count)::BIGINT AS parsed_candidate_count,
 CASE WHEN count(*) FILTER (detail_status = 'ok_with_file_items') > 0 THEN '公开可取' WHEN count(*) FILTER (detail_status = 'ok_no_file_items') > 0 THEN '无文件项'
  WHEN count(*) FILTER (detail_status = 'requires_auth') > 0 THEN '需要授权' WHEN count(*) FILTER (detail_status = 'not_found') > 0 THEN '模板未知' ELSE '需运行时验证' END AS conclusion,
 any_value(samples) AS samples FROM probe JOIN smp USING (tab_code, resource_type) GROUP BY tab_code, resource_type"""

_ST = ["ok_with_file_items", "ok_no_file_items", "requires_auth", "not_found", "request_failed"]
_ST_SQL = ", ".join(f"count(*) FILTER (detail_status = '{s}') AS {s}" for s in _ST)
_OK = "detail_status IN ('ok_with_file_items', 'ok_no_file_items')"
QUERIES["scan_summary"] = lambda spark, sf: R.scan_summary(I.probes(spark, sf)).select(
    "routes_scanned", "search_items_seen", "candidates", "detail_failures", "detail_items_seen", *_ST
)
ORACLE["scan_summary"] = f"""WITH {PROBES_SQL} SELECT count(DISTINCT route_id) AS routes_scanned, count(*) AS search_items_seen,
 count(*) FILTER ({_OK}) AS candidates, count(*) FILTER (NOT {_OK}) AS detail_failures, sum(file_item_count)::BIGINT AS detail_items_seen, {_ST_SQL} FROM probe"""
QUERIES["detail_coverage"] = lambda spark, sf: R.detail_coverage(I.probes(spark, sf)).select(
    "route_id", "search_items_seen", "details_fetched", "detail_failures", "detail_items_seen", *_ST
)
ORACLE["detail_coverage"] = f"""WITH {PROBES_SQL} SELECT route_id, count(*) AS search_items_seen, count(*) FILTER ({_OK}) AS details_fetched,
 count(*) FILTER (NOT {_OK}) AS detail_failures, sum(file_item_count)::BIGINT AS detail_items_seen, {_ST_SQL} FROM probe GROUP BY route_id"""


def first_accessible(spark, sf):
    rows = table(spark, sf, "events").select(
        F.col("user_id").alias("option_id"), F.col("event_id").alias("attempt"),
        F.concat(F.lit("https://files.example.org/"), F.col("event_id").cast("string")).alias("url"),
        ((F.col("event_type") == "view") & (F.col("user_id") % 3 == 0)).alias("ok"),
    )
    return R.first_accessible(rows)


QUERIES["first_accessible"] = first_accessible
ORACLE["first_accessible"] = """SELECT user_id AS option_id, 'https://files.example.org/' || min(event_id) FILTER (event_type = 'view' AND user_id % 3 = 0) AS source_url,
 bool_or(event_type = 'view' AND user_id % 3 = 0) AS accessible, count(*) AS attempts FROM events GROUP BY user_id"""


def _scanned(spark, sf):
    """Routes of the catalog, and probes as scanned items of a route."""
    routes = G.dedupe_routes(I.routes(spark, sf))
    numbered = routes.select("route_id", "title", "scan_strategy", F.col("ordinal").alias("_r"))
    items = I.probes(spark, sf).select(
        "ordinal", F.regexp_extract("route_id", r"(\d+)$", 1).cast("bigint").alias("_r"), "detail_status",
        F.concat(F.lit("https://x.example.org/"), "resource_id").alias("source_url"), "resource_id",
        F.when(F.col("detail_status") == "request_failed", F.lit("request failed")).alias("error"),
    )
    keyed = items.join(numbered.select("_r", "route_id"), "_r").drop("_r")
    return routes, keyed


def site_scan(spark, sf):
    routes, items = _scanned(spark, sf)
    found, lost = G.site_scan(routes, items)
    cols = ["ordinal", "route_id", "source_url", "route_title"]
    return found.select(*cols, "copies", F.lit("candidate").alias("kind")).unionByName(
        lost.select(*cols, F.lit(1).cast("bigint").alias("copies"), F.lit("failure").alias("kind"))
    )


_SCAN_CTE = f"""{ROUTES_SQL}, {PROBES_SQL}, ur AS (SELECT route_id, min(ordinal) AS r FROM route GROUP BY route_id),
 rt AS (SELECT ur.*, title, scan_strategy, catalog FROM ur JOIN route ON route.ordinal = ur.r),
 it AS (SELECT p.ordinal, rt.route_id, rt.title AS route_title, 'https://x.example.org/' || p.resource_id AS source_url, detail_status
   FROM probe p JOIN rt ON rt.r = regexp_extract(p.route_id, '(\\d+)$', 1)::BIGINT WHERE scan_strategy <> 'internal_adapter'),
 ok AS (SELECT *, count(*) OVER (PARTITION BY source_url) AS copies, row_number() OVER (PARTITION BY source_url ORDER BY ordinal) AS n FROM it WHERE detail_status <> 'request_failed')"""
QUERIES["site_scan"] = site_scan
ORACLE["site_scan"] = f"""WITH {_SCAN_CTE} SELECT ordinal, route_id, source_url, route_title, copies::BIGINT AS copies, 'candidate' AS kind FROM ok WHERE n = 1
 UNION ALL SELECT ordinal, route_id, source_url, route_title, 1::BIGINT, 'failure' FROM it WHERE detail_status = 'request_failed'"""


def site_index(spark, sf):
    routes, items = _scanned(spark, sf)
    found, lost = G.site_scan(routes, items)
    return G.site_index(routes, found, lost).select(
        "route_id", "title", "catalog", "scan_strategy", "candidates", "failures"
    )


QUERIES["site_index"] = site_index
ORACLE["site_index"] = f"""WITH {_SCAN_CTE}, c AS (SELECT route_id, count(*) AS candidates FROM ok WHERE n = 1 GROUP BY 1),
 f AS (SELECT route_id, count(*) AS failures FROM it WHERE detail_status = 'request_failed' GROUP BY 1)
SELECT rt.route_id, title, catalog, scan_strategy, coalesce(candidates, 0) AS candidates, coalesce(failures, 0) AS failures
FROM rt LEFT JOIN c USING (route_id) LEFT JOIN f USING (route_id)"""

# ---------------------------------------------------------------- textbooks


def textbooks(spark, sf):
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("ordinal"), F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("title"),
        F.lower("p_type").alias("stage"), F.when(F.col("p_size") % 5 > 0, F.col("p_size").cast("string")).alias("grade"),
        F.element_at(F.split("p_name", " "), 1).alias("subject"), F.col("p_brand").alias("version"),
        F.when(F.col("p_size") > 25, F.lit("upper")).alias("volume"), F.lit(None).cast("string").alias("format"),
        (F.col("p_retailprice") * 100).cast("bigint").alias("size"), F.array(F.col("p_brand"), F.element_at(F.split("p_name", " "), -1)).alias("providers"),
        F.concat(F.lit("https://books.example.org/"), F.col("p_partkey").cast("string")).alias("detail_page"),
    )


BOOKS_SQL = """book AS (SELECT p_partkey AS ordinal, p_partkey::VARCHAR AS id, p_name AS title, lower(p_type) AS stage,
 CASE WHEN p_size % 5 > 0 THEN p_size::VARCHAR END AS grade, split_part(p_name, ' ', 1) AS subject, p_brand AS version,
 CASE WHEN p_size > 25 THEN 'upper' END AS volume, trunc(p_retailprice * 100)::BIGINT AS size,
 p_brand || '/' || split_part(p_name, ' ', -1) AS provider, 'https://books.example.org/' || p_partkey AS detail_page FROM part)"""
QUERIES["part_candidates"] = lambda spark, sf: C.textbook_candidates(textbooks(spark, sf)).select(
    "ordinal", "source_url", "resource_id", "title", "resource_type", "format", "stage", "grade", "subject", "version", "volume",
    "provider", "official", "size", "metadata_confidence",
)
ORACLE["part_candidates"] = f"""WITH {BOOKS_SQL} SELECT ordinal, detail_page AS source_url, id AS resource_id, title, '教材' AS resource_type, 'pdf' AS format, stage, grade,
 subject, version, volume, provider, true AS official, size,
 round((4 + (grade IS NOT NULL)::INT + (volume IS NOT NULL)::INT)::DECIMAL(4,0) / 6, 2)::DOUBLE AS metadata_confidence FROM book"""

QUERIES["filter_records"] = lambda spark, sf: X.filter_records(textbooks(spark, sf), query=" RING ", stage="eco", version="#1").select("ordinal", "title", "stage", "version")
ORACLE["filter_records"] = f"""WITH {BOOKS_SQL} SELECT ordinal, title, stage, version FROM book WHERE contains(stage, 'eco') AND contains(version, '#1')
 AND contains(lower(concat_ws(' ', id, title, stage, grade, subject, version, volume, size, replace(provider, '/', ' '), detail_page)), 'ring')"""

QUERIES["tag_filter"] = lambda spark, sf: X.filter_by_tags(textbooks(spark, sf), F.when(F.col("stage") != "promo", F.lit("Brand#1")), ["stage"]).select("ordinal", "stage", "version")
ORACLE["tag_filter"] = f"""WITH {BOOKS_SQL}, k AS (SELECT *, stage = 'promo' OR contains(version, 'Brand#1') OR contains('Brand#1', version) AS keep FROM book),
 a AS (SELECT *, bool_or(keep) OVER (PARTITION BY stage) AS kept_any FROM k) SELECT ordinal, stage, version FROM a WHERE keep OR NOT kept_any"""

_DIMS = ["stage", "grade", "subject", "version", "volume"]
QUERIES["facets"] = lambda spark, sf: R.facet_counts(textbooks(spark, sf), _DIMS)
ORACLE["facets"] = f"""WITH {BOOKS_SQL}, u AS ({' UNION ALL '.join(f"SELECT '{d}' AS dimension, {d} AS value FROM book" for d in _DIMS)})
SELECT dimension, coalesce(value, 'unknown') AS value, count(*) AS n FROM u GROUP BY ALL"""
QUERIES["ambiguity"] = lambda spark, sf: R.ambiguous_dimensions(textbooks(spark, sf), {"version": "Brand#1"}, _DIMS)
ORACLE["ambiguity"] = f"""WITH {BOOKS_SQL}, u AS ({' UNION ALL '.join(f"SELECT '{d}' AS dimension, {d} AS value FROM book" for d in _DIMS if d != 'version')})
SELECT dimension, count(DISTINCT value) AS n_values FROM u GROUP BY 1 HAVING count(DISTINCT value) > 1"""

# ---------------------------------------------------------------- details: every line is a resource with three files
_STORE = "https://r2-ndr-private.ykt.cbern.com.cn/edu/"
_P, _H1, _H2, _H3 = (
    "https://r1-ndr-private.ykt.cbern.com.cn", "https://r1-ndr.ykt.cbern.com.cn",
    "https://r2-ndr.ykt.cbern.com.cn", "https://r3-ndr.ykt.cbern.com.cn",
)


def line_details(spark, sf):
    """Main file, subtitles and cover of every line; nothing is gathered per order."""
    line, orders = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    fmt = F.element_at(F.array(*[F.lit(x) for x in ("pdf", "video/mp4", "folder", "jpeg")]), (F.col("l_partkey") % 4 + 1).cast("int"))
    order, number = F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")
    stored = F.concat(F.lit("cs_path:${ref-path}/o "), order, F.lit("/"), number)
    listed = F.concat(F.lit(_STORE), F.col("l_suppkey").cast("string"), F.lit("/f 1.bin"))
    none = F.array().cast("array<string>")

    def item(kind, flag, storage, urls, size, private):
        wanted = F.array(F.struct(F.lit("total_size").alias("name"), F.when(F.col("l_linenumber") == 1, F.lit("77")).alias("value")))
        return F.struct(
            kind.alias("ti_format"), kind.alias("lc_ti_format"), flag.alias("ti_file_flag"), storage.alias("ti_storage"),
            urls.alias("ti_storages"), size.alias("ti_size"), private.alias("identification"), wanted.alias("requirements"),
        )

    text = F.lit(None).cast("string")
    items = F.array(
        item(
            fmt, F.lower("l_returnflag"), F.when(F.col("l_linestatus") == "O", stored),
            F.when(F.col("l_returnflag") == "A", F.array(listed)).otherwise(none),
            F.col("l_quantity").cast("bigint").cast("string"), F.col("l_returnflag") == "R",
        ),
        item(F.lit(""), F.lit("href"), F.concat(stored, F.lit(".srt")), none, F.lit("9"), F.lit(False)),
        item(F.lit("image/jpeg"), text, text, F.array(F.concat(F.lit("https://c.example.org/"), number, F.lit(".jpg"))), text, F.lit(False)),
    )
    joined = line.join(orders, F.col("o_orderkey") == F.col("l_orderkey"))
    tags = F.array(F.struct(F.lit("zxxnj").alias("tag_dimension_id"), F.lower("o_orderpriority").alias("tag_name")))
    return joined.select(
        order.alias("detail_id"), order.alias("id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"),
        F.concat(F.lit("Order "), F.col("o_orderstatus")).alias("title"), text.alias("alternate_title"),
        F.lit("d").alias("description"), F.lit("").alias("resource_type_code_name"),
        F.array(F.struct(F.lit("P1").alias("name")), F.struct(F.col("o_orderstatus").alias("name"))).alias("provider_list"),
        tags.alias("tag_list"), items.alias("ti_items"),
    )


QUERIES["detail_items"] = lambda spark, sf: C.detail_candidates(line_details(spark, sf), {"stage": "s1"}, ("detail_id", "line", "part")).select(
    "detail_id", "line", "part", "item_index", "source_url", "resource_id", "title", "resource_type", "format", "stage", "grade",
    "provider", "requires_auth", "size", "metadata_confidence", F.array_join("url_candidates", "|").alias("urls"),
)
ORACLE["detail_items"] = f"""WITH ln AS (SELECT l.*, o_orderstatus, o_orderpriority, '/o%20' || l_orderkey || '/' || l_linenumber AS sfx,
   ['pdf', 'mp4', 'folder', 'jpg'][l_partkey % 4 + 1] AS fmt, '{_STORE}' || l_suppkey || '/f%201.bin' AS listed FROM lineitem l JOIN orders ON o_orderkey = l_orderkey),
 it AS (SELECT *, 1 AS idx, list_concat(CASE WHEN l_linestatus = 'O' THEN ['{_P}' || sfx, '{_H1}' || sfx, '{_H2}' || sfx, '{_H3}' || sfx] ELSE [] END,
     CASE WHEN l_returnflag = 'A' THEN [listed, replace(listed, 'r2-ndr-private', 'r1-ndr')] ELSE [] END) AS urls,
     lower(l_returnflag) AS flag, l_returnflag = 'R' AS private, l_quantity::BIGINT AS sz FROM ln
   UNION ALL SELECT *, 2, ['{_P}' || sfx || '.srt', '{_H1}' || sfx || '.srt', '{_H2}' || sfx || '.srt', '{_H3}' || sfx || '.srt'], 'SRT', false, 9 FROM ln
   UNION ALL SELECT *, 3, ['https://c.example.org/' || l_linenumber || '.jpg'], 'JPG', false, NULL FROM ln),
 v AS (SELECT *, urls[1] AS u, CASE idx WHEN 2 THEN 'srt' WHEN 3 THEN 'jpg' ELSE CASE WHEN fmt = 'folder' AND l_linestatus <> 'O' THEN 'bin' ELSE fmt END END AS f FROM it WHERE len(urls) > 0)
SELECT l_orderkey::VARCHAR AS detail_id, l_linenumber AS line, l_partkey AS part, idx::BIGINT AS item_index, u AS source_url,
 l_orderkey || ':' || idx || ':' || left(sha1(u), 16) AS resource_id, 'Order ' || o_orderstatus || ' - ' || flag AS title,
 CASE f WHEN 'mp4' THEN '视频' WHEN 'jpg' THEN '图片' WHEN 'srt' THEN '字幕' ELSE '文档' END AS resource_type,
 f AS format, 's1' AS stage, lower(o_orderpriority) AS grade, 'P1/' || o_orderstatus AS provider,
 private OR list_bool_or(list_transform(urls, lambda x: contains(x, 'ndr-private'))) AS requires_auth,
 CASE WHEN l_linenumber = 1 THEN 77 ELSE sz END AS size, 1.0::DOUBLE AS metadata_confidence, array_to_string(urls, '|') AS urls
FROM v WHERE f <> 'folder'"""


def pdf_items(spark, sf):
    """Orders look up the part of the same number as their detail."""
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("id"), "o_orderstatus")
    key = F.col("p_partkey").cast("string")
    none = F.array().cast("array<string>")

    def item(fmt, storage, urls):
        return F.struct(fmt.alias("ti_format"), fmt.alias("lc_ti_format"), storage.alias("ti_storage"), urls.alias("ti_storages"))

    items = F.array(
        item(F.when(F.col("p_size") > 20, F.lit("pdf")).otherwise(F.lit("mp4")), F.concat(F.lit("cs_path:${ref-path}/p "), key), none),
        item(F.lit("pdf"), F.lit(None).cast("string"), F.when(F.col("p_size") % 2 == 0, F.array(F.concat(F.lit(_STORE), key))).otherwise(none)),
    )
    found = table(spark, sf, "part").select(key.alias("id"), items.alias("ti_items"))
    return D.attach_pdf_items(orders, found).select(
        "id", F.size("pdf_items").cast("bigint").alias("n_pdf"), F.array_join("pdf_urls", "|").alias("pdf_urls"), "pdf_error"
    )


QUERIES["pdf_items"] = pdf_items
ORACLE["pdf_items"] = f"""SELECT o_orderkey::VARCHAR AS id, CASE WHEN p_partkey IS NOT NULL THEN 1 + (p_size > 20)::BIGINT END AS n_pdf,
 CASE WHEN p_partkey IS NOT NULL THEN concat_ws('|', CASE WHEN p_size > 20 THEN '{_H1}/p%20' || p_partkey || '|{_H2}/p%20' || p_partkey || '|{_H3}/p%20' || p_partkey END,
   CASE WHEN p_size % 2 = 0 THEN '{_STORE}' || p_partkey || '|' || '{_STORE.replace("r2-ndr-private", "r1-ndr")}' || p_partkey END) END AS pdf_urls,
 CASE WHEN p_partkey IS NULL THEN 'detail not found' END AS pdf_error FROM orders LEFT JOIN part ON p_partkey = o_orderkey"""


def detail_lookup(spark, sf):
    """Orders look up three names; line numbers decide which of them exist."""
    items = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("ordinal"), F.col("o_orderkey").cast("string").alias("resource_id"), F.lower("o_orderstatus").alias("catalog")
    )
    line = table(spark, sf, "lineitem").join(items, F.col("l_orderkey") == F.col("ordinal"))
    name = (
        F.when(F.col("l_linenumber") == 2, F.concat_ws("/", "catalog", "resource_id"))
        .when(F.col("l_linenumber") == 3, F.concat_ws("-", "catalog", "resource_id"))
        .when((F.col("l_linenumber") == 5) & (F.col("l_quantity") > 25), F.col("resource_id"))
    )
    found = line.where(name.isNotNull()).select(name.alias("detail_key"), F.col("l_linenumber").alias("detail"))
    return D.attach_details(items, found).select("ordinal", "detail_key", "detail", "lookup_status")


QUERIES["detail_lookup"] = detail_lookup
ORACLE["detail_lookup"] = """WITH d AS (SELECT l_orderkey, l_linenumber, lower(o_orderstatus) AS c,
  CASE WHEN l_linenumber = 5 THEN 1 WHEN l_linenumber = 3 THEN 2 ELSE 3 END AS p FROM lineitem JOIN orders ON o_orderkey = l_orderkey
  WHERE l_linenumber IN (2, 3) OR (l_linenumber = 5 AND l_quantity > 25)),
 b AS (SELECT l_orderkey, min(p) AS p, any_value(c) AS c FROM d GROUP BY 1)
SELECT o_orderkey AS ordinal, CASE p WHEN 1 THEN o_orderkey::VARCHAR WHEN 2 THEN c || '-' || o_orderkey WHEN 3 THEN c || '/' || o_orderkey END AS detail_key,
 CASE p WHEN 1 THEN 5 WHEN 2 THEN 3 WHEN 3 THEN 2 END::INT AS detail, CASE WHEN p IS NULL THEN 'detail_not_found_in_dir' ELSE 'ok' END AS lookup_status
FROM orders LEFT JOIN b ON l_orderkey = o_orderkey"""


def detail_urls(spark, sf):
    catalog = F.element_at(F.array(*[F.lit(x) for x in ("syncClassroom", "qualityCourse", "tchMaterial")]), F.when(F.col("o_orderstatus") == "O", 1).when(F.col("o_orderstatus") == "F", 2).otherwise(3))
    urls = D.detail_url_candidates(
        F.col("o_orderkey").cast("string"), catalog, F.lit(""), F.when(F.col("o_orderkey") % 5 == 0, F.lit("prepare_lesson")),
        F.when(F.col("o_orderkey") % 2 == 0, F.array(F.concat(F.lit("https://s-file-2.ykt.cbern.com.cn/zxx/ndrv2/resources/"), F.col("o_orderkey").cast("string"), F.lit(".json")))).otherwise(F.array().cast("array<string>")),
    )
    return table(spark, sf, "orders").select("o_orderkey", F.array_join(F.transform(urls, lambda u: F.concat_ws(" ", u["family"], u["url"])), "|").alias("urls"))


def _served(family, folder, servers=3):
    return "[" + ", ".join(f"'{family} https://s-file-{i}.ykt.cbern.com.cn/zxx/ndrv2/' || {folder} || o_orderkey || '.json'" for i in range(1, servers + 1)) + "]"


QUERIES["detail_urls"] = detail_urls
ORACLE["detail_urls"] = f"""WITH o AS (SELECT *, CASE o_orderstatus WHEN 'O' THEN 'syncClassroom' WHEN 'F' THEN 'qualityCourse' ELSE 'tchMaterial' END AS c FROM orders),
 e AS (SELECT *, 'https://s-file-2.ykt.cbern.com.cn/zxx/ndrv2/resources/' || o_orderkey || '.json' AS given, list_concat(
  CASE WHEN c = 'syncClassroom' THEN {_served('s-file-ndrv2-national-lesson-detail', "'national_lesson/resources/details/'")} ELSE [] END,
  CASE WHEN o_orderkey % 5 = 0 THEN {_served('s-file-ndrv2-prepare-sub-type-detail', "'prepare_sub_type/resources/details/'")} ELSE [] END,
  CASE WHEN c = 'qualityCourse' THEN {_served('s-file-ndrv2-quality-course-detail', "'resources/'")} ELSE [] END,
  CASE WHEN c = 'tchMaterial' THEN {_served('s-file-ndrv2-tch-material-detail', "'resources/tch_material/details/'")} ELSE [] END,
  {_served('s-file-ndrv2-details', "'resources/' || c || '/details/'", 2)}) AS us FROM o)
SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'search-item-detail-json ' || given || '|' || array_to_string(list_filter(us, lambda x: NOT ends_with(x, given)), '|')
 ELSE array_to_string(us, '|') END AS urls FROM e"""


def json_items(spark, sf):
    """Event properties inside a nested envelope: a list of items and one deeper object."""
    e = table(spark, sf, "events")
    text = F.concat(
        F.lit('{"data": {"items": [{"id": "'), (F.col("event_id") % 50).cast("string"), F.lit('", "title": "'), F.col("event_type"),
        F.lit('", "props": '), F.col("props"), F.lit('}, {"resourceId": "'), F.col("user_id").cast("string"), F.lit('", "contentType": "lesson", "child": {"id": "c'),
        F.col("user_id").cast("string"), F.lit('", "name": "deep"}}, {"id": "'), (F.col("event_id") % 50).cast("string"), F.lit('", "title": "'), F.col("event_type"), F.lit('"}]}}'),
    )
    rows = e.select(F.col("event_id").alias("ordinal"), text.alias("body"))
    return extract_items(rows, "body").select(
        "ordinal", "item_id", "item_title", F.try_variant_get("item", "$.props.k", "bigint").alias("k")
    )


QUERIES["json_items"] = json_items
ORACLE["json_items"] = """SELECT event_id AS ordinal, (event_id % 50)::VARCHAR AS item_id, event_type AS item_title, (props::JSON->>'k')::BIGINT AS k FROM events
 UNION ALL SELECT event_id, user_id::VARCHAR, NULL, NULL FROM events UNION ALL SELECT event_id, 'c' || user_id, 'deep', NULL FROM events"""
