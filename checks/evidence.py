"""Checks on file evidence, names and identities, and on small helpers of the flows."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.functions.text import content_key
from shelfwise.operators import candidates as C
from shelfwise.operators import content as A
from shelfwise.operators import details as D
from shelfwise.operators import filters as X
from shelfwise.operators import intents as N
from shelfwise.operators import library as B
from shelfwise.operators import pages as P
from shelfwise.operators import ranking as K
from shelfwise.operators import search as H
from shelfwise.operators.discovery import profile_summary
from shelfwise.operators.sets import gate_by_count

from . import documents as W
from . import inputs as I
from . import pages as G
from . import requests as Q
from . import sqltext as S
from .inputs import CANDIDATES_SQL as CAND
from .inputs import table

QUERIES, ORACLE = {}, {}

# ---------------------------------------------------------------- files: documents with the magic bytes of several formats
HEADS = ["255044462D312E34202F54797065202F5061676520", "504B0304", "89504E470D0A1A0A", "3C68746D6C3E", "FFD8FF", ""]
DECLARED = ["pdf", "docx", "html", "txt", "srt"]
HEAD_LENGTHS = [len(h) // 2 for h in HEADS]


def byte_files(spark, sf):
    head = F.element_at(F.array(*[F.lit(h) for h in HEADS]), (F.col("doc_id") % 6 + 1).cast("int"))
    return table(spark, sf, "documents").select(
        "doc_id",
        F.concat(F.unhex(head), F.encode("text", "UTF-8")).alias("content"),
        F.element_at(F.array(*[F.lit(d) for d in DECLARED]), (F.col("doc_id") % 5 + 1).cast("int")).alias("format"),
    )


_HTML = r"regexp_matches(text, '(?i)^\s*(<!doctype html|<html|<head|<body)')"
FILES_CTE = f"""fl AS (SELECT doc_id, text, ['{"', '".join(DECLARED)}'][doc_id % 5 + 1] AS format, doc_id % 6 AS m,
   {HEAD_LENGTHS}[doc_id % 6 + 1] + octet_length(encode(text)) AS file_size, len(regexp_extract_all(text, '/Type\\s*/Page\\b')) AS in_text FROM documents),
 sn AS (SELECT *, CASE m WHEN 0 THEN 'pdf' WHEN 1 THEN CASE WHEN format = 'docx' THEN 'docx' ELSE 'zip' END WHEN 2 THEN 'png' WHEN 3 THEN 'html' WHEN 4 THEN 'jpg'
   ELSE CASE WHEN {_HTML} THEN 'html' ELSE format END END AS found FROM fl)"""

QUERIES["sniff_format"] = lambda spark, sf: byte_files(spark, sf).select(
    "doc_id", A.sniff_format(F.col("content"), F.col("format")).alias("found")
)
ORACLE["sniff_format"] = f"WITH {FILES_CTE} SELECT doc_id, found FROM sn"

QUERIES["file_signals"] = lambda spark, sf: A.file_signals(byte_files(spark, sf)).select(
    "doc_id", "detected_format", "analysis_type", "file_size", F.col("page_count").cast("bigint").alias("page_count"),
    F.when(F.col("detected_format") != "html", F.col("text")).alias("text"), F.array_join("file_warnings", "|").alias("warnings"),
)
_CUE = r"\d{2}:\d{2}:\d{2}[,.]\d{3}\s+-->\s+\d{2}:\d{2}:\d{2}[,.]\d{3}"


def _subtitle(x):
    return S.squeeze(f"regexp_replace(regexp_replace({x}, '{_CUE}', ' ', 'g'), '(?m)^\\d+$', ' ', 'g')")


_PLAIN = "CASE WHEN m = 0 THEN '%PDF-1.4 /Type /Page ' || text ELSE text END"
ORACLE["file_signals"] = f"""WITH {FILES_CTE}, pg AS (SELECT *, CASE WHEN found = 'pdf' THEN nullif(in_text + (m = 0)::BIGINT, 0) END AS page_count FROM sn)
SELECT doc_id, found AS detected_format, CASE WHEN found IN ('pdf', 'docx', 'txt') THEN 'document' WHEN found = 'html' THEN 'webpage' WHEN found IN ('png', 'jpg') THEN 'image' ELSE 'unknown' END AS analysis_type,
 file_size, page_count, CASE found WHEN 'html' THEN NULL WHEN 'txt' THEN {_PLAIN} WHEN 'srt' THEN {_subtitle(_PLAIN)} ELSE '' END AS text,
 concat_ws('|', CASE WHEN format <> found THEN '文件格式与实际内容不一致：声明为 ' || format || '，实际像 ' || found END,
  CASE WHEN file_size < 512 AND found NOT IN ('html', 'txt') THEN '文件过小，可能不是完整资源' END,
  CASE WHEN found = 'pdf' AND page_count IS NULL THEN '无法解析 PDF 页数' END) AS warnings FROM pg"""

QUERIES["validate_content"] = lambda spark, sf: byte_files(spark, sf).select(
    "doc_id",
    A.validate_content(
        F.col("content"), F.col("format"), F.when(F.col("doc_id") % 7 == 0, F.lit("图片")).otherwise(F.lit("文档")),
        F.when(F.col("doc_id") % 4 == 0, F.lit("text/html; charset=utf-8")).otherwise(F.lit("application/pdf")),
    ).alias("problem"),
)
ORACLE["validate_content"] = rf"""WITH {FILES_CTE}, k AS (SELECT *, CASE format WHEN 'pdf' THEN 'pdf' WHEN 'html' THEN 'html' WHEN 'docx' THEN CASE WHEN doc_id % 7 = 0 THEN 'image' ELSE '' END ELSE 'text' END AS wanted,
  CASE WHEN m = 0 THEN 'pdf' WHEN m IN (2, 4) THEN 'image' WHEN m = 3 THEN 'html' WHEN m = 1 THEN '' WHEN regexp_matches(text, '(?i)^\s*(<!doctype html|<html|<script|<head)') THEN 'html'
   WHEN regexp_matches(text, '^\s*[{{\[]') THEN 'json' ELSE '' END AS real FROM fl)
SELECT doc_id, CASE WHEN wanted <> '' AND doc_id % 4 = 0 AND wanted <> 'html' THEN '响应是 HTML 页面，不是预期的 ' || format || ' 文件'
  WHEN wanted = 'pdf' AND real <> 'pdf' THEN '响应内容不是 PDF 文件' WHEN wanted = 'image' AND real NOT IN ('', 'image') THEN '响应内容不是图片文件' END AS problem FROM k"""

QUERIES["subtitle_text"] = lambda spark, sf: table(spark, sf, "documents").select(
    "doc_id", A.subtitle_text(F.concat(F.lit("1\n00:00:01,000 --> 00:00:02,500\n"), F.col("text"), F.lit("\n2\n00:00:03.000  -->  00:00:04.000\nend"))).alias("text")
)
ORACLE["subtitle_text"] = f"""SELECT doc_id, {_subtitle("('1' || chr(10) || '00:00:01,000 --> 00:00:02,500' || chr(10) || text || chr(10) || '2' || chr(10) || '00:00:03.000  -->  00:00:04.000' || chr(10) || 'end')")} AS text FROM documents"""

QUERIES["content_key"] = lambda spark, sf: table(spark, sf, "documents").select("doc_id", content_key("text").alias("key"))
ORACLE["content_key"] = "SELECT doc_id, sha256(text) AS key FROM documents"

QUERIES["block_suffix"] = lambda spark, sf: X.block_library_suffix(table(spark, sf, "documents").select(
    "doc_id", F.concat(F.lit("lib.d/"), F.col("doc_id").cast("string"), F.lit("."), F.element_at(F.array(*[F.lit(x) for x in ("pdf", "JSON", "log", "html")]), (F.col("doc_id") % 4 + 1).cast("int"))).alias("library_file")
))
ORACLE["block_suffix"] = "SELECT doc_id, 'lib.d/' || doc_id || '.' || ['pdf', 'JSON', 'log', 'html'][doc_id % 4 + 1] AS library_file FROM documents WHERE doc_id % 4 IN (0, 3)"

# half of the documents are named as if a copy had been numbered before, so numbers and own names meet
def named_paths(spark, sf):
    own = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("_"), (F.col("doc_id") % 7 + 2).cast("string")))
    path = F.concat_ws("", "source", F.lit("/v1.0/"), "lang", own, F.when(F.col("doc_id") % 3 > 0, F.lit(".txt")))
    return B.unique_paths(table(spark, sf, "documents").select("doc_id", path.alias("path")), ordinal="doc_id", block=64)


QUERIES["unique_paths"] = named_paths
# placed one by one: every step takes the next document of each family of names and the first free number
ORACLE["unique_paths"] = """WITH RECURSIVE p AS (SELECT doc_id, source || '/v1.0/' || lang AS base, CASE WHEN doc_id % 2 = 0 THEN '_' || (doc_id % 7 + 2) ELSE '' END AS own, CASE WHEN doc_id % 3 > 0 THEN '.txt' ELSE '' END AS tail FROM documents),
 o AS (SELECT doc_id, base || own AS stem, tail, base || tail AS family, row_number() OVER (PARTITION BY base, tail ORDER BY doc_id) AS k FROM p),
 s AS (SELECT DISTINCT family, 0::BIGINT AS k, []::VARCHAR[] AS used, NULL::BIGINT AS doc_id, NULL::VARCHAR AS path FROM o UNION ALL
  SELECT family, k, list_append(used, path), doc_id, path FROM (SELECT s.family, o.k, used, o.doc_id, CASE WHEN NOT list_contains(used, stem || tail) THEN stem || tail
   ELSE stem || '_' || list_filter(range(2, len(used) + 3), lambda n: NOT list_contains(used, stem || '_' || n || tail))[1] || tail END AS path FROM s JOIN o ON o.family = s.family AND o.k = s.k + 1))
SELECT doc_id, path FROM s WHERE doc_id IS NOT NULL"""

QUERIES["gate_by_count"] = lambda spark, sf: gate_by_count(table(spark, sf, "documents").select(F.concat_ws("-", "source", "lang").alias("intent_id")), 8)
ORACLE["gate_by_count"] = "SELECT source || '-' || lang AS intent_id, count(*) AS n, count(*) >= 8 AS enough FROM documents GROUP BY 1"


def partition_ranked(spark, sf):
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left").select(
        "doc_id", F.when(F.col("quality") == 1, "high").when(F.col("toxic") == 1, "reject").when(F.col("quality") == 0, "low").otherwise("medium").alias("quality_level")
    )
    seen, rejected = K.partition_ranked(rows)
    return seen.withColumn("part", F.lit("visible")).unionByName(rejected.withColumn("part", F.lit("rejected")))


QUERIES["partition_ranked"] = partition_ranked
ORACLE["partition_ranked"] = """WITH l AS (SELECT doc_id, CASE WHEN quality = 1 THEN 'high' WHEN toxic = 1 THEN 'reject' WHEN quality = 0 THEN 'low' ELSE 'medium' END AS quality_level
 FROM documents LEFT JOIN labels USING (doc_id)) SELECT *, CASE quality_level WHEN 'reject' THEN 'rejected' ELSE 'visible' END AS part FROM l"""

_STATES = [None, "completed", "partial", "failed"]


def post_selection(spark, sf):
    states = F.array(*[F.lit(s).cast("string") for s in _STATES])

    def state(step):
        return F.element_at(states, (F.floor(F.col("event_id") / step) % 4 + 1).cast("int"))

    return table(spark, sf, "events").select(
        "event_id", B.post_selection_status(state(1), state(4), state(16), F.col("user_id") % 2).alias("status")
    )


QUERIES["post_selection"] = post_selection
ORACLE["post_selection"] = """WITH e AS (SELECT event_id, user_id, [NULL, 'completed', 'partial', 'failed'][event_id % 4 + 1] AS d, [NULL, 'completed', 'partial', 'failed'][event_id // 4 % 4 + 1] AS o,
 [NULL, 'completed', 'partial', 'failed'][event_id // 16 % 4 + 1] AS i FROM events)
SELECT event_id, CASE WHEN coalesce(d, 'failed') = 'failed' THEN 'post_selection_failed' WHEN d = 'partial' OR coalesce(o IN ('partial', 'failed'), false) OR coalesce(i IN ('partial', 'failed'), false) THEN 'post_selection_partial'
 WHEN o IS NULL AND i IS NULL THEN CASE WHEN user_id % 2 > 0 THEN 'post_selection_probed' ELSE 'post_selection_downloaded' END ELSE 'post_selection_completed' END AS status FROM e"""

# ---------------------------------------------------------------- words and filters of requests
QUERIES["build_query"] = lambda spark, sf: table(spark, sf, "documents").select(
    "doc_id",
    C.build_query(
        {
            "learner_age": (F.col("doc_id") % 10).cast("string"), "stage": F.col("lang"), "grade": F.when(F.col("doc_id") % 3 == 0, F.lit(" ")),
            "subject": F.col("source"), "core_topic": F.col("lang"), "resource_types": ["worksheet"],
        },
        printable=F.col("doc_id") % 2 == 0,
    ).alias("words"),
)
ORACLE["build_query"] = "SELECT doc_id, (doc_id % 10) || '岁 ' || lang || ' ' || source || ' worksheet' || CASE WHEN doc_id % 2 = 0 THEN ' 可打印' ELSE '' END AS words FROM documents"

QUERIES["intent_filters"] = lambda spark, sf: N.intent_filters(
    table(spark, sf, "documents").select(
        "doc_id", F.struct(F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("stage"), F.col("source").alias("subject")).alias("filters"),
        F.concat(F.lit("own-"), F.col("lang")).alias("stage"), F.when(F.col("doc_id") % 3 == 0, F.lit("g")).alias("grade"),
    ),
    ["stage", "subject", "grade"],
)
ORACLE["intent_filters"] = """SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN lang ELSE 'own-' || lang END AS stage, source AS subject, CASE WHEN doc_id % 3 = 0 THEN 'g' END AS grade FROM documents"""

# ---------------------------------------------------------------- pages and identities
_KINDS = ["national_lesson", "elite_lesson", "prepare_lesson", "", "lesson kind"]
_CATALOGS = ["qualityCourse", "sync/Classroom", ""]


def _pages(spark, sf):
    pick = lambda values, by: F.element_at(F.array(*[F.lit(v) for v in values]), (by + 1).cast("int"))
    page = D.detail_page(
        F.col("o_orderkey").cast("string"), pick(_CATALOGS, F.col("o_orderkey") % 3), F.when(F.col("o_orderkey") % 2 == 0, F.lit("sub")),
        pick(_KINDS, F.col("o_orderkey") % 5),
        F.when(F.col("o_orderkey") % 11 == 0, F.concat(F.lit("https://pages.example.org/x/y?id="), F.col("o_orderkey").cast("string"))),
    )
    return table(spark, sf, "orders").select("o_orderkey", page.alias("page"))


_SITE = "https://basic.smartedu.cn/"
_PAGE_CTE = f"""o AS (SELECT o_orderkey, o_orderkey::VARCHAR AS id, coalesce(nullif(['qualityCourse', 'sync/Classroom', ''][o_orderkey % 3 + 1], ''), 'syncClassroom') AS cat,
  CASE WHEN o_orderkey % 2 = 0 THEN 'sub' END AS sub, coalesce(nullif(['{"', '".join(_KINDS)}'][o_orderkey % 5 + 1], ''), 'resource') AS kind, o_orderkey % 11 = 0 AS own FROM orders),
 pg AS (SELECT *, replace(cat, '/', '%2F') AS q, CASE WHEN own THEN 'https://pages.example.org/x/y?id=' || id WHEN kind = 'national_lesson' THEN '{_SITE}syncClassroom/classActivity?activityId=' || id
  WHEN kind = 'elite_lesson' THEN '{_SITE}qualityCourse?courseId=' || id WHEN kind = 'prepare_lesson' THEN '{_SITE}syncClassroom/prepare/detail?resourceId=' || id
  ELSE '{_SITE}' || replace(cat, '/', '%2F') || '/detail?contentType=' || replace(kind, ' ', '%20') || '&contentId=' || id || '&catalogType=' || replace(cat, '/', '%2F') || '&subCatalog=' || coalesce(sub, '') END AS page FROM o)"""
QUERIES["detail_page"] = _pages
ORACLE["detail_page"] = f"WITH {_PAGE_CTE} SELECT o_orderkey, page FROM pg"

QUERIES["url_identity"] = lambda spark, sf: _pages(spark, sf).select("o_orderkey", D.identity_from_url(F.col("page")).alias("i")).select("o_orderkey", "i.*")
ORACLE["url_identity"] = f"""WITH {_PAGE_CTE}, c AS (SELECT *, NOT own AND kind NOT IN ('national_lesson', 'elite_lesson', 'prepare_lesson') AS plain,
 CASE WHEN own THEN 'x' WHEN kind IN ('national_lesson', 'prepare_lesson') THEN 'syncClassroom' WHEN kind = 'elite_lesson' THEN 'qualityCourse' ELSE cat END AS first FROM pg)
SELECT o_orderkey, id AS resource_id, first AS tab_code, first AS catalog, CASE WHEN plain THEN sub END AS sub_catalog,
 CASE WHEN plain OR NOT own AND kind <> 'prepare_lesson' THEN kind END AS content_type FROM c"""


def item_rows(spark, sf):
    """Events as search items of unknown JSON."""
    e = table(spark, sf, "events")
    body = F.concat(
        F.lit('{"resourceId": "r'), F.col("event_id").cast("string"), F.lit('", "name": "<em>'), F.col("event_type"), F.lit("</em> no "), (F.col("user_id") % 9).cast("string"),
        F.lit('", "resource_type": "'), F.when(F.col("event_type") == "view", F.lit("national_lesson")).otherwise(F.lit("lesson")),
        F.lit('", "format": "pdf", "resourceTypeName": "T", "summary": "s"'), F.when(F.col("user_id") % 2 == 0, F.lit(', "catalogType": "cat"')).otherwise(F.lit("")),
        F.lit(', "tags": [{"dimension_id": "zxxxd", "title": "'), F.col("event_type"), F.lit('"}], "extra": {"providers": [{"name": "A"}, {"name": "B"}]}}'),
    )
    return e.select("event_id", F.try_parse_json(body).alias("item"))


_ITEM_CTE = f"""it AS (SELECT event_id, user_id, event_type, 'r' || event_id AS id, event_type = 'view' AS national, CASE WHEN user_id % 2 = 0 THEN 'cat' END AS given FROM events),
 ip AS (SELECT *, CASE WHEN national THEN '{_SITE}syncClassroom/classActivity?activityId=' || id ELSE '{_SITE}' || coalesce(given, 'syncClassroom') || '/detail?contentType=lesson&contentId=' || id
  || '&catalogType=' || coalesce(given, 'syncClassroom') || '&subCatalog=' END AS page, CASE WHEN national THEN 'syncClassroom' ELSE coalesce(given, 'syncClassroom') END AS cat FROM it)"""
QUERIES["item_identity"] = lambda spark, sf: C.item_identity(item_rows(spark, sf)).drop("item")
ORACLE["item_identity"] = f"""WITH {_ITEM_CTE} SELECT event_id, page AS detail_page, id AS resource_id, cat AS catalog, cat AS tab_code, '' AS sub_catalog,
 CASE WHEN national THEN 'national_lesson' ELSE 'lesson' END AS content_type, CASE WHEN national THEN 'national_lesson' ELSE 'lesson' END AS resource_type, 'T' AS resource_type_name FROM ip"""

QUERIES["item_candidates"] = lambda spark, sf: C.item_candidates(item_rows(spark, sf), "asked", {"grade": "g"}).select(
    "event_id", "source_url", "title", "format", "resource_id", "description", "resource_type", "stage", "grade", "subject", "topic", "provider", "downloadable", "metadata_confidence"
)
ORACLE["item_candidates"] = f"""WITH {_ITEM_CTE} SELECT event_id, page AS source_url, event_type || ' no ' || (user_id % 9) AS title, 'pdf' AS format, 'smartedu-search:' || id AS resource_id, 's' AS description, 'T' AS resource_type,
 event_type AS stage, 'g' AS grade, NULL::VARCHAR AS subject, 'asked' AS topic, 'A/B' AS provider, false AS downloadable, 1.0::DOUBLE AS metadata_confidence FROM ip"""

QUERIES["tags_by_dimension"] = lambda spark, sf: D.tags_by_dimension(
    table(spark, sf, "part").select(
        "p_partkey", F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(c).alias("title")) for d, c in (("zxxxk", "p_brand"), ("other", "p_name"), ("zxxxd", "p_type"), ("zxxxk", "p_name"))]).alias("tags")
    ), "tags",
).drop("tags")
ORACLE["tags_by_dimension"] = "SELECT p_partkey, p_type AS stage, p_brand AS subject, NULL::VARCHAR AS grade, NULL::VARCHAR AS version, NULL::VARCHAR AS volume FROM part"


def textbook_records(spark, sf):
    key = F.col("p_partkey").cast("string")
    url = lambda n: F.concat(F.lit(f"https://img.example.org/{n}/"), key)
    raw = table(spark, sf, "part").select(
        F.col("p_partkey").alias("ordinal"), F.when(F.col("p_size") % 2 == 0, key).alias("id"), F.concat(F.lit("g"), key).alias("global_resource_id"), F.col("p_name").alias("title"),
        F.lit(None).cast("string").alias("description"), F.lit("pdf").alias("format"), F.col("p_size").cast("bigint").alias("size"),
        F.array(F.struct(F.lit("zxxbb").alias("tag_dimension_id"), F.col("p_brand").alias("tag_name"))).alias("tag_list"),
        F.when(F.col("p_size") > 9, F.array(F.struct(F.col("p_type").alias("name")))).otherwise(F.array().cast("array<struct<name:string>>")).alias("provider_list"),
        F.create_map(F.lit("Slide10"), url("b"), F.lit("Slide2"), url("a")).alias("preview"),
        F.when(F.col("p_size") % 3 == 0, F.array(url("t"))).alias("thumbnails"), F.lit("").alias("resource_type_code"),
    )
    return D.textbook_records(raw).select(
        "ordinal", "id", "title", "description", "format", "size", "stage", "version", F.array_join("providers", "|").alias("providers"), "thumbnail",
        F.col("preview_count").cast("bigint").alias("preview_count"), F.array_join("preview_urls", "|").alias("previews"), "detail_page",
    )


QUERIES["textbook_records"] = textbook_records
ORACLE["textbook_records"] = f"""WITH b AS (SELECT *, CASE WHEN p_size % 2 = 0 THEN p_partkey::VARCHAR ELSE 'g' || p_partkey END AS id FROM part)
SELECT p_partkey AS ordinal, id, p_name AS title, '' AS description, 'pdf' AS format, p_size::BIGINT AS size, NULL::VARCHAR AS stage, p_brand AS version,
 CASE WHEN p_size > 9 THEN p_type ELSE '智慧中小学' END AS providers, 'https://img.example.org/' || CASE WHEN p_size % 3 = 0 THEN 't/' ELSE 'a/' END || p_partkey AS thumbnail, 2::BIGINT AS preview_count,
 'https://img.example.org/a/' || p_partkey || '|https://img.example.org/b/' || p_partkey AS previews,
 '{_SITE}tchMaterial/detail?contentType=assets_document&contentId=' || id || '&catalogType=tchMaterial&subCatalog=tchMaterial' AS detail_page FROM b"""


def related_details(spark, sf):
    """Orders with a child of their own, a second copy of themselves and a child without files."""
    key = F.col("o_orderkey").cast("string")
    body = F.concat(
        F.lit('{"id": "'), key, F.lit('", "global_title": "Order '), F.col("o_orderstatus"), F.lit('", "ti_items": [], "provider_list": [{"name": "P"}], "relations": {"resources": [{"id": "c'), key,
        F.lit('", "title": "child", "alias_name": "a", "ti_items": []}, {"id": "'), key, F.lit('", "title": "again", "ti_items": []}], "resource": [{"id": "none", "title": "no files"}]}}'),
    )
    resource = T.StructType.fromDDL(D.RESOURCE)
    relations = T.StructType([T.StructField(r, T.ArrayType(resource)) for r in D.RELATIONS])
    schema = T.StructType([*resource.fields, T.StructField("relations", relations)])
    rows = table(spark, sf, "orders").select(key.alias("detail_id"), F.col("o_orderkey").alias("ordinal"), F.from_json(body, schema).alias("d")).select("detail_id", "ordinal", "d.*")
    return D.related_details(rows).select("detail_id", "ordinal", "id", "title", "alternate_title", F.get("provider_list", F.lit(0))["name"].alias("provider"))


QUERIES["related_details"] = related_details
ORACLE["related_details"] = """SELECT o_orderkey::VARCHAR AS detail_id, o_orderkey AS ordinal, o_orderkey::VARCHAR AS id, 'Order ' || o_orderstatus AS title, NULL::VARCHAR AS alternate_title, 'P' AS provider FROM orders
 UNION ALL SELECT o_orderkey::VARCHAR, o_orderkey, 'c' || o_orderkey, 'child', 'a', 'P' FROM orders"""

QUERIES["probe_summary"] = lambda spark, sf: D.probe_summary(
    I.probes(spark, sf).withColumns({
        "detail_endpoint_family": F.when(F.col("ordinal") % 2 == 0, F.lit("family")), "error": F.when(F.col("event_type").isin("purchase", "view"), F.lit("told")),
        "file_item_count": F.when(F.col("ordinal") % 3 > 0, F.col("file_item_count")),
        "detail_status": F.when(F.col("ordinal") % 7 > 0, F.col("detail_status")), "detail_access_policy": F.when(F.col("ordinal") % 5 > 0, F.col("detail_access_policy")),
    })
).select("ordinal", "detail_status", "detail_access_policy", "detail_endpoint_family", "file_item_count", "parsed_candidate_count", "error", "failed")
ORACLE["probe_summary"] = f"""WITH {I.PROBES_SQL}, d AS (SELECT * REPLACE (CASE WHEN ordinal % 7 > 0 THEN detail_status ELSE 'unknown' END AS detail_status), CASE WHEN event_type IN ('purchase', 'view') THEN 'told' END AS error FROM probe),
 f AS (SELECT *, detail_status NOT IN ('ok_with_file_items', 'ok_no_file_items') AS failed FROM d)
SELECT ordinal, detail_status, CASE WHEN ordinal % 5 > 0 THEN detail_access_policy ELSE 'runtime_validation_needed' END AS detail_access_policy,
 CASE WHEN ordinal % 2 = 0 THEN 'family' ELSE 's-file-ndrv2-details' END AS detail_endpoint_family, CASE WHEN ordinal % 3 > 0 THEN file_item_count ELSE 0 END::INT AS file_item_count, parsed_candidate_count,
 CASE WHEN failed THEN coalesce(error, detail_status) ELSE coalesce(error, '') END AS error, failed FROM f"""

QUERIES["detail_options"] = lambda spark, sf: D.detail_options(
    table(spark, sf, "events").select(F.col("event_id").alias("ordinal"), "user_id", "event_type"), ["user_id"], 12
).select("ordinal", "user_id", "event_type", F.col("rank").cast("bigint").alias("rank"))
ORACLE["detail_options"] = "SELECT * FROM (SELECT event_id AS ordinal, user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rank FROM events) WHERE rank <= 12"


def download_candidates(spark, sf):
    rows = table(spark, sf, "documents").select(
        F.col("doc_id").alias("ordinal"), F.concat(F.lit("o"), F.col("doc_id").cast("string")).alias("option_id"), F.when(F.col("doc_id") % 2 == 0, F.lit("fetched")).otherwise(F.lit(" ")).alias("title"),
        F.concat(F.lit("f/"), "source").alias("local_file"), F.when(F.col("doc_id") % 3 == 0, F.col("n_chars")).alias("size"),
        F.struct(F.col("lang").alias("title"), F.lit("https://e/").alias("source_url"), F.lit("pdf").alias("format"), F.col("source").alias("provider"), F.lit(7).cast("bigint").alias("size")).alias("candidate"),
    )
    return C.download_candidates(rows)


QUERIES["download_candidates"] = lambda spark, sf: download_candidates(spark, sf).select("ordinal", "option_id", "local_file", "title", "source_url", "format", "provider", "size")
ORACLE["download_candidates"] = """SELECT doc_id AS ordinal, 'o' || doc_id AS option_id, 'f/' || source AS local_file, CASE WHEN doc_id % 2 = 0 THEN 'fetched' ELSE lang END AS title, 'https://e/' AS source_url,
 'pdf' AS format, source AS provider, CASE WHEN doc_id % 3 = 0 THEN n_chars ELSE 7 END::BIGINT AS size FROM documents"""

# ---------------------------------------------------------------- pages
QUERIES["script_sources"] = lambda spark, sf: table(spark, sf, "pages").select(
    "page_id",
    F.array_join(P.script_sources(F.concat(F.lit('<script src="/js/app.js"></script><script async src=\'lib/'), F.col("page_id").cast("string"), F.lit(".js'></script><script src=\"/js/app.js\"></script>"), F.col("html")), "url"), "|").alias("sources"),
)
ORACLE["script_sources"] = f"""WITH p AS (SELECT page_id, url, '/js/app.js' AS a, 'lib/' || page_id || '.js' AS b FROM pages) SELECT page_id, {S.absolute('url', 'a')} || '|' || {S.absolute('url', 'b')} AS sources FROM p"""


def detail_hints(spark, sf):
    key = F.col("page_id").cast("string")
    html = F.concat(F.lit("resourceId: 'no' contentId='inline"), key, F.lit("' <a href=\"/detail?id=q"), key, F.lit("&catalogType=c1\">x</a> https://basic.smartedu.cn/cat/detail?id=s"), key, F.lit(" "), F.col("html"))
    hints = P.detail_hints(html, "url")
    return table(spark, sf, "pages").select("page_id", F.array_join(F.transform(hints, lambda h: F.concat_ws(" ", h["resource_id"], h["catalog"], h["source"])), "|").alias("hints"))


QUERIES["detail_hints"] = detail_hints
ORACLE["detail_hints"] = f"""WITH p AS (SELECT page_id, url, '/detail?id=q' || page_id || '&catalogType=c1' AS a FROM pages)
SELECT page_id, 'inline' || page_id || '  inline-id|s' || page_id || ' cat {_SITE}cat/detail?id=s' || page_id || '|q' || page_id || ' c1 ' || {S.absolute('url', 'a')} AS hints FROM p"""

QUERIES["profile_summary"] = lambda spark, sf: profile_summary(G.profiles(spark, sf))
ORACLE["profile_summary"] = f"""WITH {G._PROFILE_CTE} SELECT count(*) AS profiled, count(*) FILTER (crawl_strategy = 'dedicated_source_skill') AS dedicated_source_recommended,
 count(*) FILTER (crawl_strategy = 'generic_extract') AS generic_extract_recommended FROM prof"""


def extraction_summary(spark, sf):
    prof = G.profiles(spark, sf)
    links = C.profile_links(prof).where("crawl_strategy = 'generic_extract'").select("raw_url").distinct()
    return C.extraction_summary(prof, links)


QUERIES["extraction_summary"] = extraction_summary
ORACLE["extraction_summary"] = f"""WITH {G._PROFILE_CTE}, c AS (SELECT count(DISTINCT link) AS candidates FROM links JOIN prof USING (page_id) WHERE crawl_strategy = 'generic_extract' AND ext = 'html'),
 s AS (SELECT count(*) AS profiles, coalesce(sum(CASE WHEN crawl_strategy = 'generic_extract' THEN n_links END), 0)::BIGINT AS links_seen,
  coalesce(sum(CASE WHEN crawl_strategy <> 'generic_extract' THEN greatest(n_links, 1) END), 0)::BIGINT AS unused FROM prof)
SELECT profiles, links_seen, candidates, unused + links_seen - candidates AS skipped FROM s, c"""


# ---------------------------------------------------------------- reasons of search hits
def index_matches(spark, sf):
    """Every record against one query, with reasons and warnings."""
    asked = table(spark, sf, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("query"), F.when(F.col("item_id") % 2 == 0, F.lit("English")).alias("subject"),
        F.when(F.col("item_id") % 3 == 0, F.array(F.lit("pdf"), F.lit("audio"))).alias("format_preferences"),
    )
    many = asked.agg(F.count("*").alias("_n"))
    pairs = W.library_index(spark, sf).join(many).withColumn("query_id", F.col("ordinal") % F.col("_n")).drop("_n").join(asked, "query_id")
    return H.score_index(pairs).select("query_id", "ordinal", "match_score", F.array_join("match_reasons", "|").alias("reasons"), F.array_join("match_warnings", "|").alias("warnings"))


_TOK = S.word_list("text")
QUERIES["index_matches"] = index_matches
ORACLE["index_matches"] = f"""WITH {CAND}, rec AS (SELECT *, lower(concat_ws(' ', {S.blank_to_null('text')}, format, resource_type, source_url, local_file, stage, '未分年级', coalesce(subject, '综合'), resource_type, source)) AS blob FROM cand),
 q AS (SELECT item_id AS query_id, {Q._unique(_TOK)} AS toks FROM benchmark),
 p AS (SELECT query_id, rec.*, toks, list_filter(toks, lambda t: contains(blob, t)) AS hit, query_id % 2 = 0 AND subject = 'english' AS sub, query_id % 3 = 0 AS wants, format IN ('pdf', 'mp3') AS fits,
   coalesce(quality, 1) = 1 AS there, coalesce(toxic, 0) = 1 AS rev FROM rec JOIN q ON query_id = ordinal % (SELECT count(*) FROM benchmark)),
 r AS (SELECT *, concat_ws('|', CASE WHEN len(hit) > 0 THEN '查询词命中：' || array_to_string(hit, ', ') END, CASE WHEN sub THEN '学科匹配' END, CASE WHEN wants AND fits THEN '格式偏好匹配' END) AS reasons FROM p)
SELECT query_id, ordinal, CASE WHEN reasons = '' THEN 0 ELSE greatest(0, ((len(hit) * 80000 + len(toks)) // (len(toks) * 2)) + CASE WHEN sub THEN 12000 ELSE 0 END + CASE WHEN wants AND fits THEN 8000 ELSE 0 END
  + round((ordinal % 100 / 100.0)::DECIMAL(9,6) * 8000, 0)::BIGINT + CASE WHEN there THEN 6000 ELSE 0 END - CASE WHEN rev THEN 4000 ELSE 0 END) END / 1000.0::DOUBLE AS match_score, reasons,
 concat_ws('|', CASE WHEN wants AND NOT fits THEN '格式与偏好不完全匹配' END, CASE WHEN reasons <> '' AND NOT there THEN '本地文件不存在' END, CASE WHEN reasons <> '' AND rev THEN '资源分类需要复核' END) AS warnings FROM r"""
