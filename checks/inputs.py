"""How the given tables stand in for the library's inputs, in Spark and in SQL.

documents and labels -> candidates with text; events -> probes; part ->
textbooks; region, nation, customer -> catalog tree; orders and lineitem ->
details with file items; conversations -> requests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sqltext as S


# Tables that the checks do much work per row on.
LARGE = ("documents", "pages", "lineitem", "events", "conversations")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A given table.  A large one kept as a single file, which one task would read, is dealt out to all
    cores; a table of several files is read as it is."""
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    return df.repartition(spark.sparkContext.defaultParallelism) if name in LARGE and len(df.inputFiles()) == 1 else df


# ---------------------------------------------------------------- documents as candidates
FORMATS = ["pdf", "html", "mp3", "docx"]
TYPES = ["worksheet", "article", "recording", "paper"]
SUBJECTS = [("english", ["the "]), ("french", ["que "]), ("german", ["der "]), ("spanish", ["los "])]
RISK = ["license", "token ="]
KEYWORDS = ["the", "que", "der", "los", "tion", "ung", "and", "license"]
AUTH = ['token = "']
TRUST = ["src1", "src2"]
ALARM = ["toxic"]


def candidates(spark: SparkSession, sf: str) -> DataFrame:
    """documents left join labels as candidates; labels are unique per document."""
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    from shelfwise.functions.match import compact, first_label

    kind = F.regexp_extract("source", r"(\d+)$", 1).cast("int") % 4 + 1
    joined = docs.join(labels, "doc_id", "left")
    fmt = F.element_at(F.array(*[F.lit(f) for f in FORMATS]), kind)
    return joined.select(
        F.col("doc_id").alias("ordinal"),
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("resource_id"),
        "source",
        F.col("source").alias("source_name"),
        F.element_at(F.split("text", "\n"), 1).alias("title"),
        F.lit(None).cast("string").alias("description"),
        F.concat_ws("", F.lit("https://"), "source", F.lit(".example.org/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), fmt).alias("source_url"),
        F.element_at(F.array(*[F.lit(t) for t in TYPES]), kind).alias("resource_type"),
        fmt.alias("format"),
        F.col("lang").alias("stage"),
        F.lit(None).cast("string").alias("grade"),
        first_label("text", SUBJECTS).alias("subject"),
        F.lit(None).cast("string").alias("learning_domain"),
        F.when(F.col("n_chars") > 1000, F.lit("long")).alias("version"),
        F.lit(None).cast("string").alias("volume"),
        F.lit(None).cast("string").alias("topic"),
        F.col("lang").alias("provider"),
        (F.col("quality") == 1).alias("official"),
        (fmt != "html").alias("downloadable"),
        F.contains("text", F.lit(AUTH[0])).alias("requires_auth"),
        (F.when(F.col("quality").isNotNull(), F.col("doc_id") % 100 / 100.0)).alias("metadata_confidence"),
        compact([F.when(F.col("toxic") == 1, F.lit("toxic text"))]).alias("source_warnings"),
        F.concat_ws("/", F.lit("files"), "source", F.concat(F.col("doc_id").cast("string"), F.lit("."), fmt)).alias("local_file"),
        F.sha2("text", 256).alias("sha256"),
        "text",
        "n_chars",
        "quality",
        "toxic",
    )


CANDIDATES_SQL = f"""cand AS (SELECT doc_id AS ordinal, 'doc-' || doc_id AS resource_id, source, source AS source_name,
  split_part(text, chr(10), 1) AS title, NULL::VARCHAR AS description,
  'https://' || source || '.example.org/' || lang || '/' || doc_id || '.' || fmt AS source_url,
  ['worksheet', 'article', 'recording', 'paper'][k] AS resource_type, fmt AS format, lang AS stage, NULL::VARCHAR AS grade,
  {S.first_label('text', SUBJECTS)} AS subject, NULL::VARCHAR AS learning_domain, CASE WHEN n_chars > 1000 THEN 'long' END AS version,
  NULL::VARCHAR AS volume, NULL::VARCHAR AS topic, lang AS provider, quality = 1 AS official, fmt <> 'html' AS downloadable,
  contains(text, 'token = "') AS requires_auth, CASE WHEN quality IS NOT NULL THEN (doc_id % 100) / 100.0::DOUBLE END AS metadata_confidence,
  CASE WHEN toxic = 1 THEN ['toxic text'] ELSE []::VARCHAR[] END AS source_warnings,
  'files/' || source || '/' || doc_id || '.' || fmt AS local_file, sha256(text) AS sha256, text, n_chars, quality, toxic
 FROM (SELECT *, ['pdf', 'html', 'mp3', 'docx'][k] AS fmt FROM (
   SELECT d.*, quality, toxic, regexp_extract(source, '(\\d+)$', 1)::INT % 4 + 1 AS k FROM documents d LEFT JOIN labels l USING (doc_id))))"""


def files(spark: SparkSession, sf: str) -> DataFrame:
    """Read text of the files: every document has one."""
    rows = candidates(spark, sf)
    return rows.select(
        "local_file",
        F.col("format").alias("detected_format"),
        "text",
        F.col("n_chars").alias("file_size"),
        F.when(F.col("format") == "pdf", F.floor(F.col("n_chars") / 1000)).cast("int").alias("page_count"),
        F.lit(None).cast("struct<width:int,height:int>").alias("image_size"),
        F.lit(None).cast("string").alias("page_title"),
        F.array().cast("array<string>").alias("file_warnings"),
    )


# ---------------------------------------------------------------- events as probes
STATUS = {
    "view": "ok_with_file_items", "click": "ok_no_file_items", "signup": "requires_auth", "purchase": "not_found",
    "error": "request_failed",
}


def probes(spark: SparkSession, sf: str) -> DataFrame:
    from shelfwise.operators.details import access_policy

    status = F
    for name, value in STATUS.items():
        status = status.when(F.col("event_type") == name, value)
    rows = table(spark, sf, "events").select(
        F.col("event_id").alias("ordinal"),
        F.concat(F.lit("route-"), F.col("user_id").cast("string")).alias("route_id"),
        F.concat(F.lit("tab-"), (F.col("user_id") % 7).cast("string")).alias("tab_code"),
        F.concat(F.lit("type-"), (F.col("user_id") % 3).cast("string")).alias("resource_type"),
        F.lit("").alias("resource_type_name"),
        F.concat(F.lit("cat-"), (F.col("user_id") % 7).cast("string")).alias("catalog"),
        F.lit(None).cast("string").alias("sub_catalog"),
        F.lit("lesson").alias("content_type"),
        F.concat(F.lit("res-"), (F.col("event_id") % 500).cast("string")).alias("resource_id"),
        status.alias("detail_status"),
        F.floor("value").cast("int").alias("file_item_count"),
        F.when(F.col("event_type") == "view", F.floor("value")).otherwise(0).cast("int").alias("parsed_candidate_count"),
        "event_type",
    )
    return rows.withColumn("detail_access_policy", access_policy(F.col("detail_status")))


PROBES_SQL = """probe AS (SELECT event_id AS ordinal, 'route-' || user_id AS route_id, 'tab-' || (user_id % 7) AS tab_code,
  'type-' || (user_id % 3) AS resource_type, '' AS resource_type_name, 'cat-' || (user_id % 7) AS catalog, '' AS sub_catalog, 'lesson' AS content_type,
  'res-' || (event_id % 500) AS resource_id,
  CASE event_type WHEN 'view' THEN 'ok_with_file_items' WHEN 'click' THEN 'ok_no_file_items' WHEN 'signup' THEN 'requires_auth'
    WHEN 'purchase' THEN 'not_found' ELSE 'request_failed' END AS detail_status,
  floor(value)::INT AS file_item_count, CASE WHEN event_type = 'view' THEN floor(value)::INT ELSE 0 END AS parsed_candidate_count, event_type,
  CASE event_type WHEN 'view' THEN 'public_detail' WHEN 'click' THEN 'public_detail' WHEN 'signup' THEN 'requires_auth_context'
    WHEN 'purchase' THEN 'unavailable_or_template_unknown' ELSE 'runtime_validation_needed' END AS detail_access_policy FROM events)"""


# ---------------------------------------------------------------- catalog tree
def tree_nodes(spark: SparkSession, sf: str) -> DataFrame:
    region, nation, customer = (table(spark, sf, t) for t in ("region", "nation", "customer"))
    top = region.select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("id"), F.lit(None).cast("string").alias("up"), F.col("r_name").alias("name"))
    mid = nation.select(
        F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"),
        F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("up"),
        F.col("n_name").alias("name"),
    )
    low = customer.select(
        F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"),
        F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("up"),
        F.col("c_name").alias("name"),
    )
    return top.unionByName(mid).unionByName(low)


CATALOGS = ["qualityCourse", "tchMaterial", "syncClassroom", "experiment", ""]


def catalog_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as catalog entries of their nation."""
    c, n = table(spark, sf, "customer"), table(spark, sf, "nation")
    names = F.array(*[F.lit(x) for x in CATALOGS])
    rows = c.join(n, c.c_nationkey == n.n_nationkey)
    return rows.select(
        F.col("c_custkey").alias("ordinal"),
        F.concat_ws(" ", "n_name", "c_mktsegment").alias("title"),
        F.element_at(names, F.col("n_regionkey") + 1).alias("catalog"),
        F.when(F.col("c_acctbal") > 0, F.lower("c_mktsegment")).alias("sub_catalog"),
        F.when(F.col("c_nationkey") % 2 == 0, F.lit("questions")).alias("type"),
        F.when(F.col("c_acctbal") < -900, F.lit("http://h5")).alias("h5_url"),
        F.col("n_name").alias("catalog_name"),
    )


NODES_SQL = """node AS (SELECT c_custkey AS ordinal, n_name || ' ' || c_mktsegment AS title,
  ['qualityCourse', 'tchMaterial', 'syncClassroom', 'experiment', ''][n_regionkey + 1] AS catalog,
  CASE WHEN c_acctbal > 0 THEN lower(c_mktsegment) END AS sub_catalog, CASE WHEN c_nationkey % 2 = 0 THEN 'questions' END AS type,
  CASE WHEN c_acctbal < -900 THEN 'http://h5' END AS h5_url, n_name AS catalog_name
  FROM customer JOIN nation ON c_nationkey = n_nationkey)"""
ROUTES_SQL = NODES_SQL + """,
 route AS (SELECT *, left(sha1(concat_ws('|', catalog, sub_catalog, type, title)), 16) AS route_id,
   'https://basic.smartedu.cn/' || CASE WHEN catalog = 'tchMaterial' THEN catalog WHEN sub_catalog <> '' THEN catalog || '?subCatalog=' || url_encode(sub_catalog) ELSE catalog END AS page_url,
   CASE WHEN catalog = 'tchMaterial' THEN 'internal_adapter' ELSE 'search_then_detail' END AS scan_strategy,
   CASE WHEN type = 'questions' THEN 'questions' WHEN given = 'qualityCourse' OR given = 'syncClassroom' THEN 'qualityCourse' WHEN given = 'experiment' THEN 'experiment'
     WHEN sub_catalog <> '' THEN sub_catalog WHEN given <> '' THEN given ELSE 'sedu' END AS search_tab_code,
   CASE WHEN catalog = 'tchMaterial' THEN '教材' ELSE '通用资源' END AS resource_family
  FROM (SELECT ordinal, title, catalog AS given, CASE WHEN catalog = '' THEN 'syncClassroom' ELSE catalog END AS catalog,
    coalesce(sub_catalog, '') AS sub_catalog, coalesce(type, '') AS type, catalog_name, h5_url FROM node))"""


def routes(spark: SparkSession, sf: str) -> DataFrame:
    from shelfwise.operators.catalog import catalog_rows, route_for_catalog

    return route_for_catalog(catalog_rows(catalog_nodes(spark, sf)))
