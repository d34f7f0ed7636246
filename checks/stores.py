"""Checks on sources and sinks: a given table is written to the shared folder and read back by the library's readers."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from shelfwise.session import qualified, shared_folder
from shelfwise.sources import readers, writers
from shelfwise.streaming.index_stream import stream_index

from . import documents as W
from .catalog import BOOKS_SQL, textbooks
from .documents import _LIB_CTE, _UP_CTE
from .inputs import table

QUERIES, ORACLE = {}, {}
LIST_ROWS = 500


def folder(spark) -> str:
    return f"{shared_folder(spark)}/check-{uuid.uuid4().hex}"


def list_files(spark, sf, start: str, end: str) -> str:
    """Customers as JSON list files of at most LIST_ROWS entries, one folder each."""
    entry = F.struct(F.col("c_name").alias("title"), F.col("c_mktsegment").alias("source"), (F.col("c_custkey") % 2 == 0).alias("official"))
    rows = table(spark, sf, "customer").select(F.floor(F.col("c_custkey") / LIST_ROWS).alias("part"), F.struct("c_custkey", F.to_json(entry).alias("json")).alias("e"))
    listed = F.transform(F.array_sort(F.collect_list("e")), lambda e: e["json"])
    lists = rows.groupBy("part").agg(F.concat(F.lit(start), F.array_join(listed, ","), F.lit(end)).alias("value"))
    path = folder(spark)
    lists.write.partitionBy("part").text(path)
    return path


def envelopes(spark, sf):
    found = readers.load_candidates(spark, list_files(spark, sf, '{"candidates": [', "]}"))
    return found.select("title", "source", "official", (F.col("ordinal") % readers.PATH_STEP).alias("pos"), F.floor(F.col("ordinal") / readers.PATH_STEP).alias("file"))


QUERIES["envelopes"] = envelopes
ORACLE["envelopes"] = f"""WITH c AS (SELECT *, c_custkey // {LIST_ROWS} AS part FROM customer), f AS (SELECT part, row_number() OVER (ORDER BY 'part=' || part || '/') - 1 AS file FROM (SELECT DISTINCT part FROM c))
SELECT c_name AS title, c_mktsegment AS source, c_custkey % 2 = 0 AS official, row_number() OVER (PARTITION BY part ORDER BY c_custkey) - 1 AS pos, file FROM c JOIN f USING (part)"""


def feed_parts(spark, sf):
    rows = readers.load_feed_parts(spark, [list_files(spark, sf, "[", "]")], "title string, source string, official boolean")
    return rows.select("title", "source", "official", F.endswith("part_file", F.lit(".txt")).alias("named"))


QUERIES["feed_parts"] = feed_parts
ORACLE["feed_parts"] = "SELECT c_name AS title, c_mktsegment AS source, c_custkey % 2 = 0 AS official, true AS named FROM customer"


def scanned_files(spark, sf):
    """One file per bucket of customers; what the scan says of its bytes."""
    return readers.scan_files(spark, list_files(spark, sf, "[", "]"), "*.txt").select("size", "format", "magic", "sha256")


_ENTRY = """'{"title":"' || c_name || '","source":"' || c_mktsegment || '","official":' || (c_custkey % 2 = 0) || '}'"""
QUERIES["scan_files"] = scanned_files
ORACLE["scan_files"] = f"""WITH b AS (SELECT '[' || string_agg({_ENTRY}, ',' ORDER BY c_custkey) || ']' || chr(10) AS body FROM customer GROUP BY c_custkey // {LIST_ROWS})
SELECT length(body)::BIGINT AS size, 'txt' AS format, hex(left(body, 8)) AS magic, sha256(body) AS sha256 FROM b"""


def csv_export(spark, sf):
    path = folder(spark)
    writers.write_csv(textbooks(spark, sf), path)
    return spark.read.option("header", True).csv(path).select("id", "title", "stage", "grade", "version", "volume", "providers", F.col("size").cast("bigint").alias("size"), "preview_count", "detail_page")


QUERIES["csv_export"] = csv_export
ORACLE["csv_export"] = f"WITH {BOOKS_SQL} SELECT id, title, stage, grade, version, volume, provider AS providers, size, NULL::VARCHAR AS preview_count, detail_page FROM book"


def manifest(spark, sf):
    path = folder(spark)
    writers.write_manifest(table(spark, sf, "documents").select(F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("id"), "source", "text"), path)
    return spark.read.schema("id string, source string, text string").json(path)


QUERIES["manifest"] = manifest
ORACLE["manifest"] = "SELECT lpad(doc_id::VARCHAR, 12, '0') AS id, source, text FROM documents"


def envelope_rows(spark, sf):
    path = folder(spark)
    docs = table(spark, sf, "documents").select("doc_id", "text")
    writers.write_envelope(docs, docs.agg(F.count("*").alias("n")), path, "documents/v1")
    total = spark.read.json(f"{path}/summary").select(F.lit(None).cast("bigint").alias("doc_id"), F.concat_ws(" ", "schema_tag", "n").alias("text"))
    return spark.read.parquet(f"{path}/rows").unionByName(total)


QUERIES["envelope_rows"] = envelope_rows
ORACLE["envelope_rows"] = "SELECT doc_id, text FROM documents UNION ALL SELECT NULL, 'documents/v1 ' || count(*) FROM documents"


def library_layout(spark, sf):
    path = folder(spark)
    writers.write_library(W.classified(spark, sf).withColumn("needs_review", F.col("ordinal") % 4 == 0), path)
    final = spark.read.parquet(f"{path}/library").withColumn("place", F.lit("library"))
    review = spark.read.parquet(f"{path}/{writers.REVIEW_FOLDER}").withColumn("place", F.lit("review"))
    return final.unionByName(review).select("ordinal", "stage_or_age", "grade_or_phase", "domain_or_subject", "topic_or_type", "format", "place")


QUERIES["library_layout"] = library_layout
ORACLE["library_layout"] = f"""WITH {_LIB_CTE} SELECT ordinal, stage_or_age, grade_or_phase, domain_or_subject, topic_or_type, CASE WHEN ordinal % 11 = 0 THEN 'JPEG' ELSE suffix END AS format, CASE WHEN ordinal % 4 = 0 THEN 'review' ELSE 'library' END AS place FROM l3"""


def index_version(spark, sf):
    """An index written whole, then upserted bucket by bucket, then read.  The folder is named as Spark names a checkpoint folder."""
    path = qualified(spark, folder(spark)).replace("file:///", "file:/")
    old, new = W.index_parts(spark, sf)
    none = spark.createDataFrame([], readers.DUPLICATE_RECORD)
    writers.write_index(old, none, path, buckets=16)
    writers.upsert_index(spark, path, new, "2024-02-02")
    return readers.load_index(spark, path)[0].select("resource_key", "title", "library_file", "classification_confidence", F.date_format("updated_at", "yyyy-MM-dd").alias("updated"))


QUERIES["index_version"] = index_version
ORACLE["index_version"] = f"""WITH {_UP_CTE} SELECT coalesce(o.resource_key, m.resource_key) AS resource_key, coalesce(m.title, o.title, '') AS title, coalesce(m.library_file, o.library_file) AS library_file,
 coalesce(m.cc, o.cc) AS classification_confidence, CASE WHEN m.resource_key IS NULL THEN '2024-01-01' ELSE '2024-02-02' END AS updated FROM old o FULL OUTER JOIN mg m ON o.resource_key = m.resource_key"""


def indexed_stream(spark, sf):
    """Events as a stream of organized files, upserted into an index; one resource per user and type."""
    events = table(spark, sf, "events").schema
    path = folder(spark)
    stream = spark.readStream.schema(events).option("pathGlobFilter", "events.parquet").parquet(sf)
    files = stream.select(
        F.col("event_id").alias("ordinal"), "ts", F.col("event_type").alias("title"), F.concat_ws("-", F.lit("key"), F.col("user_id").cast("string"), "event_type").alias("sha256"),
        F.concat_ws("/", F.lit("lib"), "event_type", F.col("user_id").cast("string")).alias("library_file"), F.lit(0.5).alias("classification_confidence"), F.lit(False).alias("needs_review"),
    )
    stream_index(files, f"{path}/index", f"{path}/state", delay="400 days").awaitTermination()
    return readers.load_index(spark, f"{path}/index")[0].select("resource_key", "title", "library_file")


QUERIES["stream_index"] = indexed_stream
ORACLE["stream_index"] = "SELECT DISTINCT 'key-' || user_id || '-' || event_type AS resource_key, event_type AS title, 'lib/' || event_type || '/' || user_id AS library_file FROM events"
