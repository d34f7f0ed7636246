"""Readers: envelopes, index tables, feeds, items of unknown JSON, files."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import let
from ..functions.text import as_col, blank_to_null
from ..operators.candidates import ITEM_ALIASES
from ..operators.details import identity_from_url
from ..session import written


CANDIDATE = T.StructType(
    [
        T.StructField("source", T.StringType()),
        T.StructField("source_name", T.StringType()),
        T.StructField("source_url", T.StringType()),
        T.StructField("resource_id", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("resource_type", T.StringType()),
        T.StructField("format", T.StringType()),
        T.StructField("stage", T.StringType()),
        T.StructField("grade", T.StringType()),
        T.StructField("subject", T.StringType()),
        T.StructField("learning_domain", T.StringType()),
        T.StructField("version", T.StringType()),
        T.StructField("volume", T.StringType()),
        T.StructField("topic", T.StringType()),
        T.StructField("provider", T.StringType()),
        T.StructField("local_file", T.StringType()),
        T.StructField("sha256", T.StringType()),
        T.StructField("detail_page", T.StringType()),
        T.StructField("official", T.BooleanType()),
        T.StructField("downloadable", T.BooleanType()),
        T.StructField("requires_auth", T.BooleanType()),
        T.StructField("size", T.LongType()),
        T.StructField("metadata_confidence", T.DoubleType()),
        T.StructField("url_candidates", T.ArrayType(T.StringType())),
        T.StructField("source_warnings", T.ArrayType(T.StringType())),
    ]
)
INDEX_RECORD = T.StructType(
    [
        T.StructField("resource_key", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("library_file", T.StringType()),
        T.StructField("original_file", T.StringType()),
        T.StructField("format", T.StringType()),
        T.StructField("resource_type", T.StringType()),
        T.StructField("stage_or_age", T.StringType()),
        T.StructField("grade_or_phase", T.StringType()),
        T.StructField("domain_or_subject", T.StringType()),
        T.StructField("topic_or_type", T.StringType()),
        T.StructField("source_or_version", T.StringType()),
        T.StructField("source_url", T.StringType()),
        T.StructField("sha256", T.StringType()),
        T.StructField("classification_confidence", T.DoubleType()),
        T.StructField("needs_review", T.BooleanType()),
        T.StructField("dedupe_confidence", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("updated_at", T.TimestampType()),
    ]
)
DUPLICATE_RECORD = T.StructType(
    [
        T.StructField("resource_key", T.StringType()),
        T.StructField("existing_file", T.StringType()),
        T.StructField("incoming_file", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("detected_at", T.TimestampType()),
        T.StructField("reason", T.StringType()),
    ]
)
ENVELOPE_LISTS = ["candidates", "ranked_candidates", "options"]
PATH_STEP = 1 << 32


def load_candidates(spark: SparkSession, path: str | Sequence[str], schema: T.StructType = CANDIDATE) -> DataFrame:
    """One row per candidate of every envelope file, whichever list it uses, with its place.

    ``ordinal`` is unique over all files of the call: file place (by folder, then name) times 2^32 plus position.
    """
    lists = T.ArrayType(schema)
    nested = T.ArrayType(T.StructType([T.StructField("candidate", schema), *schema.fields]))
    envelope = T.StructType(
        [
            T.StructField("candidates", lists),
            T.StructField("ranked_candidates", nested),
            T.StructField("options", nested),
        ]
    )
    rows = spark.read.schema(envelope).option("multiLine", True).json(path)
    filed = rows.withColumn("_file", F.col("_metadata.file_path"))

    def inner(name: str) -> Column:
        return F.transform(
            F.col(name),
            lambda r: F.when(r["candidate"].isNotNull(), r["candidate"]).otherwise(
                F.struct(*[r[f.name].alias(f.name) for f in schema.fields])
            ),
        )

    listed = F.coalesce("candidates", inner("ranked_candidates"), inner("options"))
    opened = filed.select("_file", F.posexplode(listed).alias("_pos", "_c"))
    # names only: the bytes are not read again; files are numbered folder by folder
    files = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("_file"))
    files = files.withColumn("_folder", F.regexp_extract("_file", "^(.*/)", 1))
    before = Window.orderBy("_folder").rowsBetween(Window.unboundedPreceding, -1)
    folders = files.groupBy("_folder").agg(F.count(F.lit(1)).alias("_n"))
    folders = folders.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy("_folder").orderBy("_file")) - 1
    placed = files.withColumn("_inside", inside).join(folders, "_folder").select("_file", (F.col("_before") + F.col("_inside")).alias("_place"))
    return opened.join(placed, "_file").select(
        (F.col("_place") * F.lit(PATH_STEP) + F.col("_pos")).alias("ordinal"), "_c.*"
    )


KINDS = [
    # Names that say what kind of thing an item is.
    "catalog", "catalog_type", "catalogType", "tab_code", "tabCode", "resource_type", "resourceType", "content_type",
    "contentType",
]


STEPS = 4


def extract_items(
    df: DataFrame, json: str, key: Sequence[str] = (), ordinal: str = "ordinal", limit: int | None = None
) -> DataFrame:
    """Item-like objects (an id, and a title or a type) at any level of unknown JSON.

    The text becomes a variant once.  Every step replaces a container by itself
    and its child containers; after STEPS steps the rows are written, and what
    is still unopened goes on until no container is left.  An id may stand in
    the item or in its page URL.  An object found twice under the same (row, id,
    title) counts once, first place first; ``limit`` keeps that many per row.
    """
    keys = list(dict.fromkeys([*key, ordinal]))
    parsed = F.try_parse_json(as_col(json))
    rows = df.select(*keys, parsed.alias("_v"), F.lit("").alias("_path"), F.lit(False).alias("_done"))
    rows = rows.where(F.col("_v").isNotNull())

    def children(value: Column) -> Column:
        return F.coalesce(
            F.try_variant_get(value, "$", "array<variant>"), F.map_values(F.try_variant_get(value, "$", "map<string,variant>"))
        )

    def step(rows: DataFrame) -> DataFrame:
        below = children(F.col("_v"))
        inner = F.transform(below, lambda c, i: F.struct(c.alias("v"), (i + 1).alias("at"), F.lit(False).alias("done")))
        itself = F.array(F.struct(F.col("_v").alias("v"), F.lit(0).alias("at"), F.lit(True).alias("done")))
        stepped = F.when(F.col("_done") | below.isNull(), itself).otherwise(
            F.concat(itself, F.filter(inner, lambda s: s["v"].isNotNull() & children(s["v"]).isNotNull()))
        )
        opened = rows.select(*keys, "_path", F.explode(stepped).alias("_s"))
        place = F.concat("_path", F.lit("/"), F.lpad(F.col("_s.at").cast("string"), 9, "0"))
        return opened.select(
            *keys,
            F.col("_s.v").alias("_v"),
            F.when(F.col("_s.at") == 0, F.col("_path")).otherwise(place).alias("_path"),
            F.col("_s.done").alias("_done"),
        )

    parts = []
    while True:
        for _ in range(STEPS):
            rows = step(rows)
        rows = written(rows)
        parts.append(rows.where("_done"))
        rows = rows.where("not _done")
        if rows.isEmpty():
            break
    found = reduce(DataFrame.unionByName, parts)

    def read(names: Sequence[str]) -> Column:
        return F.coalesce(*[blank_to_null(F.try_variant_get("_v", f"$.{a}", "string")) for a in names])

    linked = let(found, {"_own": read(ITEM_ALIASES["id"]), "_page": read(ITEM_ALIASES["page"])})
    in_page = F.when(F.col("_own").isNull(), identity_from_url(F.col("_page"))["resource_id"])
    named = let(linked, {"item_id": F.coalesce("_own", blank_to_null(in_page))}).where(F.col("item_id").isNotNull())
    typed = let(named, {"item_title": read(ITEM_ALIASES["title"])})
    like = typed.where(F.col("item_title").isNotNull() | read(KINDS).isNotNull())
    firsts = like.groupBy(*keys, "item_id", "item_title").agg(
        F.min("_path").alias("item_path"), F.min_by("_v", "_path").alias("item")
    )
    if limit is not None:
        from ..operators.grouping import top_k

        firsts = top_k(firsts, keys, [F.col("item_path")], limit, "_n").drop("_n")
    return firsts.select(*keys, "item_path", "item_id", "item_title", "item")


def load_lexicon(rows: DataFrame, max_terms: int = 10_000) -> dict[str, list[tuple[str, list[str]]]]:
    """Term lists from rows (lexicon, ordinal, label, term), as ordered rules per lexicon.

    Term lists are parameters of a plan, so they come to the driver; their
    number is checked first.  Larger tables go to ``operators.search.term_hits``.
    """
    found = rows.select("lexicon", "ordinal", "label", "term").limit(max_terms + 1).collect()
    if len(found) > max_terms:
        raise ValueError(f"more than {max_terms} terms; use operators.search.term_hits")
    out: dict[str, list[tuple[str, list[str]]]] = {}
    for row in sorted(found, key=lambda r: r["ordinal"]):
        rules = out.setdefault(row["lexicon"], [])
        label = row["label"] or ""
        if not rules or rules[-1][0] != label:
            rules.append((label, []))
        rules[-1][1].append(row["term"])
    return out


def _load_table(spark: SparkSession, paths: Sequence[str], schema: T.StructType) -> DataFrame:
    if not paths:
        return spark.createDataFrame([], schema)
    found = spark.read.parquet(*paths)
    missing = [f.name for f in schema.fields if f.name not in found.columns]
    if missing:
        raise ValueError(f"malformed index at {paths[0]}: no column {', '.join(missing)}")
    return found.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def load_buckets(spark: SparkSession, path: str, manifest: Sequence[Row]) -> tuple[DataFrame, DataFrame]:
    """(resources, duplicates) of the given buckets of an index."""

    def paths(kind: str) -> list[str]:
        return [f"{path}/{kind}/{r[kind]}/bucket={r['bucket']}" for r in manifest if r[kind]]

    return _load_table(spark, paths("resources"), INDEX_RECORD), _load_table(spark, paths("duplicates"), DUPLICATE_RECORD)


def load_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(resources, duplicates) of an index, empty tables where there is none yet."""
    from .writers import read_manifest

    return load_buckets(spark, path, read_manifest(spark, path))


def load_feed_parts(spark: SparkSession, paths: Sequence[str], schema: T.StructType | str) -> DataFrame:
    """A feed of several JSON list files as one table with the part each row came from."""
    rows = spark.read.schema(schema).option("multiLine", True).json(list(paths))
    return rows.withColumn("part_file", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1))


def scan_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Files below a path with bytes, size, suffix and the first magic bytes."""
    rows = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .load(path)
    )
    return rows.select(
        F.regexp_replace("path", "^file:/*", "/").alias("local_file"),
        F.col("length").alias("size"),
        "content",
        F.lower(F.regexp_extract("path", r"[^/]\.([^./]+)$", 1)).alias("format"),
        F.hex(F.substring("content", 1, 8)).alias("magic"),
        F.sha2("content", 256).alias("sha256"),
    )
