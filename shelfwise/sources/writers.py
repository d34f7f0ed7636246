"""Writers: CSV, library folders, the index, manifests and envelopes."""

from __future__ import annotations

import posixpath
import time
from collections.abc import Sequence

from pyarrow import fs
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..functions.lexicons import LIBRARY_CLASSES, REVIEW_FOLDER
from ..operators.library import index_outcomes, index_upsert, keyed_batch, merge_duplicates
from ..session import qualified, written

MARK = "_COMPLETE"
BUCKETS = 64
MANIFEST = "bucket int, resources string, duplicates string"
# The columns of a textbook export, in order.
EXPORT_COLUMNS = [
    "id", "title", "stage", "subject", "version", "grade", "volume", "providers", "format", "size",
    "preview_count", "thumbnail", "detail_page", "update_time",
]


def write_csv(df: DataFrame, path: str, columns: Sequence[str] = EXPORT_COLUMNS, sep: str = "/") -> None:
    """Chosen columns in order, lists joined by ``/``, one header per part file."""
    types = dict(df.dtypes)
    shown = []
    for name in columns:
        if name not in types:
            shown.append(F.lit(None).cast("string").alias(name))
        elif types[name].startswith("array"):
            shown.append(F.array_join(name, sep).alias(name))
        else:
            shown.append(F.col(name))
    df.select(*shown).write.mode("overwrite").option("header", True).csv(path)


def write_library(df: DataFrame, path: str, columns: Sequence[str] = tuple(n for n, _, _ in LIBRARY_CLASSES)) -> None:
    """Library rows laid out by class folders, those under review in a folder of their own.

    Rows are gathered by class; adaptive execution cuts a class of any size into
    tasks of the advised size, and small classes do not leave a file per task.
    """
    review = df.where("needs_review")
    final = df.where("not needs_review")
    final.hint("rebalance", *[F.col(c) for c in columns]).write.mode("overwrite").partitionBy(*columns).parquet(f"{path}/library")
    review.write.mode("overwrite").partitionBy("format").parquet(f"{path}/{REVIEW_FOLDER}")


def _inside(child: str, parent: str) -> bool:
    child, parent = posixpath.normpath(child), posixpath.normpath(parent)
    return child == parent or child.startswith(parent.rstrip("/") + "/")


def _place(spark: SparkSession, path: str) -> tuple[fs.FileSystem, str]:
    """The file system and place where Spark reads ``path``."""
    return fs.FileSystem.from_uri(qualified(spark, path))


def current_version(spark: SparkSession, path: str) -> str | None:
    """Newest complete manifest of an index, or none; one listing and one look at all marks."""
    system, place = _place(spark, f"{path}/manifests")
    found = system.get_file_info(fs.FileSelector(place, allow_not_found=True))
    names = [f.base_name for f in found if f.type == fs.FileType.Directory and f.base_name.startswith("v")]
    marks = system.get_file_info([f"{place}/{n}/{MARK}" for n in names]) if names else []
    return max((n for n, m in zip(names, marks) if m.type == fs.FileType.File), default=None)


def read_manifest(spark: SparkSession, path: str) -> list[Row]:
    """A row per bucket of the current index: ``bucket``, and the version under which its ``resources`` and ``duplicates`` lie (null: none).

    As many rows as the index has buckets, so they may come to the driver; no index, no rows.
    """
    version = current_version(spark, path)
    if version is None:
        return []
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifests/{version}").orderBy("bucket").collect()


def bucket_of(key: Column | str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _write_buckets(df: DataFrame, path: str, kind: str, version: str, buckets: int) -> set[int]:
    """Writes the rows by bucket under a version of their own; the buckets that have any."""
    spark = df.sparkSession
    keyed = df.withColumn("bucket", bucket_of("resource_key", buckets))
    keyed.hint("rebalance", F.col("bucket")).write.partitionBy("bucket").parquet(f"{path}/{kind}/{version}")
    system, place = _place(spark, f"{path}/{kind}/{version}")
    names = [f.base_name for f in system.get_file_info(fs.FileSelector(place, allow_not_found=True))]
    return {int(n.partition("=")[2]) for n in names if n.startswith("bucket=")}


def _check_place(path: str, library: str | None) -> None:
    if library and _inside(path, library):
        raise ValueError("the index folder must not lie inside the library")


def write_buckets(
    resources: DataFrame, duplicates: DataFrame, path: str, touched: Sequence[int], manifest: Sequence[Row], buckets: int
) -> str:
    """Writes the ``touched`` buckets anew and a manifest that takes all others from the one before.

    Both tables change together when the manifest is marked complete, last of all; a lost job leaves the old one in
    force.  One writer at a time.
    """
    spark = resources.sparkSession
    version = f"v{time.time_ns():020d}"
    have = {kind: _write_buckets(df, path, kind, version, buckets) for kind, df in (("resources", resources), ("duplicates", duplicates))}
    rows = {r["bucket"]: (r["resources"], r["duplicates"]) for r in manifest}
    for bucket in touched:
        rows[bucket] = tuple(version if bucket in have[kind] else None for kind in ("resources", "duplicates"))
    listed = [(bucket, *rows.get(bucket, (None, None))) for bucket in range(buckets)]
    spark.createDataFrame(listed, MANIFEST).coalesce(1).write.parquet(f"{path}/manifests/{version}")
    system, place = _place(spark, f"{path}/manifests/{version}")
    system.open_output_stream(f"{place}/{MARK}").close()
    return version


def write_index(resources: DataFrame, duplicates: DataFrame, path: str, library: str | None = None, buckets: int = BUCKETS) -> str:
    """Writes both tables whole, dealt to buckets by a hash of ``resource_key``.

    Keys are unique, so buckets are even whatever the data; take as many as keep one bucket within a few tasks' size.
    """
    _check_place(path, library)
    return write_buckets(resources, duplicates, path, range(buckets), (), buckets)


def upsert_index(
    spark: SparkSession, path: str, batch: DataFrame, now: Column | str, library: str | None = None, buckets: int = BUCKETS
) -> str | None:
    """Applies a batch to the index at ``path`` and rewrites only the buckets that hold its keys; the new version.

    Outcomes are written once, because both tables come from them.  Applying the same batch again leaves the same index.
    ``buckets`` counts for a new index only.  A batch without valid rows changes nothing.
    """
    from .readers import load_buckets

    _check_place(path, library)
    manifest = read_manifest(spark, path)
    buckets = len(manifest) or buckets
    keyed = written(keyed_batch(batch))
    bucket = bucket_of("resource_key", buckets).alias("bucket")
    touched = sorted(r["bucket"] for r in keyed.where("error is null").select(bucket).distinct().collect())
    if not touched:
        return None
    resources, duplicates = load_buckets(spark, path, [r for r in manifest if r["bucket"] in set(touched)])
    outcomes = written(index_outcomes(resources, keyed.drop("resource_key", "dedupe_confidence", "error")))
    fresh, found = index_upsert(resources, batch, now, outcomes=outcomes)
    return write_buckets(fresh, merge_duplicates(duplicates, found), path, touched, manifest, buckets)


def write_manifest(df: DataFrame, path: str, key: str = "id") -> None:
    """One JSON row per attempt, sorted by id over all part files."""
    df.orderBy(key).write.mode("overwrite").json(path)


def write_envelope(df: DataFrame, summary: DataFrame, path: str, schema_tag: str) -> None:
    """Rows and a one-row summary under a schema tag."""
    df.write.mode("overwrite").parquet(f"{path}/rows")
    summary.withColumn("schema_tag", F.lit(schema_tag)).write.mode("overwrite").json(f"{path}/summary")
