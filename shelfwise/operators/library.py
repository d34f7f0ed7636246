"""Library classes, target paths and the index with its upsert."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions.columns import let
from ..functions.infer import library_format
from ..functions.match import Rules, first_label
from ..functions.text import as_col, blank_to_null, content_key, first_value, safe_part
from ..functions.urls import suffix
from ..session import written
from .grouping import BLOCK, numbered, running_sum, with_group_value

RECORD = [
    "title", "library_file", "original_file", "format", "resource_type", "stage_or_age", "grade_or_phase",
    "domain_or_subject", "topic_or_type", "source_or_version", "source_url", "sha256",
]
STEM = r"([^/]+?)(?:\.[^./]*)?$"


def _field(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def classify_library(items: DataFrame, threshold: float = 0.55, domain_rules: Rules = L.LIBRARY_DOMAIN_RULES) -> DataFrame:
    """Five class fields by fallback, confidence in [0, 1] and whether a review is due."""

    def col(name: str) -> Column:
        return _field(items, name)

    title = first_value(col("title"), F.regexp_extract(F.coalesce(col("local_file"), F.lit("")), STEM, 1))
    kind = first_value(col("resource_type"), F.lit(L.DEFAULT_TYPE))
    age = F.concat(col("learner_age").cast("string"), F.lit("岁"))
    rules = [(label, [t.lower() for t in terms]) for label, terms in domain_rules]
    based = let(items, {"_title": title, "_kind": kind})
    based = let(based, {"_low_title": F.lower(F.coalesce("_title", F.lit("")))})
    chosen = {
        "stage_or_age": first_value(col("stage"), col("stage_or_age"), age),
        "grade_or_phase": first_value(col("grade")),
        "domain_or_subject": first_value(
            col("learning_domain"), col("subject"), first_label("_low_title", rules)
        ),
        "topic_or_type": first_value(col("core_topic"), col("topic"), F.col("_kind")),
        "source_or_version": first_value(col("version"), col("source_name"), col("provider"), col("source")),
    }
    placed = let(based, {n: safe_part(chosen[n], fallback) for n, fallback, _ in L.LIBRARY_CLASSES})
    points = F.when(F.col("_title").isNotNull(), 18).otherwise(0)
    for name, fallback, value in L.LIBRARY_CLASSES:
        points = points + F.when(F.col(name) != fallback, value).otherwise(0)
    points = points + F.when(F.col("_kind") != L.DEFAULT_TYPE, 8).otherwise(0)
    points = points + F.when(blank_to_null(col("sha256")).isNotNull(), 6).otherwise(0)
    thousandths = points * 10
    if "metadata_confidence" in items.columns:
        given = F.round(F.least(F.col("metadata_confidence"), F.lit(1.0)).cast("decimal(9,6)") * 1000, 0).cast("int")
        thousandths = F.greatest(thousandths, F.coalesce(given, F.lit(0)))
    rated = let(placed, {"_points": thousandths})
    return rated.withColumns(
        {
            "resource_type": F.col("_kind"),
            "classification_confidence": F.col("_points") / F.lit(1000.0),
            "needs_review": F.col("_points") < int(round(threshold * 1000)),
        }
    ).drop("_title", "_low_title", "_kind", "_points")


def library_paths(
    items: DataFrame,
    threshold: float = 0.55,
    root: str = "",
    ordinal: str = "ordinal",
    block: int = BLOCK,
    taken: DataFrame | None = None,
) -> DataFrame:
    """Adds ``format``, ``library_file`` and the final review flag to classified items.

    Paths that meet are numbered by ``unique_paths``, around those ``taken`` already.  Names are cut
    here only: 80 characters of a class, 70 of a title.
    """
    file = F.coalesce(_field(items, "local_file"), F.lit(""))
    fmt = library_format(_field(items, "format"), file)
    declared = suffix(file)
    folded = F.regexp_replace(declared, "^jpeg$", "jpg")
    based = let(items, {"_fmt": fmt, "_suffix": declared, "_folded": folded})
    unusable = (F.col("_suffix") == "") | F.col("_suffix").isin(L.BLOCKED_SUFFIXES) | ~F.col("_folded").isin(L.LIBRARY_FORMATS)
    mismatch = ~unusable & F.col("_fmt").isin(L.LIBRARY_FORMATS) & (F.col("_folded") != F.col("_fmt"))
    review = F.col("needs_review") | mismatch | (F.col("classification_confidence") < threshold)
    judged = let(
        based, {"_ext": F.when(unusable | mismatch, F.col("_fmt")).otherwise(F.col("_suffix")), "needs_review": review}
    )
    title = first_value(_field(items, "title"), F.regexp_extract(file, STEM, 1))
    name = F.concat(safe_part(title, "未知标题", 70), F.lit("_"), F.substring(F.coalesce("sha256", F.lit("")), 1, 8))
    folder = F.when(
        F.col("needs_review"), F.concat_ws("/", F.lit(L.REVIEW_FOLDER), safe_part("_fmt", "unknown", 30))
    ).otherwise(F.concat_ws("/", *[F.substring(n, 1, 80) for n, _, _ in L.LIBRARY_CLASSES]))
    prefix = [F.lit(root.rstrip("/"))] if root else []
    path = F.concat(F.concat_ws("/", *prefix, folder, name), F.lit("."), F.col("_ext"))
    placed = let(judged, {"library_file": path}).withColumn("format", F.col("_fmt")).drop("_fmt", "_suffix", "_folded", "_ext")
    return unique_paths(placed, "library_file", ordinal, block, taken)


PATH_PARTS = r"^(.*?)(\.[^./]*)?$"
NUMBERED_STEM = r"^(.*)_([2-9]|[1-9][0-9]{1,14})$"


def unique_paths(
    items: DataFrame, path: str = "path", ordinal: str = "ordinal", block: int = BLOCK, taken: DataFrame | None = None
) -> DataFrame:
    """Paths that no two items share: in the order of ``ordinal`` an item keeps its path if it is free, else it gets the first
    free of ``_2``, ``_3`` and so on, as if the items were placed one by one.

    ``taken`` (a column ``path``) names paths that exist already.  A name such as ``a_2.pdf`` can be claimed twice, as an item's
    own and as the number 2 of ``a.pdf``; whoever comes first gets it.  Such names are few: only they are settled in rounds
    (``_settled``), everything else is numbered at once.  All steps cut a group into blocks of ordinals, so a path
    that very many items share needs no single task.  A null path stays null.
    """
    counted = numbered(items, [path], ordinal, "_copy", block)
    places = written(counted.where(F.col(path).isNotNull()).select(F.col(path).alias("_path"), F.col(ordinal).alias("_at"), "_copy"))
    contested = _contested(places, taken)
    if contested.isEmpty():
        number = F.col("_copy")
    else:
        given = _given_numbers(places, _settled(contested, places, block), block)
        counted = counted.join(given, F.col(ordinal) == F.col("_given_at"), "left")
        number = F.coalesce("_given", "_copy")
    stem, tail = (F.regexp_extract(path, PATH_PARTS, k) for k in (1, 2))
    renamed = F.concat(stem, F.lit("_"), number.cast("string"), tail)
    return counted.withColumn(path, F.when(number > 1, renamed).otherwise(F.col(path))).select(*items.columns)


def _contested(places: DataFrame, taken: DataFrame | None) -> DataFrame:
    """Names that two may claim: ``_name``, its ``_parent`` path and ``_number`` there, when its own first item comes (``_first``, null
    if the name exists already), and whether it is a path's plain name that exists (``_parent`` null)."""
    firsts = places.where("_copy = 1").select(F.col("_path").alias("_name"), F.col("_at").alias("_first"))
    if taken is not None:
        there = taken.select(F.col("path").alias("_name")).where("_name is not null").distinct().withColumn("_there", F.lit(True))
        firsts = firsts.join(there, "_name", "full_outer").withColumn("_first", F.when(F.col("_there").isNull(), F.col("_first")))
    stem, tail = (F.regexp_extract("_name", PATH_PARTS, k) for k in (1, 2))
    split = firsts.withColumns({"_stem": stem, "_tail": tail}).withColumn("_number", F.regexp_extract("_stem", NUMBERED_STEM, 2))
    parent = F.concat(F.regexp_extract("_stem", NUMBERED_STEM, 1), F.col("_tail"))
    children = split.where("_number <> ''").select("_name", parent.alias("_parent"), F.col("_number").cast("long").alias("_number"), "_first")
    sizes = places.select(F.col("_path").alias("_parent")).where(F.lit(True)).distinct()
    found = children.join(sizes, "_parent").select("_name", "_parent", "_number", "_first")
    if taken is not None:
        known = firsts.where("_there").join(places.select(F.col("_path").alias("_name")).distinct(), "_name", "left_semi")
        none = F.lit(None)
        found = found.unionByName(known.select("_name", none.cast("string").alias("_parent"), none.cast("long").alias("_number"), "_first"))
    return written(found)


def _settled(contested: DataFrame, places: DataFrame, block: int) -> DataFrame:
    """Adds ``_skip``, the parent passes over the number, and ``_lost``, the name is not its own first item's.

    A number is reached by the item that has as many items before it as numbers are left below; it is passed over if its own item came
    before that one.  Both depend on smaller numbers of the parent and on whether the parent has its plain name, so
    repeating the step ends, after as many rounds as names hang on each other.
    """
    exists = F.col("_parent").isNull()
    now = written(contested.withColumns({"_skip": ~exists, "_lost": exists}))
    while True:
        numbers = now.where("_parent is not null")
        below = running_sum(numbers, ["_parent"], "_number", F.col("_skip").cast("long"), "_skipped", block)
        lost = now.where("_lost").select(F.col("_name").alias("_parent"), F.lit(1).alias("_moved")).distinct()
        copy = F.col("_number") - 1 - F.col("_skipped") + 1 - F.coalesce("_moved", F.lit(0))
        reached = below.join(lost, "_parent", "left").withColumn("_copy", copy)
        met = reached.join(places.withColumnRenamed("_path", "_parent"), ["_parent", "_copy"], "left")
        first = F.coalesce("_first", F.lit(-(1 << 63)))
        skip = F.coalesce(first < F.col("_at"), F.lit(False))
        same = ["_name", "_parent", "_number", "_first"]
        judged = met.select(*same, skip.alias("_skip"), (F.col("_at").isNotNull() & ~skip).alias("_lost"), F.col("_skip").alias("_old_skip"), F.col("_lost").alias("_old_lost"))
        judged = written(judged)
        changed = judged.where("_skip <> _old_skip or _lost <> _old_lost")
        now = judged.select(*same, "_skip", "_lost").unionByName(now.where("_parent is null"))
        if changed.isEmpty():
            return now


def _given_numbers(places: DataFrame, settled: DataFrame, block: int) -> DataFrame:
    """``_given_at``, ``_given``: the number of every item whose path passes over numbers or has lost its plain name."""
    skips = settled.where("_skip").select(F.col("_parent").alias("_path"), "_number")
    lost = settled.where("_lost").select(F.col("_name").alias("_path"), F.lit(1).alias("_moved")).distinct()
    paths = skips.select("_path").union(lost.select("_path")).distinct()
    rows = places.join(paths, "_path", "left_semi").join(lost, "_path", "left")
    # the j-th item in want of a number gets j + 1, and one more for every number passed over by it or an item before it
    turn = F.col("_copy") - 1 + F.coalesce("_moved", F.lit(0))
    wanting = rows.select("_path", "_at", turn.alias("_turn"), (turn * 2 + 1).alias("_key"), F.lit(0).cast("long").alias("_mark"))
    passed = running_sum(skips, ["_path"], "_number", F.lit(1).cast("long"), "_before", block)
    turn_passed = F.col("_number") - 1 - F.col("_before")
    none = F.lit(None).cast("long")
    marks = passed.select("_path", none.alias("_at"), none.alias("_turn"), (turn_passed * 2).alias("_key"), F.lit(1).cast("long").alias("_mark"))
    summed = running_sum(wanting.unionByName(marks), ["_path"], "_key", F.col("_mark"), "_over", block, inclusive=True)
    kept = summed.where("_at is not null")
    number = F.when(F.col("_turn") == 0, F.lit(1).cast("long")).otherwise(F.col("_turn") + 1 + F.col("_over"))
    return written(kept.select(F.col("_at").alias("_given_at"), number.alias("_given")))


def organize_summary(organized: DataFrame) -> DataFrame:
    """Counts and status of an organize step; failed rows carry an ``error``."""
    failed, done = F.count_if(F.col("error").isNotNull()), F.count_if(F.col("error").isNull())
    return organized.agg(
        F.count(F.lit(1)).alias("input_files"),
        done.alias("organized"),
        failed.alias("failed"),
        F.count_if(F.col("error").isNull() & F.col("needs_review")).alias("needs_review"),
        run_status(done, failed).alias("status"),
    )


def run_status(done: Column, failed: Column) -> Column:
    return F.when((done > 0) & (failed == 0), "completed").when(done > 0, "partial").otherwise("failed")


# ------------------------------------------------------------------ index
def resource_key(sha256: Column, content: Column | None, path: Column) -> tuple[Column, Column]:
    """(key, confidence): the hash, the hash of the content, else the path."""
    strong = blank_to_null(sha256)
    if content is not None:
        strong = F.coalesce(strong, content_key(content))
    return F.coalesce(strong, F.concat(F.lit("path:"), path)), F.when(strong.isNotNull(), "high").otherwise("low")


def keyed_batch(batch: DataFrame) -> DataFrame:
    """Batch rows with ``resource_key``, ``dedupe_confidence`` and ``error``."""
    path = blank_to_null("library_file")
    content = F.col("content") if "content" in batch.columns else None
    key, sure = resource_key(_field(batch, "sha256"), content, path)
    error = F.when(path.isNull(), F.lit("缺少 library_file"))
    if "file_exists" in batch.columns:
        error = error.when(~F.coalesce("file_exists", F.lit(False)), F.lit("资料库文件不存在"))
    return let(batch, {"resource_key": key, "dedupe_confidence": sure, "error": error})


def index_outcomes(index: DataFrame, batch: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """Every batch row with its outcome: created, updated, duplicate or failed.

    Rows of one key are reduced to their first path before the index is met, so
    a key that a third of the batch holds is never gathered in one task.
    """
    keyed = keyed_batch(batch)
    valid = keyed.where(F.col("error").isNull())
    firsts = valid.groupBy("resource_key").agg(
        F.min(ordinal).alias("_first"), F.min_by("library_file", ordinal).alias("_first_file")
    )
    known = index.select("resource_key", F.lit(True).alias("_known"), blank_to_null("library_file").alias("_known_file"))
    homes = firsts.join(known, "resource_key", "left").select(
        "resource_key",
        "_first",
        F.coalesce("_known", F.lit(False)).alias("_known"),
        F.coalesce("_known_file", "_first_file").alias("existing_file"),
    )
    joined = with_group_value(valid, homes, ["resource_key"], "inner")
    outcome = (
        F.when(F.col("library_file") != F.col("existing_file"), "duplicate")
        .when(~F.col("_known") & (F.col(ordinal) == F.col("_first")), "created")
        .otherwise("updated")
    )
    done = joined.withColumn("outcome", outcome).drop("_first", "_known")
    failed = keyed.where(F.col("error").isNotNull()).withColumns(
        {"existing_file": F.lit(None).cast("string"), "outcome": F.lit("failed")}
    )
    return done.unionByName(failed)


def index_upsert(
    index: DataFrame, batch: DataFrame, now: Column | str, ordinal: str = "ordinal", outcomes: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """(new index, duplicate records) after a batch.

    Within a batch later values win, blank ones keep what is there, and the
    first path of a new key stays.  Values are combined per key with
    ``max_by`` before one full outer join on the unique key.
    """
    stamp = F.lit(now) if isinstance(now, str) else now
    rows = index_outcomes(index, batch, ordinal) if outcomes is None else outcomes
    taken = rows.where(F.col("outcome").isin("created", "updated"))
    have = [c for c in RECORD if c in rows.columns]

    def last(name: str) -> Column:
        value = blank_to_null(name)
        return F.max_by(F.when(value.isNotNull(), F.col(name)), F.when(value.isNotNull(), F.col(ordinal)))

    def last_given(name: str) -> Column:
        there = F.when(F.col(name).isNotNull(), F.col(ordinal))
        return F.max_by(name, there)

    merged = taken.groupBy("resource_key").agg(
        *[last(c).alias(f"_n_{c}") for c in have],
        last_given("classification_confidence").alias("_n_classification_confidence"),
        last_given("needs_review").alias("_n_needs_review"),
        F.max_by("dedupe_confidence", ordinal).alias("_n_dedupe_confidence"),
    )
    old = index.select("resource_key", *[F.col(c).alias(f"_o_{c}") for c in index.columns if c != "resource_key"])
    joined = old.join(merged, "resource_key", "full_outer")
    touched = F.col("_n_dedupe_confidence").isNotNull()

    def pick(name: str) -> Column:
        new = F.col(f"_n_{name}") if name in have else F.lit(None).cast("string")
        was = F.col(f"_o_{name}") if name in index.columns else F.lit(None).cast("string")
        return F.coalesce(new, was, F.lit("")).alias(name)

    fresh = joined.select(
        "resource_key",
        *[pick(c) for c in RECORD],
        F.coalesce("_n_classification_confidence", "_o_classification_confidence", F.lit(0.0)).alias("classification_confidence"),
        F.coalesce("_n_needs_review", "_o_needs_review", F.lit(False)).alias("needs_review"),
        F.coalesce("_n_dedupe_confidence", "_o_dedupe_confidence").alias("dedupe_confidence"),
        F.coalesce("_o_created_at", stamp).alias("created_at"),
        F.when(touched, stamp).otherwise(F.col("_o_updated_at")).alias("updated_at"),
    )
    duplicates = (
        rows.where(F.col("outcome") == "duplicate")
        .groupBy("resource_key", "existing_file", F.col("library_file").alias("incoming_file"))
        .agg(F.min_by("title", ordinal).alias("title"))
        .withColumns({"detected_at": stamp, "reason": F.lit("sha256 相同但资料库路径不同")})
    )
    return fresh, duplicates


def merge_duplicates(known: DataFrame, found: DataFrame) -> DataFrame:
    """Duplicate records keyed by (key, existing, incoming): the known ones first, each once."""
    key = ["resource_key", "existing_file", "incoming_file"]
    both = known.withColumn("_new", F.lit(0)).unionByName(found.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in known.columns if c not in key]
    return both.groupBy(*key).agg(*[F.min_by(c, "_new").alias(c) for c in rest])


def index_summary(outcomes: DataFrame) -> DataFrame:
    """Counts of a batch and its status."""

    def n(name: str) -> Column:
        return F.count_if(F.col("outcome") == name)

    did = n("created") + n("updated") + n("duplicate")
    status = F.when(n("failed") == 0, "completed").when(did > 0, "partial").otherwise("failed")
    return outcomes.agg(
        F.count(F.lit(1)).alias("input_files"),
        n("created").alias("created"),
        n("updated").alias("updated"),
        n("duplicate").alias("duplicates"),
        n("failed").alias("failed"),
        status.alias("status"),
    )


def fetch_summary(results: DataFrame) -> DataFrame:
    """Counts and status of a fetch: ``outcome`` is downloaded, probed, unreachable, skipped or failed."""
    outcome = F.col("outcome")
    good = F.count_if(outcome.isin("downloaded", "probed"))
    bad = F.count_if(outcome.isin("skipped", "failed", "unreachable"))
    return results.agg(
        F.count(F.lit(1)).alias("requested"),
        *[F.count_if(outcome == o).alias(o) for o in ("downloaded", "probed", "unreachable", "skipped", "failed")],
        run_status(good, bad).alias("status"),
    )


def post_selection_status(download: Column | str, organize: Column | str, index: Column | str, probed: Column | str) -> Column:
    """Three stage statuses rolled into one."""
    download, organize, index = as_col(download), as_col(organize), as_col(index)
    weak = ["partial", "failed"]
    return (
        F.when(F.coalesce(download, F.lit("failed")) == "failed", "post_selection_failed")
        .when(
            (download == "partial")
            | F.coalesce(organize.isin(weak), F.lit(False))
            | F.coalesce(index.isin(weak), F.lit(False)),
            "post_selection_partial",
        )
        .when(
            (download == "completed") & organize.isNull() & index.isNull(),
            F.when(F.coalesce(as_col(probed), F.lit(0)) > 0, "post_selection_probed").otherwise("post_selection_downloaded"),
        )
        .otherwise("post_selection_completed")
    )


def class_columns() -> Sequence[str]:
    return [n for n, _, _ in L.LIBRARY_CLASSES]
