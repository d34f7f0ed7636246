"""From documents to packed training data: five stages, each the Parquet table that the next one reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm import jaccard_join, mixing, packing, personal_data, quality_rules, words
from shelfwise.llm.queries import candidates_of, read, trusted_candidates
from shelfwise.llm.tables import new_folder, packed, unpacked


#: Columns of documents that a stage reads, by the names that candidates have for them.
TEXT = {"ordinal": "doc_id", "text": "text"}
SIZED = TEXT | {"size": "n_chars"}
MIXED = SIZED | {"source": "source"}


def _candidates(docs: DataFrame, names: dict[str, str]) -> DataFrame:
    """Documents as candidates; what else they hold lies in a struct, where its names clash with none of the operators'."""
    return packed(docs, **names)


def _documents(candidates: DataFrame, docs: DataFrame, names: dict[str, str]) -> DataFrame:
    return unpacked(candidates, docs.columns, **names)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    trusted = trusted_candidates(docs, read(spark, sf_dir, "labels"))
    ratio = quality_rules.fit_ratio(candidates_of(docs, "text"), trusted)
    threshold = quality_rules.trusted_threshold(trusted, ratio)
    judged = quality_rules.quality_rules(_candidates(docs, TEXT), ratio, threshold=threshold)
    return _documents(judged.where("quality.kept"), docs, TEXT)


#: Word shingles of five words at 0.8; the query ``op2_jaccard_join`` has 3 words and 0.9 by its own contract.
NEAR = jaccard_join.Rule(width=5, percent=80)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that the Jaccard join links."""
    return _documents(jaccard_join.first_of_groups(_candidates(docs, TEXT), NEAR), docs, TEXT)


def personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with their personal data and disclosing terms replaced; ``n_chars`` follows the text."""
    safe = personal_data.protect_candidates(_candidates(docs, SIZED), term=personal_data.ANY_TERM)
    out = safe.withColumns({"text": F.col("safe_text"), "size": F.length("safe_text").cast("long")})
    return _documents(out, docs, SIZED)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them; ``n_chars`` follows the text."""
    mixed = mixing.mixed_rows(_candidates(docs, MIXED))
    return _documents(mixed.withColumn("size", F.length("text").cast("long")), docs, MIXED)


def packed_bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes: ``doc_id``, ``text_key``, ``copy``, ``piece``, ``start``, ``length``, ``bin``, ``bin_start``.

    ``text_key`` and ``copy`` tell the copies apart that the mix made of a document: its cut copy has a text of its own, and
    equal copies are counted from zero.  ``text_key`` is xxhash64 of the text's SHA-256 in hex.
    """
    sized = candidates_of(docs).select(
        "ordinal", "source", words.word_count(F.col("text")).alias("size"), F.sha2("text", 256).alias("cluster")
    )
    return packing.pack_candidates(sized).withColumnsRenamed({"ordinal": "doc_id", "cluster_key": "text_key"})


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("personal data", personal),
    ("source mixture", mixture),
    ("best-fit packing", packed_bins),
]
#: Hashed likelihood ratios, reveal scores and best-fit search are not SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_folder(spark, "stage-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
