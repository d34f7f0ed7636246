"""Written intermediate tables in the folder that all executors share."""

from __future__ import annotations

import uuid

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.session import qualified, shared_folder


def new_folder(spark: SparkSession, name: str) -> str:
    """Path of a folder of its own for one run, below ``spark.checkpoint.dir``."""
    return f"{qualified(spark, shared_folder(spark)).rstrip("/")}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """``df`` as a Parquet table in the shared folder.

    Cuts the lineage, so a lost executor costs no more than the tasks it ran, and
    gives the planner a measured size: joins broadcast such a table only below
    the session's threshold.
    """
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def packed(df: DataFrame, **keep: str) -> DataFrame:
    """The columns ``new=old`` and every other one inside the struct ``rest``, where no name can clash with an operator's own."""
    others = [F.col(f"`{c}`") for c in df.columns if c not in keep.values()]
    rest = F.struct(*others) if others else F.struct(F.lit(True).alias("none"))
    return df.select(*[F.col(f"`{old}`").alias(new) for new, old in keep.items()], rest.alias("rest"))


def unpacked(df: DataFrame, columns: Sequence[str], added: Sequence[str] = (), **keep: str) -> DataFrame:
    """Back from ``packed`` to ``columns``, less those that ``added`` ones replace, and the added ones."""
    back = {old: new for new, old in keep.items()}
    kept = [F.col(back[c]).alias(c) if c in back else F.col("rest").getField(c).alias(c) for c in columns if c not in added]
    return df.select(*kept, *added)
