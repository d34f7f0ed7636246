"""Session defaults and the one place that decides where staged data goes."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "shelfwise", cores: str | None = None, **conf: str) -> SparkSession:
    """Local session for tests and benchmarks; a cluster passes its own session to every operator."""
    builder = (
        SparkSession.builder.appName(app)
        .master(f"local[{cores or os.environ.get('BENCH_CPUS', '8')}]")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        # no call-site lookup per column: plans here have many columns
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", os.environ.get("SHELFWISE_DRIVER_MEMORY", "8g"))
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors share for staged data: the one the cluster names.

    Only on a single machine, where no folder is named, is a temporary one taken.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    return tempfile.mkdtemp(prefix="shelfwise-", dir="/tmp")


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme under which Spark reads it, so that other file libraries find the same place."""
    if re.match(r"[A-Za-z][A-Za-z0-9+.-]+:", path):
        return re.sub(r"^file:/+", "file:///", path)
    if not path.startswith("/"):
        path = os.path.abspath(path) if _default_file_system(spark).startswith("file:") else path
    return _default_file_system(spark).rstrip("/") + "/" + path.lstrip("/")


def _default_file_system(spark: SparkSession) -> str:
    named = spark.conf.get("spark.hadoop.fs.defaultFS", None) or spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS")
    return re.sub(r"^file:/+$", "file://", named or "file:///")


def stage(df: DataFrame, eager: bool = False) -> DataFrame:
    """Cut lineage by a reliable checkpoint in the shared folder."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=eager)


def written(df: DataFrame) -> DataFrame:
    """The rows as a Parquet table in the shared folder: made once, and read column by column."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
