"""Intermediate tables in the shared folder, and results that are built once."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


_local: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a fresh local one only where that setting is empty and all runs in one process (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _local:
            _local[app] = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        folder = _local[app]
    return folder.rstrip("/")


def _files(spark: SparkSession, path: str) -> tuple[object, object]:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def cut(df: DataFrame) -> DataFrame:
    """Write the table in the shared folder and read it again: for loops, whose plans would grow without end."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    files, at = _files(spark, path)
    files.deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def materialize(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """SRC17: read the result at ``path`` if it is there (and complete), else build and write it."""
    files, done = _files(spark, f"{path}/_SUCCESS")
    if not files.exists(done):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
