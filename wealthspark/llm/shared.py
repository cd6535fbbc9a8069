"""Small helpers that the training-data operators share."""

from __future__ import annotations

import re
import tempfile
import uuid

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


def written(spark: SparkSession, df: DataFrame, compression: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again: cuts the lineage, survives lost executors.

    The table goes when the session's file system closes.
    """
    return _written(spark, df, compression)[0]


def _written(spark: SparkSession, df: DataFrame, compression: str) -> tuple[DataFrame, str]:
    path = f"{shared_folder(spark)}/written-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path), path


class Tables:
    """Tables that one operator writes in the shared folder; those that nothing reads any more are dropped before the session ends."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def write(self, df: DataFrame, compression: str = "zstd") -> DataFrame:
        out, path = _written(self.spark, df, compression)
        self.paths[out] = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables (as ``write`` gave them) whose readers have all been written themselves."""
        for table in tables:
            at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.paths.pop(table))
            at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def partitions(spark: SparkSession) -> int:
    """The number of shuffle partitions that the session asks for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
