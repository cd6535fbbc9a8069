"""ST1: audience answers that keep arriving, and a table that serves the mean of all of them per key."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import features

SCHEMA = "event_id long, place_id long, profile string, users double, users_lower_bound double, users_upper_bound double, mau_lower_bound double, mau_upper_bound double"
#: A batch rewrites the parts of the served table that its keys are in.
PARTS = 32


def arriving(spark: SparkSession, path: str, schema: str = SCHEMA, files_per_batch: int = 100) -> DataFrame:
    """A stream of the JSON lines files that are added to a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(path)


def served(answers: DataFrame, keys: tuple[str, ...] = ("place_id", "profile"), answer: str | None = None) -> DataFrame:
    """The sum, count and mean of all answers per key; works on a stream (state: a sum and a count per key, and the ids seen) and on a table.

    ``answer``: the id of an answer; one that comes again does not count again. An answer without a value counts as an answer, not for the mean.
    """
    value = features.active_users(*[F.col(c) for c in ("users", "users_lower_bound", "users_upper_bound", "mau_lower_bound", "mau_upper_bound")])
    once = answers if answer is None else answers.dropDuplicates([answer])
    sums = once.groupBy(*keys).agg(F.sum(value).alias("total"), F.count(value).alias("valued"), F.count(F.lit(1)).alias("answers"))
    return sums.withColumn("active_users", F.try_divide("total", "valued"))


def _parts(spark: SparkSession, path: str, before: int | None = None) -> tuple[dict[int, str], list[str]]:
    """The newest complete version of each part, and older versions that no reader needs (the one before the newest stays for those that read it now)."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    done = {re.search(r"version=(\d+)/_SUCCESS$", str(s.getPath().toString()))[1] for s in files.globStatus(jvm.org.apache.hadoop.fs.Path(f"{path}/version=*/_SUCCESS")) or []}
    found: dict[int, list[tuple[int, str]]] = {}
    for s in files.globStatus(jvm.org.apache.hadoop.fs.Path(f"{path}/version=*/part=*")) or []:
        m = re.search(r"version=(\d+)/part=(\d+)$", s.getPath().toString())
        if m and m[1] in done and (before is None or int(m[1]) < before):
            found.setdefault(int(m[2]), []).append((int(m[1]), s.getPath().toString()))
    for versions in found.values():
        versions.sort()
    return {p: v[-1][1] for p, v in found.items()}, [place for v in found.values() for _, place in v[:-2]]


def table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame | None:
    """The served table as it is now: a row per key. None if nothing has been served yet."""
    now, _ = _parts(spark, path)
    return spark.read.parquet(*now.values()) if now else None


def upsert(spark: SparkSession, rows: DataFrame, path: str, keys: tuple[str, ...], version: int, parts: int = PARTS) -> None:
    """Put the rows (one per key) into the keyed table. Only parts with a changed key are rewritten, under a version of their own that counts once it is complete: a
    version that is written again, after a failure, replaces itself."""
    rows = rows.withColumn("part", F.pmod(F.xxhash64(*keys), F.lit(parts)))
    changed = [r["part"] for r in rows.select("part").distinct().collect()]  # parts at most
    if not changed:
        return
    now, _ = _parts(spark, path, before=version)
    there = [now[p] for p in changed if p in now]
    if there:
        old = spark.read.parquet(*there).withColumn("part", F.pmod(F.xxhash64(*keys), F.lit(parts)))
        rows = rows.unionByName(old.join(rows.select(*keys), list(keys), "left_anti"))
    rows.repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{path}/version={version}")
    _, old = _parts(spark, path)
    for place in old:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def serve(stream: DataFrame, path: str, checkpoint: str, keys: tuple[str, ...] = ("place_id", "profile"), answer: str | None = "event_id", once: bool = False) -> StreamingQuery:
    """Keep the table at ``path`` up to date: the keys of each batch are put into it. A stopped query goes on where it was, from its checkpoint. ``once``: all
    that is there now, then stop."""

    def put(batch: DataFrame, version: int) -> None:
        upsert(batch.sparkSession, batch, path, keys, version)

    writer = served(stream, keys, answer).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(put)
    return (writer.trigger(availableNow=True) if once else writer).start()
