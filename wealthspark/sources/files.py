"""Readers and writers of the formats in use."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import geo
from .zips import ZippedCsv


def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None, index: bool = True) -> DataFrame:
    """SRC1: CSV with a header; the unnamed index column in front is dropped. Without a schema the types are inferred.

    A schema names the file's columns in order, without the index.
    """
    reader = spark.read.option("header", True)
    if schema is None:
        df = reader.option("inferSchema", True).csv(path)
        return df.drop(df.columns[0]) if index and (not df.columns[0] or df.columns[0].startswith(("_c", "Unnamed"))) else df
    wanted = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    full = StructType().add("_index", "string") if index else StructType()
    for f in wanted.fields:
        full = full.add(f)
    df = reader.schema(full).option("enforceSchema", True).csv(path)
    return df.drop("_index")


def write_csv(df: DataFrame, path: str) -> None:
    """SRC2."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_parquet(df: DataFrame, path: str, by: str | None = None) -> None:
    """SRC2, SRC6: Parquet, a folder per value of ``by`` if given; each value's rows go to one task group first, so that there are few files."""
    writer = (df.repartition(F.col(by)) if by else df).write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).parquet(path)


def read_geo_csv(spark: SparkSession, path: str, schema: StructType | str | None = None, lon: str = "lon", lat: str = "lat", index: bool = True) -> DataFrame:
    """SRC3: a CSV of places with x and y in metres."""
    return geo.projected(read_csv(spark, path, schema, index), lon, lat)


def read_zips(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """SRC4: all CSV members of all zip files of a folder, by name, as text, with the file and member they came from; a zip that cannot be read gives nothing.

    Each member is a partition of its own and streams, whatever its size; of a zip only its directory and that member are read. Columns a member lacks are NULL.
    The folder must be in a store that PyArrow reads (files, HDFS, S3, GCS).
    """
    spark.dataSource.register(ZippedCsv)
    schema = "zip string, member string, " + ", ".join(f"`{c}` string" for c in columns)
    return spark.read.format("zipped_csv").schema(schema).load(path)


def read_gzip_csv(spark: SparkSession, path: str, schema: StructType | str, partitions: int) -> DataFrame:
    """SRC5: a large gzip CSV (read by one task, for gzip cannot be split), dealt at once over ``partitions`` for all that follows."""
    return spark.read.schema(schema).option("header", True).csv(path).repartition(partitions)


def append_json(df: DataFrame, path: str) -> None:
    """SRC7."""
    df.write.mode("append").json(path)


def read_json(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """SRC7."""
    return spark.read.schema(schema).json(path)


def read_tiers(spark: SparkSession, path: str, variable: str) -> DataFrame:
    """SRC8: a dictionary {country: {year: {tier: [codes]}}} as rows (variable, country, year, tier, code)."""
    raw = spark.read.option("multiLine", True).option("wholetext", True).text(path)
    parsed = raw.select(F.from_json("value", "map<string, map<string, map<string, array<int>>>>").alias("c"))
    rows = parsed.select(F.explode("c").alias("country", "y")).select("country", F.explode("y").alias("year", "t")).select("country", "year", F.explode("t").alias("tier", "codes"))
    return rows.select(F.lit(variable).alias("variable"), "country", F.col("year").cast("int").alias("year"), "tier", F.explode("codes").alias("code"))


def read_polygons(spark: SparkSession, path: str, name: str = "ADMIN") -> DataFrame:
    """SRC9: GeoJSON polygons and multipolygons as (poly_id, name, rings, x0, y0, x1, y1); the parts' rings are one list under the even-odd rule."""
    raw = spark.read.option("wholetext", True).text(path)
    feature = "struct<features: array<struct<properties: map<string, string>, geometry: struct<type: string, coordinates: string>>>>"
    rows = raw.select(F.from_json("value", feature).alias("g")).select(F.posexplode("g.features").alias("poly_id", "f"))
    many = F.from_json("f.geometry.coordinates", "array<array<array<array<double>>>>")
    one = F.from_json("f.geometry.coordinates", "array<array<array<double>>>")
    rings = F.when(F.col("f.geometry.type") == "MultiPolygon", F.flatten(many)).otherwise(one)
    points = F.transform(rings, lambda ring: F.transform(ring, lambda p: F.struct(p[0].alias("lon"), p[1].alias("lat"))))
    out = rows.select("poly_id", F.col("f.properties")[name].alias("name"), points.alias("rings"))
    flat = F.flatten("rings")
    lon, lat = F.transform(flat, lambda p: p["lon"]), F.transform(flat, lambda p: p["lat"])
    return out.withColumns({"x0": F.array_min(lon), "y0": F.array_min(lat), "x1": F.array_max(lon), "y1": F.array_max(lat)})


def with_path_facts(df: DataFrame) -> DataFrame:
    """SRC10: rows of result files with what their paths tell (a struct ``facts``)."""
    from ..functions import wealth

    return df.withColumn("facts", wealth.run_facts(F.col("_metadata.file_path")))
