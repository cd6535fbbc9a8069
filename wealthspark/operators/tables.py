"""Wide tables, feature families, report tables."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What the names of each source's features start with; any other feature is OSM.
PREFIXES = {"OCI": ("cells_", "towers_"), "FBM": ("FBM_",), "NTLL": ("NTLL_",), "FBMV": ("FBMV_",), "FBP": ("population_",)}
SINGLE = {"OCI": "distance_closest_cell", "FBP": "distance_closest_tile"}
#: What is never a feature.
NOT_FEATURES = {"lon", "lat", "x", "y", "geometry", "mean_wi", "std_wi", "gtID", "OSMID", "rural", "id"}


def source_of(column: str) -> str:
    """PF12: the source of a feature by its name."""
    for source, starts in PREFIXES.items():
        if column.startswith(starts) or column == SINGLE.get(source):
            return source
    return "OSM"


def feature_names(columns: list[str], sources: str = "all") -> list[str]:
    """PF12: sorted names of the features of the sources, listed with ',', '_' or blanks between them; targets and coordinates are none."""
    wanted = {s for s in re.split(r"[,_\s]+", sources) if s}
    names = [c for c in columns if c not in NOT_FEATURES]
    return sorted(c for c in names if "all" in wanted or source_of(c) in wanted)


def projected(df: DataFrame, ids: list[str], sources: str = "all", geometry: bool = False) -> DataFrame:
    """PF11: ids first, then the features of the sources; the geometry only if wanted."""
    keep = [c for c in feature_names(df.columns, sources) if c not in ids]
    return df.select(*ids, *keep, *[c for c in ("geometry", "lon", "lat") if geometry and c in df.columns])


def matrix(df: DataFrame, names: list[str], to: str = "features", vector: str | None = None) -> DataFrame:
    """PF13, SC25: NULL and NaN features become 0, all go into one vector; ``vector``: an array column whose entries follow them (cnn0, cnn1, ...)."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import array_to_vector

    df = df.withColumns({c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)) for c in names})
    inputs = list(names)
    if vector:
        df = df.withColumn("_vector", array_to_vector(F.col(vector).cast("array<double>")))
        inputs.append("_vector")
    return VectorAssembler(inputCols=inputs, outputCol=to).transform(df).drop("_vector")


def feature_counts(df: DataFrame, ids: list[str]) -> DataFrame:
    """AG24: of each source the number of features that ``df`` has, and of values that are there, in one pass over the rows."""
    names = feature_names([c for c in df.columns if c not in ids])
    counted = df.agg(*[F.count(c).alias(c) for c in names])
    rows = counted.select(F.explode(F.array(*[F.struct(F.lit(source_of(c)).alias("source"), F.col(c).alias("n_values")) for c in names])).alias("f"))
    return rows.groupBy("f.source").agg(F.count(F.lit(1)).alias("n"), F.sum("f.n_values").alias("n_values"))


def grid(df: DataFrame, **lists: list) -> DataFrame:
    """JN20: every row with every combination of short lists of constants."""
    return reduce(lambda a, n: a.withColumn(n, F.explode(F.array(*[F.lit(v) for v in lists[n]]))), lists, df)


def enriched(predictions: DataFrame, samples: DataFrame, population: DataFrame, key: str = "cluster_id") -> DataFrame:
    """JN21: predictions with the sample's facts and its population."""
    return predictions.join(samples, key, "left").join(population, key, "left")


def by_model(runs: DataFrame, metric: str, countries: list[str], model: str = "model") -> DataFrame:
    """ML9: mean of a metric by model, a column per country."""
    return runs.groupBy(model).pivot("country", countries).agg(F.round(F.avg(metric), 2))


def by_model_and_source(runs: DataFrame, metric: str, countries: list[str], sources: list[str], features: str = "features") -> DataFrame:
    """ML9: all sources together by model, then each single source; a flag column per source tells what went in."""
    all_ = runs.filter(F.col(features) == "all").withColumns({f"uses_{s}": F.lit("y") for s in sources})
    one = runs.filter(F.col(features).isin(sources)).withColumns({f"uses_{s}": F.when(F.col(features) == s, "y").otherwise("-") for s in sources})
    flags = [f"uses_{s}" for s in sources]
    return all_.unionByName(one).groupBy("model", *flags).pivot("country", countries).agg(F.round(F.avg(metric), 2))


def facets(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """AG28, AG52, AG53: count, mean and sample deviation per facet."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))


def colour_scale(df: DataFrame, by: str, value: str, group: Column) -> DataFrame:
    """AG51: least, mean and largest value per map, and the pooled range of the map's group."""
    one = df.groupBy(by, group.alias("pool")).agg(F.min(value).alias("low"), F.avg(value).alias("mean"), F.max(value).alias("high"))
    pool = one.groupBy("pool").agg(F.min("low").alias("pool_low"), F.max("high").alias("pool_high"))
    return one.join(pool, "pool")


def points_by_kind(df: DataFrame, kind: str, id: str = "place_id") -> DataFrame:
    """GX14: a point layer with a label: wealth, year, settlement or year_settlement."""
    settlement = F.when(F.col("rural") == 1, "rural").otherwise("urban")
    label = {"wealth": F.col("mean_wi").cast("string"), "year": F.col("year").cast("string"), "settlement": settlement, "year_settlement": F.concat_ws(" ", F.col("year").cast("string"), settlement)}[kind]
    return df.select(id, "lon", "lat", label.alias("label"))


def movement_summary(df: DataFrame, by: list[str], source: str = "start_node", target: str = "end_node", value: str = "n_baseline") -> DataFrame:
    """AG6: distinct locations over both ends, rows, moves within and across areas, missing and given values, their least, largest and sum."""
    ends = df.select(*by, F.explode(F.array(source, target)).alias("place")).groupBy(*by).agg(F.countDistinct("place").alias("locations"))
    one = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(source) == F.col(target)).alias("within"), F.count_if(F.col(source) != F.col(target)).alias("across"), F.count_if(F.col(value).isNull()).alias("missing"),
        F.count(value).alias("given"), F.min(value).alias("low"), F.max(value).alias("high"), F.sum(value).alias("total"),
    )
    return ends.join(one, by)


def replicated(df: DataFrame, flag: str = "augmented", times: int = 5) -> DataFrame:
    """FE1: augmented rows ``times`` times more; ``copy`` is 0 for the row itself."""
    return df.withColumn("copy", F.explode(F.sequence(F.lit(0), F.when(F.col(flag), times).otherwise(0))))


def augmentation_summary(df: DataFrame, flag: str = "augmented") -> DataFrame:
    """AG54."""
    return df.agg(F.count(F.lit(1)).alias("total"), F.count_if(flag).alias("augmented"), (100 * F.count_if(flag) / F.count(F.lit(1))).alias("percent"))
