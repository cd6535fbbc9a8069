"""Household surveys: cleaning, scoring, clusters."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import wealth


class SurveyAdapter(Protocol):
    """UX1: a survey programme's tables in the common form."""

    def households(self) -> DataFrame: ...

    def clusters(self) -> DataFrame: ...


def conform(df: DataFrame, schema: dict[str, str], default: int = 0) -> DataFrame:
    """PF1, PF4: the named columns in order with these types; absent ones hold ``default``."""
    have = set(df.columns)
    return df.select(*[(F.col(c) if c in have else F.lit(default)).cast(t).alias(c) for c, t in schema.items()])


def complete(df: DataFrame, fill: Iterable[str], needed: Iterable[str] | None = None) -> DataFrame:
    """PF2: NULL in ``fill`` becomes 0; rows that still lack one of ``needed`` (default: any column) go."""
    df = df.fillna(0, list(fill))
    return df.dropna(subset=list(needed) if needed else None)


def settled(df: DataFrame, column: str = "hv025") -> DataFrame:
    """PF3: urban (1) and rural (2) households."""
    return df.filter(F.col(column).isin(1, 2))


def recoded(area: Column) -> Column:
    """PF5: U to 0, R to 1, anything else to -1."""
    return F.when(area == "U", 0).when(area == "R", 1).otherwise(-1)


def located(clusters: DataFrame, lat: str = "LATNUM", lon: str = "LONGNUM") -> DataFrame:
    """PF6: clusters whose coordinates are both known (neither is 0)."""
    return clusters.filter((F.col(lat) != 0) & (F.col(lon) != 0))


def renamed(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """PF7."""
    return df.withColumnsRenamed(names)


def surveyed(clusters: DataFrame, households: DataFrame, keys: list[str]) -> DataFrame:
    """JN1: clusters that some household names (year, survey, cluster)."""
    return clusters.join(households.select(*keys).distinct(), keys, "left_semi")


def with_cluster(households: DataFrame, clusters: DataFrame, column: str) -> DataFrame:
    """JN6: households whose cluster number is known; the number alone decides, whatever year and survey (as in the source)."""
    return households.join(clusters.select(column).distinct(), column, "left_semi")


def without(df: DataFrame, taken: DataFrame, keys: list[str]) -> DataFrame:
    """JN6: rows whose key is not in ``taken``."""
    return df.join(taken.select(*keys).distinct(), keys, "left_anti")


def cluster_scores(households: DataFrame, keys: list[str], score: str = "iwi") -> DataFrame:
    """AG1: mean, sample deviation (0 for a single household) and number of households of each cluster."""
    made = households.groupBy(*keys).agg(F.avg(score).alias("mean_iwi"), F.stddev_samp(score).alias("std_iwi"), F.count(F.lit(1)).alias("counts"))
    return made.withColumn("std_iwi", F.when(F.col("counts") == 1, 0.0).otherwise(F.col("std_iwi")))


def scored_clusters(clusters: DataFrame, households: DataFrame, keys: list[str]) -> DataFrame:
    """JN2: clusters with their scores."""
    return clusters.join(cluster_scores(households, keys), keys)


def categorised(clusters: DataFrame, column: str = "mean_wi") -> DataFrame:
    """SC13: name, number and interval of the wealth class."""
    c = wealth.wealth_class(F.col(column))
    return clusters.withColumns({f"{column}_cat": c["name"], f"{column}_cat_id": c["id"], f"{column}_bin": c["bin"]})


def survey_prefix(df: DataFrame, source: str = "dsource", year: str = "year") -> DataFrame:
    """SRC13: the sorted distinct surveys joined by '_'; one row."""
    return df.select(F.concat(source, F.col(year).cast("string")).alias("s")).distinct().agg(F.concat_ws("_", F.array_sort(F.collect_list("s"))).alias("prefix"))


def matching_years(files: DataFrame, years: list[int], column: str = "name") -> DataFrame:
    """SRC12: files whose four-digit groups are exactly the wanted years, or, if there is none, those that hold them all."""
    found = F.array_distinct(F.transform(F.regexp_extract_all(F.col(column), F.lit(r"(\d{4})"), 1), lambda s: s.cast("int")))
    wanted = F.array(*[F.lit(y) for y in sorted(set(years))])
    rows = files.withColumns({"exact": F.array_sort(found) == wanted, "holds": F.size(F.array_except(wanted, found)) == 0}).filter("holds")
    best = rows.agg(F.max("exact").alias("best"))
    return rows.crossJoin(F.broadcast(best)).filter(F.col("exact") == F.col("best")).drop("exact", "holds", "best")  # best: one row


def left_joined(base: DataFrame, others: list[DataFrame], keys: list[str]) -> DataFrame:
    """JN3, SRC15: feature tables joined to the places one after another."""
    return reduce(lambda a, b: a.join(b, keys, "left"), others, base)


def overridden(clusters: DataFrame, places: DataFrame, columns: list[str], key: str = "OSMID", settlement: str = "rural") -> DataFrame:
    """JN5: where a cluster was moved to a place, that place's values; ``settlement_ok`` tells whether both agree (NULL if not moved)."""
    p = places.select(key, F.col(settlement).alias("p_settlement"), *[F.col(c).alias(f"p_{c}") for c in columns])
    out = clusters.join(p, key, "left")
    moved = F.col(key).isNotNull()
    out = out.withColumns({c: F.when(moved, F.col(f"p_{c}")).otherwise(F.col(c)) for c in columns})
    out = out.withColumn("settlement_ok", F.when(moved, F.col(settlement) == F.col("p_settlement")))
    return out.drop("p_settlement", *[f"p_{c}" for c in columns])


def best_only(df: DataFrame, chosen: DataFrame, keys: list[str]) -> DataFrame:
    """PF14: rows whose (country, recency) is among the chosen ones: a join, not a built predicate."""
    return df.join(chosen.select(*keys).distinct(), keys, "left_semi")


def in_displacement(df: DataFrame, most: dict[int, float], extra: dict[int, float], rural: str = "cluster_rural", distance: str = "pplace_cluster_distance") -> DataFrame:
    """PF15: rows within the displacement allowed for their settlement."""
    return df.filter(reduce(lambda a, b: a | b, [(F.col(rural) == k) & (F.col(distance) <= most[k] + extra[k]) for k in most]))


def economic_covariate(df: DataFrame, values: DataFrame, timevar: str, year: str = "year") -> DataFrame:
    """PF17: 'deltatime' is 2021 - year; others from the table (timevar, year, value), NULL if the year is not listed."""
    if timevar == "deltatime":
        return df.withColumn("timevar", (F.lit(2021) - F.col(year)).cast("double"))
    one = values.filter(F.col("timevar") == timevar).select(F.col("year").alias(year), F.col("value").alias("timevar"))
    return df.join(one, year, "left")


def newest_years(wide: DataFrame, years: list[int], country: str = "Country Code") -> DataFrame:
    """SRC14: year columns to rows, the newest ``len(years)`` values per country, aligned to the survey years by position (oldest first)."""
    from pyspark.sql import Window

    columns = [c for c in wide.columns if c.isdigit()]
    rows = wide.unpivot([country], columns, "value_year", "value").withColumn("value_year", F.col("value_year").cast("int")).filter("value IS NOT NULL")
    w = Window.partitionBy(country)
    rows = rows.withColumn("place", F.row_number().over(w.orderBy(F.desc("value_year")))).filter(F.col("place") <= len(years))
    rows = rows.withColumn("place", F.row_number().over(w.orderBy("value_year")))
    named = F.create_map(*[x for k, y in enumerate(sorted(years), 1) for x in (F.lit(k), F.lit(y))])
    return rows.select(F.col(country).alias("country"), named[F.col("place")].alias("survey_year"), "value_year", "value")
