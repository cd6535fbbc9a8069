"""Comparison of wealth maps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import wealth
from . import metrics, spatial, stats


def per_map(maps: DataFrame, by: list[str], value: str = "wealth") -> DataFrame:
    """AG35: mean, sample deviation, population variance, Gini and size of each map."""
    made = maps.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.var_pop(value).alias("var"))
    return made.join(metrics.gini(maps, value, by), by)


def overlap(maps: DataFrame, a: str, b: str, most: float = 10.0, value: str = "wealth") -> DataFrame:
    """JN11 on two maps: pairs of places, each other's nearest within ``most`` metres, with both values."""
    left = maps.filter(F.col("map") == a).select(F.col("id").alias("id_a"), F.col(value).alias("value_a"), "x", "y")
    right = maps.filter(F.col("map") == b).select(F.col("id").alias("id_b"), F.col(value).alias("value_b"), "x", "y")
    pairs = spatial.mutual_nearest(left, right, "id_a", "id_b", most)
    return pairs.join(left.select("id_a", "value_a"), "id_a").join(right.select("id_b", "value_b"), "id_b")


def overlap_statistics(pairs: DataFrame, n_a: int, n_b: int) -> DataFrame:
    """AG36: size and share of the overlap, RMSE, both means, their difference (plain, normalised, as z), r and both Ginis. One row; names say whose mean it is."""
    a, b = F.col("value_a"), F.col("value_b")
    s = pairs.agg(
        F.count(F.lit(1)).alias("n"), F.sqrt(F.avg((a - b) * (a - b))).alias("rmse"), F.avg(a).alias("mean_a"), F.avg(b).alias("mean_b"), F.corr("value_a", "value_b").alias("r"), F.var_samp(a).alias("va"), F.var_samp(b).alias("vb"),
    )
    d = F.col("mean_a") - F.col("mean_b")
    s = s.withColumns(
        {
            "percent_a": F.try_divide(100.0 * F.col("n"), F.lit(n_a)), "percent_b": F.try_divide(100.0 * F.col("n"), F.lit(n_b)), "difference": d, "normalised": wealth.normalised_difference(F.col("mean_a"), F.col("mean_b")),
            "z": F.try_divide(d, F.sqrt((F.col("va") + F.col("vb")) / F.col("n"))),
        }
    )
    g = metrics.gini(pairs, "value_a").withColumnRenamed("gini", "gini_a").crossJoin(metrics.gini(pairs, "value_b").withColumnRenamed("gini", "gini_b"))
    return s.drop("va", "vb").crossJoin(g)


def comparison(maps: DataFrame, a: str, b: str, most: float = 10.0) -> DataFrame:
    """GX13: the second map rescaled onto the first one's range, the overlap's statistics and the Kolmogorov-Smirnov distance of the whole maps. One row."""
    first, second = maps.filter(F.col("map") == a), maps.filter(F.col("map") == b)
    scaled = metrics.rescaled(second, "wealth", first, "wealth").drop("wealth").withColumnRenamed("rescaled", "wealth")
    both = first.unionByName(scaled.select(first.columns))
    n = {r["map"]: r["n"] for r in both.groupBy("map").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    out = overlap_statistics(overlap(both, a, b, most), n.get(a, 0), n.get(b, 0))
    k = stats.ks(both, "map", a, b, "wealth").select(F.col("statistic").alias("ks"), F.col("p").alias("ks_p"))
    return out.crossJoin(k).withColumn("ks_stars", wealth.stars(F.col("ks_p")))


def expected_differences(df: DataFrame, by: list[str], gdp_a: str, gdp_b: str, gini_a: str, gini_b: str) -> DataFrame:
    """AG50: mean normalised GDP difference and mean Gini difference of map pairs, and what they let expect (limits 10 and 0.1)."""
    g = df.groupBy(*by).agg((100 * F.avg(wealth.normalised_difference(F.col(gdp_a), F.col(gdp_b)))).alias("gdp"), F.avg(F.col(gini_a) - F.col(gini_b)).alias("gini"))
    label = lambda c, limit, up, down: F.when(F.col(c) > limit, up).when(F.col(c) < -limit, down).otherwise("similar")
    return g.withColumns({"wealth_expected": label("gdp", 10.0, "wealthier", "poorer"), "inequality_expected": label("gini", 0.1, "more unequal", "more equal")})
