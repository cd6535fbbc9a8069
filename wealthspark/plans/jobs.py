"""The three jobs of the library as one plan each: ground truth, features of places, evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo, wealth
from ..operators import features, metrics, survey


def ground_truth(households: DataFrame, clusters: DataFrame, tiers: DataFrame, betas: dict, keys: list[str]) -> DataFrame:
    """Households to scored, classified clusters: one shuffle, the aggregation per cluster."""
    scored = wealth.with_tiers(survey.settled(households), tiers).withColumn("iwi", wealth.iwi(betas))
    made = survey.scored_clusters(survey.located(clusters, "lat", "lon"), scored, keys)
    return survey.categorised(survey.renamed(made, {"mean_iwi": "mean_wi", "std_iwi": "std_wi"}))


def place_features(places: DataFrame, tiles: DataFrame, antennas: DataFrame, id: str = "place_id") -> DataFrame:
    """Population and antenna features of every place (SRC15)."""
    spots = geo.projected(places)
    return survey.left_joined(places, [features.population(spots, geo.projected(tiles), id), features.cells(spots, geo.projected(antennas), id)], [id])


def evaluation(predictions: DataFrame, by: list[str], groups: list[str], metric: str = "rmse_overall") -> DataFrame:
    """Metrics per run, their mean per configuration, and the best configuration of each group."""
    runs = metrics.performance(predictions, [*by, "epoch"])
    means = runs.groupBy(*by).agg(F.avg(metric).alias(metric), F.stddev_samp(metric).alias("std"), F.count(F.lit(1)).alias("runs"))
    tie = [c for c in by if c not in groups][0]
    return metrics.best(means, groups, metric, tie)
