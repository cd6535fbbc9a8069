"""Boosted trees on Spark ML: tuning, final fit, inference, transfer."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.ml.classification import GBTClassifier, OneVsRest
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import MinMaxScaler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import metrics, tables


def scaled(df: DataFrame, column: str = "features") -> DataFrame:
    """FE5: features scaled to [0, 1] in ``{column}_scaled``; what a model uses is the caller's choice (the source's regressor uses the unscaled ones)."""
    return MinMaxScaler(inputCol=column, outputCol=f"{column}_scaled").fit(df).transform(df)


def training_table(samples: DataFrame, features: DataFrame, keys: list[str], names: list[str], weight: str | None = None, vector: str | None = None, augmented: str | None = None) -> DataFrame:
    """FE2: samples with their features (inner join), missing ones 0, one vector; optional weights, appended vectors and replicated augmented rows."""
    df = samples.join(features, keys)
    if augmented:
        df = tables.replicated(df, augmented)
    df = tables.matrix(df, names, vector=vector)
    return metrics.sample_weights(df, weight) if weight else df


def regressor(label: str, params: dict[str, object], weight: str | None = None) -> GBTRegressor:
    model = GBTRegressor(featuresCol="features", labelCol=label, predictionCol=f"pred_{label}", seed=1, **params)
    return model.setWeightCol(weight) if weight else model


def learning_rates(train: DataFrame, test: DataFrame, label: str, rates: Iterable[float], trees: int = 10) -> DataFrame:
    """ML1: R2 on the test rows after each tree, for each learning rate (a row per rate and stage); every rate is one fit."""
    spark, rows = train.sparkSession, []
    variance = test.agg(F.var_pop(label)).first()[0] or 1.0
    for rate in rates:
        model = regressor(label, {"stepSize": float(rate), "maxIter": trees}).fit(train)
        rows += [(float(rate), k + 1, 1 - mse / variance) for k, mse in enumerate(model.evaluateEachIteration(test, "squared"))]
    return spark.createDataFrame(rows, "rate double, stage int, r2 double")


def classifier_rates(train: DataFrame, test: DataFrame, label: str, rates: Iterable[float], classes: int, trees: int = 5) -> DataFrame:
    """ML2: accuracy for each learning rate; more than two classes are learned one against the rest."""
    spark, rows = train.sparkSession, []
    for rate in rates:
        tree = GBTClassifier(featuresCol="features", labelCol=label, stepSize=float(rate), maxIter=trees, seed=1)
        model = (tree if classes == 2 else OneVsRest(classifier=tree, featuresCol="features", labelCol=label)).fit(train)
        rows.append((float(rate), model.transform(test).agg(F.avg((F.col("prediction") == F.col(label)).cast("double"))).first()[0]))
    return spark.createDataFrame(rows, "rate double, accuracy double")


def tune(train: DataFrame, label: str, candidates: list[dict[str, object]], fold: str = "fold", folds: int = 3, weight: str | None = None) -> DataFrame:
    """ML3: mean and deviation of the validation MSE of each candidate over given folds (0 to folds - 1), ranked. Folds run in parallel."""
    model = regressor(label, {}, weight)
    score = RegressionEvaluator(labelCol=label, predictionCol=f"pred_{label}", metricName="mse")
    maps = [{model.getParam(k): v for k, v in c.items()} for c in candidates]
    cv = CrossValidator(estimator=model, estimatorParamMaps=maps or ParamGridBuilder().build(), evaluator=score, numFolds=folds, foldCol=fold, parallelism=2).fit(train)
    rows = [(k, str(sorted(c.items())), float(m), float(s)) for k, (c, m, s) in enumerate(zip(candidates, cv.avgMetrics, cv.stdMetrics))]
    return metrics.average_rank(train.sparkSession.createDataFrame(rows, "runid int, params string, mean_loss double, std_loss double"), "mean_loss")


def fit(train: DataFrame, params: dict[str, object], outputs: tuple[str, ...] = ("mean_wi", "std_wi"), weight: str | None = None) -> dict[str, GBTRegressionModel]:
    """ML4: one model per output (boosting here has one output each)."""
    return {o: regressor(o, params, weight).fit(train) for o in outputs}


def predict(models: dict[str, GBTRegressionModel], df: DataFrame) -> DataFrame:
    """ML5, ML6: a prediction column per output for every row; rows keep their other columns."""
    for model in models.values():
        df = model.transform(df)
    return df


def importance(spark: SparkSession, models: dict[str, GBTRegressionModel], names: list[str]) -> DataFrame:
    """AG49: importance of each feature per output."""
    rows = [(o, n, float(v)) for o, m in models.items() for n, v in zip(names, m.featureImportances.toArray())]
    return spark.createDataFrame(rows, "output string, feature string, importance double")


def evaluated(predictions: DataFrame, by: list[str], ddof: int = 1) -> DataFrame:
    """Metrics of predictions with columns mean_wi, std_wi and pred_mean_wi, pred_std_wi."""
    named = predictions.withColumnsRenamed({"mean_wi": "true_mean", "std_wi": "true_std", "pred_mean_wi": "pred_mean", "pred_std_wi": "pred_std"})
    return metrics.performance(named, by, ddof)


def transfers(models: dict[str, dict[str, GBTRegressionModel]], tests: DataFrame, country: str = "ccode") -> DataFrame:
    """ML7: every model on the test rows of every other country (a loop over a few fitted models, one plan): metrics with the population deviation."""
    out = None
    for source, fitted in models.items():
        rows = predict(fitted, tests.filter(F.col(country) != source)).select(F.lit(source).alias("source"), F.col(country).alias("target"), "mean_wi", "std_wi", "pred_mean_wi", "pred_std_wi")
        out = rows if out is None else out.unionByName(rows)
    return evaluated(out, ["source", "target"], ddof=0)
