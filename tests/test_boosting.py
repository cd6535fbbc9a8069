"""Boosted trees with several outputs against a plain NumPy model on the same bins; attributions against all subsets of features."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wealthspark.operators import boosting


def plain_fit(model, codes, y, w, trees, depth, rate, ridge, least):
    """The same model by brute force: every cut of every feature tried on the rows themselves. Predictions on the training rows."""
    pred = np.tile((y * w[:, None]).sum(0) / w.sum(), (len(y), 1))

    def grow(rows, g, below):
        G, W = (g[rows] * w[rows, None]).sum(0), w[rows].sum()
        out, best = {}, (1e-9, None)
        if below:
            for f in range(codes.shape[1]):
                for at in range(codes[:, f].max() + 1):
                    left = rows[codes[rows, f] <= at]
                    right = rows[codes[rows, f] > at]
                    if w[left].sum() < least or w[right].sum() < least:
                        continue
                    score = lambda r: ((g[r] * w[r, None]).sum(0) ** 2).sum() / (w[r].sum() + ridge)
                    gain = score(left) + score(right) - score(rows)
                    if gain > best[0] + 1e-9:
                        best = (gain, (left, right))
        if best[1]:
            for part in best[1]:
                out |= grow(part, g, below - 1)
            return out
        return dict.fromkeys(rows.tolist(), rate * G / (W + ridge))

    for _ in range(trees):
        step = grow(np.arange(len(y)), y - pred, depth)
        pred = pred + np.array([step[k] for k in range(len(y))])
    return pred


@pytest.fixture(scope="module")
def fitted(spark):
    r = np.random.default_rng(5)
    x = np.column_stack([r.normal(size=400), r.integers(0, 4, 400), r.uniform(size=400)])
    y = np.column_stack([2 * x[:, 0] + x[:, 1] + r.normal(size=400) / 4, np.where(x[:, 2] > 0.5, 3.0, 0.0) + x[:, 0]])
    w = r.choice([0.5, 1.0, 2.0], 400)
    rows = [(k, *map(float, a), *map(float, b), float(c)) for k, (a, b, c) in enumerate(zip(x, y, w))]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, u double, v double, w double").repartition(5)
    model = boosting.fit(df, ["a", "b", "c"], ["u", "v"], weight="w", trees=4, depth=3, bins=16)
    return df, model, x, y, w


def test_one_tree_for_both_outputs(fitted):
    df, model, x, y, w = fitted
    codes = model.coded(list(x.T))
    want = plain_fit(model, codes, y, w, 4, 3, 0.3, 1.0, 1.0)
    got = {r["id"]: (r["pred_u"], r["pred_v"]) for r in boosting.predict(model, df).collect()}
    assert np.array([got[k] for k in range(len(x))]) == pytest.approx(want)
    assert ((want - y) ** 2).mean() < 0.5 * y.var() and len(model.trees) == 4


def value_of(model, codes, known):
    """The expected prediction of one row when only some features are known."""
    out = model.base.copy()
    for tree in model.trees:

        def walk(node, tree=tree):
            f = tree.feature[node]
            if f < 0:
                return tree.value[node]
            if f in known:
                return walk(tree.left[node] if codes[f] <= tree.cut[node] else tree.right[node])
            return (tree.cover[tree.left[node]] * walk(tree.left[node]) + tree.cover[tree.right[node]] * walk(tree.right[node])) / tree.cover[node]

        out = out + walk(0)
    return out


def test_attributions_are_shapley_values(fitted):
    df, model, x, *_ = fitted
    rows = {(r["id"], r["output"], r["feature"]): r for r in boosting.attributions(model, df.filter("id < 25"), "id").collect()}
    codes, n = model.coded(list(x.T)), 3
    for k in range(25):
        for f in range(n):
            want = np.zeros(2)
            others = [g for g in range(n) if g != f]
            for size in range(n):
                for some in itertools.combinations(others, size):
                    part = math.factorial(size) * math.factorial(n - 1 - size) / math.factorial(n)
                    want += part * (value_of(model, codes[k], {*some, f}) - value_of(model, codes[k], set(some)))
            for o, name in enumerate(model.outputs):
                assert rows[k, name, model.names[f]]["attribution"] == pytest.approx(want[o], abs=1e-9)
        for o, name in enumerate(model.outputs):
            told = sum(rows[k, name, f]["attribution"] for f in model.names) + rows[k, name, "a"]["expected"]
            assert told == pytest.approx(model.predicted(codes[k : k + 1])[0, o])


def test_missing_values_and_no_rows(spark, fitted):
    df, model, *_ = fitted
    odd = spark.createDataFrame([(1, None, 2.0, None), (2, float("nan"), None, 0.3)], "id long, a double, b double, c double")
    assert boosting.predict(model, odd).filter("pred_u IS NOT NULL AND pred_v IS NOT NULL").count() == 2
    none = boosting.fit(df.limit(0), ["a", "b"], ["u"], trees=2)
    assert [r["pred_u"] for r in boosting.predict(none, odd).collect()] == [0.0, 0.0]
    assert boosting.attributions(model, odd.limit(0), "id").count() == 0
    gaps = df.withColumn("u", F.when(F.col("id") % 2 == 0, F.col("u")))
    assert len(boosting.fit(gaps, ["a"], ["u", "v"], trees=1, depth=1).trees[0].feature) == 3


def test_metrics_of_written_predictions(fitted, tmp_path):
    """What the metrics say of the written predictions, in SQL."""
    import duckdb

    from wealthspark.operators import models

    df, model, *_ = fitted
    named = df.withColumnsRenamed({"u": "mean_wi", "v": "std_wi"}).withColumn("country", F.col("id") % 3)
    predicted = boosting.predict(model, named).withColumnsRenamed({"pred_u": "pred_mean_wi", "pred_v": "pred_std_wi"})
    predicted.write.parquet(f"{tmp_path}/p")
    got = models.evaluated(df.sparkSession.read.parquet(f"{tmp_path}/p"), ["country"]).toPandas().sort_values("country")
    sql = f"""SELECT country, avg((mean_wi - pred_mean_wi) ** 2) AS mse_mean, sqrt(mse_mean) / stddev_samp(mean_wi) AS nrmse_mean, 1 - sum((std_wi - pred_std_wi) ** 2) / (var_pop(std_wi) * count(*)) AS r2_std,
    (avg(abs(mean_wi - pred_mean_wi)) + avg(abs(std_wi - pred_std_wi))) / 2 AS mae_overall FROM read_parquet('{tmp_path}/p/*.parquet') GROUP BY country ORDER BY country"""
    want = duckdb.sql(sql).df()
    for column in want.columns:
        assert got[column].tolist() == pytest.approx(want[column].tolist())
