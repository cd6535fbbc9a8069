"""Metrics, tables, windows, sorts, sets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..fixtures import view
from ..operators import features, metrics, sampling, survey
from ..operators.order import running
from .base import query
from .spatial import rounded

COUNTRIES = [f"C{k}" for k in range(6)]
MODELS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def pred(spark, d):
    return view(spark, d, "fx_pred")


GINI = "(2 * sum(r * x) - (count(*) + 1) * sum(x)) / (count(*) * sum(x))"


@query("AG8_gini", f"SELECT round({GINI}, 6) AS gini FROM (SELECT x, row_number() OVER (ORDER BY x) AS r FROM (SELECT mean_wi - least(0, (SELECT min(mean_wi) FROM fx_place)) + 1e-7 AS x FROM fx_place))")
def ag8(spark, d):
    return rounded(metrics.gini(view(spark, d, "fx_place"), "mean_wi"))


@query("AG9_gini_per_country_year", f"SELECT ccode, year, round({GINI}, 6) AS gini FROM (SELECT ccode, year, x, row_number() OVER (PARTITION BY ccode, year ORDER BY x) AS r FROM (SELECT ccode, year, mean_wi - least(0, min(mean_wi) OVER (PARTITION BY ccode, year)) + 1e-7 AS x FROM fx_place)) GROUP BY ccode, year")
def ag9(spark, d):
    return rounded(metrics.gini(view(spark, d, "fx_place"), "mean_wi", ["ccode", "year"]))


def metric_sql(o: str, ddof: int = 1) -> str:
    t, p = f"true_{o}", f"pred_{o}"
    return f"avg(({t} - {p}) ** 2) AS mse_{o}, sqrt(avg(({t} - {p}) ** 2)) AS rmse_{o}, sqrt(avg(({t} - {p}) ** 2)) / {'stddev_samp' if ddof else 'stddev_pop'}({t}) AS nrmse_{o}, 1 - sum(({t} - {p}) ** 2) / (var_pop({t}) * count(*)) AS r2_{o}, avg(abs({t} - {p})) AS mae_{o}"


def performance_sql(by: str, ddof: int = 1) -> str:
    names = [f"{m}_{o}" for o in ("mean", "std") for m in ("mse", "rmse", "nrmse", "r2", "mae")]
    means = ", ".join(f"round(({m}_mean + {m}_std) / 2, 6) AS {m}_overall" for m in ("mse", "rmse", "nrmse", "r2", "mae"))
    return f"SELECT {by}, {', '.join(f'round({n}, 6) AS {n}' for n in names)}, n, {means} FROM (SELECT {by}, {metric_sql('mean', ddof)}, {metric_sql('std', ddof)}, count(*) AS n FROM fx_pred GROUP BY {by})"


@query("AG10_performance", performance_sql("country, model, epoch"))
def ag10(spark, d):
    return rounded(metrics.performance(pred(spark, d), ["country", "model", "epoch"]))


@query("AG11_evaluation", performance_sql("settlement"))
def ag11(spark, d):
    return rounded(metrics.performance(pred(spark, d), ["settlement"]))


@query("AG12_transfer_metrics", performance_sql("country, model", 0))
def ag12(spark, d):
    return rounded(metrics.performance(pred(spark, d), ["country", "model"], ddof=0))


@query("AG13_weighted_r2", "SELECT country, round(1 - r / (q - s * s / n), 6) AS r2, round(1 - (r / (q - s * s / n)) * (n - 1) / (n - 3 - 1), 6) AS r2_adjusted FROM (SELECT country, sum(epoch * true_mean) AS s, sum(epoch * true_mean ** 2) AS q, sum(epoch * (true_mean - pred_mean) ** 2) AS r, sum(epoch) AS n FROM fx_pred GROUP BY country)")
def ag13(spark, d):
    return rounded(metrics.weighted_r2(pred(spark, d), ["country"], "true_mean", "pred_mean", "epoch", regressors=3))


@query("AG13_r2_outputs", "SELECT country, round((v1 * r1 + v2 * r2) / (v1 + v2), 6) AS r2 FROM (SELECT country, var_pop(true_mean) AS v1, var_pop(true_std) AS v2, 1 - avg((true_mean - pred_mean) ** 2) / var_pop(true_mean) AS r1, 1 - avg((true_std - pred_std) ** 2) / var_pop(true_std) AS r2 FROM fx_pred GROUP BY country)")
def ag13_outputs(spark, d):
    return rounded(metrics.r2_over_outputs(pred(spark, d), ["country"], [("true_mean", "pred_mean"), ("true_std", "pred_std")], "variance"))


RUNS = "(SELECT country, model, settlement, epoch, sqrt(avg((true_mean - pred_mean) ** 2)) AS rmse, 1 - avg((true_mean - pred_mean) ** 2) / var_pop(true_mean) AS r2 FROM fx_pred GROUP BY ALL)"


def runs(spark, d):
    m = metrics.regression(F.col("true_mean"), F.col("pred_mean"))
    return pred(spark, d).groupBy("country", "model", "settlement", "epoch").agg(m["rmse"].alias("rmse"), m["r2"].alias("r2"))


@query("AG17_summary", f"SELECT country, model, round(avg(rmse), 2) AS mean, round(stddev_samp(rmse), 2) AS std, count(*) AS runs FROM {RUNS} GROUP BY country, model")
def ag17(spark, d):
    return metrics.summary(runs(spark, d), ["country", "model"], "rmse")


@query("AG17_summary_blocks", f"WITH r AS (SELECT * FROM {RUNS}), b AS (SELECT 'model' AS block, model AS value, avg(rmse) AS m FROM r GROUP BY model, settlement UNION ALL SELECT 'settlement', settlement, avg(rmse) FROM r GROUP BY model, settlement) SELECT block, value, round(avg(m), 2) AS mean, round(stddev_samp(m), 2) AS std FROM b GROUP BY block, value")
def ag17_blocks(spark, d):
    return metrics.summary_blocks(runs(spark, d), "rmse", {"model": "model", "settlement": "settlement"}, ["model", "settlement"])


@query("AG18_mean_complete", "SELECT start_node, avg(n_baseline) AS n_baseline, round(avg(CASE WHEN start_node <> 3 THEN length_km END), 6) AS length_km FROM fx_move WHERE start_node <> 3 GROUP BY start_node")
def ag18(spark, d):
    m = view(spark, d, "fx_move").withColumn("length_km", F.when(F.col("start_node") != 3, F.col("length_km")))
    return rounded(metrics.mean_complete(m, ["start_node"], ["n_baseline", "length_km"]))


@query("AG19_best_model", f"SELECT country, settlement, model, epoch, round(rmse, 6) AS rmse FROM {RUNS} QUALIFY row_number() OVER (PARTITION BY country, settlement ORDER BY rmse, model) = 1")
def ag19(spark, d):
    return rounded(metrics.best(runs(spark, d), ["country", "settlement"], "rmse", "model").select("country", "settlement", "model", "epoch", "rmse"))


@query("AG20_best_run", f"SELECT country, model, settlement || '/' || CAST(epoch AS VARCHAR) AS path FROM {RUNS} QUALIFY row_number() OVER (PARTITION BY country, model ORDER BY r2 DESC, settlement) = 1")
def ag20(spark, d):
    r = runs(spark, d).withColumn("path", F.concat_ws("/", "settlement", F.col("epoch").cast("string")))
    return metrics.best(r, ["country", "model"], "r2", "settlement").select("country", "model", "path")


@query("AG21_missing_runs", "SELECT start_node, end_node, count(DISTINCT month(date_time)) AS n FROM fx_move GROUP BY start_node, end_node HAVING count(DISTINCT month(date_time)) < 3")
def ag21(spark, d):
    return metrics.missing_runs(view(spark, d, "fx_move").withColumn("m", F.month("date_time")), ["start_node", "end_node"], 3, "m")


@query("AG22_pivot", "SELECT model, " + ", ".join(f"round(avg(CASE WHEN country = '{c}' THEN rmse END), 6) AS {c}" for c in COUNTRIES) + f" FROM {RUNS} GROUP BY model")
def ag22(spark, d):
    return rounded(metrics.pivoted(runs(spark, d), ["model"], "country", COUNTRIES, F.avg("rmse")))


@query("AG23_dataset_summary", f"""WITH g AS (SELECT ccode, {GINI} AS gini FROM (SELECT ccode, x, row_number() OVER (PARTITION BY ccode ORDER BY x) AS r FROM (SELECT ccode, mean_wi - least(0, min(mean_wi) OVER (PARTITION BY ccode)) + 1e-7 AS x FROM fx_place)) GROUP BY ccode)
SELECT c.ccode, count(*) AS clusters, count(CASE WHEN rural = 0 THEN 1 END) AS urban, count(CASE WHEN rural = 1 THEN 1 END) AS rural, round(min(mean_wi), 6) AS min_mean_wi, round(max(mean_wi), 6) AS max_mean_wi, round(avg(mean_wi), 6) AS avg_mean_wi, round(stddev_samp(mean_wi), 6) AS std_mean_wi,
round(min(std_wi), 6) AS min_std_wi, round(max(std_wi), 6) AS max_std_wi, round(avg(std_wi), 6) AS avg_std_wi, round(stddev_samp(std_wi), 6) AS std_std_wi, round(corr(mean_wi, std_wi), 6) AS pearson, round(any_value(g.gini), 6) AS gini, count(*) AS places, round(sum(std_wi), 6) AS population FROM fx_place c JOIN g ON c.ccode = g.ccode GROUP BY c.ccode""")
def ag23(spark, d):
    p = view(spark, d, "fx_place")
    return rounded(metrics.dataset_summary(p, p.withColumn("population", F.col("std_wi"))))


@query("AG23_transposed", "SELECT measure, " + ", ".join(f"max(CASE WHEN ccode = '{c}' THEN v END) AS {c}" for c in COUNTRIES) + " FROM (SELECT ccode, 'clusters' AS measure, CAST(count(*) AS DOUBLE) AS v FROM fx_place GROUP BY ccode UNION ALL SELECT ccode, 'rural', CAST(sum(rural) AS DOUBLE) FROM fx_place GROUP BY ccode) GROUP BY measure")
def ag23_transposed(spark, d):
    c = view(spark, d, "fx_place").groupBy("ccode").agg(F.count(F.lit(1)).alias("clusters"), F.sum("rural").alias("rural"))
    return metrics.transposed(c, "ccode", COUNTRIES)


QUINTILE = "least(4, CAST(floor({0} / 20) AS INT))"


def quintiles(spark, d):
    q = lambda c: F.least(F.lit(4), F.floor(F.col(c) / 20).cast("int"))
    return pred(spark, d).withColumns({"tc": q("true_mean"), "pc": q("pred_mean")})


@query("AG25_class_report", f"""WITH c AS (SELECT country, {QUINTILE.format("true_mean")} AS t, {QUINTILE.format("pred_mean")} AS p FROM fx_pred), l AS (SELECT unnest([0, 1, 2, 3, 4]) AS label),
s AS (SELECT country, label, count(CASE WHEN t = label AND p = label THEN 1 END) AS tp, count(CASE WHEN p = label THEN 1 END) AS said, count(CASE WHEN t = label THEN 1 END) AS support FROM c, l GROUP BY country, label)
SELECT country, label, round(coalesce(tp / nullif(said, 0), 0), 6) AS precision, round(coalesce(tp / nullif(support, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(said + support, 0), 0), 6) AS f1, support FROM s""")
def ag25(spark, d):
    return rounded(metrics.class_report(quintiles(spark, d), ["country"], "tc", "pc", [0, 1, 2, 3, 4]))


@query("AG26_error_by_class", f"SELECT country, settlement, " + ", ".join(f"round(max(CASE WHEN c = {k} THEN v END), 6) AS Q{k}" for k in range(5)) + f" FROM (SELECT country, settlement, {QUINTILE.format('true_mean')} AS c, sqrt(avg((true_mean - pred_mean) ** 2)) AS v FROM fx_pred GROUP BY ALL) GROUP BY country, settlement")
def ag26(spark, d):
    return rounded(metrics.by_class(quintiles(spark, d), ["country", "settlement"], "tc", "rmse", "true_mean", "pred_mean", [0, 1, 2, 3, 4]))


@query("AG27_confusion", f"SELECT tc, pc, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY tc), 6) AS share FROM (SELECT {QUINTILE.format('true_mean')} AS tc, {QUINTILE.format('pred_mean')} AS pc FROM fx_pred) GROUP BY tc, pc")
def ag27(spark, d):
    return rounded(metrics.confusion(quintiles(spark, d), "tc", "pc", "true"))


@query("AG47_tuning_summary", "SELECT row_id, round((true_mean + pred_mean) / 2, 6) AS mean_loss, round(abs(true_mean - pred_mean) / 2, 6) AS std_loss, round(2.0, 6) AS mean_time, round(1.0, 6) AS std_time FROM fx_pred")
def ag47(spark, d):
    return rounded(metrics.tuning_summary(pred(spark, d).withColumn("times", F.lit("1.0,3.0")), ["true_mean", "pred_mean"], "times", ["row_id"]))


CLASS = "CAST(trunc(mean_wi / 10) AS INT)"
WEIGHTS = {"wINS": "1.0 / n", "wISNS": "1.0 / sqrt(n)", "wENS": "0.1 / (1 - pow(0.9, n))", "balanced_w": "all_n * 1.0 / (k * n)"}


@query("FE4_sample_weights", f"""WITH c AS (SELECT place_id, mean_wi, rural, CAST(trunc(mean_wi * 10 / 100) AS INT) AS s FROM fx_place), n AS (SELECT s, count(*) AS n FROM c GROUP BY s), r AS (SELECT rural, count(*) AS rn FROM c GROUP BY rural), a AS (SELECT sum(n) AS all_n, count(*) AS k FROM n)
SELECT place_id, {", ".join(f"round({v}, 6) AS {k}" for k, v in WEIGHTS.items())}, CASE WHEN c.s < 3 OR c.s >= 10 THEN 10.0 ELSE 1.0 END AS wx, round(all_n / (2.0 * rn), 6) AS balanced_s, round(all_n * 1.0 / (k * n) * all_n / (2.0 * rn), 6) AS balanced_ws FROM c JOIN n ON c.s = n.s JOIN r ON c.rural = r.rural, a""")
def fe4(spark, d):
    p = view(spark, d, "fx_place").select("place_id", "mean_wi", F.col("rural").alias("cluster_rural"))
    out = p.select("place_id")
    for m in ("wINS", "wISNS", "wENS", "balanced_w", "wx", "balanced_s", "balanced_ws"):
        out = out.join(metrics.sample_weights(p, m).select("place_id", F.col("weight").alias(m)), "place_id")
    return rounded(out)


@query("AG48_class_sizes", "SELECT CAST(trunc(mean_wi / 10) AS INT) AS ses, count(*) AS n FROM fx_place GROUP BY 1")
def ag48(spark, d):
    return view(spark, d, "fx_place").groupBy((F.col("mean_wi") / 10).cast("int").alias("ses")).agg(F.count(F.lit(1)).alias("n"))


@query("WN10_class_share", "SELECT place_id, count(*) OVER (PARTITION BY ccode) AS n, round(count(*) OVER (PARTITION BY ccode) / CAST(count(*) OVER () AS DOUBLE), 6) AS share FROM fx_place")
def wn10(spark, d):
    p = view(spark, d, "fx_place")
    n = p.groupBy("ccode").agg(F.count(F.lit(1)).alias("n"))
    total = n.agg(F.sum("n").alias("total"))
    return rounded(p.join(n.crossJoin(F.broadcast(total)), "ccode").select("place_id", "n", (F.col("n") / F.col("total")).alias("share")))


@query("WN1_normalised", "SELECT place_id, round((mean_wi - avg(mean_wi) OVER w) / stddev_samp(mean_wi) OVER w, 6) AS by_year, round((mean_wi - avg(mean_wi) OVER ()) / stddev_samp(mean_wi) OVER (), 6) AS overall FROM fx_place WINDOW w AS (PARTITION BY year)")
def wn1(spark, d):
    p = view(spark, d, "fx_place")
    a = features.normalised(p, ["mean_wi"], "year").select("place_id", F.col("mean_wi").alias("by_year"))
    return rounded(a.join(features.normalised(p, ["mean_wi"]).select("place_id", F.col("mean_wi").alias("overall")), "place_id"))


@query("WN2_average_rank", "SELECT place_id, rank() OVER (PARTITION BY ccode ORDER BY std_wi) + (count(*) OVER (PARTITION BY ccode, std_wi) - 1) / 2 AS rank FROM fx_place")
def wn2(spark, d):
    return metrics.average_rank(view(spark, d, "fx_place").select("place_id", "ccode", "std_wi"), "std_wi", ["ccode"]).select("place_id", "rank")


@query("WN4_closest_first", "SELECT place_id, row_number() OVER (PARTITION BY ccode ORDER BY std_wi, place_id) AS place FROM fx_place")
def wn4(spark, d):
    return sampling.numbered(view(spark, d, "fx_place"), F.col("std_wi"), "place_id", "place", ["ccode"]).select("place_id", "place")


@query("WN5_sort_index", "SELECT place_id, row_number() OVER w AS i, round(sum(mean_wi) OVER w, 6) AS running FROM fx_place WINDOW w AS (PARTITION BY ccode ORDER BY mean_wi, place_id ROWS UNBOUNDED PRECEDING)")
def wn5(spark, d):
    marked = view(spark, d, "fx_place").withColumns({"at": F.struct("mean_wi", "place_id"), "one": F.lit(1)})
    return rounded(running(marked, "at", {"i": "one", "running": "mean_wi"}, ["ccode"]).select("place_id", "i", "running"))


@query("WN6_least_per_side", "SELECT country, row_id, round(pred_mean, 6) AS pred_mean FROM fx_pred QUALIFY row_number() OVER (PARTITION BY country ORDER BY pred_mean, row_id) = 1")
def wn6(spark, d):
    return rounded(metrics.best(pred(spark, d).select("country", "row_id", "pred_mean"), ["country"], "pred_mean", "row_id", least=True))


@query("WN7_latest_n", "SELECT ccode, place_id FROM fx_place QUALIFY row_number() OVER (PARTITION BY ccode ORDER BY place_id DESC) <= 3")
def wn7(spark, d):
    place = F.row_number().over(Window.partitionBy("ccode").orderBy(F.desc("place_id")))
    return view(spark, d, "fx_place").withColumn("place", place).filter("place <= 3").select("ccode", "place_id")


@query("WN8_rescale", "SELECT place_id, round((std_wi - lo) * (hi2 - lo2) / (hi - lo) + lo2, 6) AS rescaled FROM fx_place, (SELECT min(std_wi) AS lo, max(std_wi) AS hi, min(mean_wi) AS lo2, max(mean_wi) AS hi2 FROM fx_place)")
def wn8(spark, d):
    p = view(spark, d, "fx_place")
    return rounded(metrics.rescaled(p, "std_wi", p, "mean_wi").select("place_id", "rescaled"))


@query("WN9_node_numbers", "SELECT node, dense_rank() OVER (ORDER BY node) - 1 AS nodeid FROM (SELECT start_node AS node FROM fx_move UNION SELECT end_node FROM fx_move)")
def wn9(spark, d):
    return features.nodes(view(spark, d, "fx_move").select(F.col("start_node").alias("source"), F.col("end_node").alias("target")))


@query("SO1_metric_order", f"SELECT country, model, settlement, epoch FROM {RUNS} ORDER BY r2 DESC, country, model, settlement, epoch LIMIT 20")
def so1(spark, d):
    return metrics.ordered(runs(spark, d), [], "r2").limit(20).select("country", "model", "settlement", "epoch")


@query("SO2_given_order", "SELECT model, count(*) AS n FROM fx_pred GROUP BY model")
def so2(spark, d):
    return metrics.in_order(pred(spark, d).groupBy("model").agg(F.count(F.lit(1)).alias("n")), "model", MODELS[::-1])


@query("SO3_top_30", "SELECT row_id, round(pred_mean, 6) AS importance FROM fx_pred ORDER BY pred_mean DESC, row_id LIMIT 30")
def so3(spark, d):
    return rounded(pred(spark, d).orderBy(F.desc("pred_mean"), "row_id").limit(30).select("row_id", F.col("pred_mean").alias("importance")))


@query("SE1_union", "SELECT place_id AS id, NULL AS population FROM fx_place UNION ALL SELECT tile_id, population FROM fx_tile")
def se1(spark, d):
    a, b = view(spark, d, "fx_place").select(F.col("place_id").alias("id")), view(spark, d, "fx_tile").select(F.col("tile_id").alias("id"), "population")
    return a.unionByName(b, allowMissingColumns=True)


@query("SE2_distinct", "SELECT DISTINCT start_node, end_node FROM fx_move")
def se2(spark, d):
    return view(spark, d, "fx_move").dropDuplicates(["start_node", "end_node"]).select("start_node", "end_node")


@query("SE3_node_set", "SELECT start_node AS node FROM fx_move UNION SELECT end_node FROM fx_move")
def se3(spark, d):
    m = view(spark, d, "fx_move")
    return m.select(F.col("start_node").alias("node")).union(m.select("end_node")).distinct()


@query("SE4_difference_intersection", "SELECT 'left' AS kind, x AS id FROM (SELECT place_id AS x FROM fx_place EXCEPT SELECT vec_id FROM embeddings) UNION ALL SELECT 'both', x FROM (SELECT place_id AS x FROM fx_place INTERSECT SELECT vec_id FROM embeddings)")
def se4(spark, d):
    from ..fixtures import table

    a, b = view(spark, d, "fx_place").select(F.col("place_id").alias("id")), table(spark, d, "embeddings").select(F.col("vec_id").alias("id"))
    return a.subtract(b).select(F.lit("left").alias("kind"), "id").union(a.intersect(b).select(F.lit("both"), "id"))


@query("SE5_changed_ids", "SELECT place_id AS id FROM fx_place WHERE rural = 1 UNION SELECT place_id FROM fx_place WHERE year = 2016")
def se5(spark, d):
    p = view(spark, d, "fx_place").select(F.col("place_id").alias("id"), "rural", "year")
    return p.filter("rural = 1").select("id").union(p.filter("year = 2016").select("id")).distinct()


@query("JN19_ordered_pairs", "SELECT DISTINCT a.ccode AS source, b.ccode AS target FROM fx_place a, (SELECT DISTINCT ccode FROM fx_place) b WHERE a.ccode <> b.ccode")
def jn19(spark, d):
    return metrics.ordered_pairs(view(spark, d, "fx_place"), "ccode")


@query("JN20_product_grid", "SELECT DISTINCT year, width FROM fx_place, (VALUES (1609.34), (2000.0)) AS w(width)")
def jn20(spark, d):
    from ..operators import tables

    return tables.grid(view(spark, d, "fx_place").select("year").distinct(), width=[1609.34, 2000.0])


@query("JN21_enriched_predictions", "SELECT p.row_id, c.ccode, c.rural, round(t.population, 6) AS population FROM fx_pred p LEFT JOIN fx_place c ON p.cluster_id = c.place_id LEFT JOIN fx_tile t ON p.cluster_id = t.tile_id")
def jn21(spark, d):
    from ..operators import tables

    c = view(spark, d, "fx_place").select(F.col("place_id").alias("cluster_id"), "ccode", "rural")
    t = view(spark, d, "fx_tile").select(F.col("tile_id").alias("cluster_id"), "population")
    p = pred(spark, d).withColumn("cluster_id", F.col("cluster_id").cast("long"))
    return rounded(tables.enriched(p, c, t).select("row_id", "ccode", "rural", "population"))


@query("JN22_map_layer", "SELECT c.place_id, c.lon, c.lat, round(avg(p.pred_mean), 6) AS pred_mean FROM fx_place c LEFT JOIN fx_pred p ON p.cluster_id = c.place_id GROUP BY ALL")
def jn22(spark, d):
    p = pred(spark, d).groupBy(F.col("cluster_id").cast("long").alias("place_id")).agg(F.avg("pred_mean").alias("pred_mean"))
    out = view(spark, d, "fx_place").select("place_id", "lon", "lat").join(p, "place_id", "left")
    return out.withColumn("pred_mean", F.round("pred_mean", 6))


WITHIN = f"(SELECT country, model, avg(rmse) AS metric FROM {RUNS} GROUP BY country, model)"
ACROSS = f"(SELECT a.country AS source, b.country AS target, a.model, (a.metric + 2 * b.metric) / 3 AS metric FROM {WITHIN} a JOIN {WITHIN} b ON a.model = b.model AND a.country <> b.country)"


def within(spark, d):
    return runs(spark, d).groupBy("country", "model").agg(F.avg("rmse").alias("metric"))


def across(spark, d):
    w = within(spark, d)
    a, b = w.select(F.col("country").alias("source"), "model", F.col("metric").alias("m1")), w.select(F.col("country").alias("target"), "model", F.col("metric").alias("m2"))
    return a.join(b, "model").filter("source <> target").select("source", "target", "model", ((F.col("m1") + 2 * F.col("m2")) / 3).alias("metric"))


@query("JN23_transfer_lookup", f"SELECT x.source, x.target, x.model, round(x.metric, 6) AS metric, round(a.metric, 6) AS within_source, round(b.metric, 6) AS within_target FROM {ACROSS} x JOIN {WITHIN} a ON x.source = a.country AND x.model = a.model JOIN {WITHIN} b ON x.target = b.country AND x.model = b.model")
def jn23(spark, d):
    return rounded(metrics.transfer(within(spark, d), across(spark, d)).select("source", "target", "model", "metric", "within_source", "within_target"))


@query("JN24_transfer_matrix", f"SELECT source, model, " + ", ".join(f"round(avg(CASE WHEN target = '{c}' THEN metric END), 6) AS {c}" for c in COUNTRIES) + f" FROM (SELECT country AS source, country AS target, model, metric FROM {WITHIN} UNION ALL SELECT source, target, model, metric FROM {ACROSS}) GROUP BY source, model")
def jn24(spark, d):
    return rounded(metrics.transfer_matrix(within(spark, d), across(spark, d), COUNTRIES))


@query("ML10_transfer_ranking", f"SELECT target, source, place FROM (SELECT target, source, row_number() OVER (PARTITION BY target ORDER BY metric, source) AS place FROM (SELECT source, target, avg(metric) AS metric FROM {ACROSS} GROUP BY source, target)) WHERE place <= 3")
def ml10(spark, d):
    a = across(spark, d).groupBy("source", "target").agg(F.avg("metric").alias("metric"))
    return metrics.transfer_ranking(a).select("target", "source", "place")


@query("ML10_similar_source", f"SELECT target, arg_max(source, metric) AS source FROM (SELECT source, target, avg(metric) AS metric FROM {ACROSS} GROUP BY source, target) GROUP BY target")
def ml10_similar(spark, d):
    a = across(spark, d).groupBy("source", "target").agg(F.avg("metric").alias("metric"))
    return metrics.similar_source(a, "metric", least=False)


@query("JN25_interval_overlaps", "WITH i AS (SELECT place_id AS id, mean_wi AS lo, mean_wi + 0.01 AS hi FROM fx_place) SELECT a.id AS a, b.id AS b FROM i a JOIN i b ON a.id < b.id AND a.lo < b.hi AND b.lo < a.hi")
def jn25(spark, d):
    i = view(spark, d, "fx_place").select(F.col("place_id").alias("id"), F.col("mean_wi").alias("lo"), (F.col("mean_wi") + 0.01).alias("hi"))
    return metrics.overlaps(i, "id", "lo", "hi")


@query("JN26_hour_interval", "SELECT event_id, CASE WHEN hour(date_time) >= 22 OR hour(date_time) < 6 THEN 'night' WHEN hour(date_time) < 12 THEN 'morning' END AS interval_name FROM fx_move")
def jn26(spark, d):
    i = spark.createDataFrame([("night", 22, 6), ("morning", 6, 12)], "interval string, start int, end int")
    return metrics.hour_interval(view(spark, d, "fx_move").withColumn("hour", F.hour("date_time")), i).select("event_id", F.col("interval").alias("interval_name"))


@query("ML11_long_form", "SELECT row_id, 'ground-truth' AS kind, true_mean AS value FROM fx_pred UNION ALL SELECT row_id, 'prediction', pred_mean FROM fx_pred")
def ml11(spark, d):
    return metrics.two_value_long(pred(spark, d), "row_id", "true_mean", "pred_mean")
