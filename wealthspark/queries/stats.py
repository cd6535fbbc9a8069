"""Distributions, tests, fits, map comparison."""

from __future__ import annotations


from pyspark.sql import functions as F

from ..fixtures import view
from ..operators import compare, stats, tables
from .base import query, xy
from .metrics import GINI
from .spatial import points, rounded


def place(spark, d):
    return view(spark, d, "fx_place")


@query("AG14_pearson", "SELECT ccode, round(corr(mean_wi, std_wi), 6) AS r, count(*) AS n FROM fx_place GROUP BY ccode")
def ag14(spark, d):
    return rounded(stats.pearson(place(spark, d), ["ccode"], "mean_wi", "std_wi").select("ccode", "r", "n"))


@query("AG14_pearson_p")
def ag14_p(spark, d):
    return rounded(stats.pearson(place(spark, d), ["ccode"], "mean_wi", "std_wi"))


@query("AG15_spearman", "SELECT ccode, round(corr(a, b), 6) AS r, count(*) AS n FROM (SELECT ccode, rank() OVER (PARTITION BY ccode ORDER BY mean_wi) + (count(*) OVER (PARTITION BY ccode, mean_wi) - 1) / 2 AS a, rank() OVER (PARTITION BY ccode ORDER BY std_wi) + (count(*) OVER (PARTITION BY ccode, std_wi) - 1) / 2 AS b FROM fx_place) GROUP BY ccode")
def ag15(spark, d):
    return rounded(stats.spearman(place(spark, d), ["ccode"], "mean_wi", "std_wi"))


@query("AG16_mean_correlation", "SELECT country, round(avg(r), 6) AS r, round(avg(n), 6) AS n FROM (SELECT country, epoch, corr(true_mean, pred_mean) AS r, count(*) AS n FROM fx_pred GROUP BY country, epoch) GROUP BY country")
def ag16(spark, d):
    return rounded(stats.mean_correlation(view(spark, d, "fx_pred"), ["country"], "epoch", "true_mean", "pred_mean").select("country", "r", "n"))


@query("AG28_facet_counts", "SELECT ccode, rural, count(*) AS n, round(avg(mean_wi), 6) AS mean, round(stddev_samp(mean_wi), 6) AS std FROM fx_place GROUP BY ccode, rural")
def ag28(spark, d):
    return rounded(tables.facets(place(spark, d), ["ccode", "rural"], "mean_wi"))


@query("AG29_histogram", "WITH e AS (SELECT min(mean_wi) AS lo, max(mean_wi) AS hi FROM fx_place), b AS (SELECT unnest(range(0, 12)) AS bin), c AS (SELECT least(11, floor((mean_wi - lo) * 12 / (hi - lo))) AS bin, count(*) AS n FROM fx_place, e GROUP BY 1) SELECT CAST(b.bin AS INT) AS bin, round(lo + (hi - lo) * b.bin / 12.0, 6) AS low, coalesce(n, 0) AS n FROM b CROSS JOIN e LEFT JOIN c ON b.bin = c.bin")
def ag29(spark, d):
    return rounded(stats.histogram(place(spark, d), "mean_wi", 12))


@query("AG29_quantile_histogram", "WITH q AS (SELECT quantile_cont(mean_wi, [0.0, 0.25, 0.5, 0.75, 1.0]) AS q FROM fx_place) SELECT CAST(b AS INT) AS bin, round(q[b + 1], 6) AS low, (SELECT count(*) FROM fx_place WHERE mean_wi <= q[b + 2] AND (mean_wi > q[b + 1] OR b = 0)) AS n FROM q, (SELECT unnest(range(0, 4)) AS b)")
def ag29_quantile(spark, d):
    return rounded(stats.histogram(place(spark, d), "mean_wi", 4, quantiles=True))


@query("AG30_ecdf", "SELECT spot, round(avg(CASE WHEN mean_wi <= spot THEN 1.0 ELSE 0 END), 6) AS ecdf, round(1 - avg(CASE WHEN mean_wi <= spot THEN 1.0 ELSE 0 END), 6) AS ccdf FROM fx_place, (SELECT CAST(unnest([0, 10, 25, 50, 75, 100]) AS DOUBLE) AS spot) GROUP BY spot")
def ag30(spark, d):
    return rounded(stats.ecdf(place(spark, d), "mean_wi", [0, 10, 25, 50, 75, 100]))


@query("AG30_poverty_line", "SELECT ccode, round(quantile_cont(mean_wi, 0.35), 6) AS line FROM fx_place GROUP BY ccode")
def ag30_line(spark, d):
    return rounded(stats.poverty_line(place(spark, d), ["ccode"], "mean_wi"))


KDE = """s AS (SELECT min(wealth) AS lo, max(wealth) AS hi FROM fx_map), g AS (SELECT lo + (hi - lo) * k / 99.0 AS spot FROM s, (SELECT unnest(range(0, 100)) AS k)),
h AS (SELECT map, stddev_samp(wealth) * pow(count(*), -0.2) AS h, count(*) AS n FROM fx_map GROUP BY map),
d AS (SELECT m.map, spot, sum(exp(-0.5 * pow((spot - wealth) / h, 2))) / (any_value(n) * any_value(h) * sqrt(2 * pi())) AS density FROM fx_map m JOIN h ON m.map = h.map CROSS JOIN g GROUP BY m.map, spot)"""


@query("AG31_kde", f"WITH {KDE} SELECT map, round(spot, 6) AS spot, round(density, 8) AS density FROM d")
def ag31(spark, d):
    m = view(spark, d, "fx_map")
    k = stats.kde(m, ["map"], "wealth", stats.support(spark, m, "wealth"))
    return k.select("map", F.round("spot", 6).alias("spot"), F.round("density", 8).alias("density"))


@query("AG32_js_distance", f"WITH {KDE}, p AS (SELECT spot, sum(CASE WHEN map = 'M1' THEN density END) AS a, sum(CASE WHEN map = 'M2' THEN density END) AS b FROM d GROUP BY spot), n AS (SELECT a / sum(a) OVER () AS p, b / sum(b) OVER () AS q FROM p) SELECT round(sqrt((sum(CASE WHEN p > 0 THEN p * ln(p / ((p + q) / 2)) ELSE 0 END) + sum(CASE WHEN q > 0 THEN q * ln(q / ((p + q) / 2)) ELSE 0 END)) / 2), 6) AS distance FROM n")
def ag32(spark, d):
    return rounded(stats.js_distance(spark, view(spark, d, "fx_map"), "map", "M1", "M2", "wealth"))


KS = "SELECT max(abs(a / n - b / m)) FROM (SELECT sum(CASE WHEN map = 'M1' THEN 1.0 ELSE 0 END) OVER w AS a, sum(CASE WHEN map = 'M2' THEN 1.0 ELSE 0 END) OVER w AS b, sum(CASE WHEN map = 'M1' THEN 1 ELSE 0 END) OVER () AS n, sum(CASE WHEN map = 'M2' THEN 1 ELSE 0 END) OVER () AS m FROM {0} WINDOW w AS (ORDER BY wealth RANGE UNBOUNDED PRECEDING))"


@query("AG33_kolmogorov_smirnov", f"SELECT round(({KS.format('fx_map')}), 6) AS statistic, (SELECT count(*) FROM fx_map WHERE map = 'M1') AS n, (SELECT count(*) FROM fx_map WHERE map = 'M2') AS m")
def ag33(spark, d):
    return rounded(stats.ks(view(spark, d, "fx_map"), "map", "M1", "M2", "wealth").select("statistic", "n", "m"))


MOMENTS = "SELECT {by}, n, m3 / pow(m2, 1.5) AS skew, m4 / (m2 * m2) - 3 AS kurt FROM (SELECT {by}, count(*) AS n, avg(pow(v - m, 2)) AS m2, avg(pow(v - m, 3)) AS m3, avg(pow(v - m, 4)) AS m4 FROM (SELECT {by}, {v} AS v, avg({v}) OVER (PARTITION BY {by}) AS m FROM {t}) GROUP BY {by})"
SKEW_Z = "(SELECT *, asinh(skew * sqrt((n + 1) * (n + 3) / (6.0 * (n - 2))) / sqrt(2 / (w2 - 1))) / sqrt(0.5 * ln(w2)) AS zs FROM (SELECT *, sqrt(2 * (3.0 * (n * n + 27.0 * n - 70) * (n + 1) * (n + 3) / ((n - 2.0) * (n + 5) * (n + 7) * (n + 9)) - 1)) - 1 AS w2 FROM ({0})))"


@query("AG34_skew_test", f"SELECT ccode, round(skew, 6) AS skew, n, round(zs, 6) AS z FROM {SKEW_Z.format(MOMENTS.format(by='ccode', v='mean_wi', t='fx_place'))}")
def ag34(spark, d):
    return rounded(stats.skew_test(place(spark, d), ["ccode"], "mean_wi").select("ccode", "skew", "n", "z"))


@query("AG35_per_map", f"SELECT m.map, count(*) AS n, round(avg(wealth), 6) AS mean, round(stddev_samp(wealth), 6) AS std, round(var_pop(wealth), 6) AS var, round(any_value(gini), 6) AS gini FROM fx_map m JOIN (SELECT map, {GINI} AS gini FROM (SELECT map, x, row_number() OVER (PARTITION BY map ORDER BY x) AS r FROM (SELECT map, wealth - least(0, min(wealth) OVER (PARTITION BY map)) + 1e-7 AS x FROM fx_map)) GROUP BY map) g ON m.map = g.map GROUP BY m.map")
def ag35(spark, d):
    return rounded(compare.per_map(view(spark, d, "fx_map"), ["map"]))


PAIRS = f"""m AS (SELECT * FROM {xy("fx_map")}), nn AS (SELECT a.id AS id_a, b.id AS id_b, a.wealth AS value_a, b.wealth AS value_b, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS dist FROM m a JOIN m b ON a.map = 'M1' AND b.map = 'M2' AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 10),
ll AS (SELECT * FROM nn QUALIFY row_number() OVER (PARTITION BY id_a ORDER BY dist, id_b) = 1), p AS (SELECT * FROM ll QUALIFY row_number() OVER (PARTITION BY id_b ORDER BY dist, id_a) = 1)"""


@query("AG36_overlap_statistics", f"WITH {PAIRS} SELECT count(*) AS n, round(sqrt(avg((value_a - value_b) ** 2)), 6) AS rmse, round(avg(value_a), 6) AS mean_a, round(avg(value_b), 6) AS mean_b, round(corr(value_a, value_b), 6) AS r, round(avg(value_a) - avg(value_b), 6) AS difference, round((avg(value_a) - avg(value_b)) / (avg(value_a) + avg(value_b)), 6) AS normalised, round((avg(value_a) - avg(value_b)) / sqrt((var_samp(value_a) + var_samp(value_b)) / count(*)), 6) AS z, round(100.0 * count(*) / (SELECT count(*) FROM fx_map WHERE map = 'M1'), 6) AS percent_a FROM p")
def ag36(spark, d):
    m = points(spark, d, "fx_map")
    n = m.filter("map = 'M1'").count()
    out = compare.overlap_statistics(compare.overlap(m, "M1", "M2"), n, n)
    return rounded(out.select("n", "rmse", "mean_a", "mean_b", "r", "difference", "normalised", "z", "percent_a"))


@query("GX13_map_comparison", f"WITH sc AS (SELECT map, id, lon, lat, CASE WHEN map = 'M1' THEN wealth ELSE (wealth - lo2) * (hi1 - lo1) / (hi2 - lo2) + lo1 END AS wealth FROM fx_map, (SELECT min(CASE WHEN map = 'M1' THEN wealth END) AS lo1, max(CASE WHEN map = 'M1' THEN wealth END) AS hi1, min(CASE WHEN map = 'M2' THEN wealth END) AS lo2, max(CASE WHEN map = 'M2' THEN wealth END) AS hi2 FROM fx_map)), {PAIRS.replace('fx_map', 'sc')} SELECT count(*) AS n, round(sqrt(avg((value_a - value_b) ** 2)), 6) AS rmse, round(avg(value_b), 6) AS mean_b, round(({KS.format('sc')}), 6) AS ks FROM p")
def gx13(spark, d):
    return rounded(compare.comparison(points(spark, d, "fx_map"), "M1", "M2").select("n", "rmse", "mean_b", "ks"))


def normal_sql(by: str, v: str, table: str) -> str:
    return f"""SELECT {by}, n, zs * zs + zk * zk AS k2, exp(-(zs * zs + zk * zk) / 2) AS p FROM (SELECT *, (1 - 2 / (9 * a) - sign(1 + x * sqrt(2 / (a - 4))) * cbrt((1 - 2 / a) / abs(1 + x * sqrt(2 / (a - 4))))) / sqrt(2 / (9 * a)) AS zk FROM (SELECT *, 6 + 8 / rb * (2 / rb + sqrt(1 + 4 / (rb * rb))) AS a FROM
(SELECT *, (kurt + 3 - 3.0 * (n - 1) / (n + 1)) / sqrt(24.0 * n * (n - 2) * (n - 3) / ((n + 1.0) * (n + 1) * (n + 3) * (n + 5))) AS x, 6.0 * (n * n - 5.0 * n + 2) / ((n + 7.0) * (n + 9)) * sqrt(6.0 * (n + 3) * (n + 5) / (n * (n - 2.0) * (n - 3))) AS rb FROM {SKEW_Z.format(MOMENTS.format(by=by, v=v, t=table))})))"""


@query("AG37_normality", f"SELECT country, n, round(k2, 6) AS k2, round(p, 6) AS p, p > 0.05 AS normal FROM ({normal_sql('country', 'true_mean - pred_mean', 'fx_pred')})")
def ag37(spark, d):
    p = view(spark, d, "fx_pred").withColumn("e", F.col("true_mean") - F.col("pred_mean"))
    return rounded(stats.normality(p, ["country"], "e"))


@query("AG37_anderson_shapiro")
def ag37_others(spark, d):
    p = place(spark, d)
    return rounded(stats.anderson_darling(p, ["ccode"], "mean_wi").join(stats.shapiro(p, ["ccode"], "mean_wi").drop("n"), "ccode"))


@query("AG38_gaussian_share", f"SELECT CAST(cluster_id % 5 AS INT) AS quintile, round(avg(CASE WHEN p > 0.05 THEN 1.0 ELSE 0 END), 6) AS share, count(*) AS clusters FROM ({normal_sql('cluster_id', 'pred_mean', '(SELECT * FROM fx_pred WHERE cluster_id IN (SELECT cluster_id FROM fx_pred GROUP BY cluster_id HAVING count(*) >= 8))')}) GROUP BY 1")
def ag38(spark, d):
    p = view(spark, d, "fx_pred").withColumn("quintile", (F.col("cluster_id") % 5).cast("int"))
    return rounded(stats.gaussian_share(p, ["cluster_id"], "pred_mean", "quintile"))


@query("AG39_polynomial", "SELECT CAST(1 AS INT) AS degree, round(regr_slope(pred_mean, true_mean), 6) AS c1, round(regr_intercept(pred_mean, true_mean), 6) AS c0, round(regr_r2(pred_mean, true_mean), 6) AS r2 FROM fx_pred")
def ag39(spark, d):
    fit = stats.polynomial(view(spark, d, "fx_pred"), "true_mean", "pred_mean", 1)
    c = fit["coefficients"]
    return rounded(spark.createDataFrame([(1, c[0], c[1], fit["r2"])], "degree int, c1 double, c0 double, r2 double"))


@query("AG39_polynomial_band")
def ag39_band(spark, d):
    return rounded(stats.polynomial_band(spark, stats.polynomial(view(spark, d, "fx_pred"), "true_mean", "pred_mean", 2)))


@query("AG40_linear", "SELECT country, round(regr_slope(pred_mean, true_mean), 6) AS slope, round(regr_intercept(pred_mean, true_mean), 6) AS intercept, round(regr_r2(pred_mean, true_mean), 6) AS r2, round(corr(true_mean, pred_mean), 6) AS r FROM fx_pred GROUP BY country")
def ag40(spark, d):
    return rounded(stats.linear(view(spark, d, "fx_pred"), ["country"], "true_mean", "pred_mean"))


@query("AG41_power_law", """WITH v AS (SELECT true_mean AS v, count(*) AS k FROM fx_pred WHERE true_mean > 0 GROUP BY true_mean), c AS (SELECT v, k, sum(k) OVER w AS n, sum(k * ln(v)) OVER w AS logs FROM v WINDOW w AS (ORDER BY v DESC)),
e AS (SELECT v AS low, n, 1 + n / (logs - n * ln(v)) AS alpha FROM c WHERE logs - n * ln(v) > 1e-12 * n),
d AS (SELECT low, e.n, alpha, max(abs((e.n - (c.n - c.k)) / CAST(e.n AS DOUBLE) - (1 - pow(v / low, 1 - alpha)))) AS distance FROM e JOIN c ON v >= low GROUP BY ALL)
SELECT round(alpha, 6) AS alpha, round(low, 6) AS least, round(distance, 6) AS distance, CAST(n AS BIGINT) AS n FROM d ORDER BY d.distance, low LIMIT 1""")
def ag41(spark, d):
    return rounded(stats.power_law(view(spark, d, "fx_pred"), "true_mean"))


@query("AG49_attribution", "SELECT country, model, round(avg(abs(true_mean - pred_mean)), 6) AS importance FROM fx_pred GROUP BY country, model")
def ag49(spark, d):
    return rounded(stats.attribution(view(spark, d, "fx_pred").withColumn("a", F.col("true_mean") - F.col("pred_mean")), ["country", "model"], "a"))


@query("AG50_expected_differences", "SELECT ccode, round(gdp, 6) AS gdp, round(gini, 6) AS gini, CASE WHEN gdp > 10 THEN 'wealthier' WHEN gdp < -10 THEN 'poorer' ELSE 'similar' END AS wealth_expected, CASE WHEN gini > 0.1 THEN 'more unequal' WHEN gini < -0.1 THEN 'more equal' ELSE 'similar' END AS inequality_expected FROM (SELECT ccode, 100 * avg((mean_wi - std_wi) / nullif(mean_wi + std_wi, 0)) AS gdp, avg(lon - 29.5) AS gini FROM fx_place GROUP BY ccode)")
def ag50(spark, d):
    p = place(spark, d).withColumn("half", F.lit(29.5))
    return rounded(compare.expected_differences(p, ["ccode"], "mean_wi", "std_wi", "lon", "half"))


@query("AG51_colour_scale", "WITH o AS (SELECT ccode, ccode IN ('C0', 'C1') AS pool, min(mean_wi) AS low, avg(mean_wi) AS mean, max(mean_wi) AS high FROM fx_place GROUP BY ccode) SELECT pool, ccode, round(low, 6) AS low, round(mean, 6) AS mean, round(high, 6) AS high, round(min(low) OVER (PARTITION BY pool), 6) AS pool_low, round(max(high) OVER (PARTITION BY pool), 6) AS pool_high FROM o")
def ag51(spark, d):
    return rounded(tables.colour_scale(place(spark, d), "ccode", "mean_wi", F.col("ccode").isin("C0", "C1")))


@query("AG52_weight_kinds", "SELECT model, country, count(*) AS n, round(avg(true_std), 6) AS mean, round(stddev_samp(true_std), 6) AS std FROM fx_pred GROUP BY model, country")
def ag52(spark, d):
    return rounded(tables.facets(view(spark, d, "fx_pred"), ["model", "country"], "true_std"))


@query("AG53_facet_lines", "SELECT settlement, model, epoch, count(*) AS n, round(avg(pred_mean), 6) AS mean, round(stddev_samp(pred_mean), 6) AS std FROM fx_pred GROUP BY settlement, model, epoch")
def ag53(spark, d):
    return rounded(tables.facets(view(spark, d, "fx_pred"), ["settlement", "model", "epoch"], "pred_mean"))


@query("AG54_augmentation_summary", "SELECT count(*) AS total, count(CASE WHEN rural = 1 THEN 1 END) AS augmented, round(100.0 * count(CASE WHEN rural = 1 THEN 1 END) / count(*), 6) AS percent FROM fx_place")
def ag54(spark, d):
    return rounded(tables.augmentation_summary(place(spark, d).withColumn("augmented", F.col("rural") == 1)))


@query("FE1_replicated", "SELECT place_id, CAST(unnest(range(0, CASE WHEN rural = 1 THEN 6 ELSE 1 END)) AS INT) AS copy FROM fx_place")
def fe1(spark, d):
    return tables.replicated(place(spark, d).withColumn("augmented", F.col("rural") == 1)).select("place_id", "copy")


@query("ML9_by_model", "SELECT model, " + ", ".join(f"round(avg(CASE WHEN country = 'C{k}' THEN pred_mean END), 2) AS C{k}" for k in range(6)) + " FROM fx_pred GROUP BY model")
def ml9(spark, d):
    return tables.by_model(view(spark, d, "fx_pred"), "pred_mean", [f"C{k}" for k in range(6)])


@query("ML9_by_source", "WITH p AS (SELECT *, CASE epoch WHEN 1 THEN 'all' WHEN 2 THEN 'FBP' ELSE 'OCI' END AS features FROM fx_pred) SELECT model, CASE WHEN features IN ('all', 'FBP') THEN 'y' ELSE '-' END AS uses_FBP, CASE WHEN features IN ('all', 'OCI') THEN 'y' ELSE '-' END AS uses_OCI, " + ", ".join(f"round(avg(CASE WHEN country = 'C{k}' THEN pred_mean END), 2) AS C{k}" for k in range(6)) + " FROM p GROUP BY 1, 2, 3")
def ml9_source(spark, d):
    f = F.when(F.col("epoch") == 1, "all").when(F.col("epoch") == 2, "FBP").otherwise("OCI")
    return tables.by_model_and_source(view(spark, d, "fx_pred").withColumn("features", f), "pred_mean", [f"C{k}" for k in range(6)], ["FBP", "OCI"])


@query("GX14_points_by_kind", "SELECT place_id, lon, lat, CAST(year AS VARCHAR) || ' ' || CASE rural WHEN 1 THEN 'rural' ELSE 'urban' END AS label FROM fx_place")
def gx14(spark, d):
    return tables.points_by_kind(place(spark, d), "year_settlement")


@query("PF11_projected", "SELECT place_id, population_in_2km, lon, lat FROM (SELECT place_id, std_wi AS population_in_2km, lon, lat FROM fx_place)")
def pf11(spark, d):
    p = place(spark, d).select("place_id", F.col("std_wi").alias("population_in_2km"), F.col("rural").alias("cells_in_2km"), "lon", "lat", "mean_wi")
    return tables.projected(p, ["place_id"], "FBP", geometry=True)


@query("PF12_feature_families", "SELECT place_id, rural AS cells_in_2km, std_wi AS population_in_2km FROM fx_place")
def pf12(spark, d):
    p = place(spark, d).select("place_id", F.col("std_wi").alias("population_in_2km"), F.col("rural").alias("cells_in_2km"), F.col("year").alias("bank"), "mean_wi")
    return p.select("place_id", *[c for c in tables.feature_names(p.columns, "OCI, FBP") if c != "place_id"])


@query("PF13_matrix", "SELECT event_id, coalesce(n_baseline, 0.0) AS a, length_km AS b FROM fx_move")
def pf13(spark, d):
    from pyspark.ml.functions import vector_to_array

    m = tables.matrix(view(spark, d, "fx_move").select("event_id", "n_baseline", "length_km"), ["n_baseline", "length_km"])
    v = vector_to_array("features")
    return m.select("event_id", v[0].alias("a"), v[1].alias("b"))


@query("SC25_vector_appended", "SELECT p.place_id, round(p.mean_wi, 6) AS first, round(CAST(e.embedding[1] AS DOUBLE), 6) AS cnn0, len(e.embedding) + 1 AS width FROM fx_place p JOIN embeddings e ON p.place_id = e.vec_id")
def sc25(spark, d):
    from pyspark.ml.functions import vector_to_array

    from ..fixtures import table

    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("place_id"), "embedding")
    m = tables.matrix(place(spark, d).select("place_id", "mean_wi").join(e, "place_id"), ["mean_wi"], vector="embedding")
    v = vector_to_array("features")
    return rounded(m.select("place_id", v[0].alias("first"), v[1].alias("cnn0"), F.size(v).cast("long").alias("width")))


@query("SC26_parameters_json", "SELECT place_id, rural AS depth, round(std_wi, 6) AS rate FROM fx_place")
def sc26(spark, d):
    text = F.to_json(F.struct(F.col("rural").alias("depth"), F.col("std_wi").alias("rate")))
    back = F.from_json(text, "depth int, rate double")
    return rounded(place(spark, d).select("place_id", back["depth"].alias("depth"), back["rate"].alias("rate")))


@query("SC17_class_bins", "SELECT row_id, CAST(greatest(0, least(9, ceil((true_mean - lo) * 10 / (hi - lo)) - 1)) AS INT) AS true_class, CAST(greatest(0, least(9, ceil((pred_mean - lo) * 10 / (hi - lo)) - 1)) AS INT) AS pred_class FROM fx_pred, (SELECT least(min(true_mean), min(pred_mean)) AS lo, greatest(max(true_mean), max(pred_mean)) AS hi FROM fx_pred)")
def sc17(spark, d):
    from ..functions import wealth

    p = view(spark, d, "fx_pred")
    ends = p.agg(F.least(F.min("true_mean"), F.min("pred_mean")).alias("lo"), F.greatest(F.max("true_mean"), F.max("pred_mean")).alias("hi"))
    b = lambda c: wealth.width_bin(F.col(c), F.col("lo"), F.col("hi"), 10)
    return p.crossJoin(F.broadcast(ends)).select("row_id", b("true_mean").alias("true_class"), b("pred_mean").alias("pred_class"))


