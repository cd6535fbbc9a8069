"""Surveys, wealth scores and classes, keys, labels."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..fixtures import view
from ..functions import wealth
from ..operators import features, survey
from .base import query
from .spatial import rounded

#: The index's published weights (low, middle, high quality; rooms one, two, three), as a parameter of the score.
BETAS = {
    "constant": 25.00447, "cheap": 4.118394, "expensive": 6.507283, "hv208": 8.612657, "hv209": 8.429076, "hv221": 7.127699, "hv210": 1.84686, "hv212": 4.651382, "hv206": 8.056664,
    "hv201": {"1": -6.306477, "2": -2.302023, "3": 7.952443}, "hv205": {"1": -7.439841, "2": -1.090393, "3": 8.140637}, "hv213": {"1": -7.558471, "2": 1.227531, "3": 6.107428}, "hv216": {"1": -3.699681, "2": 0.38405, "3": 3.445009},
}
TIERS = [("hv201", "low", 10), ("hv201", "low", 20), ("hv201", "mid", 30), ("hv201", "mid", 40), ("hv201", "high", 50), ("hv205", "low", 10), ("hv205", "mid", 20), ("hv205", "high", 30), ("hv213", "low", 10), ("hv213", "mid", 20), ("hv213", "high", 30)]


def cleaned(spark, d):
    df = survey.settled(view(spark, d, "fx_household"))
    return df.fillna(0, ["hv243a"]).withColumns({c: F.lit(0) for c in ("hv243e", "hv211", "hv243d")})


def scored(spark, d):
    tiers = spark.createDataFrame(TIERS, "variable string, tier string, code int")
    return wealth.with_tiers(cleaned(spark, d), tiers).withColumn("iwi", wealth.iwi(BETAS))


def tier_sql(v: str) -> str:
    codes = {t: [str(c) for n, k, c in TIERS if n == v and k == t] for t in ("low", "mid", "high")}
    return "CASE " + " ".join(f"WHEN {v} IN ({', '.join(codes[t])}) THEN {k}" for k, t in enumerate(("low", "mid", "high"), 1)) + " END"


def beta_sql(v: str, step: str) -> str:
    b = BETAS[v]
    return f"CASE WHEN {v} IN (96, 99) THEN 0.0 ELSE coalesce(CASE {step} WHEN 1 THEN {b['1']} WHEN 2 THEN {b['2']} WHEN 3 THEN {b['3']} END, 0.0) END"


SCORED = f"""SELECT *, CAST({BETAS["constant"]} AS DOUBLE) + {" + ".join(f"CAST({BETAS[v]} AS DOUBLE) * {v}" for v in ("hv208", "hv209", "hv221", "hv210", "hv212", "hv206"))}
+ {" + ".join(beta_sql(v, tier_sql(v)) for v in ("hv201", "hv205", "hv213"))} + {beta_sql("hv216", "(CASE WHEN hv216 <= 1 THEN 1 WHEN hv216 = 2 THEN 2 ELSE 3 END)")}
+ CASE WHEN hv212 = 1 OR hv243a = 1 THEN {BETAS["expensive"]} ELSE 0 END
+ CASE WHEN hv212 = 1 OR hv243a = 1 OR hv208 = 1 OR hv209 = 1 OR hv221 = 1 OR hv210 = 1 OR hv205 = 30 OR hv213 = 30 THEN {BETAS["cheap"]} ELSE 0 END AS iwi FROM (SELECT * REPLACE (coalesce(hv243a, 0) AS hv243a) FROM fx_household WHERE hv025 IN (1, 2))"""


@query("SC12_iwi", f"SELECT hhid, hv001, round(iwi, 6) AS iwi FROM ({SCORED})")
def sc12(spark, d):
    return rounded(scored(spark, d).select("hhid", "hv001", "iwi"))


CLUSTERS = f"(SELECT year, survey, hv001, avg(iwi) AS mean_iwi, CASE WHEN count(*) = 1 THEN 0.0 ELSE stddev_samp(iwi) END AS std_iwi, count(*) AS counts FROM ({SCORED}) GROUP BY year, survey, hv001)"


@query("AG1_cluster_scores", f"SELECT year, survey, hv001, round(mean_iwi, 6) AS mean_iwi, round(std_iwi, 6) AS std_iwi, counts FROM {CLUSTERS}")
def ag1(spark, d):
    return rounded(survey.cluster_scores(scored(spark, d), ["year", "survey", "hv001"]))


@query("AG2_group_sizes", "SELECT year, hv025, count(*) AS n FROM fx_household GROUP BY year, hv025")
def ag2(spark, d):
    return view(spark, d, "fx_household").groupBy("year", "hv025").agg(F.count(F.lit(1)).alias("n"))


@query("PF1_conform", "SELECT hhid, CAST(hv201 AS SMALLINT) AS hv201, CAST(hv208 AS BOOLEAN) AS hv208, CAST(0 AS DOUBLE) AS hv999 FROM fx_household")
def pf1(spark, d):
    return survey.conform(view(spark, d, "fx_household"), {"hhid": "bigint", "hv201": "smallint", "hv208": "boolean", "hv999": "double"})


@query("PF2_complete", "SELECT hhid, coalesce(hv243a, 0) AS hv243a FROM fx_household WHERE hv201 IS NOT NULL")
def pf2(spark, d):
    return survey.complete(view(spark, d, "fx_household").select("hhid", "hv201", "hv243a"), ["hv243a"]).select("hhid", "hv243a")


@query("PF3_settled", "SELECT hv025, count(*) AS n FROM fx_household WHERE hv025 IN (1, 2) GROUP BY hv025")
def pf3(spark, d):
    return survey.settled(view(spark, d, "fx_household")).groupBy("hv025").agg(F.count(F.lit(1)).alias("n"))


@query("PF4_casts", "SELECT hhid, CAST(CAST(hv212 AS BOOLEAN) AS INT) AS has_car, CAST(year AS SMALLINT) AS year, CAST(hv216 AS DOUBLE) AS rooms FROM fx_household")
def pf4(spark, d):
    c = survey.conform(view(spark, d, "fx_household"), {"hhid": "bigint", "hv212": "boolean", "year": "smallint", "hv216": "double"})
    return c.select("hhid", F.col("hv212").cast("int").alias("has_car"), "year", F.col("hv216").alias("rooms"))


@query("PF5_recode", "SELECT place_id, CASE a WHEN 'U' THEN 0 WHEN 'R' THEN 1 ELSE -1 END AS rural FROM (SELECT place_id, CASE place_id % 3 WHEN 0 THEN 'U' WHEN 1 THEN 'R' ELSE 'X' END AS a FROM fx_place)")
def pf5(spark, d):
    area = F.when(F.col("place_id") % 3 == 0, "U").when(F.col("place_id") % 3 == 1, "R").otherwise("X")
    return view(spark, d, "fx_place").select("place_id", survey.recoded(area).alias("rural"))


@query("PF6_located", "SELECT place_id FROM fx_place WHERE place_id % 10 <> 0 AND place_id % 7 <> 0")
def pf6(spark, d):
    raw = view(spark, d, "fx_place").withColumns({"LATNUM": F.when(F.col("place_id") % 10 != 0, F.col("lat")).otherwise(0.0), "LONGNUM": F.when(F.col("place_id") % 7 != 0, F.col("lon")).otherwise(0.0)})
    return survey.located(raw).select("place_id")


@query("PF7_rename", "SELECT hhid, hv001 AS cluster, year FROM fx_household")
def pf7(spark, d):
    return survey.renamed(view(spark, d, "fx_household").select("hhid", "hv001", "year"), {"hv001": "cluster"})


@query("PF8_key", "SELECT place_id, ccode || lpad(CAST(year AS VARCHAR), 4, ' ') || lpad(CAST(place_id AS VARCHAR), 10, '0') AS gt_id FROM fx_place")
def pf8(spark, d):
    return view(spark, d, "fx_place").select("place_id", wealth.key(F.col("ccode"), F.col("year"), F.col("place_id")).alias("gt_id"))


@query("PF9_rural_kind", "SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 0 ELSE 1 END AS rural FROM part WHERE p_partkey % 4 <> 1")
def pf9(spark, d):
    return kinds(spark, d).select(F.col("OSMID").alias("id"), "rural")


def kinds(spark, d):
    from ..fixtures import table

    kind = F.element_at(F.array(*[F.lit(k) for k in ("town", "shop", "village", "hamlet")]), (F.col("p_partkey") % 4 + 1).cast("int"))
    nodes = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.lit(0.0).alias("lat"), F.lit(0.0).alias("lon"), F.create_map(F.lit("place"), kind, F.lit("name"), F.col("p_name")).alias("tags"))
    return features.populated_places(nodes)


@query("GX6_populated_places", "SELECT p_partkey AS OSMID, CASE p_partkey % 4 WHEN 0 THEN 'town' WHEN 2 THEN 'village' ELSE 'hamlet' END AS place, p_name AS name, CAST(NULL AS VARCHAR) AS capital, CASE p_partkey % 4 WHEN 0 THEN 0 ELSE 1 END AS rural FROM part WHERE p_partkey % 4 <> 1")
def gx6(spark, d):
    return kinds(spark, d).select("OSMID", "place", "name", "capital", "rural")


@query("PF10_tags", "SELECT count(*) AS n, count(DISTINCT p_name) AS names FROM part WHERE p_partkey % 4 <> 1")
def pf10(spark, d):
    return kinds(spark, d).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("name").alias("names"))


@query("PF14_best_only", "SELECT row_id FROM fx_pred WHERE (country = 'C0' AND epoch = 1) OR (country = 'C1' AND epoch = 2)")
def pf14(spark, d):
    best = spark.createDataFrame([("C0", 1), ("C1", 2)], "country string, epoch int")
    return survey.best_only(view(spark, d, "fx_pred").withColumn("epoch", F.col("epoch").cast("int")), best, ["country", "epoch"]).select("row_id")


@query("PF15_displacement", "SELECT place_id FROM fx_place WHERE (rural = 0 AND std_wi * 1000 <= 2000 + 0) OR (rural = 1 AND std_wi * 1000 <= 5000 + 10000)")
def pf15(spark, d):
    df = view(spark, d, "fx_place").withColumn("far", F.col("std_wi") * 1000)
    return survey.in_displacement(df, {0: 2000.0, 1: 5000.0}, {0: 0.0, 1: 10000.0}, "rural", "far").select("place_id")


@query("PF17_covariate", "SELECT place_id, CAST(2021 - year AS DOUBLE) AS delta, CASE year WHEN 2016 THEN 1.5 WHEN 2019 THEN 2.5 END AS gdp FROM fx_place")
def pf17(spark, d):
    values = spark.createDataFrame([("gdp", 2016, 1.5), ("gdp", 2019, 2.5)], "timevar string, year int, value double")
    df = survey.economic_covariate(view(spark, d, "fx_place"), values, "gdp").withColumnRenamed("timevar", "gdp")
    return survey.economic_covariate(df, values, "deltatime").select("place_id", F.col("timevar").alias("delta"), "gdp")


@query("PF18_latitude_band", "SELECT place_id FROM fx_place WHERE lat > -0.5")
def pf18(spark, d):
    return view(spark, d, "fx_place").filter("lat > -0.5").select("place_id")


@query("PF19_active_users", "SELECT event_id, round(coalesce(users, (users_lower_bound + users_upper_bound) / 2, (mau_lower_bound + mau_upper_bound) / 2), 6) AS active_users FROM fx_answer")
def pf19(spark, d):
    a = view(spark, d, "fx_answer")
    return rounded(a.select("event_id", features.active_users(*[F.col(c) for c in ("users", "users_lower_bound", "users_upper_bound", "mau_lower_bound", "mau_upper_bound")]).alias("active_users")))


@query("JN1_surveyed_clusters", "SELECT place_id, year FROM fx_place p WHERE EXISTS (SELECT 1 FROM fx_household h WHERE h.hv001 = p.place_id AND h.year = p.year)")
def jn1(spark, d):
    h = view(spark, d, "fx_household").select(F.col("hv001").cast("long").alias("place_id"), "year")
    return survey.surveyed(view(spark, d, "fx_place"), h, ["place_id", "year"]).select("place_id", "year")


@query("JN2_scored_clusters", f"SELECT p.place_id, p.ccode, round(c.mean_iwi, 6) AS mean_iwi, c.counts FROM fx_place p JOIN {CLUSTERS} c ON p.place_id = c.hv001 AND p.year = c.year")
def jn2(spark, d):
    h = scored(spark, d).withColumn("place_id", F.col("hv001").cast("long"))
    return rounded(survey.scored_clusters(view(spark, d, "fx_place"), h, ["place_id", "year"]).select("place_id", "ccode", "mean_iwi", "counts"))


@query("JN3_left_joins", "SELECT p.place_id, m.n AS moves, a.n AS answers FROM fx_place p LEFT JOIN (SELECT start_node AS place_id, count(*) AS n FROM fx_move GROUP BY 1) m ON p.place_id = m.place_id LEFT JOIN (SELECT place_id, count(*) AS n FROM fx_answer GROUP BY 1) a ON p.place_id = a.place_id")
def jn3(spark, d):
    moves = view(spark, d, "fx_move").groupBy(F.col("start_node").alias("place_id")).agg(F.count(F.lit(1)).alias("moves"))
    answers = view(spark, d, "fx_answer").groupBy("place_id").agg(F.count(F.lit(1)).alias("answers"))
    return survey.left_joined(view(spark, d, "fx_place").select("place_id"), [moves, answers], ["place_id"])


@query("SRC15_wide_features", "SELECT p.place_id, p.rural, a.n AS answers FROM fx_place p LEFT JOIN (SELECT place_id, count(*) AS n FROM fx_answer GROUP BY 1) a ON p.place_id = a.place_id")
def src15(spark, d):
    answers = view(spark, d, "fx_answer").groupBy("place_id").agg(F.count(F.lit(1)).alias("answers"))
    return survey.left_joined(view(spark, d, "fx_place").select("place_id", "rural"), [answers], ["place_id"])


@query("JN4_samples_with_features", "SELECT p.place_id, p.mean_wi, e.label FROM fx_place p JOIN embeddings e ON p.place_id = e.vec_id")
def jn4(spark, d):
    from ..fixtures import table

    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("place_id"), "label")
    return view(spark, d, "fx_place").join(e, "place_id").select("place_id", "mean_wi", "label")


@query("JN5_override", "SELECT c.place_id, CASE WHEN c.osmid IS NOT NULL THEN p.std_wi ELSE c.std_wi END AS std_wi, CASE WHEN c.osmid IS NOT NULL THEN c.rural = p.rural END AS settlement_ok FROM (SELECT *, CASE WHEN place_id % 2 = 0 THEN place_id // 2 END AS osmid FROM fx_place) c LEFT JOIN fx_place p ON c.osmid = p.place_id")
def jn5(spark, d):
    c = view(spark, d, "fx_place").withColumn("OSMID", F.expr("CASE WHEN place_id % 2 = 0 THEN place_id div 2 END"))
    p = view(spark, d, "fx_place").select(F.col("place_id").alias("OSMID"), "rural", "std_wi")
    return survey.overridden(c, p, ["std_wi"]).select("place_id", "std_wi", "settlement_ok")


@query("JN6_semi_anti", "SELECT 'semi' AS kind, count(*) AS n FROM fx_household WHERE hv001 IN (SELECT place_id FROM fx_place WHERE rural = 1) UNION ALL SELECT 'anti', count(*) FROM fx_household WHERE hv001 NOT IN (SELECT place_id FROM fx_place WHERE rural = 1)")
def jn6(spark, d):
    h = view(spark, d, "fx_household").withColumn("place_id", F.col("hv001").cast("long"))
    rural = view(spark, d, "fx_place").filter("rural = 1")
    count = lambda df, k: df.agg(F.lit(k).alias("kind"), F.count(F.lit(1)).alias("n"))
    return count(survey.with_cluster(h, rural, "place_id"), "semi").union(count(survey.without(h, rural, ["place_id"]), "anti"))


@query("SC13_wealth_class", "SELECT place_id, CASE WHEN mean_wi < 0 THEN NULL WHEN mean_wi < 25 THEN 'poor' WHEN mean_wi < 50 THEN 'lower_middle' WHEN mean_wi < 75 THEN 'upper_middle' WHEN mean_wi < 101 THEN 'rich' END AS cat, CASE WHEN mean_wi < 0 THEN NULL WHEN mean_wi < 25 THEN 1 WHEN mean_wi < 50 THEN 2 WHEN mean_wi < 75 THEN 3 WHEN mean_wi < 101 THEN 4 END AS cat_id FROM fx_place")
def sc13(spark, d):
    return survey.categorised(view(spark, d, "fx_place")).select("place_id", F.col("mean_wi_cat").alias("cat"), F.col("mean_wi_cat_id").alias("cat_id"))


@query("SC14_n_bins", "SELECT place_id, CASE WHEN mean_wi >= 0 AND mean_wi < ceil(m / 7) * 7 + 1 THEN CAST(least(floor(mean_wi / ceil(m / 7)), 6) AS INT) END AS bin FROM fx_place, (SELECT max(mean_wi) AS m FROM fx_place)")
def sc14(spark, d):
    p = view(spark, d, "fx_place")
    most = p.agg(F.max("mean_wi").alias("m"))
    return p.crossJoin(F.broadcast(most)).select("place_id", wealth.n_bin(F.col("mean_wi"), F.col("m"), 7).alias("bin"))


@query("SC15_equal_width_bins", "SELECT place_id, CAST(greatest(0, least(9, ceil((mean_wi - lo) * 10 / (hi - lo)) - 1)) AS INT) AS bin FROM fx_place, (SELECT min(mean_wi) AS lo, max(mean_wi) AS hi FROM fx_place)")
def sc15(spark, d):
    p = view(spark, d, "fx_place")
    ends = p.agg(F.min("mean_wi").alias("lo"), F.max("mean_wi").alias("hi"))
    return p.crossJoin(F.broadcast(ends)).select("place_id", wealth.width_bin(F.col("mean_wi"), F.col("lo"), F.col("hi"), 10).alias("bin"))


@query("SC16_quantile_bins", "SELECT place_id, CASE WHEN mean_wi <= q[2] THEN 0 WHEN mean_wi <= q[3] THEN 1 WHEN mean_wi <= q[4] THEN 2 WHEN mean_wi <= q[5] THEN 3 ELSE 4 END AS bin FROM fx_place, (SELECT quantile_cont(mean_wi, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS q FROM fx_place)")
def sc16(spark, d):
    p = view(spark, d, "fx_place")
    edges = p.agg(F.percentile("mean_wi", [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]).alias("q"))
    return p.crossJoin(F.broadcast(edges)).select("place_id", wealth.edge_bin(F.col("mean_wi"), F.col("q"), 5).alias("bin"))


@query("SC18_gravity", "SELECT event_id, round(n_baseline / nullif(pow(length_km - 1, 2), 0), 6) AS pull FROM fx_move")
def sc18(spark, d):
    return rounded(view(spark, d, "fx_move").select("event_id", features.gravity(F.col("n_baseline"), F.col("length_km") - 1, 2.0).alias("pull")))


STARS = "CASE WHEN p <= 0.001 THEN '***' WHEN p <= 0.01 THEN '**' WHEN p <= 0.05 THEN '*' ELSE '' END"


@query("SC19_stars", f"SELECT place_id, {STARS} AS three, CASE WHEN p <= 0.0001 THEN '****' WHEN p <= 0.001 THEN '***' WHEN p <= 0.01 THEN '**' WHEN p <= 0.05 THEN '*' WHEN p > 0.05 THEN 'ns' ELSE '-' END AS five FROM (SELECT place_id, CASE WHEN place_id % 50 <> 0 THEN pow(10.0, -(place_id % 6)) * 0.6 END AS p FROM fx_place)")
def sc19(spark, d):
    p = F.when(F.col("place_id") % 50 != 0, F.pow(F.lit(10.0), -(F.col("place_id") % 6)) * 0.6)
    return view(spark, d, "fx_place").select("place_id", wealth.stars(p).alias("three"), wealth.significance(p).alias("five"))


@query("SC21_texts", "SELECT place_id, CAST(place_id AS VARCHAR) || ' (' || CAST(CAST(round(place_id * 100.0 / 3000) AS BIGINT) AS VARCHAR) || '%)' AS share, CAST(rural AS DOUBLE) + 0.5 AS value, year FROM fx_place")
def sc21(spark, d):
    p = view(spark, d, "fx_place")
    both = wealth.value_and_year(F.concat((F.col("rural") + 0.5).cast("string"), F.lit(" ("), F.col("year").cast("string"), F.lit(")")))
    return p.select("place_id", wealth.count_with_share(F.col("place_id"), F.lit(3000)).alias("share"), both["value"].alias("value"), both["year"].alias("year"))


@query("SC22_year_ranges", "SELECT place_id, CASE WHEN rural = 1 THEN '2018-19' ELSE '2016-18' END AS years, CASE rural WHEN 1 THEN 'rural' ELSE 'urban' END AS settlement FROM fx_place")
def sc22(spark, d):
    text = F.when(F.col("rural") == 1, "2018-2019").otherwise("2016-2018")
    return view(spark, d, "fx_place").select("place_id", wealth.short_years(text).alias("years"), wealth.settlement(F.col("rural")).alias("settlement"))


@query("SC9_line_ends", "SELECT place_id, 'POINT (' || CAST(round(lon, 5) AS VARCHAR) || ' ' || CAST(round(lat, 5) AS VARCHAR) || ')' AS start_point, 'POINT (' || CAST(round(lon + 1, 5) AS VARCHAR) || ' ' || CAST(round(lat, 5) AS VARCHAR) || ')' AS end_point FROM fx_place")
def sc9(spark, d):
    p = view(spark, d, "fx_place")
    line = wealth.repaired_line(F.when(F.col("place_id") % 2 == 0, F.lit("?")), F.col("lon"), F.col("lat"), F.col("lon") + 1, F.col("lat"))
    ends = wealth.wkt_ends(line)
    return p.select("place_id", ends["start"].alias("start_point"), ends["end"].alias("end_point"))


@query("SC10_time_parts", "SELECT event_id, CAST(year(date_time) AS INT) AS year, CAST(month(date_time) AS INT) AS month, strftime(date_time, '%H:%M') AS time, dayname(date_time) AS day FROM fx_move")
def sc10(spark, d):
    return wealth.time_parts(view(spark, d, "fx_move")).select("event_id", "year", "month", "time", "day")


@query("SC11_local_time", "SELECT event_id, CAST(hour(date_time + INTERVAL 2 HOUR) AS INT) AS hour, dayofweek(date_time + INTERVAL 2 HOUR) NOT IN (0, 6) AS workday FROM fx_move")
def sc11(spark, d):
    t = wealth.local_time(F.col("date_time").cast("timestamp"), "+02:00")
    return view(spark, d, "fx_move").select("event_id", t["hour"].alias("hour"), t["workday"].alias("workday"))


@query("SC27_zero_if_missing", "SELECT event_id, coalesce(n_baseline, 0) AS v FROM fx_move")
def sc27(spark, d):
    return view(spark, d, "fx_move").select("event_id", wealth.zero_if_missing(F.col("n_baseline")).alias("v"))


@query("SC29_normalised_difference", "SELECT row_id, round((true_mean - pred_mean) / nullif(true_mean + pred_mean, 0), 6) AS v FROM fx_pred")
def sc29(spark, d):
    return rounded(view(spark, d, "fx_pred").select("row_id", wealth.normalised_difference(F.col("true_mean"), F.col("pred_mean")).alias("v")))


@query("SC30_residuals", "SELECT row_id, round(true_mean - pred_mean, 6) AS residual_mean, round(true_std - pred_std, 6) AS residual_std FROM fx_pred")
def sc30(spark, d):
    return rounded(view(spark, d, "fx_pred").select("row_id", (F.col("true_mean") - F.col("pred_mean")).alias("residual_mean"), (F.col("true_std") - F.col("pred_std")).alias("residual_std")))


@query("SRC11_recency", "SELECT place_id, CASE place_id % 6 WHEN 0 THEN 'O-N' WHEN 1 THEN 'ON' WHEN 2 THEN 'O300' WHEN 3 THEN 'N300' WHEN 4 THEN 'O' ELSE 'N' END AS recency FROM fx_place")
def src11(spark, d):
    names = ["UG2016_2018_oldest_none", "UG2016_2018_all_none", "UG_2016_all300_none_x", "UG2018_all300_none", "UG_2016_all_none_x", "UG2018_all_none"]
    config = F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("place_id") % 6 + 1).cast("int"))
    return view(spark, d, "fx_place").select("place_id", wealth.recency(config).alias("recency"))


@query("SRC10_path_facts", "SELECT place_id, CASE place_id % 4 WHEN 0 THEN 'CNN' WHEN 1 THEN 'CB' WHEN 2 THEN 'CNN_a+CB_w' ELSE 'CNN+CB' END AS model, CASE WHEN place_id % 4 = 2 THEN 'yes' ELSE 'no' END AS augmented, CASE WHEN place_id % 4 = 2 THEN 'yes' ELSE 'no' END AS weighted, CAST(place_id % 5 AS INT) AS epoch FROM fx_place")
def src10(spark, d):
    kinds = ["cnn_noaug_x", "xgb-all/y", "cnn_offaug_z/xgb-all/weighted", "cnn_noaug_x/xgb-all"]
    kind = F.element_at(F.array(*[F.lit(n) for n in kinds]), (F.col("place_id") % 4 + 1).cast("int"))
    facts = wealth.run_facts(F.concat(F.lit("r/UG2016_all_none/epoch"), (F.col("place_id") % 5).cast("string"), F.lit("-rs7/"), kind, F.lit("/p.csv")))
    return view(spark, d, "fx_place").select("place_id", facts.alias("f")).select("place_id", "f.model", "f.augmented", "f.weighted", "f.epoch")


@query("ML8_model_names", "SELECT model, count(*) AS n FROM (SELECT CASE place_id % 8 WHEN 0 THEN 'CNN' WHEN 1 THEN 'CNN_a' WHEN 2 THEN 'CB' WHEN 3 THEN 'CB_w' WHEN 4 THEN 'CNN+CB' WHEN 5 THEN 'CNN+CB_w' WHEN 6 THEN 'CNN_a+CB' ELSE 'CNN_a+CB_w' END AS model FROM fx_place) GROUP BY model")
def ml8(spark, d):
    kinds = ["cnn_noaug_", "cnn_offaug_", "xgb-all", "xgb-all/weighted", "cnn_noaug_/xgb-all", "cnn_noaug_/xgb-all/weighted", "cnn_offaug_/xgb-all", "cnn_offaug_/xgb-all/weighted"]
    kind = F.element_at(F.array(*[F.lit(n) for n in kinds]), (F.col("place_id") % 8 + 1).cast("int"))
    return view(spark, d, "fx_place").select(wealth.run_facts(kind)["model"].alias("model")).groupBy("model").agg(F.count(F.lit(1)).alias("n"))


@query("SRC13_survey_prefix", "SELECT string_agg(s, '_' ORDER BY s) AS prefix FROM (SELECT DISTINCT ccode || CAST(year AS VARCHAR) AS s FROM fx_place)")
def src13(spark, d):
    return survey.survey_prefix(view(spark, d, "fx_place"), "ccode")


@query("SRC12_matching_years", "SELECT place_id FROM fx_place WHERE place_id % 3 = 1")
def src12(spark, d):
    names = F.element_at(F.array(F.lit("f_2016.csv"), F.lit("f_2016_2019.csv"), F.lit("f_2016_2018_2019.csv")), (F.col("place_id") % 3 + 1).cast("int"))
    return survey.matching_years(view(spark, d, "fx_place").withColumn("name", names), [2019, 2016]).select("place_id")


@query("SRC14_newest_years", "SELECT country, CASE r WHEN 2 THEN 2016 ELSE 2019 END AS survey_year, y AS value_year, v AS value FROM (SELECT ccode AS country, y, v, row_number() OVER (PARTITION BY ccode ORDER BY y DESC) AS r FROM (SELECT ccode, 2010 AS y, min(mean_wi) AS v FROM fx_place GROUP BY ccode UNION ALL SELECT ccode, 2012, CASE WHEN ccode <> 'C1' THEN avg(std_wi) END FROM fx_place GROUP BY ccode UNION ALL SELECT ccode, 2015, max(mean_wi) FROM fx_place GROUP BY ccode) WHERE v IS NOT NULL) WHERE r <= 2")
def src14(spark, d):
    wide = view(spark, d, "fx_place").groupBy(F.col("ccode").alias("Country Code")).agg(F.min("mean_wi").alias("2010"), F.when(F.first("ccode") != "C1", F.avg("std_wi")).alias("2012"), F.max("mean_wi").alias("2015"))
    return survey.newest_years(wide, [2016, 2019])


@query("WN3_oldest_newest", "SELECT place_id, CASE WHEN year = min(year) OVER (PARTITION BY ccode) THEN 'Oldest' ELSE 'Newest' END AS age FROM fx_place")
def wn3(spark, d):
    first = F.min("year").over(Window.partitionBy("ccode"))
    return view(spark, d, "fx_place").select("place_id", F.when(F.col("year") == first, "Oldest").otherwise("Newest").alias("age"))
