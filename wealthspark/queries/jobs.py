"""Samples, relocation, mobility, models, files, streams, whole jobs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixtures import table, view
from ..functions import geo
from ..operators import boosting, features, models, relocate, sampling, stats, tables
from ..operators.pyramid import box_sums
from ..plans import jobs
from ..sources import files
from ..sources.tables import cut, materialize, shared_folder
from ..streaming import answers
from .base import query, xy
from .spatial import meeting_sql, points, polygons, rounded
from .survey import BETAS, CLUSTERS, TIERS, cleaned

#: An order that both engines can compute, in place of the seeded hash.
SHUFFLE = "(place_id * 7919 + {0}) % 100003"


def shuffled(seed=0):
    return (F.col("place_id") * 7919 + seed) % 100003


def folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def place(spark, d):
    return view(spark, d, "fx_place")


@query("SO4_fixed_size", f"SELECT place_id FROM fx_place ORDER BY {SHUFFLE.format(5)}, place_id LIMIT 300")
def so4(spark, d):
    return sampling.fixed_size(place(spark, d), 300, "place_id", order=shuffled(5)).select("place_id")


CLASS = "CAST(trunc(mean_wi / 10) AS INT)"
STRATIFIED = f"""c AS (SELECT place_id, s.seed, {CLASS} AS ses, row_number() OVER (PARTITION BY s.seed, {CLASS} ORDER BY {SHUFFLE.format("s.seed")}, place_id) AS r, count(*) OVER (PARTITION BY s.seed, {CLASS}) AS nc, count(*) OVER (PARTITION BY s.seed) AS n FROM fx_place, (SELECT unnest([1, 2]) AS seed) s),
t AS (SELECT *, CASE WHEN r > floor(round(n * 0.75) * nc / n) THEN 1 ELSE 0 END AS is_test FROM c), f AS (SELECT *, CASE WHEN is_test = 0 THEN (row_number() OVER (PARTITION BY seed, ses, is_test ORDER BY {SHUFFLE.format("seed")}, place_id) - 1) % 3 + 1 END AS fold FROM t)"""


def split(spark, d):
    p = sampling.seeded(place(spark, d).withColumn("ses", (F.col("mean_wi") / 10).cast("int")), [1, 2])
    s = sampling.stratified(p, "ses", "place_id", 0.75, ("seed",), shuffled(F.col("seed")))
    return sampling.folds(s, "ses", "place_id", 4, ("seed",), shuffled(F.col("seed")))


@query("SMP1_stratified", f"WITH {STRATIFIED} SELECT place_id, seed, is_test FROM f")
def smp1(spark, d):
    return split(spark, d).select("place_id", "seed", "is_test")


@query("SMP2_folds", f"WITH {STRATIFIED} SELECT place_id, seed, CASE WHEN is_test = 1 THEN 1 END AS test, " + ", ".join(f"CASE WHEN is_test = 1 THEN NULL WHEN fold = {j} THEN 'val' ELSE 'train' END AS fold{j}" for j in (1, 2, 3)) + " FROM f")
def smp2(spark, d):
    return sampling.roles(split(spark, d), "place_id", 4, ("seed",))


@query("SMP4_seeds", f"WITH {STRATIFIED} SELECT seed, CAST(fold AS INT) AS fold, count(*) AS n FROM f GROUP BY seed, fold")
def smp4(spark, d):
    return split(spark, d).groupBy("seed", "fold").agg(F.count(F.lit(1)).alias("n"))


@query("PF16_run_and_fold", f"WITH {STRATIFIED} SELECT place_id, CASE WHEN is_test = 1 THEN 'test' WHEN fold = 2 THEN 'val' ELSE 'train' END AS role FROM f WHERE seed = 1")
def pf16(spark, d):
    return sampling.long_roles(split(spark, d), "place_id", 4, ("seed",)).filter("seed = 1 AND fold = 2").select("place_id", "role")


@query("SMP3_split_by_year", "SELECT place_id, CASE WHEN year = 2016 THEN 0 ELSE 1 END AS oldest, CASE WHEN year = 2019 THEN 0 ELSE 1 END AS balance FROM fx_place")
def smp3(spark, d):
    a = sampling.split_by_year(place(spark, d), "oldest").select("place_id", F.col("is_test").alias("oldest"))
    return a.join(sampling.split_by_year(place(spark, d), "balance").select("place_id", F.col("is_test").alias("balance")), "place_id")


def survey_clusters(spark, d) -> DataFrame:
    return points(spark, d, "fx_place").select(F.col("place_id").alias("cluster_id"), "year", "rural", "mean_wi", "std_wi", "x", "y")


def towns(spark, d) -> DataFrame:
    return points(spark, d, "fx_poi").select(F.col("poi_id").alias("OSMID"), (F.col("poi_id") % 3 != 0).cast("int").alias("rural"), "x", "y")


@query("REL0_unmoved", "SELECT place_id AS cluster_id, CAST(NULL AS BIGINT) AS OSMID, 0.0 AS pplace_cluster_distance FROM fx_place")
def rel0(spark, d):
    return relocate.relocate(survey_clusters(spark, d), towns(spark, d), "none").select("cluster_id", "OSMID", "pplace_cluster_distance")


@query(
    "WN4_candidates",
    f"SELECT p.place_id AS cluster_id, t.poi_id AS OSMID, round(sqrt((p.x - t.x) ** 2 + (p.y - t.y) ** 2), 3) AS distance FROM {xy('fx_place')} p JOIN {xy('fx_poi')} t ON p.rural = 0 AND t.poi_id % 3 = 0 AND t.x BETWEEN p.x - 1000 AND p.x + 1000 AND t.y BETWEEN p.y - 1000 AND p.y + 1000",
)
def wn4(spark, d):
    return rounded(relocate.candidates(survey_clusters(spark, d), towns(spark, d), 0), 3)


def greedy(name: str, candidates: str) -> str:
    """Named subqueries that give each cluster of ``candidates`` (cluster_id, OSMID, distance) its nearest place that is still free, one
    cluster after another in the order (number of candidates, id)."""
    return f"""{name}_c AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY cluster_id) AS n FROM ({candidates})),
{name}_g AS MATERIALIZED (SELECT row_number() OVER (ORDER BY n, cluster_id) AS k, * FROM (SELECT cluster_id, n, list(struct_pack(d := distance, osm := OSMID) ORDER BY distance, OSMID) AS options FROM {name}_c GROUP BY cluster_id, n)),
{name}_r AS (SELECT CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS taken, CAST(NULL AS BIGINT) AS cluster_id, CAST(NULL AS BIGINT) AS OSMID, CAST(NULL AS DOUBLE) AS distance UNION ALL
SELECT k, CASE WHEN pick IS NULL THEN taken ELSE list_append(taken, pick.osm) END, cluster_id, pick.osm, pick.d FROM (SELECT g.k, g.cluster_id, r.taken, list_filter(g.options, lambda x: NOT list_contains(r.taken, x.osm))[1] AS pick FROM {name}_r r JOIN {name}_g g ON g.k = r.k + 1)),
{name} AS MATERIALIZED (SELECT cluster_id, OSMID, distance FROM {name}_r WHERE OSMID IS NOT NULL)"""


def in_reach(rural: int, year: int | None = None, taken: str | None = None) -> str:
    half = {0: 1000, 1: 7500}[rural]
    more = (f" AND p.year = {year}" if year else "") + (f" AND t.poi_id NOT IN (SELECT OSMID FROM {taken})" if taken else "")
    return f"SELECT CAST(p.place_id AS BIGINT) AS cluster_id, CAST(t.poi_id AS BIGINT) AS OSMID, sqrt((p.x - t.x) ** 2 + (p.y - t.y) ** 2) AS distance FROM {xy('fx_place')} p JOIN {xy('fx_poi')} t ON p.rural = {rural} AND CAST(t.poi_id % 3 <> 0 AS INT) = {rural} AND t.x BETWEEN p.x - {half} AND p.x + {half} AND t.y BETWEEN p.y - {half} AND p.y + {half}{more}"


RURAL = greedy("r19", in_reach(1, 2019)) + ",\n" + greedy("r16", in_reach(1, 2016, "r19"))
URBAN = greedy("u19", in_reach(0, 2019)) + ",\n" + greedy("u16", in_reach(0, 2016, "u19"))
MOVED = "SELECT p.place_id AS cluster_id, m.OSMID, round(coalesce(m.distance, 0), 3) AS pplace_cluster_distance FROM fx_place p LEFT JOIN ({}) m ON p.place_id = m.cluster_id"


@query("REL2_options", f"WITH RECURSIVE {RURAL}\n" + MOVED.format("SELECT * FROM r19 UNION ALL SELECT * FROM r16"))
def rel2(spark, d):
    return rounded(relocate.relocate(survey_clusters(spark, d), towns(spark, d), "rc").select("cluster_id", "OSMID", "pplace_cluster_distance"), 3)


@query("JN27_assignment", f"WITH RECURSIVE {greedy('j', in_reach(1))} SELECT cluster_id, OSMID, round(distance, 3) AS distance FROM j")
def jn27(spark, d):
    return rounded(relocate.assign_near(survey_clusters(spark, d).filter("rural = 1"), towns(spark, d)), 3)


@query("REL1_relocated", f"WITH RECURSIVE {RURAL},\n{URBAN}\n" + MOVED.format("SELECT * FROM r19 UNION ALL SELECT * FROM r16 UNION ALL SELECT * FROM u19 UNION ALL SELECT * FROM u16"))
def rel1(spark, d):
    return rounded(relocate.relocate(survey_clusters(spark, d), towns(spark, d), "ruc").select("cluster_id", "OSMID", "pplace_cluster_distance"), 3)


ALLOWED = """b AS (SELECT place_id, rural, std_wi * 1000 AS d, std_wi * 1000 > CASE rural WHEN 0 THEN 2000 ELSE 5000 END AS beyond FROM fx_place),
k AS (SELECT place_id, row_number() OVER (PARTITION BY rural ORDER BY (place_id * 7919 + 0) % 100003, place_id) AS k FROM b WHERE beyond), n AS (SELECT rural, round(count(*) * CASE rural WHEN 0 THEN 0.0 ELSE 0.01 END) AS may FROM fx_place GROUP BY rural),
allowed AS (SELECT b.place_id, b.rural, CASE WHEN k.k > n.may THEN 0.0 ELSE b.d END AS distance FROM b JOIN n ON b.rural = n.rural LEFT JOIN k ON b.place_id = k.place_id)"""


def allowed(spark, d) -> DataFrame:
    p = place(spark, d).select("place_id", "rural", (F.col("std_wi") * 1000).alias("distance"))
    return relocate.within_allowance(p, "place_id", "rural", "distance", order=shuffled())


@query("REL3_allowance", f"WITH {ALLOWED} SELECT place_id, round(distance, 6) AS distance FROM allowed")
def rel3(spark, d):
    return rounded(allowed(spark, d).select("place_id", "distance"))


@query("SO5_random_revert", f"WITH {ALLOWED} SELECT place_id, rural, round(distance, 6) AS distance FROM allowed WHERE distance > CASE rural WHEN 0 THEN 2000 ELSE 5000 END")
def so5(spark, d):
    return rounded(allowed(spark, d).filter(F.col("distance") > F.when(F.col("rural") == 0, 2000).otherwise(5000)))


@query("REL4_grouped", "SELECT osmid, round(avg(mean_wi), 6) AS mean_wi, round(avg(std_wi), 6) AS std_wi, count(*) AS n FROM (SELECT *, CASE WHEN place_id % 5 <> 0 THEN place_id % 50 END AS osmid FROM fx_place) GROUP BY osmid")
def rel4(spark, d):
    return rounded(relocate.grouped(place(spark, d).withColumn("osmid", F.expr("CASE WHEN place_id % 5 <> 0 THEN place_id % 50 END")), ["osmid"]))


@query("REL5_distance_distribution", f"WITH {ALLOWED} SELECT rural, CAST(least(9, floor(distance / 1000)) AS INT) AS bin, count(*) AS n, round(avg(distance), 6) AS mean FROM allowed GROUP BY 1, 2")
def rel5(spark, d):
    return rounded(relocate.distance_distribution(allowed(spark, d), distance="distance"))


EDGES = """s AS (SELECT start_node, end_node, dayname(date_time) AS d, strftime(date_time, '%H:%M') AS t, coalesce(n_baseline, 1) AS v, length_km FROM fx_move),
c AS (SELECT start_node, end_node, d, t, v, count(*) AS n FROM s GROUP BY ALL), m AS (SELECT start_node, end_node, d, t, arg_min(v, (-n, v)) AS mode, arg_min(CASE WHEN v > 1 THEN v END, (-n, v)) FILTER (v > 1) AS above FROM c GROUP BY ALL),
l AS (SELECT start_node, end_node, d, t, avg(length_km) AS len FROM s GROUP BY ALL), e AS (SELECT m.start_node AS source, m.end_node AS target, sum(CASE WHEN mode = 1 AND above IS NOT NULL THEN above ELSE mode END) AS weight, avg(len) AS distance FROM m JOIN l ON m.start_node = l.start_node AND m.end_node = l.end_node AND m.d = l.d AND m.t = l.t GROUP BY ALL)"""


@query("AG5_edge_weights", f"WITH {EDGES} SELECT source, target, round(weight, 6) AS weight, round(distance, 6) AS distance FROM e")
def ag5(spark, d):
    return rounded(features.edge_weights(view(spark, d, "fx_move")))


@query("GX7_mobility_graph", f"WITH {EDGES} SELECT dense_rank() OVER (ORDER BY source) - 1 AS s, count(*) AS n, round(sum(weight), 6) AS weight FROM e GROUP BY source")
def gx7(spark, d):
    e = features.edge_weights(view(spark, d, "fx_move"))
    n = features.nodes(e)
    return rounded(e.join(n, F.col("source") == F.col("node")).groupBy(F.col("nodeid").alias("s")).agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("weight")))


@query("AG6_movement_summary", """SELECT g, n, within, across, missing, given, low, high, total, locations FROM (SELECT event_id % 3 AS g, count(*) AS n, count(CASE WHEN start_node = end_node THEN 1 END) AS within, count(CASE WHEN start_node <> end_node THEN 1 END) AS across, count(CASE WHEN n_baseline IS NULL THEN 1 END) AS missing, count(n_baseline) AS given, min(n_baseline) AS low, max(n_baseline) AS high, sum(n_baseline) AS total FROM fx_move GROUP BY 1)
JOIN (SELECT g, count(DISTINCT node) AS locations FROM (SELECT event_id % 3 AS g, start_node AS node FROM fx_move UNION ALL SELECT event_id % 3, end_node FROM fx_move) GROUP BY g) USING (g)""")
def ag6(spark, d):
    return tables.movement_summary(view(spark, d, "fx_move").withColumn("g", F.col("event_id") % 3), ["g"])


@query("AG7_degrees", f"WITH {EDGES}, n AS (SELECT source AS node FROM e UNION SELECT target FROM e), o AS (SELECT source AS node, count(*) AS k, sum(weight) AS f, sum(distance) AS d FROM e GROUP BY source), i AS (SELECT target AS node, count(*) AS k, sum(weight) AS f, sum(distance) AS d FROM e GROUP BY target) SELECT n.node, coalesce(o.k, 0) AS out_degree, coalesce(i.k, 0) AS in_degree, round(coalesce(o.f, 0), 6) AS out_flow, round(coalesce(i.f, 0), 6) AS in_flow, round(coalesce(o.d, 0) / (SELECT count(*) FROM n), 6) AS out_distance, round(coalesce(i.d, 0) / (SELECT count(*) FROM n), 6) AS in_distance FROM n LEFT JOIN o ON n.node = o.node LEFT JOIN i ON n.node = i.node")
def ag7(spark, d):
    return rounded(features.degrees(features.edge_weights(view(spark, d, "fx_move"))))


@query("GX9_pagerank", """WITH RECURSIVE e AS MATERIALIZED (SELECT DISTINCT start_node AS s, end_node AS t FROM fx_move), o AS (SELECT s, count(*) AS k FROM e GROUP BY s), n AS MATERIALIZED (SELECT s AS node FROM e UNION SELECT t FROM e),
r AS (SELECT 0 AS i, list(struct_pack(node := node, x := 1.0 / (SELECT count(*) FROM n))) AS v FROM n UNION ALL
SELECT i + 1, (SELECT list(struct_pack(node := n.node, x := 0.15 / (SELECT count(*) FROM n) + 0.85 * coalesce(g.x, 0))) FROM n LEFT JOIN (SELECT e.t, sum(u.p.x / o.k) AS x FROM (SELECT unnest(r.v) AS p) u JOIN e ON e.s = u.p.node JOIN o ON o.s = e.s GROUP BY e.t) g ON n.node = g.t) FROM r WHERE i < 60)
SELECT p.node AS node, round(p.x / (SELECT sum(q.x) FROM (SELECT unnest(v) AS q FROM r WHERE i = 60)), 6) AS rank FROM (SELECT unnest(v) AS p FROM r WHERE i = 60)""")
def gx9(spark, d):
    edges = view(spark, d, "fx_move").select(F.col("start_node").alias("source"), F.col("end_node").alias("target")).distinct().withColumns({"weight": F.lit(1.0), "distance": F.lit(1.0)})
    return rounded(features.pagerank(edges, weighted=False))


def ranks(name: str, weight: str) -> str:
    """Named subqueries with the page rank (node, x) of each node of ``g`` (s, t, w), by 60 rounds."""
    return f"""{name}_o AS MATERIALIZED (SELECT s, sum({weight}) AS total FROM g GROUP BY s),
{name}_r AS (SELECT 0 AS i, list(struct_pack(node := node, x := 1.0 / (SELECT count(*) FROM n))) AS v FROM n UNION ALL
SELECT i + 1, (SELECT list(struct_pack(node := n.node, x := 0.15 / (SELECT count(*) FROM n) + 0.85 * coalesce(h.x, 0))) FROM n LEFT JOIN (SELECT g.t, sum(u.p.x * {weight} / o.total) AS x FROM (SELECT unnest({name}_r.v) AS p) u JOIN g ON g.s = u.p.node JOIN {name}_o o ON o.s = g.s GROUP BY g.t) h ON n.node = h.t) FROM {name}_r WHERE i < 60),
{name}_l AS (SELECT unnest(v) AS p FROM {name}_r WHERE i = 60), {name} AS (SELECT p.node AS node, p.x / (SELECT sum(q.p.x) FROM {name}_l q) AS x FROM {name}_l)"""


SIX = ["out_degree", "in_degree", "out_flow", "in_flow", "pagerank", "pagerank_unweighted"]
MEASURES = f"""{EDGES}, g AS MATERIALIZED (SELECT source AS s, target AS t, weight AS w, distance AS d FROM e), n AS MATERIALIZED (SELECT s AS node FROM g UNION SELECT t FROM g), {ranks("pw", "g.w")}, {ranks("pu", "1.0")},
o AS (SELECT s, count(*) AS k, sum(w) AS f, sum(d) AS d FROM g GROUP BY s), i AS (SELECT t, count(*) AS k, sum(w) AS f, sum(d) AS d FROM g GROUP BY t),
y AS (SELECT n.node AS node, coalesce(o.k, 0) AS out_degree, coalesce(i.k, 0) AS in_degree, coalesce(o.f, 0) AS out_flow, coalesce(i.f, 0) AS in_flow, pw.x AS pagerank, pu.x AS pagerank_unweighted, coalesce(o.d, 0) / (SELECT count(*) FROM n) AS out_distance, coalesce(i.d, 0) / (SELECT count(*) FROM n) AS in_distance
FROM n LEFT JOIN o ON n.node = o.s LEFT JOIN i ON n.node = i.t JOIN pw ON n.node = pw.node JOIN pu ON n.node = pu.node),
b AS (SELECT place_id, arg_min(node, (d, node)) AS node, min(d) AS distance FROM (SELECT p.place_id, q.place_id AS node, sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2) AS d FROM {xy("fx_place")} p CROSS JOIN {xy("fx_place")} q WHERE q.place_id IN (SELECT node FROM n)) GROUP BY place_id)"""
TERMS = ", ".join(f"round({c} / nullif(pow(distance, {e}), 0), 6) AS FBMV_{c}_{label}" for c in SIX for label, e in (("d", 1.0), ("d15", 1.5), ("d2", 2.0)))


@query("GX8_mobility_features", f"WITH RECURSIVE {MEASURES} SELECT place_id, " + ", ".join(f"round({c}, 6) AS FBMV_{c}" for c in [*SIX, "out_distance", "in_distance", "distance"]) + f", {TERMS} FROM b LEFT JOIN y USING (node)")
def gx8(spark, d):
    edges = features.edge_weights(view(spark, d, "fx_move"))
    spots = points(spark, d, "fx_place").select(F.col("place_id").alias("node"), "x", "y").join(features.nodes(edges).select("node"), "node", "left_semi")
    return rounded(features.mobility(points(spark, d, "fx_place"), edges, spots))


ANSWERS = "(SELECT place_id, profile, avg(coalesce(users, (users_lower_bound + users_upper_bound) / 2, (mau_lower_bound + mau_upper_bound) / 2)) AS active_users, count(*) AS answers FROM fx_answer GROUP BY place_id, profile)"
PROFILES = ["click", "view", "purchase", "error"]


@query("AG44_audience", f"SELECT place_id, profile, round(active_users, 6) AS active_users FROM {ANSWERS}")
def ag44(spark, d):
    return rounded(features.audience(view(spark, d, "fx_answer")))


@query("GX10_audience_features", "SELECT p.place_id, " + ", ".join(f"round(max(CASE WHEN a.profile = '{v}' THEN active_users END), 6) AS FBM_{v}" for v in PROFILES) + f" FROM fx_place p LEFT JOIN {ANSWERS} a ON p.place_id = a.place_id GROUP BY p.place_id")
def gx10(spark, d):
    return rounded(features.audience_features(place(spark, d), view(spark, d, "fx_answer"), PROFILES))


@query("ST1_served_answers", f"SELECT place_id, profile, round(active_users, 9) AS active_users, answers FROM {ANSWERS}")
def st1(spark, d):
    """The stream is stopped between two files; the second brings answers again that the first had."""
    path, state, to = folder(spark, "answers"), folder(spark, "state"), folder(spark, "served")
    every = view(spark, d, "fx_answer").drop("ts")
    for part in (F.col("event_id") % 3 < 2, F.col("event_id") % 3 > 0):
        files.append_json(every.filter(part).repartition(3), path)
        answers.serve(answers.arriving(spark, path), to, state, once=True).awaitTermination()
    return rounded(answers.table(spark, to).select("place_id", "profile", "active_users", "answers"), 9)


@query("AG46_distance_or_zero", f"SELECT p.place_id, round(coalesce(min(sqrt((p.x - t.x) ** 2 + (p.y - t.y) ** 2)), 0), 3) AS distance FROM {xy('fx_place')} p LEFT JOIN {xy('fx_poi')} t ON t.x BETWEEN p.x - 500 AND p.x + 500 AND t.y BETWEEN p.y - 500 AND p.y + 500 GROUP BY p.place_id")
def ag46(spark, d):
    from ..operators import spatial

    made = spatial.box_aggregate(points(spark, d, "fx_place"), points(spark, d, "fx_poi"), "place_id", {"1km": 500.0}, lambda n, inside: {"distance": F.min(inside(F.col("distance")))})
    return rounded(made.fillna(0.0), 3)


@query(
    "AG42_zonal_pixels",
    f"""WITH r AS (SELECT p.place_id, t.population AS v FROM {xy('fx_place')} p LEFT JOIN {xy('fx_tile')} t ON t.x BETWEEN p.x - 2000 AND p.x + 2000 AND t.y BETWEEN p.y - 2000 AND p.y + 2000),
    e AS (SELECT place_id, quantile_cont(v, 0.33) AS p33, quantile_cont(v, 0.66) AS p66 FROM r GROUP BY place_id)
    SELECT r.place_id, count(v) AS count, round(sum(v), 6) AS sum, round(min(v), 9) AS min, round(max(v), 9) AS max, round(avg(v), 9) AS mean, round(median(v), 9) AS median, round(avg(CASE WHEN v <= p33 THEN v END), 9) AS mean_low,
    round(avg(CASE WHEN v >= p66 THEN v END), 9) AS mean_high, round(count(CASE WHEN v >= 10 THEN 1 END) / CAST(nullif(count(v), 0) AS DOUBLE), 9) AS share_lit, round(sum(CASE WHEN v >= 10 THEN v ELSE 0 END) / nullif(sum(v), 0), 9) AS share_lit_sum
    FROM r JOIN e ON r.place_id = e.place_id GROUP BY r.place_id""",
)
def ag42(spark, d):
    tiles = points(spark, d, "fx_tile").select("x", "y", F.col("population").alias("avg_rad"), F.lit(1.0).alias("area"))
    made = features.night_lights(points(spark, d, "fx_place"), tiles, halves={"2km": 2000.0})
    names = ("count", "sum", "min", "max", "mean", "median", "mean_low", "mean_high", "share_lit", "share_lit_sum")
    return rounded(made.select("place_id", *[F.col(f"NTLL_{n}_2km").alias(n) for n in names]), 9).withColumn("sum", F.round("sum", 6))


@query("AG3_box_counts", f"SELECT p.place_id, round(coalesce(sum(t.population), 0), 6) AS total, count(t.tile_id) AS n FROM {xy('fx_place')} p LEFT JOIN {xy('fx_tile')} t ON t.x BETWEEN p.x - 300 AND p.x + 300 AND t.y BETWEEN p.y - 300 AND p.y + 300 GROUP BY p.place_id")
def ag3(spark, d):
    made = box_sums(points(spark, d, "fx_place"), points(spark, d, "fx_tile"), "place_id", {"b": 300.0}, {"total": F.col("population"), "n": F.lit(1)})
    return rounded(made.withColumnsRenamed({"total_in_b": "total", "n_in_b": "n"}))


@query("SC3_distance", f"SELECT p.place_id, round(sqrt((p.x - t.x) ** 2 + (p.y - t.y) ** 2), 3) AS distance FROM {xy('fx_place')} p JOIN {xy('fx_tile')} t ON p.place_id = t.tile_id")
def sc3(spark, d):
    a, b = points(spark, d, "fx_place").alias("a"), points(spark, d, "fx_tile").alias("b")
    return a.join(b, F.col("place_id") == F.col("tile_id")).select("place_id", F.round(geo.distance(F.col("a.x"), F.col("a.y"), F.col("b.x"), F.col("b.y")), 3).alias("distance"))


ENDS = ("lon1", "lat1", "lon2", "lat2")
NEXT = """SELECT a.seg_id, a.lon1 AS ax1, a.lat1 AS ay1, a.lon2 AS ax2, a.lat2 AS ay2, b.lon1 AS bx1, b.lat1 AS by1, b.lon2 AS bx2, b.lat2 AS by2 FROM fx_road a JOIN fx_road b ON b.seg_id BETWEEN a.seg_id + 1 AND a.seg_id + 50"""


@query("SC7_segments_cross", f"WITH {meeting_sql(NEXT, 'seg_id').replace('0.001', '1e-9')} SELECT seg_id, count(pt) AS meets, round(sum(pt.x), 6) AS x, round(sum(pt.y), 6) AS y FROM met GROUP BY seg_id")
def sc7(spark, d):
    roads = view(spark, d, "fx_road")
    a, b = (roads.select(F.col("seg_id").alias(n), *[F.col(c).alias(f"{t}_{c}") for c in ENDS]) for t, n in (("a", "seg_id"), ("b", "other")))
    # a segment meets those of its block of 50 and of the next one: two rows to deal, not one for each of the 50 after it
    block = lambda n: F.floor(F.col(n) / 50).cast("long")
    a, b = a.withColumn("block", F.explode(F.array(block("seg_id"), block("seg_id") + 1))), b.withColumn("block", block("other"))
    after = (a["block"] == b["block"]) & b["other"].between(a["seg_id"] + 1, a["seg_id"] + 50)
    pairs = a.join(b, after).drop("block")
    for v in ("lon", "lat"):  # boxes that lie apart: nothing in common
        for t, u in ("ab", "ba"):
            pairs = pairs.filter(F.greatest(f"{t}_{v}1", f"{t}_{v}2") >= F.least(f"{u}_{v}1", f"{u}_{v}2") - 4e-9)
    met = geo.met(pairs, *[tuple(f"{t}_{c}" for c in ENDS) for t in "ab"], snap=1e-9)
    found = met.groupBy("seg_id").agg(F.count("met").alias("meets"), F.sum("met.x").alias("x"), F.sum("met.y").alias("y"))
    some = a.join(b, after, "left_semi").select("seg_id").distinct()  # also those that meet none
    return rounded(some.join(found, "seg_id", "left").fillna(0, ["meets"]))


# files


@query("SRC1_csv", "SELECT place_id, ccode, year FROM fx_place")
def src1(spark, d):
    path = folder(spark, "csv")
    p = place(spark, d).select(F.col("place_id").alias(" "), "place_id", "ccode", "year")
    files.write_csv(p.toDF("Unnamed: 0", "place_id", "ccode", "year"), path)
    return files.read_csv(spark, path, "place_id long, ccode string, year int")


@query("SRC2_csv_sink", "SELECT ccode, count(*) AS n FROM fx_place GROUP BY ccode")
def src2(spark, d):
    path = folder(spark, "csv")
    files.write_csv(place(spark, d).groupBy("ccode").agg(F.count(F.lit(1)).alias("n")), path)
    return files.read_csv(spark, path, "ccode string, n long", index=False)


@query("SRC3_geo_csv", "SELECT place_id, round(6378137.0 * radians(lon), 3) AS x, round(6378137.0 * ln(tan(pi() / 4 + radians(lat) / 2)), 3) AS y FROM fx_place")
def src3(spark, d):
    path = folder(spark, "csv")
    files.write_csv(place(spark, d).select("place_id", "lon", "lat"), path)
    return rounded(files.read_geo_csv(spark, path, "place_id long, lon double, lat double", index=False).select("place_id", "x", "y"), 3)


@query("SRC5_gzip_csv", "SELECT cell_id, lon FROM fx_cell")
def src5(spark, d):
    path = folder(spark, "gz")
    view(spark, d, "fx_cell").select("cell_id", "lon").coalesce(1).write.option("header", True).option("compression", "gzip").csv(path)
    return files.read_gzip_csv(spark, path, "cell_id long, lon double", 4)


@query("SRC6_by_country", "SELECT ccode, count(*) AS n FROM fx_place GROUP BY ccode")
def src6(spark, d):
    path = folder(spark, "parts")
    files.write_parquet(place(spark, d), path, "ccode")
    return spark.read.parquet(path).groupBy("ccode").agg(F.count(F.lit(1)).alias("n"))


@query("SRC7_json_lines", "SELECT event_id, profile FROM fx_answer UNION ALL SELECT event_id, profile FROM fx_answer WHERE event_id % 2 = 0")
def src7(spark, d):
    path = folder(spark, "json")
    a = view(spark, d, "fx_answer").select("event_id", "profile")
    files.append_json(a, path)
    files.append_json(a.filter("event_id % 2 = 0"), path)
    return files.read_json(spark, path, "event_id long, profile string")


@query("SRC16_vectors_by_id", "SELECT vec_id, label, len(embedding) AS width, round(CAST(embedding[1] AS DOUBLE), 6) AS first, round(list_sum(list_transform(list_transform(embedding, lambda e: CAST(e AS DOUBLE)), lambda e, i: e * i)), 4) AS by_place FROM embeddings")
def src16(spark, d):
    e = F.transform("embedding", lambda v: v.cast("double"))
    by_place = F.aggregate(F.transform(e, lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, v: a + v)
    return table(spark, d, "embeddings").select("vec_id", "label", F.size("embedding").cast("long").alias("width"), F.round(e[0], 6).alias("first"), F.round(by_place, 4).alias("by_place"))


@query("SRC17_materialized", "SELECT ccode, count(*) AS n FROM fx_place GROUP BY ccode")
def src17(spark, d):
    path = folder(spark, "once")
    build = lambda: place(spark, d).groupBy("ccode").agg(F.count(F.lit(1)).alias("n"))
    materialize(spark, path, build)
    return materialize(spark, path, lambda: spark.range(0).toDF("never"))


@query("SRC9_polygons", "SELECT name, round(x0, 6) AS x0, round(y0 + w, 6) AS y1 FROM fx_polygon")
def src9(spark, d):
    path = folder(spark, "geojson")
    ring = F.transform(F.col("rings")[0], lambda p: F.array(p["lon"], p["lat"]))
    feature = F.struct(F.struct(F.col("name").alias("ADMIN")).alias("properties"), F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"))
    polygons(spark, d).agg(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.collect_list(feature).alias("features"))).alias("value")).coalesce(1).write.text(path)  # 25 areas
    return rounded(files.read_polygons(spark, path).select("name", "x0", "y1"))


@query("SRC8_tiers", "SELECT DISTINCT 'hv201' AS variable, 'N' || CAST(s_nationkey AS VARCHAR) AS country, CAST(2016 + s_suppkey % 3 AS INT) AS year, CASE WHEN s_suppkey % 2 = 0 THEN 'low' ELSE 'high' END AS tier, CAST(s_suppkey % 40 AS INT) AS code FROM supplier")
def src8(spark, d):
    path, key = folder(spark, "tiers"), F.col("s_suppkey")
    tier = F.when(key % 2 == 0, "low").otherwise("high").alias("tier")
    codes = table(spark, d, "supplier").groupBy(F.concat(F.lit("N"), F.col("s_nationkey").cast("string")).alias("country"), (2016 + key % 3).cast("string").alias("year"), tier).agg(F.collect_set((key % 40).cast("int")).alias("codes"))
    nested = lambda df, by, name, value, to: df.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct(name, value))).alias(to))
    years = nested(nested(codes, ["country", "year"], "tier", "codes", "tiers"), ["country"], "year", "tiers", "years")
    nested(years, [], "country", "years", "all").select(F.to_json("all").alias("value")).coalesce(1).write.text(path)  # as large as the dictionary
    return files.read_tiers(spark, path, "hv201")


# models


def learned(spark, d) -> DataFrame:
    """Places with a few features, a vector, weights and folds, written once: fits read them again and again. Features are made for the places that have a vector."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("place_id"), "embedding")
    p = points(spark, d, "fx_place").join(e, "place_id", "left_semi")
    f = features.population(p, points(spark, d, "fx_tile"))
    p = p.withColumn("fold", (F.col("place_id") % 3).cast("int")).withColumnRenamed("rural", "cluster_rural")
    return cut(p.join(f.join(e, "place_id"), "place_id"))


NAMES = ["population_closest_tile", "population_in_2km", "population_in_5km"]
#: Trees and their depth in the fitted models of these queries.
FITTED = {"maxIter": 10, "maxDepth": 5}


@query("FE2_training_table", "WITH c AS (SELECT place_id, mean_wi, CAST(trunc(mean_wi * 10 / 100) AS INT) AS s FROM fx_place), n AS (SELECT s, count(*) AS n FROM c GROUP BY s), f AS (SELECT p.place_id, " + ", ".join(f"coalesce(max(CASE WHEN a.profile = '{v}' THEN active_users END), 0) AS {v}" for v in PROFILES) + f" FROM fx_place p LEFT JOIN {ANSWERS} a ON p.place_id = a.place_id GROUP BY p.place_id) SELECT c.place_id, round(mean_wi, 6) AS mean_wi, " + ", ".join(f'round("{v}", 6) AS {v}' for v in PROFILES) + ", round(1.0 / n, 9) AS weight FROM c JOIN n ON c.s = n.s JOIN f ON c.place_id = f.place_id")
def fe2(spark, d):
    from pyspark.ml.functions import vector_to_array

    samples = place(spark, d).select("place_id", "mean_wi", F.col("rural").alias("cluster_rural"))
    names = [f"FBM_{v}" for v in PROFILES]
    t = models.training_table(samples, features.audience_features(place(spark, d), view(spark, d, "fx_answer"), PROFILES), ["place_id"], names, "wINS")
    f = vector_to_array("features")
    return rounded(t.select("place_id", "mean_wi", *[f[k].alias(v) for k, v in enumerate(PROFILES)])).join(t.select("place_id", F.round("weight", 9).alias("weight")), "place_id")


@query("AG24_feature_counts", f"SELECT 'FBM' AS source, CAST(4 AS BIGINT) AS n, CAST((SELECT count(active_users) FROM {ANSWERS} a JOIN fx_place p ON a.place_id = p.place_id WHERE a.profile IN ('click', 'view', 'purchase', 'error')) AS BIGINT) AS n_values UNION ALL SELECT 'OCI', 9, 9 * count(*) FROM fx_place")
def ag24(spark, d):
    a = features.audience_features(place(spark, d), view(spark, d, "fx_answer"), PROFILES)
    return tables.feature_counts(a.join(features.cells(points(spark, d, "fx_place"), points(spark, d, "fx_cell")), "place_id"), ["place_id"])


@query("FE5_scaled", "SELECT place_id, round((mean_wi - lo) / (hi - lo), 6) AS scaled FROM fx_place, (SELECT min(mean_wi) AS lo, max(mean_wi) AS hi FROM fx_place)")
def fe5(spark, d):
    from pyspark.ml.functions import vector_to_array

    m = models.scaled(tables.matrix(place(spark, d), ["mean_wi"]))
    return rounded(m.select("place_id", vector_to_array("features_scaled")[0].alias("scaled")))


def matrix(spark, d):
    return tables.matrix(learned(spark, d), NAMES)


@query("ML1_learning_rates")
def ml1(spark, d):
    m = matrix(spark, d)
    return models.learning_rates(m.filter("fold < 2"), m.filter("fold = 2"), "mean_wi", [0.05, 0.1, 0.5])


@query("ML2_classifier_rates")
def ml2(spark, d):
    m = matrix(spark, d).withColumn("rich", (F.col("mean_wi") > 50).cast("double"))
    return models.classifier_rates(m.filter("fold < 2"), m.filter("fold = 2"), "rich", [0.05, 0.1, 0.5], classes=2)


@query("ML3_tuning")
def ml3(spark, d):
    return models.tune(matrix(spark, d), "mean_wi", [{"maxIter": 5, "maxDepth": 3}, FITTED])


@query("ML4_fit_and_test")
def ml4(spark, d):
    m = matrix(spark, d)
    return rounded(models.evaluated(models.predict(models.fit(m.filter("fold < 2"), FITTED), m.filter("fold = 2")), ["ccode"]))


PAIR = ["mean_wi", "std_wi"]


def boosted(rows):
    return boosting.fit(rows, NAMES, PAIR, trees=6, depth=3)


@query("ML4_two_outputs")
def ml4_two(spark, d):
    """One tree for both outputs a step; the metrics of both on the rows that were left out."""
    rows = learned(spark, d)
    return rounded(models.evaluated(boosting.predict(boosted(rows.filter("fold < 2")), rows.filter("fold = 2")), ["ccode"]))


@query("AG49_attributed")
def ag49_attributed(spark, d):
    """Mean absolute attribution of each feature for each output over all rows."""
    rows = learned(spark, d)
    each = boosting.attributions(boosted(rows), rows, "place_id")
    return rounded(stats.attribution(each, ["output", "feature"]))


@query("ML5_inference")
def ml5(spark, d):
    m = matrix(spark, d)
    return models.predict(models.fit(m, FITTED, ("mean_wi",)), m).select("place_id", F.round("pred_mean_wi", 6).alias("pred_mean_wi"))


@query("ML6_inference_with_vectors")
def ml6(spark, d):
    m = tables.matrix(learned(spark, d), NAMES, vector="embedding")
    return models.predict(models.fit(m, FITTED, ("mean_wi",)), m).select("place_id", F.round("pred_mean_wi", 6).alias("pred_mean_wi"))


@query("ML7_transfer")
def ml7(spark, d):
    m = matrix(spark, d)
    countries = sorted(r[0] for r in m.select("ccode").distinct().collect())
    return rounded(models.transfers({c: models.fit(m.filter(F.col("ccode") == c), FITTED) for c in countries}, m))


@query("AG49_importance")
def ag49(spark, d):
    return models.importance(spark, models.fit(matrix(spark, d), FITTED, ("mean_wi",)), NAMES)


# whole jobs


@query("JOB1_ground_truth", f"SELECT p.place_id, round(c.mean_iwi, 6) AS mean_wi, round(c.std_iwi, 6) AS std_wi, c.counts, CASE WHEN c.mean_iwi < 0 THEN NULL WHEN c.mean_iwi < 25 THEN 'poor' WHEN c.mean_iwi < 50 THEN 'lower_middle' WHEN c.mean_iwi < 75 THEN 'upper_middle' WHEN c.mean_iwi < 101 THEN 'rich' END AS category FROM fx_place p JOIN {CLUSTERS} c ON p.place_id = c.hv001 AND p.year = c.year WHERE p.lon <> 0 AND p.lat <> 0")
def job1(spark, d):
    h = cleaned(spark, d).withColumn("place_id", F.col("hv001").cast("long"))
    clusters = place(spark, d).drop("mean_wi", "std_wi")
    made = jobs.ground_truth(h, clusters, spark.createDataFrame(TIERS, "variable string, tier string, code int"), BETAS, ["place_id", "year"])
    return rounded(made.select("place_id", "mean_wi", "std_wi", "counts", F.col("mean_wi_cat").alias("category")))


@query("JOB2_place_features", "SELECT count(*) AS places, 22 AS columns FROM fx_place")
def job2(spark, d):
    made = jobs.place_features(place(spark, d), view(spark, d, "fx_tile"), view(spark, d, "fx_cell"))
    return made.agg(F.count(F.lit(1)).alias("places")).withColumn("columns", F.lit(len(made.columns) - len(place(spark, d).columns) + 4))


@query("JOB3_evaluation", "WITH r AS (SELECT country, model, epoch, (sqrt(avg((true_mean - pred_mean) ** 2)) + sqrt(avg((true_std - pred_std) ** 2))) / 2 AS rmse FROM fx_pred GROUP BY ALL), m AS (SELECT country, model, avg(rmse) AS rmse, count(*) AS runs FROM r GROUP BY country, model) SELECT country, model, round(rmse, 6) AS rmse_overall, runs FROM m QUALIFY row_number() OVER (PARTITION BY country ORDER BY rmse, model) = 1")
def job3(spark, d):
    return rounded(jobs.evaluation(view(spark, d, "fx_pred"), ["country", "model"], ["country"]).select("country", "model", "rmse_overall", "runs"))


# the extension surface


class StandIn:
    """UX1: an adapter of the stand-in survey."""

    def __init__(self, spark, d):
        self.spark, self.d = spark, d

    def households(self) -> DataFrame:
        return cleaned(self.spark, self.d).withColumn("place_id", F.col("hv001").cast("long"))

    def clusters(self) -> DataFrame:
        return place(self.spark, self.d).drop("mean_wi", "std_wi")


@query("UX1_survey_adapter", f"SELECT p.ccode, count(*) AS clusters, round(avg(c.mean_iwi), 6) AS mean_wi FROM fx_place p JOIN {CLUSTERS} c ON p.place_id = c.hv001 AND p.year = c.year GROUP BY p.ccode")
def ux1(spark, d):
    adapter = StandIn(spark, d)
    made = jobs.ground_truth(adapter.households(), adapter.clusters(), spark.createDataFrame(TIERS, "variable string, tier string, code int"), BETAS, ["place_id", "year"])
    return rounded(made.groupBy("ccode").agg(F.count(F.lit(1)).alias("clusters"), F.avg("mean_wi").alias("mean_wi")))


IN_AREA = "p.lon > q.x0 AND p.lon < q.x0 + q.w AND p.lat > q.y0 AND p.lat < q.y0 + q.w"


@query("UX2_own_aggregates", f"SELECT q.poly_id, round(max(p.mean_wi) - min(p.mean_wi), 6) AS span, count(DISTINCT p.ccode) AS countries FROM fx_polygon q LEFT JOIN fx_place p ON {IN_AREA} GROUP BY q.poly_id")
def ux2(spark, d):
    from ..operators import spatial

    own = {"span": F.max("mean_wi") - F.min("mean_wi"), "countries": F.countDistinct("ccode")}
    return rounded(spatial.zonal(place(spark, d), polygons(spark, d), "mean_wi", own).select("poly_id", "span", "countries"))


@query("JN17_polygon_attributes", f"SELECT q.poly_id, q.name, round(q.w, 6) AS w, n FROM fx_polygon q JOIN (SELECT q.poly_id, count(p.place_id) AS n FROM fx_polygon q LEFT JOIN fx_place p ON {IN_AREA} GROUP BY q.poly_id) c ON q.poly_id = c.poly_id")
def jn17(spark, d):
    from ..operators import spatial

    return rounded(spatial.zonal(place(spark, d), polygons(spark, d), "place_id", {"n": F.count("place_id")}).select("poly_id", "name", "w", "n"))


@query("UX3_row_expressions", "SELECT event_id, round(n_baseline / nullif(length_km - 1, 0), 6) AS pull, CASE WHEN start_node = end_node THEN 'within' ELSE 'across' END AS kind FROM fx_move")
def ux3(spark, d):
    m = view(spark, d, "fx_move")
    return rounded(m.select("event_id", features.gravity(F.col("n_baseline"), F.col("length_km") - 1, 1.0).alias("pull"), F.when(F.col("start_node") == F.col("end_node"), "within").otherwise("across").alias("kind")))


@query("UX4_group_expressions", "SELECT country, settlement, count(CASE WHEN pred_mean > true_mean THEN 1 END) AS over_, round(max(pred_mean) - min(true_mean), 6) AS span FROM fx_pred GROUP BY country, settlement")
def ux4(spark, d):
    p = view(spark, d, "fx_pred")
    return rounded(p.groupBy("country", "settlement").agg(F.count_if(F.col("pred_mean") > F.col("true_mean")).alias("over_"), (F.max("pred_mean") - F.min("true_mean")).alias("span")))


@query("UX5_row_generators", "SELECT place_id, CAST(unnest(range(year, 2020)) AS INT) AS year FROM fx_place")
def ux5(spark, d):
    return place(spark, d).select("place_id", F.explode(F.sequence("year", F.lit(2019))).alias("year"))


@query("SRC4_zipped_csv", "SELECT ccode, year, count(*) AS n FROM fx_place GROUP BY ccode, year")
def src4(spark, d):
    import io
    import zipfile

    path = folder(spark, "zips")
    counted = place(spark, d).groupBy("ccode", "year").agg(F.count(F.lit(1)).alias("n")).collect()  # a row per country and year
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs
    for country in sorted({r["ccode"] for r in counted}):
        held = io.BytesIO()
        with zipfile.ZipFile(held, "w") as z:
            for r in counted:
                if r["ccode"] == country:
                    z.writestr(f"{r['year']}.csv", f"ccode,year,n\n{r['ccode']},{r['year']},{r['n']}\n")
        at = fs.Path(f"{path}/{country}.zip")
        out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at)
        out.write(bytearray(held.getvalue()))
        out.close()
    return files.read_zips(spark, path, ["ccode", "year", "n"]).select("ccode", F.col("year").cast("int").alias("year"), F.col("n").cast("long").alias("n"))
