"""Spatial joins and features of places."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixtures import view
from ..functions import geo
from ..operators import features, spatial
from ..operators.pyramid import box_sums
from .base import query, x, xy, y


def points(spark: SparkSession, d: str, name: str) -> DataFrame:
    return geo.projected(view(spark, d, name))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, as in the statements."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])


@query("SC1_mercator", f"SELECT place_id, round({x()}, 3) AS x, round({y()}, 3) AS y, round(degrees(({x()}) / 6378137.0), 6) AS lon_back, round(degrees(2 * atan(exp(({y()}) / 6378137.0)) - pi() / 2), 6) AS lat_back FROM fx_place")
def sc1(spark, d):
    df = points(spark, d, "fx_place")
    return df.select("place_id", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"), F.round(geo.to_lon(F.col("x")), 6).alias("lon_back"), F.round(geo.to_lat(F.col("y")), 6).alias("lat_back"))


@query("SC2_box", f"SELECT place_id, round(degrees(2 * atan(exp(({y()} - 1000) / 6378137.0)) - pi() / 2), 6) AS south, round(degrees(({x()} - 1000) / 6378137.0), 6) AS west, round(degrees(2 * atan(exp(({y()} + 1000) / 6378137.0)) - pi() / 2), 6) AS north, round(degrees(({x()} + 1000) / 6378137.0), 6) AS east FROM fx_place")
def sc2(spark, d):
    return rounded(view(spark, d, "fx_place").select("place_id", geo.box(F.col("lon"), F.col("lat"), 2000.0).alias("b")).select("place_id", "b.*"))


LAMBERT = """
WITH s AS (SELECT seg_id, atan((1 - 1 / 298.257223563) * tan(radians(lat1))) AS b1, atan((1 - 1 / 298.257223563) * tan(radians(lat2))) AS b2, radians(lon2 - lon1) AS dl FROM fx_segment),
h AS (SELECT *, 2 * asin(least(1.0, sqrt(pow(sin((b2 - b1) / 2), 2) + cos(b1) * cos(b2) * pow(sin(dl / 2), 2)))) AS s FROM s)
SELECT seg_id, round(CASE WHEN s = 0 THEN 0.0 ELSE 6378137.0 * (s - 1 / 298.257223563 / 2 * (
  (s - sin(s)) * pow(sin((b1 + b2) / 2), 2) * pow(cos((b2 - b1) / 2), 2) / pow(cos(s / 2), 2) + (s + sin(s)) * pow(cos((b1 + b2) / 2), 2) * pow(sin((b2 - b1) / 2), 2) / pow(sin(s / 2), 2))) END, 3) AS metres FROM h"""


@query("SC4_geodesic_length", LAMBERT)
def sc4(spark, d):
    point = lambda k: F.struct(F.col(f"lon{k}").alias("lon"), F.col(f"lat{k}").alias("lat"))
    return view(spark, d, "fx_segment").select("seg_id", F.round(geo.polyline_length(F.array(point(1), point(2))), 3).alias("metres"))


@query(
    "SC5_geodesic_area",
    """SELECT poly_id, round(radians(w) * radians(w) * 6378137.0 * cos(radians(y0)) / sqrt(1 - e2 * pow(sin(radians(y0)), 2)) * 6378137.0 * (1 - e2) / pow(1 - e2 * pow(sin(radians(y0)), 2), 1.5), 0) AS square_metres
    FROM fx_polygon, (SELECT 1 / 298.257223563 * (2 - 1 / 298.257223563) AS e2)""",
)
def sc5(spark, d):
    p = polygons(spark, d)
    return p.select("poly_id", F.round(geo.polygon_area(F.col("rings")[0]), 0).alias("square_metres"))


def polygons(spark: SparkSession, d: str) -> DataFrame:
    """The areas with their ring and box."""
    corner = lambda a, b: F.struct((F.col("x0") + a * F.col("w")).alias("lon"), (F.col("y0") + b * F.col("w")).alias("lat"))
    df = view(spark, d, "fx_polygon").withColumn("rings", F.array(F.array(corner(0, 0), corner(1, 0), corner(1, 1), corner(0, 1))))
    return df.withColumns({"x1": F.col("x0") + F.col("w"), "y1": F.col("y0") + F.col("w")})


@query("SC8_vertices", "SELECT road_id, count(*) AS n, min(seq) AS first_seq, max(seq) AS last_seq FROM fx_segment GROUP BY road_id HAVING count(*) >= 2")
def sc8(spark, d):
    made = view(spark, d, "fx_segment").groupBy("road_id").agg(geo.vertices(F.col("seq"), F.col("lon1"), F.col("lat1"), 2).alias("v")).filter("v IS NOT NULL")
    return made.select("road_id", F.size("v").cast("long").alias("n"), F.col("v")[0]["seq"].alias("first_seq"), F.element_at("v", -1)["seq"].alias("last_seq"))


CLOSEST_TILE = f"""
SELECT p.place_id, arg_min(t.tile_id, sqrt((p.x - t.x) ** 2 + (p.y - t.y) ** 2)) AS tile_id, round(min(sqrt((p.x - t.x) ** 2 + (p.y - t.y) ** 2)), 3) AS distance
FROM {xy("fx_place")} p CROSS JOIN {xy("fx_tile")} t GROUP BY p.place_id"""


@query("JN7_nearest", CLOSEST_TILE)
def jn7(spark, d):
    return rounded(spatial.nearest(points(spark, d, "fx_place"), points(spark, d, "fx_tile"), "place_id", "tile_id"), 3)


@query("JN9_nearest_one", CLOSEST_TILE)
def jn9(spark, d):
    return rounded(spatial.nearest(points(spark, d, "fx_place"), points(spark, d, "fx_tile"), "place_id", "tile_id", ties="lowest"), 3)


@query(
    "JN8_nearest_deduped",
    f"""WITH p AS (SELECT place_id, x, y FROM (SELECT *, row_number() OVER (PARTITION BY x, y ORDER BY place_id) AS r FROM (SELECT place_id, floor(({x()}) / 20000) * 20000 AS x, floor(({y()}) / 20000) * 20000 AS y FROM fx_place)) WHERE r = 1)
    SELECT p.place_id, round(min(sqrt((p.x - t.x) ** 2 + (p.y - t.y) ** 2)), 3) AS distance FROM p CROSS JOIN {xy("fx_tile")} t GROUP BY p.place_id""",
)
def jn8(spark, d):
    coarse = points(spark, d, "fx_place").withColumns({"x": F.floor(F.col("x") / 20000) * 20000.0, "y": F.floor(F.col("y") / 20000) * 20000.0})
    one = spatial.one_per_geometry(coarse, "place_id")
    return rounded(spatial.nearest(one, points(spark, d, "fx_tile"), "place_id", "tile_id", ties="lowest").select("place_id", "distance"), 3)


@query(
    "JN10_nearest_within",
    f"""SELECT p.place_id, arg_min(t.tile_id, sqrt((p.x - t.x) ** 2 + (p.y - t.y) ** 2)) AS tile_id, round(min(sqrt((p.x - t.x) ** 2 + (p.y - t.y) ** 2)), 3) AS distance
    FROM {xy("fx_place")} p JOIN {xy("fx_tile")} t ON sqrt((p.x - t.x) ** 2 + (p.y - t.y) ** 2) <= 300 GROUP BY p.place_id""",
)
def jn10(spark, d):
    return rounded(spatial.nearest(points(spark, d, "fx_place"), points(spark, d, "fx_tile"), "place_id", "tile_id", most=300.0, how="inner"), 3)


@query(
    "JN11_mutual_nearest",
    f"""WITH m AS (SELECT * FROM {xy("fx_map")}), n AS (SELECT a.id AS id_a, b.id AS id_b, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS distance FROM m a JOIN m b ON a.map = 'M1' AND b.map = 'M2' AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 10),
    l AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY id_a ORDER BY distance, id_b) = 1)
    SELECT id_a, id_b, round(distance, 3) AS distance FROM l QUALIFY row_number() OVER (PARTITION BY id_b ORDER BY distance, id_a) = 1""",
)
def jn11(spark, d):
    m = points(spark, d, "fx_map")
    a, b = (m.filter(F.col("map") == k).withColumnRenamed("id", n) for k, n in (("M1", "id_a"), ("M2", "id_b")))
    return rounded(spatial.mutual_nearest(a, b, "id_a", "id_b", 10.0), 3)


@query("JN12_nearest_feature", f"""SELECT place_id, arg_min(poi_id, (d, poi_id)) AS poi_id, round(min(d), 3) AS distance FROM (SELECT p.place_id, t.poi_id, sqrt((p.x - t.x) ** 2 + (p.y - t.y) ** 2) AS d FROM {xy("fx_place")} p CROSS JOIN {xy("fx_poi")} t) GROUP BY place_id""")
def jn12(spark, d):
    return rounded(spatial.nearest(points(spark, d, "fx_place"), points(spark, d, "fx_poi"), "place_id", "poi_id", ties="lowest").select("place_id", "poi_id", "distance"), 3)


BOXES = {"1mile": 1609.34, "2km": 2000.0, "5km": 5000.0, "10km": 10000.0}
IN_BOX = "t.x BETWEEN p.x - {0} AND p.x + {0} AND t.y BETWEEN p.y - {0} AND p.y + {0}"


@query(
    "JN13_box_sums",
    f"""SELECT p.place_id, {", ".join(f"round(coalesce(sum(CASE WHEN {IN_BOX.format(w / 2)} THEN t.population END), 0), 6) AS population_in_{n}, count(CASE WHEN {IN_BOX.format(w / 2)} THEN 1 END) AS tiles_in_{n}" for n, w in BOXES.items())}
    FROM {xy("fx_place")} p LEFT JOIN {xy("fx_tile")} t ON {IN_BOX.format(5000.0)} GROUP BY p.place_id""",
)
def jn13(spark, d):
    made = box_sums(points(spark, d, "fx_place"), points(spark, d, "fx_tile"), "place_id", {n: w / 2 for n, w in BOXES.items()}, {"population": F.col("population"), "tiles": F.lit(1)})
    return rounded(made)


@query(
    "JN14_square_filter",
    f"""SELECT p.place_id, t.tile_id, round(sqrt((p.x - t.x) ** 2 + (p.y - t.y) ** 2), 3) AS distance FROM {xy("fx_place")} p JOIN {xy("fx_tile")} t ON {IN_BOX.format(1000.0)}""",
)
def jn14(spark, d):
    return rounded(spatial.find_in_square(points(spark, d, "fx_place"), points(spark, d, "fx_tile"), "place_id", 2000.0, ["tile_id"]), 3)


INSIDE = "{0}.lon > q.x0 AND {0}.lon < q.x0 + q.w AND {0}.lat > q.y0 AND {0}.lat < q.y0 + q.w"


@query("JN15_point_in_polygon", f"SELECT c.cell_id, coalesce(arg_min(q.name, q.poly_id), 'unknown') AS country FROM fx_cell c LEFT JOIN fx_polygon q ON {INSIDE.format('c')} GROUP BY c.cell_id")
def jn15(spark, d):
    return spatial.point_in_polygon(view(spark, d, "fx_cell"), polygons(spark, d), "cell_id").select("cell_id", "country")


@query("GX11_cells_by_country", f"SELECT country, count(*) AS n FROM (SELECT c.cell_id, coalesce(arg_min(q.name, q.poly_id), 'unknown') AS country FROM fx_cell c LEFT JOIN fx_polygon q ON {INSIDE.format('c')} GROUP BY c.cell_id) GROUP BY country")
def gx11(spark, d):
    return spatial.point_in_polygon(view(spark, d, "fx_cell"), polygons(spark, d), "cell_id").groupBy("country").count().withColumnRenamed("count", "n")


@query("JN16_polygon_right_join", f"SELECT q.poly_id, count(p.place_id) AS n FROM fx_polygon q LEFT JOIN fx_place p ON {INSIDE.format('p')} GROUP BY q.poly_id")
def jn16(spark, d):
    return spatial.zonal(view(spark, d, "fx_place"), polygons(spark, d), "place_id", {"n": F.count("place_id")}).select("poly_id", "n")


@query(
    "GX12_zonal",
    f"""SELECT q.poly_id, any_value(q.name) AS name, round(avg(p.mean_wi), 6) AS mean_wi_mean, round(stddev_samp(p.mean_wi), 6) AS mean_wi_std, round(coalesce(sum(p.mean_wi), 0), 6) AS mean_wi_sum, round(min(p.mean_wi), 6) AS mean_wi_min,
    round(max(p.mean_wi), 6) AS mean_wi_max, count(DISTINCT p.mean_wi) AS mean_wi_nunique, count(p.mean_wi) AS mean_wi_count FROM fx_polygon q LEFT JOIN fx_place p ON {INSIDE.format("p")} GROUP BY q.poly_id""",
)
def gx12(spark, d):
    names = ["mean", "std", "sum", "min", "max", "nunique", "count"]
    return rounded(spatial.zonal(view(spark, d, "fx_place"), polygons(spark, d), "mean_wi", names).select("poly_id", "name", *[f"mean_wi_{n}" for n in names]))


@query(
    "AG4_zonal_mode",
    f"""WITH c AS (SELECT q.poly_id, p.year, count(*) AS n FROM fx_polygon q JOIN fx_place p ON {INSIDE.format("p")} GROUP BY ALL)
    SELECT q.poly_id, (SELECT year FROM c WHERE c.poly_id = q.poly_id ORDER BY n DESC, year LIMIT 1) AS year_mode FROM fx_polygon q""",
)
def ag4(spark, d):
    return spatial.zonal(view(spark, d, "fx_place"), polygons(spark, d), "year", ["mode"]).select("poly_id", "year_mode")


SEGMENTS = f"(SELECT seg_id, {x('lon1')} AS x1, {y('lat1')} AS y1, {x('lon2')} AS x2, {y('lat2')} AS y2 FROM fx_segment)"
ROADS = f"(SELECT seg_id, road_id, {x('lon1')} AS x1, {y('lat1')} AS y1, {x('lon2')} AS x2, {y('lat2')} AS y2 FROM fx_road)"


def segments(spark: SparkSession, d: str, name: str = "fx_segment") -> DataFrame:
    df = view(spark, d, name)
    return df.withColumns({f"{v}{k}": f(F.col(f"{n}{k}")) for k in (1, 2) for v, n, f in (("x", "lon", geo.to_x), ("y", "lat", geo.to_y))})


def meeting_sql(pairs: str, kept: str = "a, b") -> str:
    """CTEs up to ``met``: of pairs (kept, ax1, ay1, ... by2) where their segments meet, x and y NULL if they do not."""
    side = "CASE WHEN abs(({1}x2 - {1}x1) * ({0}y{2} - {1}y1) - ({1}y2 - {1}y1) * ({0}x{2} - {1}x1)) <= 0.001 * sqrt(({1}x2 - {1}x1) ** 2 + ({1}y2 - {1}y1) ** 2) THEN 0 ELSE sign(({1}x2 - {1}x1) * ({0}y{2} - {1}y1) - ({1}y2 - {1}y1) * ({0}x{2} - {1}x1)) END AS {0}{2}"
    inside = "({0}{2} = 0 AND {0}x{2} BETWEEN least({1}x1, {1}x2) - 0.001 AND greatest({1}x1, {1}x2) + 0.001 AND {0}y{2} BETWEEN least({1}y1, {1}y2) - 0.001 AND greatest({1}y1, {1}y2) + 0.001)"
    order = [("b", "a", 1), ("b", "a", 2), ("a", "b", 1), ("a", "b", 2)]
    ends = " ".join(f"WHEN {inside.format(*o)} THEN {{{{'x': {o[0]}x{o[2]}, 'y': {o[0]}y{o[2]}}}}}".replace("{{", "{").replace("}}", "}") for o in order)
    t1, t2 = (f"((bx{k} - ax1) * (ax2 - ax1) + (by{k} - ay1) * (ay2 - ay1)) / nullif((ax2 - ax1) ** 2 + (ay2 - ay1) ** 2, 0)" for k in (1, 2))
    low, high = f"greatest(least({t1}, {t2}), 0.0)", f"least(greatest({t1}, {t2}), 1.0)"
    t = "((bx1 - ax1) * (by2 - by1) - (by1 - ay1) * (bx2 - bx1)) / ((ax2 - ax1) * (by2 - by1) - (ay2 - ay1) * (bx2 - bx1))"
    at = "{{'x': ax1 + {0} * (ax2 - ax1), 'y': ay1 + {0} * (ay2 - ay1)}}"
    return f"""sided AS (SELECT *, {', '.join(side.format(*o) for o in order)} FROM ({pairs})),
    met AS (SELECT {kept}, CASE WHEN a1 = 0 AND a2 = 0 AND b1 = 0 AND b2 = 0 AND ({high} - {low}) * sqrt((ax2 - ax1) ** 2 + (ay2 - ay1) ** 2) > 0.001 THEN {at.format(f'({low} + {high}) / 2')}
    {ends} WHEN a1 * a2 < 0 AND b1 * b2 < 0 THEN {at.format(t)} END AS pt FROM sided)"""


#: All pairs of segments of different roads whose boxes meet.
ROAD_PAIRS = """SELECT a.road_id AS ra, b.road_id AS rb, a.x1 AS ax1, a.y1 AS ay1, a.x2 AS ax2, a.y2 AS ay2, b.x1 AS bx1, b.y1 AS by1, b.x2 AS bx2, b.y2 AS by2
    FROM s a JOIN s b ON a.x0 <= b.x9 + 0.002 AND b.x0 <= a.x9 + 0.002 AND a.y0 <= b.y9 + 0.002 AND b.y0 <= a.y9 + 0.002 AND a.seg_id < b.seg_id AND a.road_id <> b.road_id"""
JUNCTIONS = f"""s AS MATERIALIZED (SELECT *, least(x1, x2) AS x0, greatest(x1, x2) AS x9, least(y1, y2) AS y0, greatest(y1, y2) AS y9 FROM {ROADS}),
    {meeting_sql(ROAD_PAIRS, "ra, rb")}, j AS MATERIALIZED (SELECT DISTINCT round(pt.x / 0.01) * 0.01 AS jx, round(pt.y / 0.01) * 0.01 AS jy, unnest([ra, rb]) AS road_id FROM met WHERE pt IS NOT NULL)"""


@query("JN18_junctions", f"WITH {JUNCTIONS} SELECT round(jx, 2) AS x, round(jy, 2) AS y, count(*) AS roads FROM j GROUP BY ALL")
def jn18(spark, d):
    met = spatial.junctions(segments(spark, d, "fx_road"))
    return met.groupBy(F.round("x", 2).alias("x"), F.round("y", 2).alias("y")).agg(F.count(F.lit(1)).alias("roads"))


@query(
    "SC6_point_to_segment",
    f"""WITH s AS (SELECT p.place_id, s.seg_id, p.x, p.y, x1, y1, x2, y2, greatest(0.0, least(1.0, ((p.x - x1) * (x2 - x1) + (p.y - y1) * (y2 - y1)) / ((x2 - x1) ** 2 + (y2 - y1) ** 2))) AS t
    FROM {xy("fx_place")} p JOIN {SEGMENTS} s ON p.place_id = s.seg_id WHERE (x2 - x1) ** 2 + (y2 - y1) ** 2 > 0)
    SELECT place_id, round(sqrt((x - x1 - t * (x2 - x1)) ** 2 + (y - y1 - t * (y2 - y1)) ** 2), 3) AS distance FROM s""",
)
def sc6(spark, d):
    both = points(spark, d, "fx_place").join(segments(spark, d).filter("x1 <> x2 OR y1 <> y2"), F.col("place_id") == F.col("seg_id"))
    return both.select("place_id", F.round(geo.to_segment(*[F.col(c) for c in ("x", "y", "x1", "y1", "x2", "y2")]), 3).alias("distance"))


@query(
    "GX3_towers",
    f"""WITH RECURSIVE c AS (SELECT cell_id, {x()} AS x, {y()} AS y FROM fx_cell),
    e AS (SELECT a.cell_id AS a, b.cell_id AS b FROM c a JOIN c b ON sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 10),
    r AS (SELECT a AS cell_id, b AS reached FROM e UNION SELECT r.cell_id, e.b FROM r JOIN e ON r.reached = e.a)
    SELECT cell_id, min(reached) AS tower_id FROM r GROUP BY cell_id""",
)
def gx3(spark, d):
    return spatial.towers(points(spark, d, "fx_cell")).select("cell_id", "tower_id")


def gravity_sql(value: str, distance: str, name: str) -> str:
    return ", ".join(f"round({value} / nullif(pow({distance}, {e}), 0), 6) AS {name}_{n}" for n, e in (("d", 1.0), ("d15", 1.5), ("d2", 2.0)))


@query(
    "GX1_population_features",
    f"""WITH n AS (SELECT p.place_id, arg_min(t.population, sqrt((p.x - t.x) ** 2 + (p.y - t.y) ** 2)) AS v, min(sqrt((p.x - t.x) ** 2 + (p.y - t.y) ** 2)) AS dist FROM {xy("fx_place")} p CROSS JOIN {xy("fx_tile")} t GROUP BY p.place_id),
    b AS (SELECT p.place_id, {", ".join(f"round(coalesce(sum(CASE WHEN {IN_BOX.format(w / 2)} THEN t.population END), 0), 6) AS population_in_{n}" for n, w in BOXES.items())} FROM {xy("fx_place")} p LEFT JOIN {xy("fx_tile")} t ON {IN_BOX.format(5000.0)} GROUP BY p.place_id)
    SELECT b.*, round(v, 6) AS population_closest_tile, round(dist, 6) AS distance_closest_tile, {gravity_sql("v", "dist", "population_closest")} FROM n JOIN b ON n.place_id = b.place_id""",
)
def gx1(spark, d):
    return rounded(features.population(points(spark, d, "fx_place"), points(spark, d, "fx_tile")))


@query(
    "GX2_cell_features",
    f"""WITH RECURSIVE c AS (SELECT cell_id, {x()} AS x, {y()} AS y FROM fx_cell), e AS (SELECT a.cell_id AS a, b.cell_id AS b FROM c a JOIN c b ON sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 10),
    r AS (SELECT a AS cell_id, b AS reached FROM e UNION SELECT r.cell_id, e.b FROM r JOIN e ON r.reached = e.a), w AS (SELECT cell_id, min(reached) AS tower_id FROM r GROUP BY cell_id), t AS (SELECT c.*, tower_id FROM c JOIN w ON c.cell_id = w.cell_id)
    SELECT p.place_id, round(min(sqrt((p.x - t.x) ** 2 + (p.y - t.y) ** 2)), 6) AS distance_closest_cell, {", ".join(f"count(CASE WHEN {IN_BOX.format(w / 2)} THEN 1 END) AS cells_in_{n}, count(DISTINCT CASE WHEN {IN_BOX.format(w / 2)} THEN tower_id END) AS towers_in_{n}" for n, w in BOXES.items())}
    FROM {xy("fx_place")} p CROSS JOIN t GROUP BY p.place_id""",
)
def gx2(spark, d):
    return rounded(features.cells(points(spark, d, "fx_place"), points(spark, d, "fx_cell")))


def pixels(spark: SparkSession, d: str) -> DataFrame:
    p = view(spark, d, "fx_pixel").withColumns({"ts": F.make_timestamp("year", "month", F.lit(1), F.lit(0), F.lit(0), F.lit(0))})
    return p


@query("AG43_composite", "SELECT lon, lat, round(median(avg_rad), 9) AS median_rad, round(max(avg_rad), 9) AS max_rad, round(avg(avg_rad), 9) AS mean_rad, round(min(CASE WHEN year * 12 + month = m THEN avg_rad END), 9) AS first_rad FROM (SELECT *, min(year * 12 + month) OVER (PARTITION BY lon, lat) AS m FROM fx_pixel WHERE year BETWEEN 1995 AND 1996) GROUP BY lon, lat")
def ag43(spark, d):
    out = None
    for how in ("median", "max", "mean", "first"):
        part = features.composite(pixels(spark, d), "1995-01-01", "1997-01-01", how).withColumnRenamed("avg_rad", f"{how}_rad")
        out = part if out is None else out.join(part, ["lon", "lat"])
    return out.select("lon", "lat", *[F.round(f"{h}_rad", 9).alias(f"{h}_rad") for h in ("median", "max", "mean", "first")])


NTLL = """count(v) AS NTLL_count_{0}, round(sum(v), 9) AS NTLL_sum_{0}, round(min(v), 9) AS NTLL_min_{0}, round(max(v), 9) AS NTLL_max_{0}, round(avg(v), 9) AS NTLL_mean_{0}, round(median(v), 9) AS NTLL_median_{0},
round(avg(CASE WHEN v <= p33 THEN v END), 9) AS NTLL_mean_low_{0}, round(avg(CASE WHEN v >= p66 THEN v END), 9) AS NTLL_mean_high_{0}, round(count(CASE WHEN v >= 30 THEN 1 END) / nullif(count(v), 0), 9) AS NTLL_share_lit_{0},
round(sum(CASE WHEN v >= 30 THEN v ELSE 0 END) / sum(v), 9) AS NTLL_share_lit_sum_{0}, round(sum(CASE WHEN v >= 30 THEN s ELSE 0 END) / sum(s), 9) AS NTLL_share_lit_area_{0}"""


@query(
    "GX4_night_lights",
    f"""WITH c AS (SELECT lon, lat, median(avg_rad) AS v, 1.0 + lat * lat AS s FROM fx_pixel WHERE year >= 1995 GROUP BY lon, lat), t AS (SELECT *, {x()} AS x, {y()} AS y FROM c), p AS (SELECT place_id, {x()} AS x, {y()} AS y FROM fx_place)
    SELECT a.*, b.* EXCLUDE (place_id) FROM """
    + " JOIN ".join(
        f"(SELECT place_id, {NTLL.format(n)} FROM (SELECT p.place_id, t.v, t.s, quantile_cont(t.v, 0.33) OVER (PARTITION BY p.place_id) AS p33, quantile_cont(t.v, 0.66) OVER (PARTITION BY p.place_id) AS p66 FROM p LEFT JOIN t ON {IN_BOX.format(w)}) GROUP BY place_id) {a}"
        for a, n, w in (("a", "2km", 2000.0), ("b", "5km", 5000.0))
    )
    + " ON a.place_id = b.place_id",
)
def gx4(spark, d):
    lit = features.composite(pixels(spark, d), "1995-01-01", "2100-01-01").withColumn("area", 1.0 + F.col("lat") * F.col("lat"))
    return rounded(features.night_lights(points(spark, d, "fx_place"), geo.projected(lit), halves={"2km": 2000.0, "5km": 5000.0}, threshold=30.0), 9)


def roads_sql(half: float) -> str:
    """CTEs up to ``r``: the roads of each spot's box."""
    inside = f"least(x1, x2) <= p.x + {half} AND greatest(x1, x2) >= p.x - {half} AND least(y1, y2) <= p.y + {half} AND greatest(y1, y2) >= p.y - {half} AND abs((p.x - x1) * (y2 - y1) - (p.y - y1) * (x2 - x1)) <= {half} * (abs(x2 - x1) + abs(y2 - y1))"
    return f"""{JUNCTIONS}, p AS MATERIALIZED (SELECT place_id, {x()} AS x, {y()} AS y FROM fx_spot), h AS MATERIALIZED (SELECT DISTINCT place_id, p.x, p.y, road_id FROM p JOIN s ON {inside}),
    w AS (SELECT road_id, sum(sqrt((x1 - x2) ** 2 + (y1 - y2) ** 2)) AS len FROM s GROUP BY road_id), t AS (SELECT place_id, sum(len) AS total FROM h JOIN w USING (road_id) GROUP BY place_id),
    k AS (SELECT place_id, x, y, x1, y1, x2, y2, greatest(0.0, least(1.0, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / ((x2 - x1) ** 2 + (y2 - y1) ** 2))) AS u FROM h JOIN s USING (road_id)),
    c AS (SELECT place_id, min(sqrt((x - x1 - u * (x2 - x1)) ** 2 + (y - y1 - u * (y2 - y1)) ** 2)) AS d FROM k GROUP BY place_id),
    q AS (SELECT place_id, x, y, jx, jy FROM h JOIN j USING (road_id) GROUP BY ALL HAVING count(*) > 1), n AS (SELECT place_id, count(*) AS n, min(sqrt((x - jx) ** 2 + (y - jy) ** 2)) AS d FROM q GROUP BY place_id),
    r AS (SELECT p.place_id, p.x, p.y, round(coalesce(total, 0), 3) AS total_length_roads, round(coalesce(c.d, 0), 3) AS distance_closest_road, coalesce(n.n, 0) AS num_junctions, round(coalesce(n.d, 0), 3) AS distance_closest_junction
    FROM p LEFT JOIN t USING (place_id) LEFT JOIN c USING (place_id) LEFT JOIN n USING (place_id))"""


def infrastructure_sql(half: float, classes: list[str]) -> str:
    some = "{0} AS (SELECT p.place_id, {1} FROM p JOIN {2} t ON t.x BETWEEN p.x - {3} AND p.x + {3} AND t.y BETWEEN p.y - {3} AND p.y + {3} GROUP BY p.place_id)"
    far = "sqrt((p.x - t.x) ** 2 + (p.y - t.y) ** 2)"
    per_class = ", ".join(f"count(CASE WHEN kind = {k} THEN 1 END) AS n{k}, min(CASE WHEN kind = {k} THEN {far} END) AS d{k}" for k in range(len(classes)))
    shown = ", ".join(f"coalesce(n{k}, 0) AS {c}, round(coalesce(d{k}, 0), 3) AS {c}_dist" for k, c in enumerate(classes))
    built = some.format("b", "sum(t.area) AS area, count(*) AS n", xy("fx_building"), half)
    return f"""WITH {roads_sql(half)}, {built}, {some.format("o", per_class, xy("fx_amenity"), half)}
    SELECT r.* EXCLUDE (x, y), round(coalesce(b.area, 0), 6) AS total_building_area, coalesce(b.n, 0) AS num_buildings, {shown} FROM r LEFT JOIN b USING (place_id) LEFT JOIN o USING (place_id)"""


def infrastructure(spark: SparkSession, d: str, side: float, classes: list[str]) -> DataFrame:
    """What ``features.infrastructure`` gives for the network, its buildings and its points of interest; their kinds are places in the list of classes."""
    roads = segments(spark, d, "fx_road").withColumn("length", geo.distance(*[F.col(c) for c in ("x1", "y1", "x2", "y2")]))
    pois = points(spark, d, "fx_amenity").withColumn("amenity", F.get(F.array(*map(F.lit, classes)), F.col("kind")))
    return features.infrastructure(points(spark, d, "fx_spot"), roads, points(spark, d, "fx_building"), pois, side=side, classes=classes)


@query("GX5_infrastructure", infrastructure_sql(geo.MILE / 2, features.AMENITIES))
def gx5_infrastructure(spark, d):
    out = infrastructure(spark, d, geo.MILE, features.AMENITIES)
    return out.select(*[F.round(c, 6 if c == "total_building_area" else 3).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


@query("AG45_roads_buildings_classes", f"WITH {roads_sql(500.0)} SELECT * EXCLUDE (x, y) FROM r")
def ag45(spark, d):
    roads = segments(spark, d, "fx_road").withColumn("length", geo.distance(*[F.col(c) for c in ("x1", "y1", "x2", "y2")]))
    spots = points(spark, d, "fx_spot")
    found = spots.select("place_id").join(features.roads_in_box(spots, roads, side=1000.0), "place_id", "left")
    return rounded(found.fillna(0), 3)
