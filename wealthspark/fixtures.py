"""Stand-in tables: the driver's tables seen as surveys, places, tiles, antennas and so on.

One SQL text serves Spark and, with VARCHAR for STRING, the DuckDB statements of the catalog.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings")

VIEWS: dict[str, str] = {
    "fx_place": """SELECT CAST(c_custkey AS BIGINT) AS place_id, 'C' || CAST(c_nationkey % 6 AS STRING) AS ccode,
 CASE WHEN c_custkey % 2 = 0 THEN 2016 ELSE 2019 END AS year, CAST(c_custkey % 3 <> 0 AS INT) AS rural,
 CAST(29 AS DOUBLE) + CAST((c_custkey * 7919) % 100003 AS DOUBLE) / CAST(100003 AS DOUBLE) AS lon,
 CAST(-1 AS DOUBLE) + CAST((c_custkey * 104729) % 100019 AS DOUBLE) / CAST(100019 AS DOUBLE) AS lat,
 (c_acctbal + CAST(1000 AS DOUBLE)) / CAST(110 AS DOUBLE) AS mean_wi,
 CAST(3 AS DOUBLE) + CAST((c_custkey * 31) % 200 AS DOUBLE) / CAST(10 AS DOUBLE) AS std_wi FROM customer""",
    "fx_cell": """SELECT CAST(p_partkey AS BIGINT) AS cell_id,
 CAST(29 AS DOUBLE) + CAST(((p_partkey - p_partkey % 4) * 15485863) % 99991 AS DOUBLE) / CAST(99991 AS DOUBLE) + CAST(p_partkey % 4 AS DOUBLE) * CAST(0.00003 AS DOUBLE) AS lon,
 CAST(-1 AS DOUBLE) + CAST(((p_partkey - p_partkey % 4) * 32452843) % 99989 AS DOUBLE) / CAST(99989 AS DOUBLE) AS lat FROM part""",
    "fx_tile": """SELECT CAST(o_orderkey AS BIGINT) AS tile_id,
 CAST(29 AS DOUBLE) + CAST((o_orderkey * 6700417) % 100043 AS DOUBLE) / CAST(100043 AS DOUBLE) AS lon,
 CAST(-1 AS DOUBLE) + CAST((o_orderkey * 2796203) % 100049 AS DOUBLE) / CAST(100049 AS DOUBLE) AS lat,
 o_totalprice / CAST(10000 AS DOUBLE) AS population FROM orders""",
    "fx_move": """SELECT event_id, ts AS date_time, user_id % 40 AS start_node, CAST(floor(value) AS BIGINT) % 40 AS end_node,
 CASE WHEN event_id % 7 = 0 THEN NULL ELSE CAST(1 + event_id % 5 AS DOUBLE) END AS n_baseline,
 CAST(1 + abs(user_id % 40 - CAST(floor(value) AS BIGINT) % 40) AS DOUBLE) AS length_km FROM events""",
    "fx_pred": """SELECT o_orderkey AS row_id, 'C' || CAST(c_nationkey % 6 AS STRING) AS country, o_orderpriority AS model, o_custkey AS cluster_id,
 1 + o_orderkey % 3 AS epoch, CASE WHEN o_custkey % 3 <> 0 THEN 'rural' ELSE 'urban' END AS settlement,
 (c_acctbal + CAST(1000 AS DOUBLE)) / CAST(110 AS DOUBLE) AS true_mean,
 (c_acctbal + CAST(1000 AS DOUBLE)) / CAST(110 AS DOUBLE) * CAST(0.8 AS DOUBLE) + CAST((o_orderkey * 37) % 300 AS DOUBLE) / CAST(10 AS DOUBLE) AS pred_mean,
 CAST(3 AS DOUBLE) + CAST((o_custkey * 31) % 200 AS DOUBLE) / CAST(10 AS DOUBLE) AS true_std,
 CAST(4 AS DOUBLE) + CAST((o_orderkey * 17) % 190 AS DOUBLE) / CAST(10 AS DOUBLE) AS pred_std
 FROM orders JOIN customer ON o_custkey = c_custkey""",
    "fx_household": """SELECT CAST(l_orderkey AS BIGINT) * 8 + l_linenumber AS hhid, CASE WHEN l_orderkey % 2 = 0 THEN 2016 ELSE 2019 END AS year,
 'S' || CAST(l_orderkey % 2 AS STRING) AS survey, l_suppkey AS hv001, 1 + CAST(l_orderkey % 3 AS INT) AS hv025,
 CASE WHEN l_partkey % 11 = 0 THEN 99 ELSE 10 + CAST(l_partkey % 6 AS INT) * 10 END AS hv201, 10 + CAST(l_partkey % 4 AS INT) * 10 AS hv205,
 10 + CAST(l_partkey % 3 AS INT) * 10 AS hv213, CAST(l_quantity AS INT) % 5 AS hv216, CAST(l_partkey % 2 AS INT) AS hv208,
 CAST(l_partkey % 3 = 0 AS INT) AS hv209, CAST(l_partkey % 5 = 0 AS INT) AS hv221, CAST(l_partkey % 13 = 0 AS INT) AS hv212,
 CAST(l_partkey % 4 = 0 AS INT) AS hv210, CAST(l_orderkey % 2 AS INT) AS hv206, CASE WHEN l_partkey % 17 = 0 THEN NULL ELSE CAST(l_partkey % 9 = 0 AS INT) END AS hv243a
 FROM lineitem""",
    "fx_pixel": """SELECT CAST(l_orderkey AS BIGINT) * 8 + l_linenumber AS pixel_id, year(l_shipdate) AS year, month(l_shipdate) AS month,
 CAST(29 AS DOUBLE) + CAST((l_partkey * 7919 + l_suppkey * 104729) % 240 AS DOUBLE) / CAST(240 AS DOUBLE) AS lon,
 CAST(-1 AS DOUBLE) + CAST((l_partkey * 6700417 + l_suppkey * 31) % 240 AS DOUBLE) / CAST(240 AS DOUBLE) AS lat,
 l_extendedprice / CAST(2000 AS DOUBLE) AS avg_rad FROM lineitem""",
    "fx_polygon": """SELECT n_nationkey AS poly_id, n_name AS name, CAST(29 AS DOUBLE) + CAST(n_nationkey % 5 AS DOUBLE) / CAST(5 AS DOUBLE) AS x0,
 CAST(-1 AS DOUBLE) + CAST((n_nationkey - n_nationkey % 5) AS DOUBLE) / CAST(25 AS DOUBLE) AS y0, CAST(0.18 AS DOUBLE) AS w FROM nation""",
    "fx_segment": """SELECT CAST(o_orderkey AS BIGINT) AS seg_id, o_custkey AS road_id, o_orderkey AS seq,
 CAST(29 AS DOUBLE) + CAST((o_orderkey * 6700417) % 100043 AS DOUBLE) / CAST(100043 AS DOUBLE) AS lon1,
 CAST(-1 AS DOUBLE) + CAST((o_orderkey * 2796203) % 100049 AS DOUBLE) / CAST(100049 AS DOUBLE) AS lat1,
 CAST(29 AS DOUBLE) + CAST((o_orderkey * 6700417) % 100043 AS DOUBLE) / CAST(100043 AS DOUBLE) + CAST((o_orderkey * 131) % 41 - 20 AS DOUBLE) / CAST(500 AS DOUBLE) AS lon2,
 CAST(-1 AS DOUBLE) + CAST((o_orderkey * 2796203) % 100049 AS DOUBLE) / CAST(100049 AS DOUBLE) + CAST((o_orderkey * 137) % 37 - 18 AS DOUBLE) / CAST(500 AS DOUBLE) AS lat2
 FROM orders""",
    # A network over blocks of 0.02 degrees, 400 to a row, so that its area grows with the tables: roads of ten segments with shared nodes, ends on other
    # roads, crossings, stretches on each other and ends in the next block. All nodes are whole thousandths of a degree.
    "fx_road": """SELECT seg_id, road_id, b,
 CAST(29 AS DOUBLE) + CAST(20 * (b % 400) + CASE k WHEN 0 THEN 2 * j WHEN 1 THEN 6 WHEN 2 THEN 9 WHEN 3 THEN 1 + 2 * j ELSE 3 * j + CASE WHEN b % 4 = 0 THEN 1 ELSE 5 END END AS DOUBLE) / CAST(1000 AS DOUBLE) AS lon1,
 CAST(-1 AS DOUBLE) + CAST(20 * CAST(floor(b / 400) AS BIGINT) + CASE k WHEN 0 THEN 4 WHEN 1 THEN 2 * j WHEN 2 THEN 4 + j WHEN 3 THEN 1 + j * (1 + b % 3) ELSE CASE WHEN b % 4 = 0 THEN 4 ELSE 7 END END AS DOUBLE) / CAST(1000 AS DOUBLE) AS lat1,
 CAST(29 AS DOUBLE) + CAST(20 * (b % 400) + CASE k WHEN 0 THEN 2 * j + 2 WHEN 1 THEN 6 WHEN 2 THEN 9 WHEN 3 THEN 3 + 2 * j ELSE 3 * j + 3 + CASE WHEN b % 4 = 0 THEN 1 ELSE 5 END END AS DOUBLE) / CAST(1000 AS DOUBLE) AS lon2,
 CAST(-1 AS DOUBLE) + CAST(20 * CAST(floor(b / 400) AS BIGINT) + CASE k WHEN 0 THEN 4 WHEN 1 THEN 2 * j + 2 WHEN 2 THEN 5 + j WHEN 3 THEN 1 + (j + 1) * (1 + b % 3) ELSE CASE WHEN b % 4 = 0 THEN 4 ELSE 7 END END AS DOUBLE) / CAST(1000 AS DOUBLE) AS lat2
 FROM (SELECT CAST(o_orderkey AS BIGINT) AS seg_id, CAST(floor(o_orderkey / 10) AS BIGINT) AS road_id, CAST(floor(o_orderkey / 50) AS BIGINT) AS b,
 CAST(floor(o_orderkey % 50 / 10) AS BIGINT) AS k, o_orderkey % 10 AS j FROM orders) o""",
    "fx_spot": """SELECT CAST(c_custkey AS BIGINT) AS place_id, CAST(29 AS DOUBLE) + CAST(20 * (CAST(floor(c_custkey / 5) AS BIGINT) % 400) + c_custkey * 7 % 20 AS DOUBLE) / CAST(1000 AS DOUBLE) + CAST(0.00031 AS DOUBLE) AS lon,
 CAST(-1 AS DOUBLE) + CAST(20 * CAST(floor(c_custkey / 2000) AS BIGINT) + c_custkey * 11 % 20 AS DOUBLE) / CAST(1000 AS DOUBLE) + CAST(0.00017 AS DOUBLE) AS lat FROM customer""",
    "fx_building": """SELECT CAST(o_orderkey AS BIGINT) AS building_id, o_totalprice / CAST(1000 AS DOUBLE) AS area,
 CAST(29 AS DOUBLE) + CAST(20 * (CAST(floor(o_orderkey / 50) AS BIGINT) % 400) AS DOUBLE) / CAST(1000 AS DOUBLE) + CAST(o_orderkey * 7919 % 20011 AS DOUBLE) / CAST(1000000 AS DOUBLE) AS lon,
 CAST(-1 AS DOUBLE) + CAST(20 * CAST(floor(o_orderkey / 20000) AS BIGINT) AS DOUBLE) / CAST(1000 AS DOUBLE) + CAST(o_orderkey * 104729 % 19997 AS DOUBLE) / CAST(1000000 AS DOUBLE) AS lat FROM orders""",
    "fx_amenity": """SELECT CAST(p_partkey AS BIGINT) AS poi_id, CAST(p_partkey * 5 % 26 AS INT) AS kind,
 CAST(29 AS DOUBLE) + CAST(20 * (CAST(floor(p_partkey / 7) AS BIGINT) % 400) AS DOUBLE) / CAST(1000 AS DOUBLE) + CAST(p_partkey * 6291469 % 20011 AS DOUBLE) / CAST(1000000 AS DOUBLE) AS lon,
 CAST(-1 AS DOUBLE) + CAST(20 * CAST(floor(p_partkey / 2800) AS BIGINT) AS DOUBLE) / CAST(1000 AS DOUBLE) + CAST(p_partkey * 12582917 % 19997 AS DOUBLE) / CAST(1000000 AS DOUBLE) AS lat FROM part""",
    "fx_poi": """SELECT CAST(p_partkey AS BIGINT) AS poi_id, p_type AS amenity,
 CAST(29 AS DOUBLE) + CAST((p_partkey * 6291469) % 100057 AS DOUBLE) / CAST(100057 AS DOUBLE) AS lon,
 CAST(-1 AS DOUBLE) + CAST((p_partkey * 12582917) % 100069 AS DOUBLE) / CAST(100069 AS DOUBLE) AS lat FROM part""",
    "fx_answer": """SELECT event_id, ts, user_id % 50 AS place_id, event_type AS profile,
 CASE WHEN event_id % 3 = 0 THEN value END AS users,
 CASE WHEN event_id % 3 = 1 THEN value END AS users_lower_bound, CASE WHEN event_id % 3 = 1 THEN value + CAST(10 AS DOUBLE) END AS users_upper_bound,
 CASE WHEN event_id % 3 = 2 THEN value END AS mau_lower_bound, CASE WHEN event_id % 3 = 2 THEN value + CAST(20 AS DOUBLE) END AS mau_upper_bound FROM events""",
    "fx_map": """SELECT CASE WHEN s_or_c = 0 THEN 'M1' ELSE 'M2' END AS map, id, lon, lat, wealth FROM (
 SELECT 0 AS s_or_c, CAST(c_custkey AS BIGINT) AS id, CAST(29 AS DOUBLE) + CAST((c_custkey * 7919) % 997 AS DOUBLE) / CAST(997 AS DOUBLE) AS lon,
 CAST(-1 AS DOUBLE) + CAST((c_custkey * 104729) % 991 AS DOUBLE) / CAST(991 AS DOUBLE) AS lat, (c_acctbal + CAST(1000 AS DOUBLE)) / CAST(110 AS DOUBLE) AS wealth FROM customer
 UNION ALL SELECT 1, CAST(p_partkey AS BIGINT), CAST(29 AS DOUBLE) + CAST((p_partkey * 7919 + p_partkey % 2) % 997 AS DOUBLE) / CAST(997 AS DOUBLE) + CAST(0.00005 AS DOUBLE),
 CAST(-1 AS DOUBLE) + CAST((p_partkey * 104729) % 991 AS DOUBLE) / CAST(991 AS DOUBLE), p_retailprice / CAST(20 AS DOUBLE) FROM part) u""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A stand-in table over the Parquet tables of ``sf_dir``."""
    sql, used = VIEWS[name], {}
    for t in TABLES:
        new = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", sql)
        if new != sql:
            sql, used[t] = new, table(spark, sf_dir, t)
    return spark.sql(sql, **used)


def with_views(sql: str) -> str:
    """A DuckDB statement, with the stand-in tables that it names defined first."""
    named = [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]
    if not named:
        return sql
    heads = ",\n".join(f"{v} AS ({VIEWS[v].replace('AS STRING', 'AS VARCHAR')})" for v in named)
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {heads},\n{body[14:]}"
    return f"WITH {heads},\n{body[4:]}" if body.upper().startswith("WITH ") else f"WITH {heads}\n{body}"
