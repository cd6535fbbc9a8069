"""Hand cases of what a plain port would get wrong."""

import math
import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from wealthspark import catalog
from wealthspark.fixtures import table, view
from wealthspark.functions import geo, wealth
from wealthspark.operators import features, metrics, relocate, sampling, spatial, stats, survey, tables
from wealthspark.operators.order import running
from wealthspark.sources import files
from wealthspark.streaming import answers


def values(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_empty_box_and_distance_zero(spark):
    places = spark.createDataFrame([(1, 0.0, 0.0), (2, 1e6, 1e6)], "place_id long, x double, y double")
    tiles = spark.createDataFrame([(7, 0.0, 0.0, 5.0)], "tile_id long, x double, y double, population double")
    row = {r["place_id"]: r for r in features.population(places, tiles).collect()}
    assert row[1]["distance_closest_tile"] == 0 and row[1]["population_closest_d"] is None  # no division by zero
    assert row[2]["population_in_10km"] == 0 and row[2]["population_closest_tile"] == 5
    assert row[2]["distance_closest_tile"] == pytest.approx(math.hypot(1e6, 1e6))  # found on a coarser grid


def test_nearest_keeps_ties(spark):
    left = spark.createDataFrame([(1, 0.0, 0.0)], "a long, x double, y double")
    right = spark.createDataFrame([(5, 10.0, 0.0), (4, -10.0, 0.0), (9, 0.0, 11.0)], "b long, x double, y double")
    assert values(spatial.nearest(left, right, "a", "b"), "b") == [(4,), (5,)]
    assert values(spatial.nearest(left, right, "a", "b", ties="lowest"), "b") == [(4,)]
    assert values(spatial.nearest(left, right.limit(0), "a", "b"), "a", "b") == [(1, None)]


def test_box_edges_belong(spark):
    left = spark.createDataFrame([(1, 0.0, 0.0)], "a long, x double, y double")
    right = spark.createDataFrame([(5, 1000.0, -1000.0), (6, 1000.1, 0.0)], "b long, x double, y double")
    assert values(spatial.find_in_square(left, right, "a", 2000.0, ["b"]), "b") == [(5,)]


def test_towers_are_chains(spark):
    cells = spark.createDataFrame([(3, 0.0, 0.0), (1, 9.0, 0.0), (2, 18.0, 0.0), (8, 100.0, 0.0)], "cell_id long, x double, y double")
    assert values(spatial.towers(cells), "cell_id", "tower_id") == [(1, 1), (2, 1), (3, 1), (8, 8)]


def test_polygon_with_hole_and_edge(spark):
    ring = lambda *p: [{"lon": float(a), "lat": float(b)} for a, b in p]
    rings = [ring((0, 0), (4, 0), (4, 4), (0, 4)), ring((1, 1), (3, 1), (3, 3), (1, 3))]
    concave = [ring((10, 0), (14, 0), (14, 4), (12, 1), (10, 4))]
    polys = spark.createDataFrame([(1, "hole", rings, 0.0, 0.0, 4.0, 4.0), (2, "dent", concave, 10.0, 0.0, 14.0, 4.0)], "poly_id int, name string, rings array<array<struct<lon:double,lat:double>>>, x0 double, y0 double, x1 double, y1 double")
    points = spark.createDataFrame([(1, 0.5, 0.5), (2, 2.0, 2.0), (3, 0.0, 2.0), (4, 12.0, 3.0), (5, 12.0, 0.5)], "id long, lon double, lat double")
    assert values(spatial.point_in_polygon(points, polys, "id"), "id", "country") == [(1, "hole"), (2, "unknown"), (3, "unknown"), (4, "unknown"), (5, "dent")]


def test_geodesic_known_values(spark):
    row = spark.range(1).select(geo.geodesic(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.0)).alias("equator"), geo.geodesic(F.lit(5.0), F.lit(5.0), F.lit(5.0), F.lit(5.0)).alias("none")).first()
    assert row["equator"] == pytest.approx(111319.49, rel=1e-5) and row["none"] == 0


def test_iwi_rules(spark):
    betas = {"constant": 10.0, "cheap": 1.0, "expensive": 2.0, "hv208": 5.0, "hv201": {"1": -1.0, "2": 0.0, "3": 3.0}, "hv216": {"1": 1.0, "2": 2.0, "3": 4.0}}
    names = ["hv208", "hv209", "hv221", "hv210", "hv212", "hv243e", "hv211", "hv243d", "hv243a", "hv201", "hv216"]
    rows = [(0, 0, 0, 0, 0, 0, 0, 0, 0, 50, 0), (1, 0, 0, 0, 0, 0, 0, 0, 0, 96, 5), (0, 0, 0, 0, 1, 0, 0, 0, None, 1, 2)]
    df = spark.createDataFrame(rows, ", ".join(f"{n} int" for n in names)).withColumns({"hv201_tier": F.when(F.col("hv201") == 50, 3), "hv205_tier": F.lit(1), "hv213_tier": F.lit(None).cast("int")})
    got = [r[0] for r in df.select(wealth.iwi(betas)).collect()]
    assert got == [10 + 3 + 1, 10 + 5 + 0 + 4 + 1, 10 + 0 + 2 + 2 + 1]  # code 96 adds nothing; expensive brings cheap


def test_single_household_has_deviation_zero(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 1.0), (2, 3.0)], "c int, iwi double")
    assert values(survey.cluster_scores(df, ["c"]), "c", "std_iwi", "counts") == [(1, 0.0, 1), (2, math.sqrt(2), 2)]


def test_edge_weight_rules(spark):
    day = "2020-01-06 00:00:00"
    rows = [(1, 2, day, None, 1.0), (1, 2, day, 1.0, 1.0), (1, 2, day, 3.0, 1.0), (1, 2, day, 2.0, 1.0), (5, 6, day, 1.0, 1.0), (7, 8, day, 2.0, 1.0), (7, 8, day, 4.0, 1.0)]
    moves = spark.createDataFrame(rows, "start_node long, end_node long, date_time string, n_baseline double, length_km double").withColumn("date_time", F.col("date_time").cast("timestamp"))
    assert values(features.edge_weights(moves), "source", "weight") == [(1, 2.0), (5, 1.0), (7, 2.0)]  # ties of a mode: the smallest


def test_pagerank_sums_to_one(spark):
    edges = spark.createDataFrame([(1, 2, 1.0), (2, 3, 2.0), (3, 1, 1.0), (3, 4, 1.0)], "source long, target long, weight double").withColumn("distance", F.lit(1.0))
    assert features.pagerank(edges).agg(F.sum("rank")).first()[0] == pytest.approx(1.0)


def test_gini(spark):
    df = spark.createDataFrame([("a", 3.0), ("a", 3.0), ("b", 0.0), ("b", 1.0), ("n", -1.0), ("n", 1.0)], "g string, v double")
    got = dict(values(metrics.gini(df, "v", ["g"]), "g", "gini"))
    assert got["a"] == pytest.approx(0, abs=1e-9) and got["b"] == pytest.approx(0.5, abs=1e-6) and got["n"] == pytest.approx(0.5, abs=1e-6)


def test_r2_documented_example(spark):
    df = spark.createDataFrame([(1, 2.0, 1.0), (1, 4.0, 4.0), (1, 4.0, 3.0)], "g int, t double, p double")
    assert metrics.weighted_r2(df, ["g"], "t", "p").first()["r2"] == pytest.approx(1 - 2 / (8 / 3))


def test_rank_ties_and_missing(spark):
    df = spark.createDataFrame([(1, 2.0), (2, 2.0), (3, None), (4, 5.0)], "id long, v double")
    assert values(metrics.average_rank(df, "v"), "id", "rank") == [(1, 1.5), (2, 1.5), (3, 4.0), (4, 3.0)]
    assert metrics.average_rank(df, "v").filter("best").count() == 1


def test_wrapping_hours(spark):
    events = spark.createDataFrame([(1, 23), (2, 5), (3, 6)], "id long, hour int")
    table = spark.createDataFrame([("night", 22, 6)], "interval string, start int, end int")
    assert values(metrics.hour_interval(events, table), "id", "interval") == [(1, "night"), (2, "night"), (3, None)]


def test_recency_first_rule_wins(spark):
    names = ["UG_2016_oldest_x", "UG_2016_all_none", "UG_2016_all300_x_y", "UG2018_all300_none", "UG_2016_all_x_y", "UG2018_all_none", "none"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in df.select(wealth.recency(F.col("n"))).collect()] == ["O-N", "ON", "O300", "N300", "O", "N", None]


def test_malformed_lines(spark):
    df = spark.createDataFrame([("LINESTRING (1.123456 2, 3 4)",), ("nothing",), (None,)], "t string")
    got = [r[0] for r in df.select(wealth.wkt_ends(F.col("t"))).collect()]
    assert tuple(got[0]) == ("POINT (1.12346 2.0)", "POINT (3.0 4.0)") and tuple(got[1]) == (None, None)


def test_assignment_is_serial_dictatorship(spark):
    rng = np.random.default_rng(3)
    pairs = [(int(c), int(p), float(rng.integers(1, 50))) for c in range(25) for p in rng.choice(18, 4, replace=False)]
    got = dict(values(relocate.assign(spark.createDataFrame(pairs, "cluster_id long, OSMID long, distance double")), "cluster_id", "OSMID"))
    free, want = set(range(18)), {}
    n = {c: sum(p[0] == c for p in pairs) for c in range(25)}
    for c in sorted(range(25), key=lambda c: (n[c], c)):
        options = sorted((d, p) for k, p, d in pairs if k == c and p in free)
        if options:
            want[c] = options[0][1]
            free.discard(options[0][1])
    assert got == want


def test_missing_place_keys_group_together(spark):
    df = spark.createDataFrame([(None, 1.0, 1.0), (None, 3.0, 1.0), (5, 2.0, 2.0)], "osmid long, mean_wi double, std_wi double")
    assert values(relocate.grouped(df, ["osmid"]), "osmid", "mean_wi") == [(5, 2.0), (None, 2.0)]


def test_quotas_and_folds_partition(spark):
    df = sampling.seeded(spark.range(103).select(F.col("id"), (F.col("id") % 7).alias("ses")), [1, 2])
    split = sampling.folds(sampling.stratified(df, "ses", "id", 0.8, ("seed",)), "ses", "id", 5, ("seed",)).collect()
    for seed in (1, 2):
        rows = [r for r in split if r["seed"] == seed]
        assert len(rows) == 103 and all((r["fold"] is None) == (r["is_test"] == 1) for r in rows)
        assert {r["fold"] for r in rows if r["is_test"] == 0} == {1, 2, 3, 4}


def test_tests_on_aggregates(spark):
    assert stats.incomplete_beta(2, 3, 0.4) == pytest.approx(0.5248)
    assert stats.student_quantile(0.975, 10) == pytest.approx(2.228139, abs=1e-5)
    w, p = stats.shapiro_wilk(np.array([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236], float))
    assert w == pytest.approx(0.79, abs=0.01) and p == pytest.approx(0.0067, abs=0.002)


def test_small_groups_and_long_groups_of_shapiro(spark):
    df = spark.range(60).select((F.col("id") % 3).alias("g"), F.sin("id").alias("v")).filter("g < 2 OR id < 6")
    got = {r["g"]: r for r in stats.shapiro(df, ["g"], "v", most=19).collect()}
    assert got[0]["w"] is None and got[2]["w"] is None


def test_feature_families():
    names = ["cells_in_2km", "distance_closest_tile", "FBM_x", "bank", "mean_wi", "NTLL_sum"]
    assert tables.feature_names(names, "OCI,FBP") == ["cells_in_2km", "distance_closest_tile"]
    assert tables.feature_names(names, "all") == ["FBM_x", "NTLL_sum", "bank", "cells_in_2km", "distance_closest_tile"]


def test_zip_folder(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("one.csv", "a,b\n1,2\n3,4\n")
        z.writestr("two.csv", "b,c\n5,6\n")
        z.writestr("read me.txt", "a,b\n9,9\n")
    (tmp_path / "broken.zip").write_bytes(b"no zip")
    for path in (str(tmp_path), f"file://{tmp_path}"):
        assert values(files.read_zips(spark, path, ["a", "b"]), "member", "a", "b") == [("one.csv", "1", "2"), ("one.csv", "3", "4"), ("two.csv", None, "5")]
    (tmp_path / "none").mkdir()
    assert files.read_zips(spark, f"{tmp_path}/none", ["a"]).count() == 0


def test_zip_members_are_partitions(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "many.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for k in range(12):
            z.writestr(f"m{k}.csv", "v\n" + f"{k}\n" * 25_000)
    got = files.read_zips(spark, str(tmp_path), ["v"])
    assert got.select(F.spark_partition_id()).distinct().count() == 12 and values(got.groupBy("v").count(), "v", "count") == sorted((str(k), 25_000) for k in range(12))


def test_stream_and_table_agree(spark, tmp_path):
    schema = "event_id long, place_id long, profile string, users double, users_lower_bound double, users_upper_bound double"
    first = [(1, 1, "m", 4.0, None, None), (2, 1, "m", None, 1.0, 3.0), (3, 2, "m", None, None, None)]
    second = [(1, 1, "m", 4.0, None, None), (4, 1, "m", 9.0, None, None), (5, 3, "f", 7.0, None, None)]
    files.append_json(spark.createDataFrame(first, schema), f"{tmp_path}/in")
    assert answers.table(spark, f"{tmp_path}/out") is None

    def run():
        answers.serve(answers.arriving(spark, f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/state", once=True).awaitTermination()
        return values(answers.table(spark, f"{tmp_path}/out"), "place_id", "active_users", "answers")

    assert run() == [(1, 3.0, 2), (2, None, 1)]
    files.append_json(spark.createDataFrame(second, schema), f"{tmp_path}/in")  # the stream was stopped; one answer comes again
    assert run() == [(1, 5.0, 3), (2, None, 1), (3, 7.0, 1)]
    assert run() == [(1, 5.0, 3), (2, None, 1), (3, 7.0, 1)]


def test_upserts(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame(list(r), "k long, v int")
    now = lambda: values(answers.table(spark, path), "k", "v")
    path = str(tmp_path / "t")
    answers.upsert(spark, rows(*[(k, 0) for k in range(50)]), path, ("k",), 1, parts=4)
    answers.upsert(spark, rows((3, 3), (99, 9)), path, ("k",), 2, parts=4)
    want = sorted([(k, 0) for k in range(50) if k != 3] + [(3, 3), (99, 9)], key=str)
    assert now() == want
    answers.upsert(spark, rows((3, 3), (99, 9)), path, ("k",), 2, parts=4)  # a batch that is written again
    assert now() == want
    for n in range(3, 8):
        answers.upsert(spark, rows((3, n)), path, ("k",), n, parts=4)
    assert now() == sorted([(k, v) if k != 3 else (3, 7) for k, v in want], key=str)
    assert len(list((tmp_path / "t").glob("version=*/part=*"))) <= 8
    (tmp_path / "t/version=9/part=0").mkdir(parents=True)  # a version that was never completed
    assert now() == sorted([(k, v) if k != 3 else (3, 7) for k, v in want], key=str)


def test_every_order_is_a_segment(spark, data):
    orders = {r[0] for r in table(spark, data, "orders").select("o_orderkey").collect()}
    assert {r[0] for r in view(spark, data, "fx_segment").select("seg_id").collect()} == orders
    places = {r[0] for r in view(spark, data, "fx_place").select("place_id").collect()}
    got = {r[0] for r in catalog.QUERIES["SC6_point_to_segment"](spark, data).select("place_id").collect()}
    assert got <= places & orders and len(got) > 0.9 * len(places & orders)  # a segment without length has no distance


def test_transfer_takes_all_ordered_pairs(spark, data):
    countries = {r[0] for r in view(spark, data, "fx_place").select("ccode").collect()}
    got = {tuple(r) for r in catalog.QUERIES["ML7_transfer"](spark, data).select("source", "target").collect()}
    assert got == {(a, b) for a in countries for b in countries if a != b}


def test_running_totals_over_ranges_of_groups(spark):
    rows = [(g, v, 1) for g in ("a", "b", None) for v in range(200)]
    got = running(spark.createDataFrame(rows, "g string, v int, k int").repartition(7), "v", {"n": "k"}, ["g"]).collect()
    assert len(got) == 600 and all(r["n"] == r["v"] + 1 for r in got)


def test_ranks_of_groups_with_missing_values(spark):
    rows = [("a", 1.0, 9), ("a", 1.0, 8), ("a", None, 1), (None, 2.0, 1), (None, None, 2), ("b", None, 1)]
    got = metrics.average_rank(spark.createDataFrame(rows, "g string, v double, id int"), "v", ["g"])
    assert values(got, "g", "id", "rank", "best") == sorted([("a", 9, 1.5, False), ("a", 8, 1.5, True), ("a", 1, 3.0, False), (None, 1, 1.0, True), (None, 2, 2.0, False), ("b", 1, 1.0, True)], key=str)


def test_spearman_and_anderson_by_hand(spark):
    rng = np.random.default_rng(5)
    x = rng.integers(0, 9, 120).astype(float)
    y = x + rng.integers(0, 9, 120)
    df = spark.createDataFrame([("g", float(a), float(b)) for a, b in zip(x, y)], "g string, x double, y double")
    rank = lambda v: np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v])
    assert stats.spearman(df, ["g"], "x", "y").first()["r"] == pytest.approx(np.corrcoef(rank(x), rank(y))[0, 1])
    z = (np.sort(y) - y.mean()) / y.std(ddof=1)
    low, i, n = np.array([0.5 * math.erfc(-v / math.sqrt(2)) for v in z]), np.arange(1, 121), 120
    want = -n - ((2 * i - 1) * (np.log(low) + np.log(1 - low[::-1]))).sum() / n
    assert stats.anderson_darling(df, ["g"], "y").first()["a2"] == pytest.approx(want)
    assert stats.spearman(df.limit(0), ["g"], "x", "y").count() == 0


def test_nearest_far_away_with_ties(spark):
    rng = random.Random(3)
    spot = lambda: (rng.choice([-2e7, -5e6, 0.0, 3e3, 1.9e7]) + rng.randrange(-50, 50) * 100.0, rng.randrange(-40, 40) * 5e5)
    left, right = [(i, *spot()) for i in range(120)], [(i, *spot()) for i in range(60)]
    right += [(100 + i, x, y) for i, x, y in right[:5]]  # repeated positions
    got = spatial.nearest(spark.createDataFrame(left, "a long, x double, y double"), spark.createDataFrame(right, "b long, x double, y double"), "a", "b")
    expected = []
    for a, x, y in left:
        distances = {b: math.sqrt((x - u) ** 2 + (y - v) ** 2) for b, u, v in right}
        expected += [(a, b) for b, d in distances.items() if d == min(distances.values())]
    assert values(got, "a", "b") == sorted(expected, key=str)


def test_assignment_is_the_serial_one(spark):
    rng = random.Random(5)
    pairs = [(c, o, float(rng.randrange(6))) for c in range(60) for o in rng.sample(range(45), rng.randrange(1, 7))]
    options = {c: sorted((d, o) for k, o, d in pairs if k == c) for c in range(60)}
    taken, expected = set(), []
    for c in sorted(options, key=lambda c: (len(options[c]), c)):
        free = [o for _, o in options[c] if o not in taken]
        if free:
            taken.add(free[0])
            expected.append((c, free[0]))
    got = relocate.assign(spark.createDataFrame(pairs, "cluster_id long, OSMID long, distance double"))
    assert values(got, "cluster_id", "OSMID") == sorted(expected, key=str)


def test_relocation_of_no_clusters(spark):
    clusters = spark.createDataFrame([], "cluster_id long, year int, rural int, x double, y double")
    places = spark.createDataFrame([(1, 1, 0.0, 0.0)], "OSMID long, rural int, x double, y double")
    got = relocate.relocate(clusters, places, "ruc")
    assert got.count() == 0 and {"OSMID", "pplace_cluster_distance", "pplace_rural"} <= set(got.columns)


MEETINGS = [
    ((0, 0, 4, 0), (2, -1, 2, 1), (2, 0)),  # inner points
    ((0, 0, 4, 0), (2, 0, 2, 5), (2, 0)),  # an end on the other
    ((0, 0, 4, 0), (4, 0, 9, 9), (4, 0)),  # a shared node
    ((4, 0, 0, 0), (4, 0, 9, 0), (4, 0)),  # on one line, a shared node
    ((0, 0, 4, 0), (5, 0, 9, 0), None),  # on one line, apart
    ((0, 0, 4, 0), (2, 0, 9, 0), (3, 0)),  # they share a stretch
    ((0, 0, 9, 9), (8, 8, 2, 2), (5, 5)),  # one lies in the other
    ((0, 0, 4, 0), (2, 1, 2, 5), None),
    ((0, 0, 4, 4), (5, 5, 9, 0), None),  # an end on the line, not on the segment
    ((2, 0, 2, 0), (0, 0, 4, 0), (2, 0)),  # a point
    ((2, 0, 2, 0), (2, 0, 2, 0), (2, 0)),
    ((2, 0, 2, 0), (3, 0, 3, 0), None),
    ((2, 1, 2, 1), (0, 0, 4, 0), None),
]


def test_meeting_segments(spark):
    names = [f"{t}{c}" for t in "ab" for c in ("x1", "y1", "x2", "y2")]
    rows = [(k, *map(float, a + b)) for k, (a, b, _) in enumerate(MEETINGS)]
    rows += [(k + 100, *map(float, b + a)) for k, (a, b, _) in enumerate(MEETINGS)]
    df = spark.createDataFrame(rows, "k int, " + ", ".join(f"{n} double" for n in names))
    got = {r["k"]: r["met"] and tuple(r["met"]) for r in geo.met(df, tuple(names[:4]), tuple(names[4:])).collect()}
    for k, (_, _, want) in enumerate(MEETINGS):
        assert got[k] == got[k + 100] == want, k


def test_junctions_are_of_roads(spark):
    rows = [(1, 1, 0, 0, 100, 0), (2, 1, 100, 0, 200, 0), (3, 2, 100, -100, 100, 0), (4, 2, 100, 0, 100, 100), (5, 3, 100, 0, 150, 50), (6, 4, 1e6, 0, 1e6 + 9, 0)]
    roads = spark.createDataFrame([(a, b, *map(float, c)) for a, b, *c in rows], "seg_id long, road_id long, x1 double, y1 double, x2 double, y2 double")
    for size in (7.0, 500.0):  # segments over many cells, all in one
        assert values(spatial.junctions(roads, size=size), "x", "y", "road_id") == [(100.0, 0.0, 1), (100.0, 0.0, 2), (100.0, 0.0, 3)]
        pairs = values(spatial.segment_crossings(roads, size=size), "a", "b")
        assert pairs == [(1, 2), (1, 3), (1, 4), (1, 5), (2, 3), (2, 4), (2, 5), (3, 4), (3, 5), (4, 5)]  # each once, also those of one road
    assert spatial.junctions(roads.limit(0)).count() == 0


@pytest.mark.parametrize("size", [0.37, 5.0])
def test_crossings_against_all_pairs(spark, size):
    """Steep, flat, long and short segments over and along the borders of cells."""
    r = random.Random(int(size * 100))
    rows = [(k, *(float(r.randrange(-12, 12)) / r.choice([1, 1, 3]) for _ in range(4))) for k in range(120)]
    df = spark.createDataFrame(rows, "seg_id long, x1 double, y1 double, x2 double, y2 double")
    every = df.toDF(*[f"{c}_a" for c in df.columns]).join(df.toDF(*[f"{c}_b" for c in df.columns]), F.expr("seg_id_a < seg_id_b"))
    ends = [tuple(f"{c}_{t}" for c in ("x1", "y1", "x2", "y2")) for t in "ab"]
    want = values(geo.met(every, *ends).filter("met IS NOT NULL"), "seg_id_a", "seg_id_b")
    assert len(want) > 300 and values(spatial.segment_crossings(df, size=size), "a", "b") == want


def test_roads_by_geometry(spark):
    """A road through the box with its nodes far outside counts, whole and once; its junctions too where both roads pass the box."""
    rows = [(1, 1, -900, 0, 900, 0), (2, 1, 900, 0, 900, 500), (3, 2, 0, -40, 0, 5000), (4, 3, 800, -50, 800, 50), (5, 4, 60, 60, 60, 90), (6, 5, 50, -90, 50, -41)]
    roads = spark.createDataFrame([(a, b, *map(float, c)) for a, b, *c in rows], "seg_id long, road_id long, x1 double, y1 double, x2 double, y2 double")
    roads = roads.withColumn("length", geo.distance(*[F.col(c) for c in ("x1", "y1", "x2", "y2")]))
    places = spark.createDataFrame([(1, 0.0, 10.0), (2, 9e5, 0.0)], "place_id long, x double, y double")
    got = features.roads_in_box(places, roads, side=100.0).collect()
    assert [tuple(r) for r in got] == [(1, 1800.0 + 500 + 5040, 0.0, 1, 10.0)]  # roads 1 and 2; road 5 ends below the box


def test_box_touches_segment(spark):
    cases = [((-9, 1, 9, 1), True), ((-9, 1.01, 9, 1.01), False), ((0, 2, 2, 0), True), ((0, 2.5, 2.5, 0), False), ((1, 1, 5, 5), True), ((0.1, 0.1, 0.2, 0.2), True), ((2, 0, 2, 0), False), ((1, 0, 1, 0), True)]
    df = spark.createDataFrame([(k, *map(float, c)) for k, (c, _) in enumerate(cases)], "k int, x1 double, y1 double, x2 double, y2 double")
    hit = geo.meets_box(*[F.col(c) for c in ("x1", "y1", "x2", "y2")], F.lit(0.0), F.lit(0.0), 1.0)
    assert [r[0] for r in df.orderBy("k").select(hit).collect()] == [h for _, h in cases]


def test_numbers_as_text(spark):
    numbers = [0.0, 1.5, -29.12345, 0.5, 0.001, 0.0005, -0.00012, 0.0001, 5e-05, -1.25e-05, 3e-10]
    df = spark.createDataFrame([(v,) for v in numbers], "v double")
    assert [r[0] for r in df.select(wealth.number_text(F.col("v"))).collect()] == [repr(v) for v in numbers]
    ends = wealth.wkt_ends(F.lit("LINESTRING (5e-05 0.00012, 1 2.5, -1.0E-4 7)"))
    assert spark.range(1).select(ends["start"], ends["end"]).first() == ("POINT (5e-05 0.00012)", "POINT (-0.0001 7.0)")


@pytest.mark.parametrize("seed,n", [(1, 400), (2, 60), (3, 2)])
def test_power_law_over_every_least_value(spark, seed, n):
    """A power-law tail above other values, with ties: the scan of all values by all values."""
    r = np.random.default_rng(seed)
    v = np.concatenate([r.uniform(0.1, 3, n), np.round(3 * r.pareto(1.7, n) + 3, 1), [-1.0, 0.0]])
    positive, best = np.sort(v[v > 0]), None
    for least in np.unique(positive):
        tail = positive[positive >= least]
        logs = np.log(tail / least).sum()
        if logs > 1e-9:
            alpha = 1 + len(tail) / logs
            distance = np.abs(np.searchsorted(tail, tail, "right") / len(tail) - (1 - (tail / least) ** (1 - alpha))).max()
            best = min(best or (9.0,), (distance, least, alpha, len(tail)))
    df = spark.createDataFrame([(float(x),) for x in v], "v double").repartition(3)
    for samples, block in ((128, 32), (3, 2)):
        got = stats.power_law(df, "v", samples, block).first()
        assert (got["distance"], got["least"], got["alpha"], got["n"]) == pytest.approx(best)
    assert stats.power_law(df.filter("v <= 0"), "v").count() == 0 and stats.power_law(df.filter("v < 0.2").limit(1), "v").count() == 0


def test_fits_read_a_written_table(spark, data):
    """Each pass of a fit reads the rows; they must not be joined anew every time."""
    from wealthspark.queries import jobs

    rows = jobs.matrix(spark, data)
    assert "Join" not in rows._jdf.queryExecution().toString()
    assert rows.count() == spark.read.parquet(f"{data}/customer.parquet").join(spark.read.parquet(f"{data}/embeddings.parquet"), F.expr("c_custkey = vec_id")).count()


def test_assignment_without_all_pairs(spark, monkeypatch):
    """Lists of few places that grow ring by ring give what the table of all pairs gives: crowds of clusters, ties, more clusters than places."""
    r = random.Random(6)
    monkeypatch.setattr(relocate, "LISTED", 2)
    spots = [(k, int(k % 4 > 0), float(r.randrange(-60, 60) * 100), float(r.randrange(-60, 60) * 100)) for k in range(60)] + [(100 + k, 1, 50.0 * k, 0.0) for k in range(20)] + [(200, 1, 1e6, 0.0)]
    places = [(k, int(k % 3 > 0), float(r.randrange(-60, 60) * 100), float(r.randrange(-60, 60) * 100)) for k in range(70)]
    clusters, towns = spark.createDataFrame(spots, "cluster_id long, rural int, x double, y double"), spark.createDataFrame(places, "OSMID long, rural int, x double, y double")
    want = values(relocate.assign(relocate.candidates(clusters, towns, 0).union(relocate.candidates(clusters, towns, 1))), "cluster_id", "OSMID", "distance")
    monkeypatch.setattr(relocate, "candidates", None)
    assert values(relocate.assign_near(clusters, towns), "cluster_id", "OSMID", "distance") == want and len(want) > 30
    assert relocate.relocate(clusters.withColumn("year", F.lit(2016)), towns, "ruc").filter("OSMID IS NOT NULL").count() == len(want)


def test_crossings_deal_a_segment_to_two_blocks(spark, data):
    """Before, each segment was dealt 50 times and each pair was judged in full."""
    made = catalog.QUERIES["SC7_segments_cross"](spark, data)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence" not in plan and "LeftSemi" in plan
    n = spark.read.parquet(f"{data}/orders.parquet").count()
    assert made.count() == n - 1 and made.filter("meets = 0 AND x IS NOT NULL").count() == 0
