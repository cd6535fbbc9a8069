"""Pyramid sums, polygon covers and exact percentiles against all pairs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wealthspark.functions import geo
from wealthspark.operators import cover, features, leaves, pyramid, spatial
from wealthspark.operators.order import percentiles


def values(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


@pytest.mark.parametrize("leaf", [1, 32])
def test_box_sums_against_all_pairs(spark, monkeypatch, leaf):
    """Crowds at one point, in a cell and far away; boxes whose edges hold items; small leaves open many levels."""
    monkeypatch.setattr(pyramid, "LEAF", leaf)
    r = random.Random(leaf)
    places = [(k, float(r.randrange(-50, 50)), float(r.randrange(-50, 50))) for k in range(25)] + [(90, 1e7, -1e7)]
    items = [(k, float(r.randrange(-80, 80)), float(r.randrange(-80, 80)), float(r.randrange(9))) for k in range(150)]
    items += [(1000 + k, 3.0, 4.0, 1.0) for k in range(100)] + [(2000 + k, 20 + r.random(), 20 + r.random(), 1.0) for k in range(100)]
    df = spark.createDataFrame(items, "item long, x double, y double, v double")
    got = pyramid.box_sums(spark.createDataFrame(places, "id long, x double, y double"), df, "id", {"a": 5.0, "b": 30.0}, {"v": F.col("v"), "n": F.lit(1)})
    want = []
    for k, x, y in places:
        inside = {h: [i for i in items if abs(i[1] - x) <= h and abs(i[2] - y) <= h] for h in (5.0, 30.0)}
        want.append((k, *(f(inside[h]) for h in (5.0, 30.0) for f in (lambda s: sum(i[3] for i in s), len))))
    assert values(got, "id", "v_in_a", "n_in_a", "v_in_b", "n_in_b") == sorted(want, key=str)


def test_box_sums_of_items_with_parts(spark, monkeypatch):
    """An item over the edge of a box or of a cell counts once, and only if one of its parts is in the box."""
    monkeypatch.setattr(pyramid, "LEAF", 2)
    r = random.Random(4)
    parts = [(k, x + r.choice([0, 0, 3, -7]), y + r.choice([0, 0, 12])) for k in range(120) for x, y in [(r.uniform(-60, 60), r.uniform(-60, 60))] for _ in range(r.randint(1, 4))]
    parts += [(500, -40.0, 0.0), (500, 40.0, 0.0), (500, 0.0, 55.0)]  # all around the first place, not in its box
    places = [(0, 0.0, 0.0)] + [(k, r.uniform(-50, 50), r.uniform(-50, 50)) for k in range(1, 20)]
    df = spark.createDataFrame(parts, "item long, x double, y double")
    got = pyramid.box_sums(spark.createDataFrame(places, "id long, x double, y double"), df.select("item").distinct(), "id", {"a": 8.0, "b": 25.0}, {"n": F.lit(1)}, df, "item")
    want = [(k, *(len({i for i, a, b in parts if abs(a - x) <= h and abs(b - y) <= h}) for h in (8.0, 25.0))) for k, x, y in places]
    assert values(got, "id", "n_in_a", "n_in_b") == sorted(want, key=str)
    assert values(pyramid.box_sums(spark.createDataFrame(places[:1], "id long, x double, y double"), df.select("item").limit(0), "id", {"a": 8.0}, {"n": F.lit(1)}, df, "item"), "n_in_a") == [(0,)]


def star(r, x, y, n, size):
    turn = [2 * math.pi * (k + r.random() * 0.8) / n for k in range(n)]
    return [{"lon": x + size * r.uniform(0.4, 1) * math.cos(t), "lat": y + size * r.uniform(0.4, 1) * math.sin(t)} for t in turn]


@pytest.mark.parametrize("size,most", [(1.0, 8), (0.7, 2), (13.0, 3)])
def test_cover_against_the_even_odd_rule(spark, monkeypatch, size, most):
    """Stars, holes, boxes on the lines of cells, points on edges and corners, polygons that overlap or lie in one cell."""
    monkeypatch.setattr(cover, "MOST", most)
    r = random.Random(int(size * 10))
    square = lambda x, y, s: [{"lon": float(a), "lat": float(b)} for a, b in ((x, y), (x + s, y), (x + s, y + s), (x, y + s))]
    rings = [[star(r, r.uniform(-4, 4), r.uniform(-4, 4), r.randint(3, 60), r.uniform(0.2, 4))] for _ in range(8)]
    rings += [[square(0, 0, 4), square(1, 1, 2)], [square(-3, -3, 1)], [square(-0.5, 2, 0.25)], [star(r, 0, 0, 300, 4), star(r, 0, 0, 50, 1.5)], []]
    polygons = spark.createDataFrame(list(enumerate(rings)), "poly_id int, rings array<array<struct<lon:double,lat:double>>>")
    points = [(r.uniform(-9, 9), r.uniform(-9, 9)) for _ in range(300)] + [(r.randrange(-16, 16) / 4, r.randrange(-16, 16) / 4) for _ in range(300)]
    points += [(c["lon"], c["lat"]) for p in rings for ring in p for c in ring[:6]]
    df = spark.createDataFrame([(k, *p) for k, p in enumerate(points)], "id long, lon double, lat double")
    got = values(cover.held(df, polygons, ["poly_id"], size=size), "id", "_of_poly_id")
    every = df.crossJoin(polygons).filter(geo.in_polygon(F.col("lon"), F.col("lat"), F.col("rings")))
    want = values(every, "id", "poly_id")
    assert got == want and len(want) > 200


def test_cover_keeps_whole_cells(spark):
    """Most of a large polygon is cells without edges; no edge cell that could be opened has many edges."""
    ring = [{"lon": 10 * math.cos(k / 500 * math.pi), "lat": 10 * math.sin(k / 500 * math.pi)} for k in range(1000)]
    polygons = spark.createDataFrame([(1, [ring])], "poly_id int, rings array<array<struct<lon:double,lat:double>>>")
    cells = cover.cover(polygons, ["poly_id"]).collect()
    area = sum(16.0 ** -c["level"] for c in cells if c["edges"] is None)
    assert 0.9 * 314 < area < 314.2 and max(len(c["edges"]) for c in cells if c["edges"] and c["level"] < cover.LEVELS) <= cover.MOST


def test_percentiles_are_exact(spark):
    r = np.random.default_rng(3)
    rows = [(g, float(v), int(k)) for g, n in (("a", 1), ("b", 2), ("c", 40), (None, 7)) for v, k in zip(r.permutation(100)[:n] / 8, r.integers(1, 6, n))]
    got = {x["g"]: x for x in percentiles(spark.createDataFrame(rows, "g string, v double, k long"), "v", "k", {"low": 0.33, "mid": 0.5, "top": 1.0, "least": 0.0}, ["g"]).collect()}
    for g in ("a", "b", "c", None):
        every = np.repeat([x[1] for x in rows if x[0] == g], [x[2] for x in rows if x[0] == g])
        assert [got[g][c] for c in ("low", "mid", "top", "least")] == pytest.approx(np.quantile(every, [0.33, 0.5, 1, 0]).tolist())


def test_night_lights_of_missing_values_and_empty_boxes(spark):
    places = spark.createDataFrame([(1, 0.0, 0.0), (2, 1e6, 0.0)], "place_id long, x double, y double")
    pixels = spark.createDataFrame([(0.0, 0.0, 20.0, 1.0), (1.0, 0.0, None, 1.0), (9.0, 0.0, 2.0, 1.0), (9.0, 1.0, 2.0, 3.0)], "x double, y double, avg_rad double, area double")
    got = {r["place_id"]: r for r in features.night_lights(places, pixels, halves={"s": 5.0, "l": 10.0}).collect()}
    assert (got[1]["NTLL_count_s"], got[1]["NTLL_mean_s"], got[1]["NTLL_count_l"], got[1]["NTLL_median_l"], got[1]["NTLL_share_lit_area_l"]) == (1, 20.0, 3, 2.0, 0.2)
    assert (got[2]["NTLL_count_l"], got[2]["NTLL_sum_l"]) == (0, None)


@pytest.mark.parametrize("ties", ["all", "lowest"])
def test_nearest_in_crowds(spark, monkeypatch, ties):
    """Rows look into leaves of a few points, not into fixed cells; crowds, repeated points, ties over leaves' edges, rows far away and without a position."""
    monkeypatch.setattr(spatial, "near", None)
    monkeypatch.setattr(spatial, "LEAF", 4)
    monkeypatch.setattr(leaves, "planted", lambda points, size: leaves.Tree(*(np.array([r[v] for r in points.collect()]) for v in "xy"), size))
    r = random.Random(8)
    right = [(k, float(r.randrange(40)), float(r.randrange(40))) for k in range(300)] + [(400 + k, 7.0, 7.0) for k in range(30)] + [(500, 1e6, -1e6), (501, None, 0.0)]
    left = [(f"p{k}", r.randrange(-20, 120) / 2, r.randrange(-20, 120) / 2) for k in range(400)] + [("far", -1e7, 2e7), ("none", None, 1.0)]
    got = spatial.nearest(spark.createDataFrame(left, "a string, x double, y double"), spark.createDataFrame(right, "b long, x double, y double"), "a", "b", ties=ties)
    want = []
    for a, x, y in left:
        d = {b: math.sqrt((x - u) ** 2 + (y - v) ** 2) for b, u, v in right if u is not None} if x is not None else {}
        best = sorted(b for b in d if d[b] == min(d.values()))
        want += [(a, b, d[b]) for b in (best if ties == "all" else best[:1])] or [(a, None, None)]
    assert values(got, "a", "b", "distance") == sorted(want, key=str)


def test_night_lights_make_no_pairs(spark, monkeypatch):
    """Against all pairs by numpy, in leaves of a few places, without a table of places and pixels."""
    monkeypatch.setattr(spatial, "near", None)
    monkeypatch.setattr(leaves, "planted", lambda points, size: leaves.Tree(*(np.array([r[v] for r in points.collect()]) for v in "xy"), 5))
    r = random.Random(11)
    spots, pixels = [(k, r.uniform(0, 40), r.uniform(0, 40)) for k in range(60)], [(float(r.randrange(40)), float(r.randrange(40)), float(r.randrange(30)), 1.0) for _ in range(500)]
    made = features.night_lights(spark.createDataFrame(spots, "place_id long, x double, y double"), spark.createDataFrame(pixels, "x double, y double, avg_rad double, area double"), halves={"s": 3.0, "l": 8.0})
    got = {row["place_id"]: row for row in made.collect()}
    for k, x, y in spots:
        for label, h in (("s", 3.0), ("l", 8.0)):
            v = np.array([p[2] for p in pixels if abs(p[0] - x) <= h and abs(p[1] - y) <= h])
            assert got[k][f"NTLL_count_{label}"] == len(v)
            if len(v):
                want = [np.median(v), v[v <= np.quantile(v, 0.33)].mean(), v[v >= np.quantile(v, 0.66)].mean(), (v >= 10).mean()]
                assert [got[k][f"NTLL_{n}_{label}"] for n in ("median", "mean_low", "mean_high", "share_lit_area")] == pytest.approx(want)
