"""Geometry as column expressions: web-mercator metres, boxes, distances, ellipsoidal lengths and areas, segments, rings."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RADIUS = 6378137.0
FLATTENING = 1 / 298.257223563
MILE = 1609.34


def to_x(lon: Column) -> Column:
    """SC1: degrees of longitude to web-mercator metres."""
    return F.lit(RADIUS) * F.radians(lon)


def to_y(lat: Column) -> Column:
    """SC1: degrees of latitude to web-mercator metres."""
    return F.lit(RADIUS) * F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2))


def to_lon(x: Column) -> Column:
    return F.degrees(x / F.lit(RADIUS))


def to_lat(y: Column) -> Column:
    return F.degrees(2 * F.atan(F.exp(y / F.lit(RADIUS))) - F.lit(math.pi / 2))


def projected(df: DataFrame, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """The table with its points in metres, columns x and y."""
    return df.withColumns({"x": to_x(F.col(lon)), "y": to_y(F.col(lat))})


def box(lon: Column, lat: Column, width: Column | float) -> Column:
    """SC2: the square of this width (metres) around a point, as degrees (south, west, north, east)."""
    x, y, h = to_x(lon), to_y(lat), (width if isinstance(width, Column) else F.lit(float(width))) / 2
    return F.struct(to_lat(y - h).alias("south"), to_lon(x - h).alias("west"), to_lat(y + h).alias("north"), to_lon(x + h).alias("east"))


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """SC3: planar distance of projected points."""
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))


def geodesic(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """SC4: WGS84 length between two points by Lambert's formula for long lines. Equal points: 0. Relative error about 1e-5."""
    b1, b2 = (F.atan((1 - FLATTENING) * F.tan(F.radians(v))) for v in (lat1, lat2))
    dlon = F.radians(lon2 - lon1)
    h = F.pow(F.sin((b2 - b1) / 2), 2) + F.cos(b1) * F.cos(b2) * F.pow(F.sin(dlon / 2), 2)
    s = 2 * F.asin(F.least(F.lit(1.0), F.sqrt(h)))
    p, q = (b1 + b2) / 2, (b2 - b1) / 2
    x = (s - F.sin(s)) * F.try_divide(F.pow(F.sin(p), 2) * F.pow(F.cos(q), 2), F.pow(F.cos(s / 2), 2))
    y = (s + F.sin(s)) * F.try_divide(F.pow(F.cos(p), 2) * F.pow(F.sin(q), 2), F.pow(F.sin(s / 2), 2))
    return F.when(s == 0, F.lit(0.0)).otherwise(RADIUS * (s - FLATTENING / 2 * (x + y)))


def polyline_length(points: Column) -> Column:
    """SC4: WGS84 length of an array of (lon, lat) points; fewer than two points: 0."""
    n = F.size(points)
    steps = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.struct(F.try_element_at(points, i).alias("a"), F.try_element_at(points, i + 1).alias("b")))
    return F.when(n < 2, F.lit(0.0)).otherwise(F.aggregate(steps, F.lit(0.0), lambda acc, s: acc + geodesic(s["a"]["lon"], s["a"]["lat"], s["b"]["lon"], s["b"]["lat"])))


def polygon_area(ring: Column) -> Column:
    """SC5: WGS84 area of a ring of (lon, lat) points: shoelace on metres of the ellipsoid at the ring's first latitude. Fewer than three points: NULL."""
    lat0 = F.radians(ring[0]["lat"])
    e2 = FLATTENING * (2 - FLATTENING)
    w = 1 - e2 * F.pow(F.sin(lat0), 2)
    kx, ky = RADIUS * F.cos(lat0) / F.sqrt(w), RADIUS * (1 - e2) / F.pow(w, 1.5)
    n = F.size(ring)

    def cross(i: Column) -> Column:
        a, b = F.element_at(ring, i), F.element_at(ring, i % n + 1)
        o = ring[0]
        return F.radians(a["lon"] - o["lon"]) * F.radians(b["lat"] - o["lat"]) - F.radians(b["lon"] - o["lon"]) * F.radians(a["lat"] - o["lat"])

    return F.when(n >= 3, F.abs(F.aggregate(F.sequence(F.lit(1), n), F.lit(0.0), lambda acc, i: acc + cross(i))) / 2 * kx * ky)


def to_segment(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """SC6: distance from a point to the nearest point of a segment; a segment of length 0 is its point."""
    dx, dy = x2 - x1, y2 - y1
    t = F.coalesce(F.try_divide((px - x1) * dx + (py - y1) * dy, dx * dx + dy * dy), F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    return distance(px, py, x1 + t * dx, y1 + t * dy)


#: Coordinates this close to a line are on it: a thousandth of a metre for projected points.
SNAP = 1e-3


def _side(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column, snap: float) -> Column:
    """-1 or 1: on which side of the line from a to b the point c lies; 0 on it (closer than ``snap``). All points are on a line of length 0."""
    det = (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)
    return F.when(F.abs(det) <= snap * distance(ax, ay, bx, by), F.lit(0)).otherwise(F.signum(det).cast("int"))


def _in_box(px: Column, py: Column, a: tuple[Column, ...], snap: float) -> Column:
    within = lambda v, p, q: v.between(F.least(p, q) - snap, F.greatest(p, q) + snap)
    return within(px, a[0], a[2]) & within(py, a[1], a[3])


def met(pairs: DataFrame, a: tuple[str, ...], b: tuple[str, ...], name: str = "met", snap: float = SNAP) -> DataFrame:
    """SC7: adds where two segments, columns (x1, y1, x2, y2), have a point in common: a struct of x and y, NULL if they have none.

    Where an end of one lies on the other it is that end, exactly as given, so that all segments of a shared node meet in equal points. Segments that
    lie on each other meet in the middle of what they share. A segment of length 0 is its point.
    """
    a, b = (tuple(F.col(c) for c in s) for s in (a, b))
    dx, dy, ex, ey = a[2] - a[0], a[3] - a[1], b[2] - b[0], b[3] - b[1]
    along = lambda x, y: F.try_divide((x - a[0]) * dx + (y - a[1]) * dy, dx * dx + dy * dy)
    pairs = pairs.withColumns(
        {
            "_b1": _side(*a, b[0], b[1], snap),
            "_b2": _side(*a, b[2], b[3], snap),
            "_a1": _side(*b, a[0], a[1], snap),
            "_a2": _side(*b, a[2], a[3], snap),
            "_t1": along(b[0], b[1]),
            "_t2": along(b[2], b[3]),
            "_cross": F.try_divide((b[0] - a[0]) * ey - (b[1] - a[1]) * ex, dx * ey - dy * ex),
        }
    )
    pairs = pairs.withColumns({"_low": F.greatest(F.least("_t1", "_t2"), F.lit(0.0)), "_high": F.least(F.greatest("_t1", "_t2"), F.lit(1.0))})
    flat = (F.col("_b1") == 0) & (F.col("_b2") == 0) & (F.col("_a1") == 0) & (F.col("_a2") == 0)
    ends = [("_b1", b[0], b[1], a), ("_b2", b[2], b[3], a), ("_a1", a[0], a[1], b), ("_a2", a[2], a[3], b)]
    kind = F.when(flat & ((F.col("_high") - F.col("_low")) * distance(*a) > snap), 0)
    for k, (side, x, y, other) in enumerate(ends, 1):
        kind = kind.when((F.col(side) == 0) & _in_box(x, y, other, snap), k)
    pairs = pairs.withColumn("_kind", kind.when((F.col("_a1") * F.col("_a2") < 0) & (F.col("_b1") * F.col("_b2") < 0), 5))
    share = F.when(F.col("_kind") == 0, (F.col("_low") + F.col("_high")) / 2).otherwise(F.col("_cross"))
    chosen = lambda k, d: F.coalesce(*[F.when(F.col("_kind") == n, (x, y)[k]) for n, (_, x, y, _) in enumerate(ends, 1)], a[k] + share * d)
    point = F.when(F.col("_kind").isNotNull(), F.struct(chosen(0, dx).alias("x"), chosen(1, dy).alias("y")))
    return pairs.withColumn(name, point).drop("_b1", "_b2", "_a1", "_a2", "_t1", "_t2", "_cross", "_low", "_high", "_kind")


def meets_box(x1: Column, y1: Column, x2: Column, y2: Column, x: Column, y: Column, half: float) -> Column:
    """Whether a segment and the square reaching ``half`` to each side of (x, y) have a point in common (edges belong to it)."""
    near = (F.least(x1, x2) <= x + half) & (F.greatest(x1, x2) >= x - half) & (F.least(y1, y2) <= y + half) & (F.greatest(y1, y2) >= y - half)
    dx, dy = x2 - x1, y2 - y1
    return near & (F.abs((x - x1) * dy - (y - y1) * dx) <= half * (F.abs(dx) + F.abs(dy)))  # not all corners on one side


def vertices(seq: Column, lon: Column, lat: Column, least: int = 1) -> Column:
    """SC8 (aggregate): the points in sequence order; NULL if fewer than ``least`` (4 for a closed ring)."""
    points = F.array_sort(F.collect_list(F.struct(seq.alias("seq"), lon.alias("lon"), lat.alias("lat"))))
    return F.when(F.size(points) >= least, points)


def in_ring(px: Column, py: Column, ring: Column) -> Column:
    """Even-odd rule for a point and an array of (lon, lat) points."""
    n = F.size(ring)

    def odd(i: Column) -> Column:
        a, b = F.element_at(ring, i), F.element_at(ring, i % n + 1)
        hit = ((a["lat"] > py) != (b["lat"] > py)) & (px < a["lon"] + F.try_divide((b["lon"] - a["lon"]) * (py - a["lat"]), b["lat"] - a["lat"]))
        return F.when(hit, 1).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda acc, i: acc + odd(i)) % 2 == 1


def on_ring(px: Column, py: Column, ring: Column) -> Column:
    """Whether the point is on an edge of the ring."""
    n = F.size(ring)

    def on(i: Column) -> Column:
        a, b = F.element_at(ring, i), F.element_at(ring, i % n + 1)
        line = (b["lon"] - a["lon"]) * (py - a["lat"]) == (b["lat"] - a["lat"]) * (px - a["lon"])
        return line & px.between(F.least(a["lon"], b["lon"]), F.greatest(a["lon"], b["lon"])) & py.between(F.least(a["lat"], b["lat"]), F.greatest(a["lat"], b["lat"]))

    return F.exists(F.sequence(F.lit(1), n), on)


def in_polygon(px: Column, py: Column, rings: Column) -> Column:
    """Strictly inside: by the even-odd rule over all rings, so that holes are outside; edges are outside too."""
    odd = F.aggregate(rings, F.lit(False), lambda acc, ring: acc != in_ring(px, py, ring))
    return odd & ~F.exists(rings, lambda ring: on_ring(px, py, ring))
