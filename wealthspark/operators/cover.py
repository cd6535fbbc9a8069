"""Points in polygons by a quad-tree cover: cells inside a polygon need no test, cells on its edge hold the few ring edges that pass them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..sources.tables import cut
from .cells import walked

#: Cells are opened into 4 x 4 while more than ``MOST`` edges pass them, ``LEVELS`` times at most.
MOST, LEVELS = 8, 4
MARGIN = 1e-9
#: Where in a cell its reference point is, as shares of its side; no corner of a grid of decimal coordinates falls there.
AT_X, AT_Y = 0.41421356237309503, 0.7320508075688772


def _crossed(x1: Column, y1: Column, x2: Column, y2: Column, rx: Column, ry: Column, px: Column, py: Column) -> Column:
    """How often the way from r to p, first along y and then along x, crosses an edge. An even number over all edges: both are inside, or both outside."""
    between = lambda v, a, b: (v > F.least(a, b)) & (v <= F.greatest(a, b))
    first = ((x1 > rx) != (x2 > rx)) & between(y1 + (rx - x1) * F.try_divide(y2 - y1, x2 - x1), ry, py)
    then = ((y1 > py) != (y2 > py)) & between(x1 + (py - y1) * F.try_divide(x2 - x1, y2 - y1), rx, px)
    return F.coalesce(first, F.lit(False)).cast("int") + F.coalesce(then, F.lit(False)).cast("int")


def _on(x1: Column, y1: Column, x2: Column, y2: Column, px: Column, py: Column) -> Column:
    """Whether the point is on an edge."""
    line = (x2 - x1) * (py - y1) == (y2 - y1) * (px - x1)
    return line & px.between(F.least(x1, x2), F.greatest(x1, x2)) & py.between(F.least(y1, y2), F.greatest(y1, y2))


def cover(polygons: DataFrame, keys: list[str], size: float = 1.0, rings: str = "rings") -> DataFrame:
    """(keys, level, gx, gy, inside, edges): the cells of each polygon. Level 0 has cells of ``size``, each further one a quarter of that.

    Cells without ``edges`` lie inside. For the others ``inside`` tells it of their reference point; a way inside the cell from there tells it of any of their points. Rings
    are taken apart once; an edge is kept in the cells that it passes. Holes are rings like others (even-odd rule).
    """

    def edges_of(ring: Column) -> Column:
        n = F.size(ring)
        corner = lambda i, k: (F.element_at(ring, i)["lon"].alias(f"x{k}"), F.element_at(ring, i)["lat"].alias(f"y{k}"))
        return F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(*corner(i, 1), *corner(i % n + 1, 2)))

    edges = polygons.select(*keys, F.explode(rings).alias("ring")).filter(F.size("ring") > 0).select(*keys, F.inline(edges_of(F.col("ring"))))
    edge = F.struct("x1", "y1", "x2", "y2")
    ry = (F.col("gy") + AT_Y) * size
    straddles = (F.col("y1") > ry) != (F.col("y2") > ry)
    x = F.col("x1") + (ry - F.col("y1")) * F.try_divide(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    crossing = F.when(straddles & (F.floor(x / size) == F.col("gx")), x)
    cells = walked(edges, size, MARGIN).groupBy(*keys, "gx", "gy").agg(F.collect_list(edge).alias("edges"), F.count(crossing).alias("k"), F.count_if(crossing > (F.col("gx") + AT_X) * size).alias("own"))
    row = Window.partitionBy(*keys, "gy").orderBy(F.desc("gx"))  # at most as many cells as the polygon's edge has in a row
    right = F.coalesce(F.sum("k").over(row.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = cut(cells.withColumns({"inside": (right + F.col("own")) % 2 == 1, "behind": (right % 2 == 1), "next": F.lag("gx").over(row)}))
    runs = cells.filter("behind AND next > gx + 1").select(*keys, F.lit(0).alias("level"), F.explode(F.sequence(F.col("gx") + 1, F.col("next") - 1)).alias("gx"), "gy", F.lit(True).alias("inside"))
    none = F.lit(None).cast(cells.schema["edges"].dataType)
    out = [runs.withColumn("edges", none)]
    here = cells.select(*keys, F.lit(0).alias("level"), "gx", "gy", "inside", "edges")
    for level in range(1, LEVELS + 1):
        out.append(here.filter(F.size("edges") <= MOST))
        wide, side = size / 4.0 ** (level - 1), size / 4.0**level
        child = here.filter(F.size("edges") > MOST).select(*keys, "gx", "gy", "inside", F.inline("edges"))
        child = child.withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(15))))
        child = child.withColumns({"cx": F.col("gx") * 4 + F.col("at") % 4, "cy": F.col("gy") * 4 + F.floor(F.col("at") / 4)})
        ends = [F.col(c) for c in ("x1", "y1", "x2", "y2")]
        crossed = _crossed(*ends, (F.col("gx") + AT_X) * wide, (F.col("gy") + AT_Y) * wide, (F.col("cx") + AT_X) * side, (F.col("cy") + AT_Y) * side)
        kept = F.when(geo.meets_box(*ends, (F.col("cx") + 0.5) * side, (F.col("cy") + 0.5) * side, side / 2 + MARGIN), edge)
        child = child.groupBy(*keys, "cx", "cy").agg((F.first("inside") != (F.sum(crossed) % 2 == 1)).alias("inside"), F.collect_list(kept).alias("edges"))
        child = child.select(*keys, F.lit(level).alias("level"), F.col("cx").alias("gx"), F.col("cy").alias("gy"), "inside", "edges")
        child = cut(child)
        out.append(child.filter(F.size("edges") == 0).filter("inside").withColumn("edges", none))
        here = child.filter(F.size("edges") > 0)
        if here.filter(F.size("edges") > MOST).isEmpty():
            break
    return reduce(DataFrame.unionByName, [*out, here])


def held(points: DataFrame, polygons: DataFrame, keys: list[str], lon: str = "lon", lat: str = "lat", size: float = 1.0) -> DataFrame:
    """Points with the keys of each polygon that holds them, strictly inside. A point goes to its cell of each level that the cover has."""
    cells = cut(cover(polygons, keys, size)).withColumnsRenamed({k: f"_of_{k}" for k in keys})
    levels = [r[0] for r in cells.select("level").distinct().collect()]  # at most LEVELS + 1
    near = points.withColumn("level", F.explode(F.array(*map(F.lit, sorted(levels))).cast("array<int>"))) if levels else points.withColumn("level", F.lit(0))
    scale = F.pow(F.lit(4.0), F.col("level")) / size
    near = near.withColumns({"gx": F.floor(F.col(lon) * scale), "gy": F.floor(F.col(lat) * scale), "_side": 1 / scale})
    met = near.join(cells, ["level", "gx", "gy"])
    shown = [*points.columns, *[f"_of_{k}" for k in keys]]
    whole = met.filter("edges IS NULL").select(shown)
    # on an edge cell: a row for each of its few edges, summed per point and polygon
    ends, px, py = [F.col(c) for c in ("x1", "y1", "x2", "y2")], F.col(lon), F.col(lat)
    near = cut(met.filter("edges IS NOT NULL").withColumn("_row", F.monotonically_increasing_id()))  # written, so that the numbers stay
    edge = near.select(*shown, "gx", "gy", "_side", "inside", "_row", F.inline("edges"))
    crossed = _crossed(*ends, (F.col("gx") + AT_X) * F.col("_side"), (F.col("gy") + AT_Y) * F.col("_side"), px, py)
    judged = edge.groupBy("_row").agg(F.first("inside").alias("inside"), F.sum(crossed).alias("crossed"), F.max(_on(*ends, px, py)).alias("on"), *[F.first(c).alias(c) for c in shown])
    return whole.unionByName(judged.filter("NOT on AND inside <> (crossed % 2 = 1)").select(shown))
