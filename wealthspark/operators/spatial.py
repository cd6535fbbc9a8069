"""Spatial joins as equi-joins on grid cells. Tables have points in metres (x, y), see ``functions.geo.projected``."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..sources.tables import cut
from . import leaves
from .cells import cell, touched, walked
from .cover import held

def near(left: DataFrame, right: DataFrame, half: float) -> DataFrame:
    """All pairs with both coordinate differences at most ``half`` metres (edges belong to the box). Left columns, then right columns.

    A left row goes to the cells (at most 3 x 3, of side ``2 * half``) that its box touches, a right row to its own: an equi-join.
    """
    size = 2.0 * half
    gx, gy = touched(F.col("x"), F.col("y"), F.lit(float(half)), size)
    a = left.withColumn("gx", F.explode(gx)).withColumn("gy", F.explode(gy)).alias("a")
    b = right.withColumns({"gx": cell(F.col("x"), size), "gy": cell(F.col("y"), size)}).alias("b")
    joined = a.join(b, (F.col("a.gx") == F.col("b.gx")) & (F.col("a.gy") == F.col("b.gy")))
    inside = F.col("b.x").between(F.col("a.x") - half, F.col("a.x") + half) & F.col("b.y").between(F.col("a.y") - half, F.col("a.y") + half)
    return joined.filter(inside)


def box_aggregate(
    places: DataFrame, points: DataFrame, id: str, halves: dict[str, float], make: Callable[[str, Callable[[Column], Column]], dict[str, Column]]
) -> DataFrame:
    """JN13, AG3: for each place and each box, aggregates of the points in the box; all boxes from one join on the largest.

    ``halves``: label -> half the box's side. ``make(label, inside)`` gives the aggregates of one box by name; ``inside(column)`` is NULL
    for points outside it. The points' columns are those of ``b``, their planar distance is ``distance``. Places with empty boxes are kept
    (NULL; wrap sums and counts in ``coalesce`` outside).
    """
    pairs = near(places.select(id, "x", "y"), points, max(halves.values()))
    dx, dy = F.col("a.x") - F.col("b.x"), F.col("a.y") - F.col("b.y")
    pairs = pairs.withColumns({"reach": F.greatest(F.abs(dx), F.abs(dy)), "distance": F.sqrt(dx * dx + dy * dy)})
    aggs = {}
    for label, half in halves.items():
        aggs |= make(label, lambda column, half=half: F.when(F.col("reach") <= half, column))
    found = pairs.groupBy(F.col(f"a.{id}").alias(id)).agg(*[c.alias(n) for n, c in aggs.items()])
    return places.select(id).join(found, id, "left")


def find_in_square(places: DataFrame, points: DataFrame, id: str, width: float, columns: list[str]) -> DataFrame:
    """JN14: the points in the square of side ``width`` around each place, with their distance."""
    pairs = near(places.select(id, "x", "y"), points, width / 2)
    d = geo.distance(F.col("a.x"), F.col("a.y"), F.col("b.x"), F.col("b.y"))
    return pairs.select(F.col(f"a.{id}").alias(id), *[F.col(f"b.{c}").alias(c) for c in columns], d.alias("distance"))


#: Points of a leaf, and distances that a task looks at at once.
LEAF, PAIRS = 1024, 1 << 21


def _closest(items: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, pa.Array] | None:
    if not items:
        return None
    columns = [pa.chunked_array([b.column(n) for b in items]) for n in ("x", "y", "right")]
    return columns[0].to_numpy(), columns[1].to_numpy(), columns[2].combine_chunks()


def _ranked(ties: str) -> Callable[[tuple | None, pa.RecordBatch], Iterator[pa.RecordBatch]]:
    """Of a leaf's points (by right_id) the nearest for each row, if not further than its ``distance``; ``one`` marks a row's first."""

    def work(held: tuple | None, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if held is None:
            return
        rx, ry, right = held
        x, y, reach = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("x", "y", "distance"))
        step = max(1, PAIRS // len(rx))
        for k in range(0, len(x), step):
            dx, dy = x[k : k + step, None] - rx, y[k : k + step, None] - ry
            square = dx * dx + dy * dy
            least = square.min(axis=1)
            row, at = np.nonzero(square <= (least * (1 + 1e-15))[:, None])  # distances may tie where squares do not
            d = np.sqrt(square[row, at])
            same = (d == np.sqrt(least)[row]) & ~(d > reach[k : k + step][row])
            row, at, d = row[same], at[same], d[same]
            one = np.diff(row, prepend=-1) != 0
            if ties == "lowest":
                row, at, d, one = row[one], at[one], d[one], one[one]
            if len(row):
                back = pa.array(row + k)
                yield pa.record_batch([*(batch.column(n).take(back) for n in ("id", "x", "y")), right.take(pa.array(at)), pa.array(d), pa.array(one)], ["id", "x", "y", "right", "distance", "one"])

    return work


def _nearest(left: DataFrame, right: DataFrame, ties: str) -> DataFrame | None:
    """(id, right, distance) that hold the nearest ``right`` (right.right_id, x, y) of each row of ``left`` (id, x, y); None without points.

    A row first meets the points of its own leaf. Only where another leaf's points lie within the distance found there (their bounds say so) it meets those too.
    """
    spark, left, right = left.sparkSession, leaves.there(left), cut(leaves.there(right))
    tree = leaves.planted(right, LEAF)
    if tree is None:
        return None
    least = lambda v: {f"{v}0": F.min(v), f"{v}1": F.max(v)}
    points = right.withColumn("leaf", leaves.leaf(tree))
    tree.bounded(leaves.bounds(leaves.per_leaf(tree, points, least("x") | least("y"))))
    shared = spark.sparkContext.broadcast(tree)
    kind, void = left.schema["id"].dataType, F.lit(None)
    items = points.select("leaf", F.lit(0).alias("kind"), void.cast(kind).alias("id"), "x", "y", "right", void.cast("double").alias("distance"))
    made = f"id {kind.simpleString()}, x double, y double, right {right.schema['right'].dataType.simpleString()}, distance double, one boolean"

    def found(rows: DataFrame) -> DataFrame:
        rows = rows.select("leaf", F.lit(1).alias("kind"), "id", "x", "y", void.cast(items.schema["right"].dataType).alias("right"), "distance")
        return leaves.by_leaf(items.union(rows), _closest, _ranked(ties), made, ["right.right_id"])

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 1024):
                batch = whole.slice(k, 1024)
                x, y, d = (batch.column(n).to_numpy() for n in ("x", "y", "distance"))
                reach = d * (1 + 1e-12)
                _, _, row, at = shared.value.met(x - reach, x + reach, y - reach, y + reach, whole=False)
                away = at != shared.value.leaves(x, y)[row]
                row, at = pa.array(row[away]), pa.array(at[away], pa.int32())
                yield pa.record_batch([at, *(batch.column(n).take(row) for n in ("id", "x", "y", "distance"))], ["leaf", "id", "x", "y", "distance"])

    first = cut(found(left.select("id", "x", "y", void.cast("double").alias("distance")).withColumn("leaf", leaves.leaf(tree))))
    more = first.filter("one").select("id", "x", "y", "distance").mapInArrow(others, f"leaf int, id {kind.simpleString()}, x double, y double, distance double")
    return first.unionByName(found(more)).select("id", "right", "distance")


def nearest(
    left: DataFrame, right: DataFrame, id: str, right_id: str, columns: tuple[str, ...] = (), ties: str = "all", most: float | None = None, how: str = "left"
) -> DataFrame:
    """JN7, JN9, JN10, JN12: for each left row the nearest right row(s) and the ``distance``.

    ``ties``: "all" keeps every right row at the least distance, "lowest" the one with the smallest id. ``most``: no further than this.
    ``how``: "left" keeps rows without a match (NULL), "inner" drops them. Without ``most`` rows look into the leaves of a tree over the right rows: work
    grows with the rows, however dense they are.
    """
    order = [F.col("distance")] if ties == "all" else [F.col("distance"), F.col(right_id)]
    best = F.rank() if ties == "all" else F.row_number()
    todo, wanted = left.select(id, "x", "y"), (right_id, *columns)
    if most is None:
        held = F.struct(*[F.col(c).alias("right_id" if c == right_id else c) for c in wanted]).alias("right")
        double = [F.col(v).cast("double").alias(v) for v in "xy"]
        out = _nearest(todo.select(F.col(id).alias("id"), *double), right.select(held, *double), ties)
        if out is None:
            out = todo.limit(0).crossJoin(right.select(*wanted).limit(0)).withColumn("distance", F.lit(None).cast("double")).drop("x", "y")
        else:
            out = out.select(F.col("id").alias(id), *[F.col("right")["right_id" if c == right_id else c].alias(c) for c in wanted], "distance")
    else:
        pairs = near(todo, right.select(*wanted, "x", "y"), float(most))
        d = geo.distance(F.col("a.x"), F.col("a.y"), F.col("b.x"), F.col("b.y"))
        out = pairs.select(F.col(f"a.{id}").alias(id), *[F.col(f"b.{c}").alias(c) for c in wanted], d.alias("distance")).filter(F.col("distance") <= most)
    # the rank is limited before the shuffle too
    out = out.withColumn("place", best.over(Window.partitionBy(id).orderBy(*order))).filter("place = 1").drop("place")
    return left.select(id).join(out, id, "left") if how == "left" else out


def one_per_geometry(df: DataFrame, id: str) -> DataFrame:
    """JN8: of rows with equal coordinates the one with the smallest id (distinct places that share coordinates merge, as in the source)."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy("x", "y").orderBy(id))).filter("place = 1").drop("place")


def mutual_nearest(left: DataFrame, right: DataFrame, id: str, right_id: str, most: float) -> DataFrame:
    """JN11: pairs within ``most``: first each left row's nearest, then each right row's nearest of those (ties: the smaller ids)."""
    pairs = nearest(left, right, id, right_id, ties="lowest", most=most, how="inner")
    again = F.row_number().over(Window.partitionBy(right_id).orderBy("distance", id))
    return pairs.withColumn("place", again).filter("place = 1").drop("place")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): the smallest id that links reach. Labels fall along links and by jumps until none changes."""
    both = cut(links.select(F.col(a).alias("id"), F.col(b).alias("other")).union(links.select(b, a)).distinct())
    labels = cut(both.groupBy("id").agg(F.least(F.col("id"), F.min("other")).alias("component")))
    while True:
        near_labels = both.join(labels.toDF("other", "label"), "other").groupBy("id").agg(F.min("label").alias("label"))
        new = labels.join(near_labels, "id").select("id", F.least("component", "label").alias("component"), F.col("component").alias("old"))
        new = new.join(labels.toDF("component", "further"), "component", "left")
        new = cut(new.select("id", F.least("component", F.coalesce("further", "component")).alias("component"), "old"))
        labels = new.select("id", "component")
        if new.filter("component <> old").isEmpty():
            return labels


def towers(cells: DataFrame, id: str = "cell_id", eps: float = 10.0) -> DataFrame:
    """GX3: antennas no more than ``eps`` metres apart, directly or in a chain, are one tower; its id is the smallest antenna id."""
    points = cells.select(id, "x", "y")
    pairs = near(points, points, eps)
    close = pairs.filter((F.col(f"a.{id}") < F.col(f"b.{id}")) & (geo.distance(F.col("a.x"), F.col("a.y"), F.col("b.x"), F.col("b.y")) <= eps))
    found = components(close.select(F.col(f"a.{id}").alias("a"), F.col(f"b.{id}").alias("b")))
    named = found.withColumnsRenamed({"id": id, "component": "tower_id"})
    return cells.join(named, id, "left").withColumn("tower_id", F.coalesce("tower_id", id))


def point_in_polygon(points: DataFrame, polygons: DataFrame, id: str, name: str = "name", order: str = "poly_id", lon: str = "lon", lat: str = "lat") -> DataFrame:
    """JN15: the name of the first polygon (by ``order``) that holds the point, else 'unknown'.

    ``polygons``: order, name, rings (array of arrays of (lon, lat)); edges are outside, holes too. See ``cover`` for the join.
    """
    hits = held(points.select(id, lon, lat), polygons, [order, name], lon, lat)
    first = hits.groupBy(id).agg(F.min_by(F.col(f"_of_{name}"), F.col(f"_of_{order}")).alias("found"))
    return points.join(first, id, "left").withColumn("country", F.coalesce("found", F.lit("unknown"))).drop("found")


#: AG4: what a name of an aggregate in a zonal aggregation means. Sums of empty polygons are 0, counts too, the rest NULL.
ZONAL = {
    "mean": F.avg,
    "std": F.stddev_samp,
    "sum": lambda c: F.coalesce(F.sum(c), F.lit(0.0)),
    "min": F.min,
    "max": F.max,
    "nunique": F.countDistinct,
    "mode": lambda c: F.mode(c, True),
    "count": F.count,
}


def zonal(points: DataFrame, polygons: DataFrame, column: str, functions: list[str] | dict[str, Column], id: str = "poly_id", lon: str = "lon", lat: str = "lat") -> DataFrame:
    """JN16, AG4, JN17, GX12: every polygon with aggregates of the points in it, named ``{column}_{function}``; a dict of columns is used as it is."""
    inside = held(points, polygons, [id], lon, lat).withColumnRenamed(f"_of_{id}", id)
    named = functions if isinstance(functions, dict) else {f"{column}_{f}": ZONAL[f](F.col(column)) for f in functions}
    got = polygons.select(id).join(inside, id, "left").groupBy(id).agg(*[c.alias(n) for n, c in named.items()])
    return polygons.join(got, id)


def segment_crossings(segments: DataFrame, id: str = "seg_id", road: str | None = None, size: float = 500.0, snap: float = geo.SNAP) -> DataFrame:
    """JN18: pairs (a < b) of segments (x1, y1, x2, y2) that have a point in common, and where: a, b, x, y. Touching ends count, see ``geo.met``.

    ``road``: the column of the road; pairs of one road do not count and the roads are added as road_a, road_b. A segment goes to the cells that it
    passes; a pair belongs to the cell of its point, so it is found once. ``size``: the cells' side, about a segment's length.
    """
    kept = [id, "x1", "y1", "x2", "y2", *([road] if road else [])]
    cells = cut(walked(segments.select(*kept), size, 4 * snap))  # both sides read it
    first, second = (cells.select("gx", "gy", *[F.col(c).alias(f"{c}_{t}") for c in kept]) for t in "ab")
    pairs = first.join(second, ["gx", "gy"]).filter(F.col(f"{id}_a") < F.col(f"{id}_b"))
    if road:
        pairs = pairs.filter(~F.col(f"{road}_a").eqNullSafe(F.col(f"{road}_b")))
    for v in "xy":
        for t, u in ("ab", "ba"):
            pairs = pairs.filter(F.greatest(f"{v}1_{t}", f"{v}2_{t}") >= F.least(f"{v}1_{u}", f"{v}2_{u}") - 2 * snap)
    pairs = geo.met(pairs, *[tuple(f"{c}_{t}" for c in ("x1", "y1", "x2", "y2")) for t in "ab"], snap=snap)
    pairs = pairs.withColumn("met", F.explode(F.array("met")))  # keeps the filter below from being put in front, with the whole expression in it
    here = (cell(F.col("met.x"), size) == F.col("gx")) & (cell(F.col("met.y"), size) == F.col("gy"))
    names = [F.col(f"{road}_{t}").alias(f"road_{t}") for t in "ab"] if road else []
    return pairs.filter(here).select(F.col(f"{id}_a").alias("a"), F.col(f"{id}_b").alias("b"), *names, F.col("met.x").alias("x"), F.col("met.y").alias("y"))


def junctions(segments: DataFrame, road: str = "road_id", id: str = "seg_id", size: float = 500.0, snap: float = geo.SNAP) -> DataFrame:
    """JN18: where roads meet, a row for each junction and road: x, y, the road's column. Points that agree to ten times ``snap`` are one junction.

    A stretch that two roads share is a junction in the middle of each pair of segments that lie on each other there.
    """
    met = segment_crossings(segments, id, road, size, snap)
    same = lambda v: F.round(F.col(v) / (10 * snap)) * (10 * snap)
    each = met.select(same("x").alias("x"), same("y").alias("y"), F.explode(F.array("road_a", "road_b")).alias(road))
    return each.distinct()


def segments_in_square(places: DataFrame, segments: DataFrame, id: str, width: float, columns: list[str]) -> DataFrame:
    """JN14 for segments: for each place the segments that have a point in the square of side ``width`` around it; a segment may come once for each cell."""
    half = width / 2
    gx, gy = touched(F.col("x"), F.col("y"), F.lit(half), width)
    a = places.select(id, "x", "y").withColumn("gx", F.explode(gx)).withColumn("gy", F.explode(gy)).alias("a")
    b = walked(segments.select(*columns, "x1", "y1", "x2", "y2"), width, geo.SNAP).alias("b")
    joined = a.join(b, (F.col("a.gx") == F.col("b.gx")) & (F.col("a.gy") == F.col("b.gy")))
    joined = joined.filter(geo.meets_box(*[F.col(f"b.{c}") for c in ("x1", "y1", "x2", "y2")], F.col("a.x"), F.col("a.y"), half))
    return joined.select(F.col(f"a.{id}").alias(id), F.col("a.x").alias("x"), F.col("a.y").alias("y"), *[F.col(f"b.{c}").alias(c) for c in columns])
