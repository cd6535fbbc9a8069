"""Relocation of survey clusters to populated places."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import cut
from . import spatial
from .pyramid import box_sums
from .sampling import mixed, numbered

#: The displacement of survey positions in metres by settlement (0 urban, 1 rural), the extra reach, the share of rows that may use it.
MOST = {0: 2000.0, 1: 5000.0}
EXTRA = {0: 0.0, 1: 10000.0}
ALLOWED = {0: 0.0, 1: 0.01}
OPTIONS = ("none", "rc", "ruc")


def unmoved(clusters: DataFrame) -> DataFrame:
    """REL0."""
    return clusters.withColumns({"OSMID": F.lit(None).cast("long"), "pplace_cluster_distance": F.lit(0.0), "pplace_rural": F.lit(None).cast("int")})


def candidates(clusters: DataFrame, places: DataFrame, rural: int) -> DataFrame:
    """WN4: places of the same settlement in the square of side most + extra around each cluster, with their distance."""
    side = MOST[rural] + EXTRA[rural]
    near = spatial.find_in_square(clusters.filter(F.col("rural") == rural), places.filter(F.col("rural") == rural), "cluster_id", side, ["OSMID"])
    return near.select("cluster_id", "OSMID", "distance")


def assign(pairs: DataFrame) -> DataFrame:
    """JN27: one-to-one assignment of clusters to places, as if clusters came one by one in the order (number of candidates, id) and took their nearest free place (ties: smaller OSMID).

    All places rank clusters alike, so deferred acceptance gives the same result in rounds: each cluster asks its best place of those left,
    each place holds the first of those that have asked, the others lose it. It ends when none has lost.
    A cluster that loses a place moves on in its ranked list, past all places that are held by one before it; only such clusters ask again, and what a round
    writes is what they ask for.
    """
    mine = Window.partitionBy("cluster_id")
    ranked = pairs.withColumns({"n": F.count(F.lit(1)).over(mine), "place": F.row_number().over(mine.orderBy("distance", "OSMID"))})
    ranked = cut(ranked)
    columns = ["OSMID", "n", "cluster_id", "place", "distance"]
    asking = ranked.filter("place = 1").select(columns)
    rounds: list[DataFrame] = []  # who asked for what; of those that ever asked for a place the first holds it
    first = lambda rows: rows.groupBy("OSMID").agg(F.min(F.struct(*columns[1:])).alias("best")).select("OSMID", "best.*")
    while True:
        asked = cut(asking)
        rounds = [*rounds, asked] if len(rounds) < 8 else [cut(reduce(DataFrame.union, rounds)), asked]
        every = reduce(DataFrame.union, rounds)
        held = first(every)
        if asked.isEmpty():
            return held.select("cluster_id", "OSMID", "distance")
        last = every.groupBy("cluster_id").agg(F.max(F.struct("place", "OSMID")).alias("last")).select("cluster_id", F.col("last.place").alias("lost"), "last.OSMID")
        out = last.join(held.select("OSMID", F.col("cluster_id").alias("holder")), "OSMID").filter("cluster_id <> holder").select("cluster_id", "lost")
        # the next place in the list that is free or held by one that comes later; holders only ever come earlier
        rest = ranked.join(out, "cluster_id").filter("place > lost").join(held.select("OSMID", F.struct("n", "cluster_id").alias("holder")), "OSMID", "left")
        rest = rest.filter(F.col("holder").isNull() | (F.struct("n", "cluster_id") < F.col("holder")))
        asking = rest.groupBy("cluster_id").agg(F.min(F.struct("place", "OSMID", "n", "distance")).alias("next")).select("next.OSMID", "next.n", "cluster_id", "next.place", "next.distance")


#: Places that a cluster's first list has, about.
LISTED = 8


def _listed(going: DataFrame, places: DataFrame, held: DataFrame | None) -> DataFrame:
    """(cluster_id, n, OSMID, distance): the places of each cluster's ring (beyond ``least``, up to ``reach``) and square that are free or held by a later cluster."""
    levels = [r["k"] for r in going.select("k").distinct().collect()]  # a few powers of two
    half = F.when(F.col("rural") == 0, (MOST[0] + EXTRA[0]) / 2).otherwise((MOST[1] + EXTRA[1]) / 2)
    reach = 2 * half / F.pow(F.lit(2.0), F.col("k"))
    at = lambda v: F.floor(v / (2 * F.col("reach"))).cast("long")
    a = going.withColumns({"half": half, "reach": reach})
    for v, g in (("x", "gx"), ("y", "gy")):
        a = a.withColumn(g, F.explode(F.sequence(at(F.col(v) - F.col("reach")), at(F.col(v) + F.col("reach")))))
    b = places.select("OSMID", "rural", F.col("x").alias("px"), F.col("y").alias("py"), F.explode(F.array(*map(F.lit, levels))).alias("k")).withColumn("reach", reach)
    b = b.withColumns({"gx": at(F.col("px")), "gy": at(F.col("py"))}).drop("reach")
    pairs = a.join(b, ["rural", "k", "gx", "gy"]).withColumn("distance", spatial.geo.distance(F.col("x"), F.col("y"), F.col("px"), F.col("py")))
    square = [F.col(f"p{v}").between(F.col(v) - F.col("half"), F.col(v) + F.col("half")) for v in "xy"]
    pairs = pairs.filter(square[0] & square[1] & (F.col("distance") > F.col("least")) & (F.col("distance") <= F.col("reach"))).select("cluster_id", "n", "OSMID", "distance")
    return pairs if held is None else _open(pairs, held)


def _open(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """Pairs whose place is free or held by a later cluster; holders only ever come earlier."""
    out = pairs.join(held.select("OSMID", F.struct("n", "cluster_id").alias("holder")), "OSMID", "left")
    return out.filter(F.col("holder").isNull() | (F.struct("n", "cluster_id") < F.col("holder"))).select(pairs.columns)


def assign_near(clusters: DataFrame, places: DataFrame) -> DataFrame:
    """JN27: what ``assign`` gives for all places of the same settlement in each cluster's square (see ``candidates``), without a table of all pairs.

    The numbers of candidates are box sums. Clusters have lists of the nearest few places only; one that finds all of them held by earlier clusters gets
    those of a ring twice as wide that are not, up to its whole square. ``clusters``: cluster_id, rural, x, y; ``places``: OSMID, rural, x, y.
    """
    spots = clusters.select("cluster_id", "rural", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    counted = []
    for rural in MOST:
        own = [t.filter(F.col("rural") == rural) for t in (spots, places)]
        counted.append(box_sums(*own, "cluster_id", {"square": (MOST[rural] + EXTRA[rural]) / 2}, {"n": F.lit(1)}))
    k = F.greatest(F.floor(F.log2(F.col("n") * (math.pi / LISTED)) / 2), F.lit(0)).cast("int")
    going = cut(spots.join(reduce(DataFrame.union, counted).withColumnRenamed("n_in_square", "n").filter("n > 0"), "cluster_id").withColumns({"k": k, "least": F.lit(-1.0)}))
    places = cut(places.select("OSMID", "rural", "x", "y"))
    columns = ["OSMID", "n", "cluster_id", "distance"]
    first = lambda rows: rows.groupBy("OSMID").agg(F.min(F.struct(*columns[1:])).alias("best")).select("OSMID", "best.*")
    next_one = lambda rows: rows.groupBy("cluster_id").agg(F.min(F.struct("distance", "OSMID", "n")).alias("next")).select("next.OSMID", "next.n", "cluster_id", "next.distance")
    lists: list[DataFrame] = []
    rounds: list[DataFrame] = []  # who asked for what, as in ``assign``
    held = rings = None
    while True:
        lists = [*lists, cut(_listed(going, places, held))]
        asked = cut(next_one(lists[-1]))
        while not asked.isEmpty():
            rounds = [*rounds, asked] if len(rounds) < 8 else [cut(reduce(DataFrame.union, rounds)), asked]
            every = reduce(DataFrame.union, rounds)
            held = cut(first(every))
            last = every.groupBy("cluster_id").agg(F.max(F.struct("distance", "OSMID")).alias("lost"))
            out = last.join(held.select(F.col("OSMID").alias("_of"), F.col("cluster_id").alias("holder")), F.col("lost.OSMID") == F.col("_of")).filter("cluster_id <> holder").select("cluster_id", "lost")
            rest = reduce(DataFrame.union, lists).join(out, "cluster_id").filter(F.struct("distance", "OSMID") > F.col("lost")).drop("lost")
            asked = cut(next_one(_open(rest, held)))
        # each cluster's widest ring so far; those that lost a place to a cluster of this ring may need their next one too
        widest = F.min_by(F.struct(*[c for c in going.columns if c != "cluster_id"]), "k").alias("ring")
        rings = going if rings is None else cut(rings.unionByName(going).groupBy("cluster_id").agg(widest).select("cluster_id", "ring.*"))
        left = rings if held is None else rings.join(held, "cluster_id", "left_anti")
        reach = 2 * F.when(F.col("rural") == 0, (MOST[0] + EXTRA[0]) / 2).otherwise((MOST[1] + EXTRA[1]) / 2) / F.pow(F.lit(2.0), F.col("k"))
        going = cut(left.filter("k > 0").withColumn("least", reach).withColumn("k", F.col("k") - 1).select(going.columns))
        if going.isEmpty():
            return (first(lists[0]).limit(0) if held is None else held).select("cluster_id", "OSMID", "distance")


def relocate(clusters: DataFrame, places: DataFrame, option: str = "rc", strict_global: bool = True) -> DataFrame:
    """REL1, REL2: 'none', 'rc' (rural only) or 'ruc' (both), per settlement and, newest first, per year.

    ``strict_global``: a place taken for one year is not taken again for another; else each year starts with all places free. Clusters without a free place keep
    their location. ``clusters``: cluster_id, year, rural, x, y; ``places``: OSMID, rural, x, y.
    """
    if option not in OPTIONS:
        raise ValueError(f"option must be one of {OPTIONS}")
    if option == "none":
        return unmoved(clusters)
    years = sorted((r["year"] for r in clusters.select("year").distinct().collect()), reverse=True)  # a handful
    moving, done = clusters.filter("rural = 1") if option == "rc" else clusters, None
    for year in years:
        free = places if done is None or not strict_global else places.join(done, "OSMID", "left_anti")
        # settlements share neither clusters nor places: one assignment serves both
        got = cut(assign_near(moving.filter(F.col("year") == year), free))
        done = got if done is None else done.union(got)
    if done is None:  # no clusters
        return unmoved(clusters)
    out = clusters.join(done.withColumnRenamed("distance", "pplace_cluster_distance"), "cluster_id", "left")
    return out.withColumns({"pplace_cluster_distance": F.coalesce("pplace_cluster_distance", F.lit(0.0)), "pplace_rural": F.when(F.col("OSMID").isNotNull(), F.col("rural"))})


def within_allowance(df: DataFrame, id: str = "cluster_id", rural: str = "rural", distance: str = "pplace_cluster_distance", seed: int = 0, order=None) -> DataFrame:
    """REL3, SO5: of each settlement, at most round(share * n) rows may be beyond its displacement; a random surplus goes back to where it was.

    The surplus is found among the rows beyond only, ranked by a seeded hash.
    """
    most = F.when(F.col(rural) == 0, MOST[0]).otherwise(MOST[1])
    share = F.when(F.col(rural) == 0, ALLOWED[0]).otherwise(ALLOWED[1])
    sizes = df.groupBy(rural).agg(F.count(F.lit(1)).alias("n")).select(rural, F.round(F.col("n") * share).alias("may"))
    beyond = numbered(df.filter(F.col(distance) > most), mixed(id, seed) if order is None else order, id, "k", [rural]).select(id, rural, "k")
    back = beyond.join(F.broadcast(sizes), rural).filter(F.col("k") > F.col("may")).select(id, F.lit(True).alias("back"))  # two rows
    out = df.join(back, id, "left").withColumn("back", F.coalesce("back", F.lit(False)))
    reset = {c: F.when(~F.col("back"), F.col(c)) for c in ("OSMID", "pplace_rural") if c in df.columns}
    return out.withColumns(reset | {distance: F.when(F.col("back"), 0.0).otherwise(F.col(distance))}).drop("back")


def distance_distribution(df: DataFrame, rural: str = "rural", distance: str = "pplace_cluster_distance", width: float = 1000.0, bins: int = 10) -> DataFrame:
    """REL5: by settlement, how many rows moved so far: bins of ``width`` metres, the last one open; count and mean of each."""
    bin = F.least(F.floor(F.col(distance) / width), F.lit(bins - 1)).cast("int").alias("bin")
    return df.groupBy(rural, bin).agg(F.count(F.lit(1)).alias("n"), F.avg(distance).alias("mean"))


def grouped(df: DataFrame, keys: list[str], targets: tuple[str, ...] = ("mean_wi", "std_wi")) -> DataFrame:
    """REL4: means of the targets per place; missing keys are one group."""
    return df.groupBy(*keys).agg(*[F.avg(t).alias(t) for t in targets], F.count(F.lit(1)).alias("n"))
