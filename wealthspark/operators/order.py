"""Running totals and ranks over a whole table, or over large groups, without putting a group into one task."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import cut


def beside(left: DataFrame, right: DataFrame, keys: Iterable[str]) -> DataFrame:
    """Inner join on ``keys``, where NULL equals NULL; without keys every row meets the (one-row) right table."""
    keys = list(keys)
    other = right.withColumnsRenamed({k: f"_of_{k}" for k in keys})
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys], F.lit(True))
    return left.join(other, on).drop(*[f"_of_{k}" for k in keys])


def running(df: DataFrame, order: str, columns: dict[str, str], by: Iterable[str] = ()) -> DataFrame:
    """For each name the sum of a column over all rows of the group up to and with this one in ``order`` (distinct values within a group).

    Rows are dealt by ranges of group and ``order``, so a large group lies in several ranges; each range's sum is added to those after it (a row per
    group and range), and a window runs inside a range.
    """
    by = list(by)
    dealt = cut(df.repartitionByRange(*by, order).withColumn("_range", F.spark_partition_id()))
    sums = dealt.groupBy(*by, "_range").agg(*[F.sum(c).alias(f"_{n}") for n, c in columns.items()])
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*by, "_range", *[F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_{n}") for n in columns])
    inside = Window.partitionBy(*by, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = beside(dealt, starts, [*by, "_range"]).withColumns({n: F.sum(c).over(inside) + F.col(f"_{n}") for n, c in columns.items()})
    return out.drop("_range", *[f"_{n}" for n in columns])


def average_ranks(df: DataFrame, column: str, name: str, by: Iterable[str] = ()) -> DataFrame:
    """(by, column, name): the average rank of each distinct value within its group; missing values rank last."""
    by = list(by)
    counted = df.groupBy(*by, column).agg(F.count(F.lit(1)).alias("_k")).withColumn("_order", F.struct(F.col(column).isNull(), F.col(column)))
    upto = running(counted, "_order", {"_upto": "_k"}, by)
    return upto.select(*by, column, (F.col("_upto") - (F.col("_k") - 1) / 2).alias(name))


def percentiles(counted: DataFrame, value: str, times: str, shares: dict[str, float], by: Iterable[str] = ()) -> DataFrame:
    """(by, a column for each share): exact percentiles by linear interpolation, of distinct values and how often each stands in its group.

    The values at the ranks around a share are found by running counts, so no group is held in memory.
    """
    by = list(by)
    upto = running(counted.select(*by, value, times), value, {"_upto": times}, by)
    totals = counted.groupBy(*by).agg(F.sum(times).alias("_n"))
    ranked = beside(upto, totals, by)
    rank = {n: (F.col("_n") - 1) * F.lit(float(q)) for n, q in shares.items()}
    at = [F.min(F.when(F.col("_upto") > f(r), F.col(value))).alias(f"{side}_{n}") for n, r in rank.items() for side, f in (("low", F.floor), ("high", F.ceil))]
    found = ranked.groupBy(*by, "_n").agg(*at)
    between = {n: F.col(f"low_{n}") + (F.col(f"high_{n}") - F.col(f"low_{n}")) * (r - F.floor(r)) for n, r in rank.items()}
    return found.select(*by, *[c.alias(n) for n, c in between.items()])
