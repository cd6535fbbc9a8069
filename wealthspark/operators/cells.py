"""Grid cells that make spatial joins equi-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cell(v: Column, size: float) -> Column:
    return F.floor(v / F.lit(float(size))).cast("long")


def touched(x: Column, y: Column, half: Column, size: float) -> list[Column]:
    """All cells that the box touches, as one generator column after another."""
    return [F.sequence(cell(x - half, size), cell(x + half, size)), F.sequence(cell(y - half, size), cell(y + half, size))]


def walked(segments: DataFrame, size: float, margin: float) -> DataFrame:
    """Each segment (x1, y1, x2, y2) in the cells that it passes, column by column (and those within ``margin``): columns gx, gy."""
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    out = segments.withColumn("gx", F.explode(F.sequence(cell(F.least(x1, x2) - margin, size), cell(F.greatest(x1, x2) + margin, size))))
    # the part of the segment in the column, as shares of its way
    ends = [F.try_divide(F.col("gx") * size + shift - x1, x2 - x1) for shift in (-margin, size + margin)]
    first, last = (F.least(F.greatest(F.coalesce(pick(*ends), F.lit(whole)), F.lit(0.0)), F.lit(1.0)) for pick, whole in ((F.least, 0.0), (F.greatest, 1.0)))
    ya, yb = y1 + first * (y2 - y1), y1 + last * (y2 - y1)
    return out.withColumn("gy", F.explode(F.sequence(cell(F.least(ya, yb) - margin, size), cell(F.greatest(ya, yb) + margin, size))))
