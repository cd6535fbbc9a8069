"""Spatial work leaf by leaf: a tree cuts the plane into leaves with about as many points each, and a task works on one leaf's points in memory.

Leaves follow the points, not a grid: where these are dense, leaves are small. The tree is cut at the medians of some points (as range partitioning is);
all points are dealt by it, and what is found does not depend on where it is cut.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Leaves at most, and points a leaf that the cuts are taken from: the bound of what the driver gets.
MOST, DRAWN = 16384, 8


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of ranges, one after another."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


class Tree:
    """Nodes in the order of their making, children after their parent; ``leaf`` is the number of a node without children, else -1."""

    def __init__(self, x: np.ndarray, y: np.ndarray, size: int, numbered: bool = False):
        """Cuts at medians, across the wider side, until a leaf has at most ``size`` points or all of them lie at one place. ``numbered``: keep ``order`` and ``starts`` of the leaves' points."""
        axis, at, low, high, leaf, parts = [0], [0.0], [-1], [-1], [-1], []
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, here = todo.pop()
            a, b = x[here], y[here]
            k = 0 if len(here) < 2 or np.ptp(a) >= np.ptp(b) else 1
            c = (a, b)[k]
            if len(here) <= size or c.min() == c.max():
                leaf[node] = len(parts)
                parts.append(here if numbered else None)
                continue
            v = np.partition(c, len(c) // 2)[len(c) // 2]
            v = v if v > c.min() else c[c > v].min()  # both sides have points
            axis[node], at[node] = k, v
            for child, side in ((low, c < v), (high, c >= v)):
                child[node] = len(leaf)
                todo.append((len(leaf), here[side]))
                for column, empty in ((axis, 0), (at, 0.0), (low, -1), (high, -1), (leaf, -1)):
                    column.append(empty)
        self.axis, self.at, self.low, self.high, self.leaf = np.array(axis), np.array(at), np.array(low), np.array(high), np.array(leaf)
        self.n = len(parts)
        if numbered:
            self.order, self.starts = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])

    def leaves(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        while len(going := np.flatnonzero(self.leaf[node] < 0)):
            here = node[going]
            below = np.where(self.axis[here] == 0, x[going], y[going]) < self.at[here]
            node[going] = np.where(below, self.low[here], self.high[here])
        return self.leaf[node]

    def up(self, of_leaves: np.ndarray, add: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
        """Values of the leaves carried to all nodes."""
        out = np.zeros((len(self.leaf), *of_leaves.shape[1:]), of_leaves.dtype)
        ends = self.leaf >= 0
        out[ends] = of_leaves[self.leaf[ends]]
        for node in range(len(self.leaf) - 1, -1, -1):
            if self.leaf[node] < 0:
                out[node] = add(out[self.low[node]], out[self.high[node]])
        return out

    def bounded(self, bounds: np.ndarray) -> Tree:
        """Keeps the bounds (x0, x1, y0, y1) of the leaves' items, whose boxes may reach beyond their leaf; of leaves without items inf, -inf, inf, -inf."""
        least, most = self.up(bounds[:, [0, 2]], np.minimum), self.up(bounds[:, [1, 3]], np.maximum)
        self.bounds = np.stack([least[:, 0], most[:, 0], least[:, 1], most[:, 1]], axis=1)
        return self

    def met(
        self, left: np.ndarray, right: np.ndarray, bottom: np.ndarray, top: np.ndarray, whole: bool = True, sides: list[tuple[np.ndarray, np.ndarray]] | None = None
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(boxes, nodes) of nodes whose bounds lie in a box, below no other such node, and (boxes, leaves) of leaves over a box's edge. Without ``whole`` all leaves that meet the box.

        ``sides``: takes for the left, right, lower and upper edge the (boxes, nodes) of nodes that only this edge cuts; they are not looked into.
        """
        box, node = np.arange(len(left)), np.zeros(len(left), np.int64)
        inside, edges, cut_by = [], [], [[], [], [], []]
        while len(box):
            x0, x1, y0, y1 = self.bounds[node].T
            l, r, low, high = left[box], right[box], bottom[box], top[box]
            keep = (x1 >= l) & (x0 <= r) & (y1 >= low) & (y0 <= high)
            if whole:
                over = x0 < l, x1 > r, y0 < low, y1 > high
                n = np.add.reduce(over, axis=0, dtype=np.int8)
                full = keep & (n == 0)
                inside.append((box[full], node[full]))
                keep &= n > (0 if sides is None else 1)
                for k in range(4 if sides is not None else 0):
                    one = over[k] & (n == 1) & (x1 >= l) & (x0 <= r) & (y1 >= low) & (y0 <= high)
                    cut_by[k].append((box[one], node[one]))
            box, node = box[keep], node[keep]
            leaf = self.leaf[node]
            end = leaf >= 0
            edges.append((box[end], leaf[end]))
            box, node = box[~end], node[~end]
            box, node = np.concatenate([box, box]), np.concatenate([self.low[node], self.high[node]])
        join = lambda parts, k: np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64)
        if sides is not None:
            sides[:] = [(join(c, 0), join(c, 1)) for c in cut_by]
        return join(inside, 0), join(inside, 1), join(edges, 0), join(edges, 1)


def there(df: DataFrame) -> DataFrame:
    """Rows that have a position."""
    return df.filter("x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def planted(points: DataFrame, size: int) -> Tree | None:
    """A tree with about ``size`` of the points (x, y) in a leaf, smaller leaves for few points so that all tasks get some; None without points."""
    n = points.count()
    if not n:
        return None
    size = min(size, max(512, n // (16 * partitions(points.sparkSession))))
    leaves = min(MOST, -(-n // size))
    share = DRAWN * leaves / n
    drawn = (points if share >= 1 else points.sample(share, seed=1)).select(F.col("x").cast("double"), F.col("y").cast("double")).toArrow()
    x, y = (drawn.column(k).to_numpy() for k in range(2))
    return Tree(x, y, max(1, -(-len(x) // leaves)))


def leaf(tree: Tree) -> Column:
    """The number of the leaf that the row (x, y) belongs to."""

    @F.arrow_udf("int")
    def of(x: pa.Array, y: pa.Array) -> pa.Array:
        return pa.array(tree.leaves(*(v.to_numpy(zero_copy_only=False) for v in (x, y))), pa.int32())

    return of(F.col("x").cast("double"), F.col("y").cast("double")).alias("leaf")


def per_leaf(tree: Tree, items: DataFrame, aggregates: dict[str, Column]) -> dict[str, np.ndarray]:
    """Aggregates of ``items`` (leaf, ...) by leaf, as arrays by the number of the leaf; what leaves without items have is NaN or 0."""
    got = items.groupBy("leaf").agg(*[c.alias(n) for n, c in aggregates.items()]).toArrow()  # a row for each leaf
    out = {}
    for n in aggregates:
        v = got.column(n).to_numpy()
        out[n] = np.zeros(tree.n, v.dtype) if v.dtype.kind == "i" else np.full(tree.n, np.nan)
        out[n][got.column("leaf").to_numpy()] = v
    return out


def bounds(got: dict[str, np.ndarray]) -> np.ndarray:
    return np.stack([np.where(np.isnan(got[n]), e, got[n]) for n, e in (("x0", np.inf), ("x1", -np.inf), ("y0", np.inf), ("y1", -np.inf))], axis=1)


def by_leaf(rows: DataFrame, prepare: Callable[[list[pa.RecordBatch]], object], work: Callable[[object, pa.RecordBatch], Iterable[pa.RecordBatch]], schema: str, order: Iterable[str] = ()) -> DataFrame:
    """``rows``: leaf, kind, ...; a leaf's rows of kind 0 are held in memory as ``prepare`` makes them, those of kind 1 pass by in batches through ``work``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, made = None, [], None
        for batch in batches:
            leaves, kinds = (batch.column(n).to_numpy() for n in ("leaf", "kind"))
            ends = np.flatnonzero((np.diff(leaves) != 0) | (np.diff(kinds) != 0)) + 1
            for a, b in zip([0, *ends.tolist()], [*ends.tolist(), len(leaves)]):
                if a == b:
                    continue
                if leaves[a] != at:
                    at, held, made = leaves[a], [], None
                if kinds[a] == 0:
                    held.append(batch.slice(a, b - a))
                    continue
                if made is None:
                    made, held = prepare(held), []
                yield from work(made, batch.slice(a, b - a))

    dealt = rows.repartition(partitions(rows.sparkSession), "leaf").sortWithinPartitions("leaf", "kind", *order)
    return dealt.mapInArrow(run, schema)
