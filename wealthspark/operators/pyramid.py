"""Sums over many boxes from sums of a tree's nodes: whole nodes inside a box are taken as they are, only leaves on its edge are opened."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import cut
from . import leaves

#: Items of a leaf of the tree over all items, and of a leaf of the tree that a task grows over these; pairs of boxes and items looked at at once.
BLOCK, LEAF, PAIRS = 8192, 32, 1 << 20


class _Held:
    """The items of a leaf under a tree of their own."""

    def __init__(self, batches: list[pa.RecordBatch], values: list[str]):
        column = lambda n: pa.chunked_array([b.column(n) for b in batches]).combine_chunks()
        x, y = (column(n).to_numpy() for n in "xy")
        tree = self.tree = leaves.Tree(x, y, LEAF, numbered=True)
        order, starts = tree.order, tree.starts
        self.x0, self.y0 = x[order], y[order]
        self.x1, self.y1, self.parts = self.x0, self.y0, None
        if "parts" in batches[0].schema.names:
            self.x1, self.y1 = (column(n).to_numpy()[order] for n in ("x1", "y1"))
            parts = column("parts").take(pa.array(order))  # none for items at one place
            self.parts = [parts.flatten().field(k).to_numpy(zero_copy_only=False).astype(float) for k in range(2)]
            self.n = parts.value_lengths().fill_null(0).to_numpy().astype(np.int64)
            self.first = np.cumsum(self.n) - self.n
        self.values = [column(n).to_numpy()[order] for n in values]
        ends = starts[:-1]
        tree.bounded(np.stack([f.reduceat(v, ends) for f, v in ((np.minimum, self.x0), (np.maximum, self.x1), (np.minimum, self.y0), (np.maximum, self.y1))], axis=1))
        self.sums = [tree.up(np.add.reduceat(v, ends), np.add) for v in self.values]
        if self.parts is None:
            self._sort()

    def _sort(self) -> None:
        """Each node's items in the order of x and of y, with their sums from both ends: level below level in one array."""
        tree, n = self.tree, len(self.x0)
        first, last = (tree.up(np.arange(tree.n), f) for f in (np.minimum, np.maximum))
        begin, self.size = tree.starts[first], tree.starts[last + 1] - tree.starts[first]
        depth = np.zeros(len(first), np.int64)
        for node in np.flatnonzero(tree.leaf < 0):
            depth[[tree.low[node], tree.high[node]]] = depth[node] + 1
        levels = int(depth.max()) + 1
        self.begin = begin + depth * n
        self.sorted, self.below, self.above = [], [], []
        for v in (self.x0, self.y0):
            at, totals = np.zeros(levels * n), [[np.zeros(levels * n, s.dtype) for s in self.values] for _ in range(2)]
            for node in range(len(first)):
                here = slice(self.begin[node], self.begin[node] + self.size[node])
                items = begin[node] + np.argsort(v[begin[node] : begin[node] + self.size[node]], kind="stable")
                at[here] = v[items]
                for k, s in enumerate(self.values):
                    totals[0][k][here], totals[1][k][here] = np.cumsum(s[items]), np.cumsum(s[items[::-1]])[::-1]
            self.sorted.append(at)
            self.below.append(totals[0])
            self.above.append(totals[1])

    def _cut(self, out: list[np.ndarray], side: int, box: np.ndarray, node: np.ndarray, edge: np.ndarray) -> None:
        """Adds what nodes have on the inner side of the one edge that cuts them: no difference of sums is taken."""
        v, begin, size = self.sorted[side // 2], self.begin[node], self.size[node]
        low, high = np.zeros(len(node), np.int64), size.copy()
        while len(going := np.flatnonzero(low < high)):  # how many items lie before the edge, with those on it for the upper ones
            mid = (low[going] + high[going]) // 2
            here = v[begin[going] + mid]
            before = here <= edge[going] if side % 2 else here < edge[going]
            low[going], high[going] = np.where(before, mid + 1, low[going]), np.where(before, high[going], mid)
        some = low > 0 if side % 2 else low < size
        at = begin[some] + low[some] - side % 2
        for total, sums in zip(out, (self.below if side % 2 else self.above)[side // 2]):
            np.add.at(total, box[some], sums[at])

    def add(self, out: list[np.ndarray], left: np.ndarray, right: np.ndarray, bottom: np.ndarray, top: np.ndarray) -> None:
        """Adds to ``out`` (an array for each value) what lies in each box."""
        sides = [] if self.parts is None else None
        box, node, over, at = self.tree.met(left, right, bottom, top, sides=sides)
        for total, v in zip(out, self.sums):
            np.add.at(total, box, v[node])
        for k, (whose, nodes) in enumerate(sides or []):
            self._cut(out, k, whose, nodes, (left, right, bottom, top)[k][whose])
        n = np.diff(self.tree.starts)[at]
        cuts = np.flatnonzero(np.diff(np.cumsum(n) // PAIRS, prepend=0)) if len(n) else []
        for a, b in zip([0, *cuts], [*cuts, len(at)]):
            items, owner = leaves.spread(self.tree.starts[at[a:b]], n[a:b]), np.repeat(over[a:b], n[a:b])
            x0, y0 = self.x0[items], self.y0[items]
            x1, y1 = (x0, y0) if self.parts is None else (self.x1[items], self.y1[items])
            l, r, low, high = (v[owner] for v in (left, right, bottom, top))
            inside = (x0 >= l) & (x1 <= r) & (y0 >= low) & (y1 <= high)
            if self.parts is not None:
                some = np.flatnonzero(~inside & (x1 >= l) & (x0 <= r) & (y1 >= low) & (y0 <= high) & (self.n[items] > 0))
                if len(some):
                    n_parts = self.n[items[some]]
                    p, whose = leaves.spread(self.first[items[some]], n_parts), np.repeat(some, n_parts)
                    x, y = (v[p] for v in self.parts)
                    inside[whose[(x >= l[whose]) & (x <= r[whose]) & (y >= low[whose]) & (y <= high[whose])]] = True
            for total, v in zip(out, self.values):
                np.add.at(total, owner[inside], v[items[inside]])


def box_sums(places: DataFrame, items: DataFrame, id: str, halves: dict[str, float], values: dict[str, Column], parts: DataFrame | None = None, item: str | None = None) -> DataFrame:
    """JN13, AG3: for each place and each box the sums of ``values`` over the items in it: id and ``{name}_in_{label}``, 0 for empty boxes (edges belong to the box).

    ``halves``: label -> half the box's side. ``items`` have x and y in metres; sums are whole numbers where the values are, else doubles. A tree over the items has the bounds and
    sums of its nodes; they go to all tasks (at most 16384 leaves). A node whose bounds lie in the box adds its sums, one whose bounds lie apart nothing; a leaf on the
    edge is met by the place in a task that holds the leaf's items under a tree of their own, with few items in a leaf. What only one edge cuts is read from sorted sums, so
    that items are looked at around corners only: the work for a place hardly grows with the items, however many a box has, and items at one point never need opening.

    With ``parts`` (``item``, x, y) an item is in a box if one of its parts is: its bounds are those of its parts, and only for items that lie over a
    box's edge are parts looked at.
    """
    spark, names = places.sparkSession, [f"s{k}" for k in range(len(values))]
    shown = [f"{n}_in_{label}" for label in halves for n in values]
    chosen = [c.alias(n) for n, c in zip(names, values.values())]
    corner = [F.col(v).cast("double").alias(v) for v in "xy"]
    if parts is None:
        spread = leaves.there(items).select(*corner, *chosen)
    else:
        around = leaves.there(parts).select(item, *corner).groupBy(item)
        around = around.agg(F.min("x").alias("x"), F.max("x").alias("x1"), F.min("y").alias("y"), F.max("y").alias("y1"), F.collect_list(F.struct("x", "y")).alias("parts"))
        around = around.withColumn("parts", F.when((F.col("x1") > F.col("x")) | (F.col("y1") > F.col("y")), F.col("parts")))
        spread = items.select(item, *chosen).join(around, item).drop(item)
    number = {n: "bigint" if t in ("tinyint", "smallint", "int", "bigint") else "double" for n, t in spread.dtypes if n in names}
    spread = cut(spread.withColumns({n: F.coalesce(F.col(n).cast(t), F.lit(0).cast(t)) for n, t in number.items()}))
    tree = leaves.planted(spread.select("x", "y"), BLOCK)
    if tree is None:
        return places.select(id, *[F.lit(0).cast(number[n]).alias(c) for c, n in zip(shown, names * len(halves))])
    spread = spread.withColumn("leaf", leaves.leaf(tree))
    far = ("x", "y") if parts is None else ("x1", "y1")
    got = leaves.per_leaf(tree, spread, {"x0": F.min("x"), "x1": F.max(far[0]), "y0": F.min("y"), "y1": F.max(far[1])} | {n: F.sum(n) for n in names})
    empty = np.isnan(got["x0"])
    tree.bounded(leaves.bounds(got))
    shared = spark.sparkContext.broadcast((tree, [tree.up(np.where(empty, 0, got[n]).astype(got[n].dtype), np.add) for n in names]))
    half = list(map(float, halves.values()))
    kinds = [np.int64 if number[n] == "bigint" else np.float64 for n in names]

    def zeros(n: int) -> list[np.ndarray]:
        return [np.zeros(n, t) for t in kinds]

    def found(out: list[np.ndarray], n: int) -> list[pa.Array]:
        return [pa.array(total.reshape(len(half), n)[b]) for b in range(len(half)) for total in out]

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each place with what whole nodes give, dealt evenly below leaf 0, and one for each place and leaf that an edge of its boxes meets."""
        own, sums = shared.value
        for whole in batches:
            for k in range(0, whole.num_rows, 1024):
                batch = whole.slice(k, 1024)
                n, x, y = batch.num_rows, batch.column("x").to_numpy(), batch.column("y").to_numpy()
                out = zeros(n * len(half))
                box, node, over, at = own.met(*(np.concatenate([v + s * h for h in half]) for v, s in ((x, -1), (x, 1), (y, -1), (y, 1))))
                for total, v in zip(out, sums):
                    np.add.at(total, box, v[node])
                pairs, which = np.unique(over % n * own.n + at, return_inverse=True)
                boxes = np.zeros(len(pairs), np.int64)
                np.bitwise_or.at(boxes, which, 1 << (over // n))
                row = np.concatenate([np.arange(n), pairs // own.n])
                leaf = pa.array(np.concatenate([-1 - (np.arange(n) + k) % 997, pairs % own.n]), pa.int32())
                given = pa.StructArray.from_arrays([pa.concat_arrays([c, pa.nulls(len(pairs), c.type)]) for c in found(out, n)], columns, mask=pa.array(np.arange(len(row)) >= n))
                yield pa.record_batch([leaf, *(batch.column(c).take(pa.array(row)) for c in ("id", "x", "y")), pa.array(np.concatenate([np.zeros(n, np.int64), boxes])), given], ["leaf", "id", "x", "y", "boxes", "given"])

    def work(held: _Held | None, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if held is None:
            yield pa.record_batch([batch.column("id"), *batch.column("given").flatten()], ["id", *columns])
            return
        n, x, y, boxes = batch.num_rows, *(batch.column(c).to_numpy() for c in ("x", "y", "boxes"))
        out = zeros(n * len(half))
        for b, h in enumerate(half):
            rows = np.flatnonzero(boxes >> b & 1)
            for k in range(0, len(rows), 1024):
                r = rows[k : k + 1024]
                part = zeros(len(r))
                held.add(part, x[r] - h, x[r] + h, y[r] - h, y[r] + h)
                for total, v in zip(out, part):
                    total[b * n + r] = v
        yield pa.record_batch([batch.column("id"), *found(out, n)], ["id", *columns])

    columns = [f"c{k}" for k in range(len(shown))]
    fields = ", ".join(f"{c}: {number[n]}" for c, n in zip(columns, names * len(half)))
    boxes = leaves.there(places).select(F.col(id).alias("id"), *corner)
    kind = boxes.schema["id"].dataType.simpleString()
    boxes = boxes.mapInArrow(look, f"leaf int, id {kind}, x double, y double, boxes bigint, given struct<{fields}>")
    void = lambda df, other: [F.lit(None).cast(t).alias(c) for c, t in other.dtypes if c not in df.columns]
    rows = spread.select("*", F.lit(0).alias("kind"), *void(spread, boxes)).unionByName(boxes.select("*", F.lit(1).alias("kind"), *void(boxes, spread)))
    sums = leaves.by_leaf(rows, lambda batches: _Held(batches, names) if batches else None, work, f"id {kind}, {fields.replace(':', '')}")
    out = sums.groupBy("id").agg(*[F.sum(c).alias(to) for c, to in zip(columns, shown)])
    return places.select(id).join(out.withColumnRenamed("id", id), id, "left").fillna(0, shown)
