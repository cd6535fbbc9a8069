"""Boosted trees with several outputs in one tree, from histograms summed on the executors, and exact attributions of their predictions."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import cut


@dataclass
class Tree:
    """Nodes in the order of their making; ``feature`` is -1 for leaves; rows with a code up to ``cut`` go left."""

    feature: list[int] = field(default_factory=list)
    cut: list[int] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[np.ndarray] = field(default_factory=list)
    cover: list[float] = field(default_factory=list)

    def add(self, value: np.ndarray, cover: float) -> int:
        for column, v in zip((self.feature, self.cut, self.left, self.right, self.value, self.cover), (-1, -1, -1, -1, value, cover)):
            column.append(v)
        return len(self.feature) - 1

    def nodes(self, codes: np.ndarray) -> np.ndarray:
        """The node that each row reaches."""
        feature, at = np.array(self.feature), np.zeros(len(codes), np.int64)
        cuts, left, right = (np.array(c) for c in (self.cut, self.left, self.right))
        while len(going := np.flatnonzero(feature[at] >= 0)):
            here = at[going]
            at[going] = np.where(codes[going, feature[here]] <= cuts[here], left[here], right[here])
        return at


@dataclass
class Boosted:
    names: list[str]
    outputs: list[str]
    edges: list[np.ndarray]
    base: np.ndarray
    trees: list[Tree] = field(default_factory=list)

    def coded(self, columns: list[np.ndarray]) -> np.ndarray:
        """Each feature's bin: how many edges lie below the value; missing values count as 0."""
        return np.stack([np.searchsorted(e, np.nan_to_num(c), "left") for e, c in zip(self.edges, columns)], axis=1).astype(np.uint8)

    def predicted(self, codes: np.ndarray) -> np.ndarray:
        out = np.tile(self.base, (len(codes), 1))
        for tree in self.trees:
            out += np.array(tree.value)[tree.nodes(codes)]
        return out


def _floats(batch: pa.RecordBatch, k: int) -> np.ndarray:
    return batch.column(k).cast(pa.float64()).to_numpy(zero_copy_only=False)


def _split(sums: np.ndarray, ridge: float, least: float) -> tuple[float, int, int]:
    """The best (gain, feature, cut) of a node from sums[feature, bin, (weight, gradients)]; ties go to the first."""
    below = sums.cumsum(axis=1)
    whole = below[:, -1:, :]
    score = lambda s: (s[..., 1:] ** 2).sum(axis=-1) / (s[..., 0] + ridge)
    gain = score(below) + score(whole - below) - score(whole)
    gain[(below[..., 0] < least) | ((whole - below)[..., 0] < least)] = -np.inf
    at = int(np.round(gain, 9).argmax())
    return float(gain.flat[at]), *divmod(at, gain.shape[1])


def fit(
    df: DataFrame, names: list[str], outputs: list[str], weight: str | None = None, trees: int = 10, depth: int = 3, rate: float = 0.3, bins: int = 32, ridge: float = 1.0, least: float = 1.0
) -> Boosted:
    """ML4: squared loss over all outputs, one tree for all of them a step; a split is judged by all outputs' gains together.

    Values are put into at most ``bins`` (256 at most) bins by quantiles. A level of a tree is one pass: each task sums weight and gradients by node, feature and bin, Spark adds them
    up, and the driver gets nodes x features x bins sums, whatever the rows. ``least``: the least weight of a side. Missing features count as 0, rows with a missing output
    or weight are left out. Without rows all predictions are 0.
    """
    known = df.select(*[F.coalesce(F.col(n).cast("double"), F.lit(0.0)).alias(n) for n in names], *[F.col(o).cast("double").alias(f"_{o}") for o in outputs], (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("_w"))
    known = known.dropna()
    quantiles = known.approxQuantile(names, [k / bins for k in range(1, bins)], 0.001) if names else []
    model = Boosted(names, outputs, [np.unique(q) if q else np.zeros(0) for q in quantiles], np.zeros(len(outputs)))
    means = known.agg(*[F.try_divide(F.sum(F.col(f"_{o}") * F.col("_w")), F.sum("_w")) for o in outputs]).first()
    model.base = np.array([m or 0.0 for m in means])
    n, m = len(names), len(outputs)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = model.coded([_floats(batch, k) for k in range(n)])
            data = np.ascontiguousarray(codes).tobytes()
            yield pa.record_batch([pa.array([data[i : i + n] for i in range(0, len(data), n)], pa.binary()), *batch.columns[n:]], ["codes", *batch.schema.names[n:]])

    rows = cut(known.mapInArrow(code, "codes binary, " + ", ".join(f"`_{o}` double" for o in outputs) + ", _w double"))
    width = max((len(e) for e in model.edges), default=0) + 1
    for _ in range(trees):
        tree, level = Tree(), [0]
        tree.add(np.zeros(m), 0.0)
        for below in range(depth, -1, -1):
            sums = _level(rows, model, tree, level, width)
            following = []
            for node, s in zip(level, sums):
                whole = s[0].sum(axis=0)
                tree.value[node], tree.cover[node] = rate * whole[1:] / (whole[0] + ridge), float(whole[0])
                gain, feature, at = _split(s, ridge, least)
                if not below or gain <= 1e-9:
                    continue
                tree.feature[node], tree.cut[node] = feature, at
                tree.left[node], tree.right[node] = tree.add(np.zeros(m), 0.0), tree.add(np.zeros(m), 0.0)
                following += [tree.left[node], tree.right[node]]
            level = following
            if not level:
                break
        model.trees.append(tree)
    return model


def _level(rows: DataFrame, model: Boosted, tree: Tree, level: list[int], width: int) -> np.ndarray:
    """sums[node of the level, feature, bin, (weight, gradients)]."""
    n, m = len(model.names), len(model.outputs)
    shape = (len(level), n, width, 1 + m)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.full(len(tree.feature), -1)
        place[level] = np.arange(len(level))
        total = np.zeros(shape)
        for batch in batches:
            codes = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(-1, n)
            y, w = np.stack([_floats(batch, 1 + k) for k in range(m)], axis=1), _floats(batch, 1 + m)
            at = place[tree.nodes(codes)]
            here = at >= 0
            codes, at, w = codes[here], at[here], w[here]
            parts = np.column_stack([w, (y[here] - model.predicted(codes)) * w[:, None]])
            for f in range(n):
                np.add.at(total[:, f], (at, codes[:, f]), parts)
        cells = np.flatnonzero(total.reshape(-1, 1 + m).any(axis=1))
        found = total.reshape(-1, 1 + m)[cells]
        yield pa.record_batch([pa.array(cells), *(pa.array(c) for c in found.T)], ["cell", *(f"s{k}" for k in range(1 + m))])

    parts = rows.mapInArrow(work, "cell long, " + ", ".join(f"s{k} double" for k in range(1 + m)))
    out = np.zeros((math.prod(shape[:-1]), 1 + m))
    for r in parts.groupBy("cell").agg(*[F.sum(f"s{k}").alias(f"s{k}") for k in range(1 + m)]).collect():  # nodes x features x bins
        out[r["cell"]] = r[1:]
    return out.reshape(shape)


def predict(model: Boosted, df: DataFrame) -> DataFrame:
    """ML5: a column pred_{output} for every output beside the columns of ``df``. The model is broadcast: its size does not grow with the rows."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    kept = df.columns
    at = [kept.index(n) for n in model.names]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = shared.value.predicted(shared.value.coded([_floats(batch, k) for k in at]))
            yield pa.record_batch([*batch.columns, *(pa.array(c) for c in got.T)], [*batch.schema.names, *(f"pred_{o}" for o in shared.value.outputs)])

    return df.mapInArrow(work, ", ".join(f"`{c}` {t}" for c, t in [*df.dtypes, *((f"pred_{o}", "double") for o in model.outputs)]))


def attributed(model: Boosted, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, features, outputs) Shapley values of the predictions and the expected prediction. Where a feature is not known, a tree's rows go both ways by their cover.

    Leaf by leaf: only features on the leaf's path count. Each has a share of rows that its conditions let through, and lets this row through or not; the
    sums over all subsets of the other features are the coefficients of a product of as many linear terms.
    """
    out, expected = np.zeros((len(codes), len(model.names), len(model.outputs))), model.base.copy()
    for tree in model.trees:
        stack = [(0, {}, {})]  # node, feature -> rows let through, feature -> share
        while stack:
            node, passed, share = stack.pop()
            f = tree.feature[node]
            if f >= 0:
                goes = codes[:, f] <= tree.cut[node]
                for child, way in ((tree.left[node], goes), (tree.right[node], ~goes)):
                    part = tree.cover[child] / tree.cover[node] if tree.cover[node] else 0.0
                    stack.append((child, passed | {f: passed[f] & way if f in passed else way}, share | {f: share.get(f, 1.0) * part}))
                continue
            value, used = tree.value[node], sorted(passed)
            expected = expected + value * math.prod(share.values())
            for f in used:
                terms = [np.ones(len(codes))]  # by how many of the other features are known
                for g in used:
                    if g != f:
                        grown = [t * share[g] for t in terms] + [np.zeros(len(codes))]
                        for k, t in enumerate(terms):
                            grown[k + 1] = grown[k + 1] + t * passed[g]
                        terms = grown
                size = len(used)
                mean = sum(t * (math.factorial(k) * math.factorial(size - 1 - k) / math.factorial(size)) for k, t in enumerate(terms))
                out[:, f, :] += (mean * (passed[f] - share[f]))[:, None] * value
    return out, expected


def attributions(model: Boosted, df: DataFrame, id: str) -> DataFrame:
    """AG49: (id, output, feature, attribution): a row's attributions and the expected prediction (``expected``) add up to its prediction."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        n, m = len(own.names), len(own.outputs)
        for batch in batches:
            got, expected = attributed(own, own.coded([_floats(batch, 1 + k) for k in range(n)]))
            rows = np.repeat(np.arange(len(got)), n * m)
            names, outputs = np.tile(np.repeat(own.names, m), len(got)), np.tile(own.outputs, len(got) * n)
            yield pa.record_batch([batch.column(0).take(pa.array(rows)), pa.array(outputs), pa.array(names), pa.array(got.reshape(-1)), pa.array(np.tile(expected, len(got) * n))], ["id", "output", "feature", "attribution", "expected"])

    chosen = df.select(F.col(id).alias("id"), *[F.coalesce(F.col(n).cast("double"), F.lit(0.0)).alias(n) for n in model.names])
    return chosen.mapInArrow(work, f"id {df.schema[id].dataType.simpleString()}, output string, feature string, attribution double, expected double").withColumnRenamed("id", id)
