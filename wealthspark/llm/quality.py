"""Quality by votes of labelled neighbours in a latent-semantic space."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import slices

SHAPES, WORDS, EXTRA = 512, 1024, 8
DIMENSIONS = SHAPES + WORDS + EXTRA
#: At most so many labelled rows of each class are fitted on: the documented bound of the sample.
PER_CLASS = 1024
LATENT = 48
#: Weight of a neighbour: exp(SHARPNESS * (cosine - 1)).
SHARPNESS = 30.0
HELD = 400_000


def shape(word: str) -> str:
    """The word's outline: runs of lower-case letters, capitals and digits become one mark; marks are kept, two at most."""
    if word.isalpha():
        return "a" if word.islower() else "A" if len(word) > 1 and word.isupper() else "B"
    word = re.sub(r"[^\W\d_]+", lambda m: "a" if m[0].islower() else "A" if len(m[0]) > 1 and m[0].isupper() else "B", word)
    return re.sub(r"(\W)\1+", r"\1\1", re.sub(r"\d+", "0", word))[:12]


class _Shapes(dict):
    def __missing__(self, outline: str) -> int:
        number = self[outline] = xxhash.xxh3_64_intdigest(outline) % SHAPES << 20
        return number


_shapes = _Shapes()


class _Features(dict):
    """word -> its shape's number and its own, packed into one integer."""

    def __missing__(self, word: str) -> int:
        out = self[word] = _shapes[shape(word)] | xxhash.xxh3_64_intdigest(word.lower()) % WORDS
        return out


_features = _Features()


def vector(text: str) -> np.ndarray:
    """Roots of the shares of shapes and words, and how the text repeats itself. Reads the whole text, nothing else."""
    if len(_features) > HELD:
        _features.clear()
        _shapes.clear()
    words, out = text.split(), np.zeros(DIMENSIONS, np.float32)
    n = len(words)
    if not n:
        out[-1] = 1
        return out
    codes = np.fromiter(map(_features.__getitem__, words), np.int64, n)
    out[:SHAPES] = np.sqrt(np.bincount(codes >> 20, minlength=SHAPES) / n)
    out[SHAPES : SHAPES + WORDS] = 0.5 * np.sqrt(np.bincount(codes & 0xFFFFF, minlength=WORDS) / n)
    again = float(np.mean(codes[1:] == codes[:-1])) if n > 1 else 0.0
    lines = [x for x in text.split("\n") if x]
    out[SHAPES + WORDS :] = (np.sqrt(again), 1 - len(set(words)) / n if n > 20 else 0, 1 - len(set(lines)) / len(lines) if lines else 0, 0.1 * (n < 5), 0.1 * (n < 20), 0.1 * (n > 1000), 0, 0)
    return out / max(float(np.linalg.norm(out)), 1e-9)


@dataclass
class Neighbours:
    """The fitted model: weights and axes of the latent space, the labelled vectors, each one's label and weight."""

    idf: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    weights: np.ndarray

    def latent(self, x: np.ndarray) -> np.ndarray:
        z = (x * self.idf) @ self.axes
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Exact cosines with all labelled vectors, block by block; each votes with a weight that grows with its cosine."""
        out = np.empty(len(x))
        for k in range(0, len(x), 512):
            votes = np.exp(SHARPNESS * (self.latent(x[k : k + 512]) @ self.vectors.T - 1)) * self.weights
            total = votes.sum(axis=1)
            out[k : k + 512] = (votes @ self.labels) / np.maximum(total, 1e-30)
        return np.clip(out, 0.0, 1.0)


def fit(x: np.ndarray, labels: np.ndarray, share: float, latent: int = LATENT) -> Neighbours:
    """Latent axes by the eigenvectors of the weighted vectors' second moments; ``share``: of label 1 among all labelled rows."""
    idf = np.log1p(len(x) / (1.0 + (x > 0).sum(axis=0))).astype(np.float32)
    idf[SHAPES + WORDS :] = 1
    weighted = x * idf
    _, axes = np.linalg.eigh((weighted.T @ weighted).astype(np.float64))
    axes = axes[:, ::-1][:, :latent].astype(np.float32)
    model = Neighbours(idf, axes, x, labels.astype(np.float32), np.ones(len(x), np.float32))
    model.vectors = model.latent(x)
    ones = float(labels.mean()) if len(labels) else 0.5
    model.weights = np.where(labels == 1, share / max(ones, 1e-9), (1 - share) / max(1 - ones, 1e-9)).astype(np.float32)
    return model


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for labels, texts in slices(batch.column(0), batch.column(1)):
            packed = [vector(t).tobytes() for t in texts]
            yield pa.record_batch([labels, pa.array(packed, pa.binary())], ["label", "x"])


def train(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality", per_class: int = PER_CLASS) -> Neighbours:
    """Fit on at most ``per_class`` rows of each label (0, 1), those whose ids have the smallest hashes; labels without a text are left out.

    Of several rows with a labelled id the smallest text counts, so no more texts are gathered than labels. With no labelled row at all every score is 0.5.
    """
    marks = labels.filter(F.col(label).isin(0, 1) & F.col(id).isNotNull()).groupBy(id).agg(F.max(label).alias("label"))
    counts = {r["label"]: r["count"] for r in marks.groupBy("label").count().collect()}
    order = F.xxhash64(F.col(id).cast("string"))
    few = [marks.filter(F.col("label") == k).orderBy(order, id).limit(per_class) for k in (0, 1)]
    sample = F.broadcast(few[0].unionByName(few[1]).select(F.col(id).alias("labelled"), F.col("label").cast("int").alias("label")))  # 2 * per_class rows at most
    rows = docs.join(sample, docs[id] == F.col("labelled")).groupBy("labelled").agg(F.first("label").alias("label"), F.min(docs[text].cast("string")).alias("text")).drop("labelled")
    got = rows.mapInArrow(_vectors, "label int, x binary").collect()
    if not got:
        return Neighbours(np.ones(DIMENSIONS, np.float32), np.eye(DIMENSIONS, 1, dtype=np.float32), np.zeros((1, 1), np.float32), np.full(1, 0.5, np.float32), np.ones(1, np.float32))
    got.sort(key=lambda r: (r["label"], bytes(r["x"])))  # the same model whatever order the rows come in
    x = np.stack([np.frombuffer(r["x"], np.float32) for r in got])
    y = np.array([r["label"] for r in got])
    return fit(x, y, counts.get(1, 0) / max(1, sum(counts.values())))


def score(spark: SparkSession, docs: DataFrame, model: Neighbours, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id and ``score`` (0 to 1) of each row. Null text counts as empty; any length; null ids and repeated rows are kept."""
    shared = spark.sparkContext.broadcast(model)  # 2 * PER_CLASS vectors at most

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in slices(batch.column(0), batch.column(1)):
                x = np.stack([vector(t) for t in texts])
                yield pa.record_batch([ids, pa.array(shared.value.scores(x), pa.float64())], ["id", "score"])

    kind = docs.schema[id].dataType.simpleString()
    return docs.select(F.col(id), F.col(text).cast("string")).mapInArrow(work, f"id {kind}, score double").withColumnRenamed("id", id)


def held_out(id: str = "doc_id", parts: int = 5) -> Column:
    """Rows never learned from: crc32 of the id's text divisible by ``parts``."""
    return F.crc32(F.col(id).cast("string").cast("binary")) % parts == 0


def accepted(spark: SparkSession, docs: DataFrame, model: Neighbours, least: float = 0.3, text: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score is at least ``least``."""
    shared = spark.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start = 0
            for _, texts in slices(batch.column(at), batch.column(at)):
                part = batch.slice(start, len(texts))
                start += len(texts)
                yield part.filter(pa.array(shared.value.scores(np.stack([vector(t) for t in texts])) >= least))

    names = [f"c{k}" for k in range(len(docs.columns))]  # clashing names do not matter inside
    schema = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, docs.schema.fields))
    return docs.toDF(*names).mapInArrow(work, schema).toDF(*docs.columns)
