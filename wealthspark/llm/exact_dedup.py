"""Exact duplicates of long documents by recipes of content-defined chunks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST, MOST, MEAN_BITS = 512, 65_536, 12
_STEP = np.uint64(0x9E3779B97F4A7C15)


def cuts(data: bytes, least: int = LEAST, most: int = MOST, mean_bits: int = MEAN_BITS) -> list[int]:
    """Ends of the chunks of ``data``. A cut depends on the eight bytes before it and on the cut before it alone."""
    n = len(data)
    if n <= least:
        return [n] if n else []
    padded = data + bytes(16)
    seen = np.empty(n, np.uint64)
    for k in range(8):
        part = seen[k::8]
        part[:] = np.frombuffer(padded, "<u8", len(part), k)
    marks = np.flatnonzero((seen * _STEP) >> np.uint64(64 - mean_bits) == 0) + 8
    ends, last = [], 0
    for mark in marks.tolist():
        if mark >= n:
            break
        while mark - last > most:
            last += most
            ends.append(last)
        if mark - last >= least:
            ends.append(mark)
            last = mark
    while n - last > most:
        last += most
        ends.append(last)
    return [*ends, n]


def _normalised(column: pa.ChunkedArray | pa.Array) -> Iterator[bytes]:
    for value in column.cast(pa.binary()):
        yield (value.as_py() or b"").lower()  # bytes.lower() changes A-Z alone


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, content) of each chunk; once for all its places in a batch."""
    for batch in batches:
        found: dict[bytes, bytes] = {}
        held = 0
        for data in _normalised(batch.column(0)):
            start = 0
            for end in cuts(data):
                content = data[start:end]
                key = hashlib.sha256(content).digest()
                if key not in found:
                    found[key] = content
                    held += len(content)
                elif found[key] != content:  # a clash goes on, to be found below
                    yield pa.record_batch([pa.array([key]), pa.array([content])], ["key", "content"])
                start = end
            if held > 8 << 20:
                yield pa.record_batch([pa.array(list(found)), pa.array(list(found.values()))], ["key", "content"])
                found, held = {}, 0
        if found:
            yield pa.record_batch([pa.array(list(found)), pa.array(list(found.values()))], ["key", "content"])


def _recipes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        shas, recipes = [], []
        for data in _normalised(batch.column(1)):
            shas.append(hashlib.sha256(data).hexdigest())
            start, keys = 0, []
            for end in cuts(data):
                keys.append(hashlib.sha256(data[start:end]).digest())
                start = end
            recipes.append(b"".join(keys))
        yield pa.record_batch([batch.column(0), pa.array(shas, pa.string()), pa.array(recipes, pa.binary())], ["id", "text_sha256", "recipe"])


def clashing_chunks(docs: DataFrame, text: str = "text") -> DataFrame:
    """Chunk identifiers that stand for more than one content: what the verification looks for (none is expected)."""
    chunks = docs.select(F.col(text).cast("string")).mapInArrow(_chunks, "key binary, content binary")
    return chunks.distinct().groupBy("key").count().filter("count > 1")


def exact_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", verify: bool = True) -> DataFrame:
    """One row per row of ``docs``: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Texts are equal when identical after lower-casing A-Z. Each text is cut into content-defined chunks; a chunk's
    identifier is its SHA-256. Every distinct chunk travels once, and the contents under one identifier are
    compared byte by byte (``verify``); a clash raises. Documents are then grouped by their ordered identifier lists, so no
    long text moves again. The largest id of a group stays.

    Null text counts as empty; empty texts are equal to each other. A null id is below all others and stays only where no
    other id has its text. Rows repeated with the same id get the same answer. An empty table gives an empty table;
    other columns are not read.
    """
    if verify and clashing_chunks(docs, text).limit(1).count():
        raise ValueError("two different chunks share one SHA-256 identifier")
    kind = docs.schema[id].dataType.simpleString()
    lists = docs.select(F.col(id), F.col(text).cast("string")).mapInArrow(_recipes, f"id {kind}, text_sha256 string, recipe binary")
    groups = lists.groupBy("recipe").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    out = lists.join(groups, "recipe")
    return out.select(F.col("id").alias(id), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
