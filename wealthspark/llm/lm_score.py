"""Language-model scores from a log-frequency Bloom filter of bigram counts, beside exact unigram scores.

Documents are cut into parts of bounded size; a part is kept as its sorted distinct tokens and each token's place among
them. Counts of tokens and bigrams are summed by hash range over all parts. A range puts its bigrams into its own
segment of the filter, once for each level 1 .. 1 + log2(count), and answers each part's distinct bigrams from it by probing
level after level until one is missing. No task and not the driver holds the filter as a whole: it grows with the corpus.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import slices
from .shared import partitions, written
from .words import joined, mix, word_numbers

#: The number of the token that ends every text, and of what stands before its first.
END, START = np.uint64(0xE5D0E5D0E5D0E5D1), np.uint64(0x57A1257A1257A125)
#: Bits for each (bigram, level) entry, probes for each, and the share of the bigram model in a probability.
BITS_EACH, PROBES, SHARE = 12, 4, 0.3
LEVELS = 40


def _pack(*arrays: np.ndarray) -> bytes:
    head = np.array([len(arrays), *(len(a) for a in arrays)], "<i8")
    return zstandard.ZstdCompressor(level=1).compress(b"".join([head.tobytes(), *(np.ascontiguousarray(a).tobytes() for a in arrays)]))


def _unpack(blob: bytes, *kinds: str) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    n = np.frombuffer(data, "<i8", len(kinds) + 1)
    out, at = [], n.nbytes
    for kind, size in zip(kinds, n[1:].tolist()):
        out.append(np.frombuffer(data, kind, size, at))
        at += out[-1].nbytes
    return out


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text, learned) -> (part, ids, packed: tokens of each document, distinct tokens, places, learned)."""
    for batch in batches:
        start = 0
        for ids, texts in slices(batch.column(0), batch.column(1)):
            learned = np.array(batch.column(2).slice(start, len(ids)).to_pylist(), np.uint8)
            start += len(ids)
            numbers = [np.append(word_numbers(t.encode().lower().split()), END) for t in texts]
            sizes = np.fromiter(map(len, numbers), np.int64, len(numbers))
            distinct, place = np.unique(np.concatenate(numbers), return_inverse=True)
            packed = _pack(sizes, distinct, place.astype("<u4"), learned)
            yield pa.record_batch([pa.array([uuid.uuid4().hex]), pa.array([ids.to_pylist()], pa.list_(ids.type)), pa.array([packed], pa.binary())], ["part", "ids", "packed"])


_PART = ("<i8", "<u8", "<u4", "<u1")


def _bigrams(sizes: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[np.cumsum(sizes) - sizes] = START
    return joined(before, tokens)


def _edges(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's range begins among sorted keys: key's upper half * buckets / 2**32."""
    low = (np.arange(buckets + 1, dtype=np.uint64) << np.uint64(32)) // np.uint64(buckets)
    low[1:-1] += ((low[1:-1] * np.uint64(buckets)) >> np.uint64(32)) < np.arange(1, buckets, dtype=np.uint64)
    return np.concatenate([np.searchsorted(keys, low[:-1] << np.uint64(32)), [len(keys)]])


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def _counted(buckets: int):
    """(part, packed) -> (bucket, part, packed): a part's tokens and bigrams, with counts in its learned rows, by hash range."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                sizes, distinct, place, learned = _unpack(blob.as_py(), *_PART)
                use = np.repeat(learned, sizes).astype(bool)
                n = np.bincount(place[use], minlength=len(distinct)).astype("<u4")
                pairs, at = np.unique(_bigrams(sizes, distinct[place]), return_inverse=True)
                times = np.bincount(at[use], minlength=len(pairs)).astype("<u4")
                edges = zip(_edges(distinct, buckets).tolist(), _edges(pairs, buckets).tolist())
                out = []
                for b, ((i, k), (j, m)) in enumerate(pairwise(edges)):
                    if i < j or k < m:
                        zero = np.uint64(0)
                        out.append((b, part, _pack(np.diff(distinct[i:j], prepend=zero), n[i:j], np.diff(pairs[k:m], prepend=zero), times[k:m])))
                yield pa.record_batch([pa.array([r[0] for r in out], pa.int32()), pa.array([r[1] for r in out], pa.string()), pa.array([r[2] for r in out], pa.binary())], ["bucket", "part", "packed"])

    return work


def _level(counts: np.ndarray) -> np.ndarray:
    """1 for a count of 1, 2 for 2 and 3, 3 for 4 to 7, ..."""
    return np.frexp(counts.astype(float))[1]


def _middle(levels: np.ndarray) -> np.ndarray:
    """The middle of each level's bin of counts; 0 for level 0."""
    return np.where(levels > 0, 0.75 * 2.0 ** levels.astype(float) - 0.5, 0)


def _spots(keys: np.ndarray, level: int | np.ndarray, size: int) -> Iterator[np.ndarray]:
    """The filter positions of (key, level), ``PROBES`` arrays."""
    a = mix(keys + np.uint64(0x9E3779B97F4A7C15) * np.asarray(level, np.uint64))
    b = mix(a + np.uint64(0x632BE59BD9B4E019)) | np.uint64(1)
    for _ in range(PROBES):
        yield (a >> np.uint64(3)) % np.uint64(size)
        a = a + b


def segment(keys: np.ndarray, counts: np.ndarray, most_bits: int | None = None) -> tuple[np.ndarray, int]:
    """A range's bits and the first level that is stored: 1, or more only if ``most_bits`` is given and all levels would not fit it."""
    levels = _level(counts)
    entries = np.cumsum(np.bincount(levels, minlength=LEVELS + 1)[::-1])[::-1][1:]  # bigrams at each level or above
    needed = np.cumsum(entries[::-1])[::-1] * BITS_EACH
    first = 1 if most_bits is None else 1 + int(np.argmax(needed <= most_bits))
    size = max(64, int(needed[first - 1]) + 63 & ~63)
    bits = np.zeros(size, bool)
    for level in range(first, int(levels.max(initial=0)) + 1):
        for spot in _spots(keys[levels >= level], level, size):
            bits[spot] = True
    return np.packbits(bits, bitorder="little"), first


def _sums(keys: tuple[np.ndarray, ...], counts: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Distinct keys, their sums, and where each array's keys are among them."""
    distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
    return distinct, np.bincount(at, np.concatenate(counts), len(distinct)).astype("<u8"), np.split(at, np.cumsum([len(k) for k in keys])[:-1])


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A bucket's rows -> for each part its tokens' counts and its bigrams' levels in the bucket's filter; the bucket's sums."""
    found: dict[int, list] = {}
    for batch in batches:
        for bucket, part, blob in zip(*(c.to_pylist() for c in batch.columns)):
            steps, n, pair_steps, times = _unpack(blob, "<u8", "<u4", "<u8", "<u4")
            found.setdefault(bucket, []).append((part, np.cumsum(steps, dtype=np.uint64), n, np.cumsum(pair_steps, dtype=np.uint64), times))
    for bucket in sorted(found):
        parts, tokens, n, pairs, times = zip(*found.pop(bucket))
        _, total, of_tokens = _sums(tokens, n)
        keys, counts, of_pairs = _sums(pairs, times)
        bits, first = segment(keys[counts > 0], counts[counts > 0])
        levels = Filter({0: _pack(np.array([first], "<i8"), bits)}, 1).levels(keys)
        rows = [(bucket, p, _pack(total[t], levels[q]), None, None) for p, t, q in zip(parts, of_tokens, of_pairs)]
        rows.append((bucket, None, None, int(total.sum()), int((total > 0).sum())))
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.string(), pa.binary(), pa.int64(), pa.int64()))], ["bucket", "part", "packed", "tokens", "types"])


class Filter:
    """The segments of some ranges: in memory once, probed by range."""

    def __init__(self, segments: dict[int, bytes], buckets: int):
        self.buckets = buckets
        self.first, self.size, self.at = np.full(buckets, LEVELS, np.int64), np.full(buckets, 64, np.int64), np.zeros(buckets, np.int64)
        bits, at = [np.zeros(8, np.uint8)], 64  # ranges without bigrams share an empty stretch
        for b, blob in segments.items():
            first, part = _unpack(blob, "<i8", "<u1")
            self.first[b], self.size[b], self.at[b] = first[0], 8 * len(part), at
            bits.append(part)
            at += 8 * len(part)
        self.bits = np.concatenate(bits)

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """The middle of the bin of each bigram's highest level found; 0 if its lowest is not there."""
        return _middle(self.levels(keys))

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """Each bigram's highest level found; 0 if its lowest is not there."""
        b = _bucket(keys, self.buckets).astype(np.int64)
        level, live = self.first[b], np.arange(len(keys))
        out = np.zeros(len(keys), np.uint8)
        while len(live):
            k, size = keys[live], self.size[b[live]].astype(np.uint64)
            there = np.ones(len(live), bool)
            for spot in _spots(k, level[live], 1 if not len(size) else size):
                spot = spot.astype(np.int64) + self.at[b[live]]
                there &= (self.bits[spot >> 3] >> (spot & 7).astype(np.uint8) & 1).astype(bool)
            live = live[there]
            out[live] = level[live]
            level[live] += 1
            live = live[level[live] < LEVELS]
        return out


def score(spark: SparkSession, docs: DataFrame, learned: Column, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``.

    ``learned``: a condition that marks the rows to learn from. Tokens are words cut at ASCII white space, lower-cased in A-Z, and one end for
    each text; null text counts as empty, so it is the end alone. ``base_score`` adds log10((c + 1) / (N + V + 1)) over the tokens with exact counts of the
    learned rows. ``score`` mixes that probability with the bigram's: its count from the filter over the exact count
    of the token before it. The filter stores all levels of all bigrams, whatever the size of the corpus.
    Null ids and repeated rows are scored like others; other columns are not read; an empty table gives an empty table.
    """
    buckets = partitions(spark)
    rows = docs.select(F.col(id), F.col(text).cast("string").alias("text"), F.coalesce(learned, F.lit(False)).alias("learned"))
    kind = docs.schema[id].dataType.simpleString()
    parts = written(spark, rows.mapInArrow(_parts, f"part string, ids array<{kind}>, packed binary"), "uncompressed")
    counted = parts.select("part", "packed").mapInArrow(_counted(buckets), "bucket int, part string, packed binary")
    merged = counted.repartitionById(buckets, "bucket").mapInArrow(_merged, "bucket int, part string, packed binary, tokens long, types long")
    merged = written(spark, merged, "uncompressed")
    sums = merged.agg(F.sum("tokens").alias("tokens"), F.sum("types").alias("types")).first()
    total, types = int(sums["tokens"] or 0), int(sums["types"] or 0)
    starts = float(rows.filter("learned").count())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, blob, lists in zip(batch.column(0), batch.column(1), batch.column(2)):
                sizes, distinct, place, _ = _unpack(blob.as_py(), *_PART)
                lists = sorted(lists.as_py(), key=lambda x: x["bucket"])
                counts, levels = (np.concatenate(x) for x in zip(*(_unpack(x["packed"], "<u8", "<u1") for x in lists)))
                c = counts[place].astype(float)
                _, at = np.unique(_bigrams(sizes, distinct[place]), return_inverse=True)
                first = np.cumsum(sizes) - sizes
                before = np.empty_like(c)
                before[1:] = c[:-1]
                before[first] = starts
                base = (c + 1) / (total + types + 1)
                pair = np.minimum(_middle(levels)[at], np.minimum(before, c)) / np.maximum(before, 1)
                mixed = np.where(before > 0, SHARE * pair + (1 - SHARE) * base, base)
                yield pa.record_batch(
                    [ids.values, pa.array(sizes), pa.array(np.add.reduceat((c > 0).astype(np.int64), first)), pa.array(np.full(len(sizes), total)), pa.array(np.add.reduceat(np.log10(base), first)), pa.array(np.add.reduceat(np.log10(mixed), first))],
                    ["id", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    counts = merged.filter("part IS NOT NULL").groupBy("part").agg(F.collect_list(F.struct("bucket", "packed")).alias("counts"))  # one for each bucket
    out = parts.join(counts, "part").select("ids", "packed", "counts")
    return out.mapInArrow(work, f"id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double").withColumnRenamed("id", id)
