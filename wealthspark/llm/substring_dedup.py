"""Repeated passages: windows of k words that also start in a document with a smaller id, by super-k-mers.

Consecutive windows whose smallest three-word sequence (the minimiser, by hash) is the same one travel as one packed string of words
to the minimiser's bucket. Equal windows have equal minimisers, so a bucket sees all places of its windows; sorting them there finds
each window's smallest document id. A word travels as 40 bits of its hash, as a place in its package's sorted list of words; windows
are compared in all their words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import slices
from .shared import partitions
from .words import joined, mix, word_numbers

WINDOW, MINIMISER = 13, 3
#: Bytes of text whose super-k-mers are packed together; bounds a task's memory.
TOGETHER = 12 << 20
#: Runs whose words are compared at once.
_AT_ONCE = 1 << 14
_FACTOR = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_FACTOR), -1, 1 << 64))
_RUN = np.dtype([("id", "<i8"), ("mark", "<i8"), ("start", "<i4"), ("n", "<i4")])


def _planes(a: np.ndarray) -> bytes:
    """All first bytes, then all second bytes, and so on: small numbers then compress well."""
    return np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _of_planes(data: bytes, n: int, at: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8, 8 * n, at).reshape(8, n).T).view("<u8").ravel()


def _packed(runs: np.ndarray, words: np.ndarray) -> bytes:
    distinct, places = np.unique(words, return_inverse=True)
    head = np.array([len(runs), len(distinct), len(words)], "<i8").tobytes()
    parts = [head, *(np.ascontiguousarray(runs[name]).tobytes() for name in _RUN.names), _planes(np.diff(distinct, prepend=np.uint64(0))), _planes(places)]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def _unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    n, n_distinct, n_words = np.frombuffer(data, "<i8", 3).tolist()
    runs, at = np.empty(n, _RUN), 24
    for name in _RUN.names:
        runs[name] = np.frombuffer(data, _RUN[name], n, at)
        at += n * _RUN[name].itemsize
    distinct = np.cumsum(_of_planes(data, n_distinct, at), dtype=np.uint64)
    return runs, distinct[_of_planes(data, n_words, at + 8 * n_distinct).astype(np.int64)]


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each of ``starts``, ``sizes`` of them."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


def super_kmers(ids: np.ndarray, marks: np.ndarray, numbers: list[np.ndarray], k: int, buckets: int) -> Iterator[tuple[int, bool, bytes]]:
    """(bucket, settled, packed) of some documents. Settled runs are known to be repeats: the same super-k-mer stands in
    a smaller document of this part, so only the smallest one's travels to be compared (a combiner before the shuffle)."""
    sizes = np.fromiter(map(len, numbers), np.int64, len(numbers))
    words, doc = np.concatenate(numbers), np.repeat(np.arange(len(numbers)), sizes)
    first = np.cumsum(sizes) - sizes
    if len(words) < k:
        return
    starts = np.flatnonzero(doc[: len(words) - k + 1] == doc[k - 1 :])
    if not len(starts):
        return
    mers = words
    for j in range(1, MINIMISER):
        mers = joined(mers[: len(words) - MINIMISER + 1], words[j : len(words) - MINIMISER + 1 + j])
    wide = k - MINIMISER + 1
    where = np.arange(len(mers) - wide + 1)
    least = mers[: len(where)].copy()
    for j in range(1, wide):
        other = mers[j : j + len(where)]
        better = other < least
        least[better] = other[better]
        where[better] = np.flatnonzero(better) + j
    where = where[starts]
    new = np.flatnonzero(np.concatenate([[True], (where[1:] != where[:-1]) | (starts[1:] != starts[:-1] + 1)]))
    runs = np.empty(len(new), _RUN)
    begin, n = starts[new], np.diff(np.append(new, len(starts)))
    owner = doc[begin]
    runs["id"], runs["mark"], runs["start"], runs["n"] = ids[owner], marks[owner], begin - first[owner], n
    bucket = (least[begin] % np.uint64(buckets)).astype(np.int64)
    # a hash of each run's words
    power = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(len(words), _FACTOR)]))
    back = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(len(words), _INVERSE)]))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(words) * power[:-1])])
    whole = mix((sums[begin + n + k - 1] - sums[begin]) * back[begin] + n.astype(np.uint64))
    by = np.lexsort((runs["id"], whole))
    head = np.concatenate([[True], whole[by][1:] != whole[by][:-1]])
    del mers, where, starts, power, back, sums, doc  # long arrays that packing does not need
    lead = by[head][np.cumsum(head) - 1]
    settled = np.zeros(len(runs), bool)
    settled[by] = (runs["id"][by] > runs["id"][lead]) & (n[by] == n[lead])
    of_lead = np.empty(len(runs), np.int64)
    of_lead[by] = lead
    # the hash only proposes: each is compared with its smallest in all words, and travels itself if they differ
    said = np.flatnonzero(settled)
    for at in range(0, len(said), _AT_ONCE):
        some = said[at : at + _AT_ONCE]
        long = n[some] + k - 1
        same = words[_spread(begin[some], long)] == words[_spread(begin[of_lead[some]], long)]
        settled[some] = np.logical_and.reduceat(same, np.cumsum(long) - long)
    yield int(bucket[0]), True, _packed(runs[settled], words[:0])
    go = np.flatnonzero(~settled)
    go = go[np.argsort(bucket[go], kind="stable")]
    short = words >> np.uint64(24)
    edges = np.flatnonzero(np.diff(bucket[go])) + 1
    for part in np.split(go, edges):
        if len(part):
            yield int(bucket[part[0]]), False, _packed(runs[part], short[_spread(begin[part], n[part] + k - 1)])


def repeats(runs: np.ndarray, words: np.ndarray, k: int) -> np.ndarray:
    """Of all super-k-mers of a bucket, the stretches of windows that also start in a smaller document."""
    n = runs["n"].astype(np.int64)
    at = np.cumsum(n + k - 1) - (n + k - 1)
    place, ids = _spread(at, n), np.repeat(runs["id"], n)
    key = np.zeros(len(place), np.uint64)
    for j in range(k):
        key = mix(key * _FACTOR + words[place + j])
    order = np.argsort(key)
    head = np.concatenate([[True], key[order][1:] != key[order][:-1]])
    number = np.cumsum(head) - 1
    lead = order[head][number]
    same = np.ones(len(order), bool)
    for j in range(k):
        same &= words[place[order] + j] == words[place[lead] + j]
    smallest = np.minimum.reduceat(ids[order], np.flatnonzero(head))
    repeated = np.zeros(len(place), bool)
    repeated[order] = ids[order] > smallest[number]
    if not same.all():  # different windows under one key: compare their words instead
        for group in np.unique(number[~same]):
            members = order[number == group]
            texts = [words[place[x] : place[x] + k].tobytes() for x in members]
            least: dict[bytes, int] = {}
            for x, t in zip(members, texts):
                least[t] = min(least.get(t, ids[x]), ids[x])
            repeated[members] = [ids[x] > least[t] for x, t in zip(members, texts)]
    flat = np.concatenate([[False], repeated, [False]])
    bounds = np.zeros(len(flat), bool)
    bounds[(np.cumsum(n) - n) + 1] = True  # a stretch does not go on into the next run
    rise = np.flatnonzero(flat[1:-1] & (~flat[:-2] | bounds[1:-1]))
    fall = np.flatnonzero(flat[1:-1] & (~flat[2:] | bounds[2:]))
    run = np.repeat(np.arange(len(runs)), n)[rise]
    out = runs[run]
    out["start"] += (rise - (np.cumsum(n) - n)[run]).astype(np.int32)
    out["n"] = fall - rise + 1
    return out


def remove_repeats(spark: SparkSession, docs: DataFrame, k: int = WINDOW, id: str = "doc_id", text: str = "text", buckets: int | None = None) -> DataFrame:
    """One row per row of ``docs``: id, ``n_words``, ``n_removed``, ``kept_text`` (the kept words joined by one space).

    Words are cut at ASCII white space and otherwise unchanged. A word goes if it is in a window of ``k`` words that also starts in a document
    with a smaller id; all windows are judged on the input. Null and empty texts, and texts shorter than a window,
    lose nothing. Ids are integers; a row with a null id is left whole and takes nothing from others; rows
    repeated with one id are no repeats of each other. Other columns are not read; an empty table gives an empty table.
    ``buckets`` (default: the session's shuffle partitions): a task holds one bucket in memory.
    """
    buckets = buckets or partitions(spark)
    docs = docs.select(F.col(id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    docs = docs.withColumn("mark", F.xxhash64(F.coalesce("text", F.lit(""))))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start = 0
            for ids, texts in slices(batch.column(0), batch.column(1), TOGETHER):
                marks = batch.column(2).slice(start, len(ids)).to_numpy()
                start += len(ids)
                out = list(super_kmers(ids.to_numpy(), marks, [word_numbers(t.encode().split()) for t in texts], k, buckets))
                yield pa.record_batch([pa.array([r[0] for r in out], pa.int32()), pa.array([r[1] for r in out], pa.bool_()), pa.array([r[2] for r in out], pa.binary())], ["bucket", "settled", "packed"])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_runs: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for batch in batches:
            for bucket, settled, blob in zip(*(c.to_pylist() for c in batch.columns)):
                got = _unpacked(blob)
                if settled:
                    yield rows(got[0])
                else:
                    open_runs.setdefault(bucket, []).append(got)
        for parts in open_runs.values():
            yield rows(repeats(np.concatenate([r for r, _ in parts]), np.concatenate([w for _, w in parts]), k))

    def rows(runs: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch([pa.array(np.ascontiguousarray(runs[name])) for name in _RUN.names], list(_RUN.names))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start = 0
            for ids, texts in slices(batch.column(0), batch.column(1)):
                ranges = batch.column(2).slice(start, len(ids)).to_pylist()
                start += len(ids)
                n, gone, kept = [], [], []
                for t, found in zip(texts, ranges):
                    words = t.encode().split()
                    n.append(len(words))
                    if found:
                        steps = np.zeros(len(words) + 1, np.int64)
                        np.add.at(steps, [r["start"] for r in found], 1)
                        np.add.at(steps, [r["start"] + r["n"] + k - 1 for r in found], -1)
                        keep = np.cumsum(steps)[:-1] == 0
                        words = [words[i] for i in np.flatnonzero(keep).tolist()]
                    gone.append(n[-1] - len(words))
                    kept.append(b" ".join(words))
                yield pa.record_batch([ids, pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["id", "n_words", "n_removed", "kept_text"])

    packed = docs.filter("id IS NOT NULL").select("id", "text", "mark").mapInArrow(pack, "bucket int, settled boolean, packed binary")
    found = packed.repartitionById(buckets, "bucket").mapInArrow(find, "id long, mark long, start int, n int")
    found = found.groupBy("id", "mark").agg(F.collect_list(F.struct("start", "n")).alias("ranges"))  # at most one document's windows
    out = docs.join(found, ["id", "mark"], "left").select("id", "text", "ranges").mapInArrow(cut, "id long, n_words long, n_removed long, kept_text string")
    return out.withColumnRenamed("id", id)
