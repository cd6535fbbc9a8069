"""Best-fit packing of token pieces by a configuration linear program over the histogram of their lengths.

A configuration is a multiset of lengths that fits a sequence. Lengths are first rounded up to a bounded number of classes with about as many tokens each;
the shortest lengths, with a stated share of all tokens, stay out to fill up what room the others leave. The program (fewest configurations that cover
every class's count) is solved by multiplicative weights: each step prices the classes, a knapsack dynamic program gives the dearest configuration and,
for each class, the dearest that holds it; those within a small share of the dearest are taken as often as their scarcest class allows, and the prices
of what they cover fall. Older steps count less and less. The steps end when the cover is within a stated gap of the lower bound that the prices, or their
mean over the steps, give. The solution is rounded in the order of its weights while the counts last, its places are given to items of their class, and
what is left is packed best fit, longest first, into what room there is. All of this works on at most ``capacity`` counts, whatever the corpus.
"""

from __future__ import annotations

import json
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bpe
from .shared import partitions, written

CAPACITY = 2048
END = 0
#: Classes of lengths in the program, and the share of all tokens, in the shortest lengths, that stays out of it.
CLASSES, FILL = 48, 0.25
#: Steps in which sequences of the program are given up.
PARTS = 10
#: The gap between cover and bound at which the steps end, and a limit of steps, far above what it takes.
GAP, STEPS = 0.05, 800
#: The rates at which prices fall in the first and in late steps and how it shrinks; what a step's cover and prices still count a step later; how far a
#: configuration may be below the dearest.
RATE, LAST_RATE, SHRINK, KEPT, MEAN, NEAR = 0.2, 0.02, 0.997, 0.99, 0.98, 0.01

Configurations = list[tuple[tuple[tuple[int, int], ...], int]]  # ((length, times), ...), how many sequences


def knapsack(prices: np.ndarray, capacity: int) -> np.ndarray:
    """The largest total price within each room up to ``capacity``, any length any number of times. Prices of -inf are not used."""
    best = np.zeros(capacity + 1)
    lengths = np.flatnonzero(prices > -np.inf)
    worth, upto = prices[lengths], np.searchsorted(lengths, np.arange(capacity + 1), "right").tolist()
    for c in range(1, capacity + 1):
        best[c] = max(best[c - 1], (worth[: upto[c]] + best[c - lengths[: upto[c]]]).max(initial=0.0))
    return best


def dear(prices: np.ndarray, best: np.ndarray, left: np.ndarray, start: int, room: int, slack: float) -> dict[int, int]:
    """A configuration of length ``start`` and more, less than ``slack`` below the dearest: at each room the length of which most is left."""
    out, lengths = {start: 1}, np.flatnonzero(left > 0)
    room -= start
    while room > 0:
        lengths = lengths[: int(np.searchsorted(lengths, room, "right"))]
        loss = best[room] - prices[lengths] - best[room - lengths]
        good = lengths[loss <= slack]
        if not len(good):
            break
        n = int(good[(left[good] * good).argmax()])
        if out.get(n, 0) >= left[n]:
            lengths = lengths[lengths != n]
            continue
        slack -= max(0.0, best[room] - prices[n] - best[room - n])
        out[n] = out.get(n, 0) + 1
        room -= n
    return out


def classes(counts: np.ndarray, most: int = CLASSES) -> np.ndarray:
    """The largest lengths of at most ``most`` classes: each used length its own if they are few, else runs of lengths with about as many tokens each."""
    used = np.flatnonzero(counts)
    if len(used) <= most:
        return used
    tokens = np.cumsum(counts[used] * used)
    part = (tokens - 1) * most // tokens[-1]
    return used[np.append(np.flatnonzero(np.diff(part)), len(used) - 1)]


def fractional(counts: np.ndarray, capacity: int, steps: int = STEPS, gap: float = GAP) -> tuple[dict[tuple[tuple[int, int], ...], float], float]:
    """Configurations and how often each is used to cover all counts, and a lower bound of any cover's size."""
    lengths, used = np.arange(capacity + 1), counts > 0
    if not used.any():
        return {}, 0.0
    prices, mean, rate = np.where(used, lengths / capacity, -np.inf), np.where(used, 0.0, -np.inf), RATE
    cover, found, bound = np.zeros(capacity + 1), defaultdict(float), 0.0
    step, best_size, out = 0, np.inf, {}
    while step < steps or not out:
        best, step = knapsack(prices, capacity), step + 1
        top = best[capacity]
        bound = max(bound, float((counts[used] * prices[used]).sum()) / top)
        mean[used] = MEAN * mean[used] + prices[used] / top
        if step % 10 == 0:
            bound = max(bound, float((counts[used] * mean[used]).sum()) / knapsack(mean, capacity)[capacity])
        value = np.where(used, prices + best[capacity - lengths], -np.inf)
        left = counts.astype(np.int64).copy()
        good = np.flatnonzero(value >= (1 - NEAR) * top)
        for n in good[np.argsort(-value[good], kind="stable")].tolist():
            while left[n] > 0:
                chosen = dear(prices, best, left, n, capacity, value[n] - (1 - NEAR) * top)
                share = min(int(left[m]) // k for m, k in chosen.items())
                if share < 1 or sum(prices[m] * k for m, k in chosen.items()) < (1 - NEAR) * top:
                    break
                found[tuple(sorted(chosen.items(), reverse=True))] += share
                for m, k in chosen.items():
                    left[m] -= share * k
        fresh = np.where(used, 1 - left / np.maximum(counts, 1), 0)
        cover = KEPT * (cover + fresh)
        for config in found:
            found[config] *= KEPT
        prices[used] *= np.exp(-rate * fresh[used])
        prices[used] /= prices[used].max()
        rate = max(LAST_RATE, rate * SHRINK)
        least = cover[used].min()
        size = sum(found.values()) / least if least > 0 else np.inf
        if size < best_size:
            best_size, out = size, {config: x / least for config, x in found.items() if x / least > 1e-6}
            if size <= (1 + gap) * bound:
                break
    return out, bound


def best_fit(counts: np.ndarray, capacity: int, begun: Configurations = ()) -> Configurations:
    """Best fit, longest first, on counts, also into the rooms of sequences that are begun: bins with the same content move together."""
    bins: dict[int, dict[tuple[int, ...], int]] = defaultdict(lambda: defaultdict(int))  # free room -> content -> bins
    room = np.zeros(capacity + 1, bool)
    for config, number in begun:
        free = capacity - sum(n * k for n, k in config)
        bins[free][tuple(n for n, k in config for _ in range(k))] += number
        room[free] = True
    for n in range(capacity, 0, -1):
        left = int(counts[n])
        while left:
            free = n + int(room[n:].argmax())
            if not room[free]:
                each = min(left, capacity // n)
                new, free_then = left // each, capacity - each * n
                bins[free_then][(n,) * each] += new
                room[free_then] = True
                left -= new * each
                continue
            content, have = bins[free].popitem()
            put = min(left, have)
            if have > put:
                bins[free][content] += have - put
            room[free] = bool(bins[free])
            bins[free - n][(*content, n)] += put
            room[free - n] = True
            left -= put
    out = []
    for group in bins.values():
        for content, number in group.items():
            sizes: dict[int, int] = defaultdict(int)
            for n in content:
                sizes[n] += 1
            out.append((tuple(sorted(sizes.items(), reverse=True)), number))
    return sorted(out)


def rounded(counts: np.ndarray, solution: dict[tuple[tuple[int, int], ...], float]) -> Configurations:
    """Whole parts of the solution's configurations, by weight, while the counts last."""
    left, out = counts.astype(np.int64).copy(), []
    for config, x in sorted(solution.items(), key=lambda c: (-c[1], c[0])):
        number = min(int(x), *(int(left[n]) // k for n, k in config))
        if number > 0:
            out.append((config, number))
            for n, k in config:
                left[n] -= number * k
    return out


def filled(plan: Configurations, tops: np.ndarray, counts: np.ndarray) -> tuple[Configurations, np.ndarray]:
    """Configurations of classes with items of the classes in their places, longest first; the counts that are left."""
    left, out = counts.copy(), []
    longest = {n: n for n in tops.tolist()}
    for config, number in plan:
        while number:
            chosen = {}
            for n, k in config:
                while not left[longest[n]]:
                    longest[n] -= 1
                at = longest[n]
                while k:
                    if use := min(k, int(left[at])):
                        chosen[at] = use
                    k, at = k - use, at - 1
            times = min(number, *(int(left[n]) // k for n, k in chosen.items()))
            for n, k in chosen.items():
                left[n] -= times * k
            out.append((tuple(sorted(chosen.items(), reverse=True)), times))
            number -= times
    return out, left


def planned(counts: np.ndarray, capacity: int, steps: int = STEPS) -> tuple[Configurations, int]:
    """Configurations that use every item once, and how many of the sequences are begun by the program: all that it has, unless best fit alone needs
    fewer. Then the least full of them are given up, a tenth at a time, until it does not."""
    left = counts.astype(np.int64).copy()
    full: Configurations = [(((capacity, 1),), int(left[capacity]))] if left[capacity] else []
    left[capacity] = 0
    sequences = lambda plan: sum(number for _, number in plan)
    plain = best_fit(left, capacity)
    tokens = np.cumsum(left * np.arange(capacity + 1))
    if not tokens[-1]:
        return full, 0
    inside = left.copy()
    inside[: int(np.searchsorted(tokens, FILL * tokens[-1]))] = 0
    tops, grouped = classes(inside), np.zeros(capacity + 1, np.int64)
    grouped[tops] = np.add.reduceat(inside, np.concatenate([[0], tops[:-1] + 1]))
    begun, _ = filled(rounded(grouped, fractional(grouped, capacity, steps)[0]), tops, inside)
    begun.sort(key=lambda c: (-sum(n * k for n, k in c[0]), c))
    for part in range(PARTS, 0, -1):
        kept, rest = [], left.copy()
        most = sequences(begun) * part // PARTS
        for config, number in begun:
            number = min(number, most)
            most -= number
            if number:
                kept.append((config, number))
                for n, k in config:
                    rest[n] -= number * k
        plan = best_fit(rest, capacity, kept)
        if sequences(plan) <= sequences(plain):
            return full + plan, sequences(kept)
    return full + plain, 0


def configurations(counts: np.ndarray, capacity: int = CAPACITY) -> Configurations:
    """Configurations that use every item once. ``counts[n]``: items of length n."""
    return planned(counts, capacity)[0]


def layout(plan: Configurations) -> dict[str, np.ndarray]:
    """For each (length, first rank): times in its configuration, first sequence, first offset; sorted for a binary search."""
    rows, first, taken = [], 0, defaultdict(int)
    for config, number in plan:
        offset = 0
        for n, k in config:
            rows.append((n << 40 | taken[n], taken[n], k, first, offset, n))
            taken[n] += number * k
            offset += n * k
        first += number
    table = np.array(sorted(rows), np.int64).reshape(-1, 6)
    return dict(zip(("key", "rank", "times", "sequence", "offset", "length"), table.T))


class Tokens:
    """The vocabulary's ids by a compiled tokeniser; texts beyond ``LONG`` by our own encoder, whose memory does not grow with a run of one character."""

    LONG = 1_000_000

    def __init__(self, spec: str):
        self.spec, data, letters = spec, json.loads(spec), bpe.byte_letters()
        self.special = {t["content"]: t["id"] for t in data.get("added_tokens") or []}
        ranks = {bytes(map(letters.__getitem__, t)): i for t, i in data["model"]["vocab"].items() if t not in self.special}
        self.coder = tiktoken.Encoding("vocabulary", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens=self.special)

    def encode(self, text: str) -> bytes:
        if len(text) > self.LONG:
            return bpe.encoder_of(self.spec).encode([text])[0]
        if any(s in text for s in self.special):
            ids = self.coder.encode(text, allowed_special="all")
        else:
            ids = self.coder.encode_ordinary(text)
        return np.array(ids, "<u4").tobytes()


_tokens: dict[str, Tokens] = {}


def tokens_of(spec: str) -> Tokens:
    """Made once per Python worker."""
    if spec not in _tokens:
        _tokens.clear()
        _tokens[spec] = Tokens(spec)
    return _tokens[spec]


def pieces(spark: SparkSession, docs: DataFrame, vocabulary_path: str, capacity: int = CAPACITY, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document's ids and the end id, cut into pieces of ``capacity``; only a first piece may be shorter."""
    spec = spark.sparkContext.broadcast(bpe.vocabulary(vocabulary_path))
    end = np.array([END], "<u4").tobytes()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokens_of(spec.value)
        for batch in batches:
            for ids, texts in bpe.slices(batch.column(0), batch.column(1)):
                out: list[list] = [[], [], [], [], []]
                for k, packed in enumerate(map(coder.encode, texts)):
                    packed += end
                    n = len(packed) // 4
                    cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
                    for p, (a, b) in enumerate(zip(cuts, cuts[1:])):
                        for column, value in zip(out, (k, p, a, b - a, zlib.crc32(packed[4 * a : 4 * b]))):
                            column.append(value)
                yield pa.record_batch([ids.take(pa.array(out[0], pa.int64())), pa.array(out[1], pa.int32()), *(pa.array(c, pa.int64()) for c in out[2:])], ["id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema[id].dataType.simpleString()
    return docs.select(F.col(id), F.col(text).cast("string")).mapInArrow(work, f"id {kind}, piece int, start long, length long, ids_crc32 long")


def pack(spark: SparkSession, docs: DataFrame, vocabulary_path: str, capacity: int = CAPACITY, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: id, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``, ``offset``.

    Null text counts as empty; an empty text is one piece with the end id alone. Null ids and repeated rows are packed as
    documents of their own. An empty table gives an empty table; other columns are not read. Pieces of one length are
    numbered in parts, so that a length which a third of all pieces have is dealt over many tasks.
    """
    parts = 4 * partitions(spark)
    cut = pieces(spark, docs, vocabulary_path, capacity, id, text)
    cut = written(spark, cut.withColumn("part", F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.lit(parts)).cast("int")))
    counted = cut.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    counts = np.zeros(capacity + 1, np.int64)
    for row in counted.groupBy("length").agg(F.sum("n").alias("n")).collect():  # capacity rows at most
        counts[row["length"]] = row["n"]
    plan = spark.sparkContext.broadcast(layout(configurations(counts, capacity)))  # bounded by the capacity, not by the corpus

    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counted.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("length", "part").orderBy("id", "piece", "ids_crc32")
    ranked = cut.withColumn("rank", F.row_number().over(inside) - 1).join(starts, ["length", "part"])
    ranked = ranked.select("id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).cast("long").alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where = plan.value
        for batch in batches:
            length, rank = (batch.column(k).to_numpy(zero_copy_only=False) for k in (3, 5))
            at = np.searchsorted(where["key"], length << 40 | rank, "right") - 1
            rank = rank - where["rank"][at]
            sequence = where["sequence"][at] + rank // where["times"][at]
            offset = where["offset"][at] + rank % where["times"][at] * length
            yield pa.record_batch([*batch.columns[:5], pa.array(sequence), pa.array(offset)], ["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    kind = docs.schema[id].dataType.simpleString()
    out = ranked.mapInArrow(place, f"id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return out.withColumnRenamed("id", id)
