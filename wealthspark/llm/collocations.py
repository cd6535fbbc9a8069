"""Collocations: phrases of two to four words whose parts seldom stand apart, with exact counts per language.

Counts come from suffix trees of depth four, built in vertical parts. A first scan counts words, a second one pairs by their hashes, so that suffixes can be cut where
no phrase that is frequent enough goes on. Prefixes are grouped so that a group's suffixes fit a memory budget: a prefix above the budget is
lengthened by a word (one more scan counts the longer ones), large ones are put together largest first, and the many small ones are dealt by hash. A last
scan sends each suffix, cut to four words, to its prefix's group; a group sorts its suffixes, and the totals of the leaves below
a node are its count. Suffixes are summed before they move, so repeated passages stay small.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from heapq import heapify, heapreplace

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import Tables, partitions
from .words import joined, mix, word_numbers

#: Words of a phrase at most, occurrences of a phrase at least, and phrases that are told for each language.
DEPTH, LEAST, TOP = 4, 30, 2000
#: Suffixes of a group; larger only where there would be more than ``GROUPS`` groups. A prefix with an eighth of it has its group by name.
BUDGET, GROUPS, NAMED = 1 << 21, 1 << 16, 8
#: Tokens that a task gathers before it sums suffixes, bytes of text cut into words at a time, and words that it counts before it sends them on.
BLOCK, CHUNK, WORDS_HELD = 1 << 20, 8 << 20, 300_000
#: Filters of words and of pairs that are frequent enough have 2 ** so many bits: fixed sizes, so that they can be broadcast. They let some rare ones pass,
#: never drop a frequent one.
WORD_BITS, PAIR_BITS = 26, 27
#: Bits of a pair's hash that are counted by.
PAIR_HASH = 40

_PIECES = bytes(ord("\n") if chr(c) in ".,;:!?\n\v\f\r" else ord(" ") if c == 9 else c for c in range(256))
_BREAK = b"."  # no word: it ends pieces itself

Prefix = tuple[int, ...]


def _chunks(text: str) -> Iterator[list[bytes]]:
    """The text's words and, as ``_BREAK``, the ends of its pieces, a part of the text after the other."""
    data, at = text.encode().lower().translate(_PIECES), 0
    while at < len(data):
        end = at + CHUNK
        if end < len(data):  # up to the next white space, so that no word is cut
            ends = [x for x in (data.find(b" ", end), data.find(b"\n", end)) if x >= 0]
            end = min(ends, default=len(data))
        yield data[at:end].replace(b"\n", b" . ").split()
        at = end


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[str, str]]:
    for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
        yield lang, text.as_py()


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) -> (lang, word, n), summed while they fit."""
    counts: dict[str, Counter] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, words in counts.items():
            words.pop(_BREAK, None)
            keys = list(words)
            for k in range(0, len(keys), 50_000):
                part = keys[k : k + 50_000]
                yield pa.record_batch([pa.array([lang] * len(part)), pa.array(part, pa.binary()), pa.array([words[w] for w in part])], ["lang", "word", "n"])
        counts.clear()

    for batch in batches:
        for lang, text in _texts(batch):
            for tokens in _chunks(text):
                counts.setdefault(lang, Counter()).update(tokens)
            if sum(map(len, counts.values())) > WORDS_HELD:
                yield from flush()
    yield from flush()


def _seed(lang: str, salt: int) -> np.uint64:
    return np.uint64(xxhash.xxh3_64_intdigest(lang.encode(), salt))


def _ids(words: list[bytes], seed: np.uint64) -> np.ndarray:
    """Numbers of the words of a language; 0 stands for none."""
    ids = mix(word_numbers(words) + seed)
    ids[ids == 0] = 1
    return ids


def _named(salt: int):
    """(lang, word, n) -> (lang, word, n, key): the number as eight bytes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, words = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            seeds = {lang: _seed(lang, salt) for lang in set(langs)}
            ids = _ids(words, np.array([seeds[x] for x in langs], np.uint64)) if words else np.zeros(0, np.uint64)
            data = ids.astype(">u8").tobytes()
            yield pa.record_batch([*batch.columns, pa.array([data[k : k + 8] for k in range(0, len(data), 8)], pa.binary())], ["lang", "word", "n", "key"])

    return work


class Frequent:
    """Filters of words and, once they are counted, of pairs."""

    def __init__(self, words: np.ndarray, pairs: np.ndarray | None = None):
        self.words, self.pairs = words, pairs

    @staticmethod
    def _bits(filter: np.ndarray, at: np.ndarray) -> np.ndarray:
        return (filter[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)

    def word(self, ids: np.ndarray) -> np.ndarray:
        return self._bits(self.words, (ids >> np.uint64(64 - WORD_BITS)).astype(np.int64))

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        there = (left != 0) & (right != 0)
        if self.pairs is not None:
            there[there] = self._bits(self.pairs, (joined(left[there], right[there]) >> np.uint64(64 - PAIR_BITS)).astype(np.int64))
        return there


def _blocks(batches: Iterator[pa.RecordBatch], salt: int, frequent: Frequent) -> Iterator[tuple[str, np.ndarray]]:
    """(lang, a row of word numbers for each suffix): suffixes that begin with a pair that may be frequent, cut at four words, at a piece's end, before a
    word that surely is rare and before a word that surely is rare after the word in front of it."""
    held: dict[str, list[np.ndarray]] = {}
    sizes: Counter = Counter()
    total = 0

    def suffixes(lang: str) -> Iterator[tuple[str, np.ndarray]]:
        every = np.concatenate([*held.pop(lang), np.zeros(DEPTH, np.uint64)])
        for start in range(0, len(every) - DEPTH, BLOCK):
            ids = every[start : start + BLOCK + DEPTH - 1]
            ids[~frequent.word(ids)] = 0
            n = len(ids) - DEPTH + 1
            goes_on = frequent.pair(ids[:-1], ids[1:])
            rows = np.flatnonzero(goes_on[:n])
            out = np.stack([ids[rows + k] for k in range(DEPTH)], axis=1)
            cut = np.zeros(len(rows), bool)
            for k in range(2, DEPTH):
                cut |= ~goes_on[rows + k - 1]
                out[cut, k] = 0
            yield lang, out

    stop = word_numbers([_BREAK])[0]
    for batch in batches:
        for lang, text in _texts(batch):
            seed = _seed(lang, salt)
            mine = held.setdefault(lang, [])
            for tokens in _chunks(text):
                numbers = word_numbers(tokens)
                ids = mix(numbers + seed)
                ids[ids == 0] = 1
                ids[numbers == stop] = 0
                mine.append(ids)
                sizes[lang] += len(ids)
                total += len(ids)
            mine.append(np.zeros(1, np.uint64))
            while total >= BLOCK:
                largest = max(sizes, key=sizes.get)
                total -= sizes.pop(largest)
                yield from suffixes(largest)
    for lang in list(held):
        yield from suffixes(lang)


def _narrow(a: np.ndarray) -> np.ndarray:
    """The same numbers in as few bytes as they need."""
    return a.astype(np.min_scalar_type(int(a.max(initial=0))))


def _pair_counts(salt: int, shared, parts: int):
    """(lang, text) -> (part, packed): a block's pairs by the upper bits of their hashes, sorted, in differences, with their counts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = -(-(1 << PAIR_HASH) // parts)
        for _, rows in _blocks(batches, salt, shared.value):
            keys, n = np.unique(joined(rows[:, 0], rows[:, 1]) >> np.uint64(64 - PAIR_HASH), return_counts=True)
            edges = np.searchsorted(keys, (np.arange(parts + 1) * width).astype(np.uint64)).tolist()
            there = [p for p in range(parts) if edges[p] < edges[p + 1]]
            packed = [_pack(keys[edges[p] : edges[p] + 1], _narrow(np.diff(keys[edges[p] : edges[p + 1]])), _narrow(n[edges[p] : edges[p + 1]])) for p in there]
            yield pa.record_batch([pa.array(there, pa.int64()), pa.array(packed, pa.binary())], ["part", "packed"])

    return work


def _frequent_pairs(least: int):
    """A part's counts -> the filter's bits of pairs that may be frequent."""

    def work(table: pa.Table) -> pa.Table:
        keys, times = [], []
        for blob in table["packed"]:
            first, steps, n = _unpack(blob.as_py())
            keys.append(np.cumsum(np.concatenate([first, steps.astype(np.uint64)]), dtype=np.uint64))
            times.append(n.astype(np.int64))
        keys, at = np.unique(np.concatenate(keys), return_inverse=True)
        often = np.bincount(at, np.concatenate(times), len(keys)) >= least
        return pa.table({"place": np.unique(keys[often] >> np.uint64(PAIR_HASH - PAIR_BITS)).astype(np.int64)})

    return work


def _filter(places: DataFrame, bits: int) -> np.ndarray:
    """A filter with the bits at ``place``, put together in slices of 4096 bytes; the driver gets a fixed number of them."""
    slices = places.groupBy(F.shiftright("place", 15).alias("slice")).agg(F.expr("bitmap_construct_agg(place & 32767)").alias("bits"))
    out = np.zeros(1 << (bits - 3), np.uint8)
    for row in slices.collect():
        out[row["slice"] << 12 : (row["slice"] + 1) << 12] = np.frombuffer(row["bits"], np.uint8)
    return out


def _coded(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct numbers in order (0 first), and their places instead of the numbers."""
    distinct, codes = np.unique(rows, return_inverse=True)
    codes = codes.reshape(rows.shape)
    if not len(distinct) or distinct[0] != 0:
        distinct, codes = np.concatenate([np.zeros(1, np.uint64), distinct]), codes + 1
    return distinct, codes


def _summed(codes: np.ndarray, size: int, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows in order and how often they stand there: the leaves of a suffix tree."""
    p, q = codes[:, 0] * size + codes[:, 1], codes[:, 2] * size + codes[:, 3]
    by = np.lexsort((q, p))
    p, q = p[by], q[by]
    first = np.ones(len(p), bool)
    first[1:] = (p[1:] != p[:-1]) | (q[1:] != q[:-1])
    starts = np.flatnonzero(first)
    n = np.diff(np.append(starts, len(p))) if times is None else np.add.reduceat(times[by], starts)
    return codes[by[starts]], n.astype(np.int64)


def _pack(*arrays: np.ndarray) -> bytes:
    head = np.array([len(arrays), *(x for a in arrays for x in (a.itemsize, len(a)))], "<i8")
    return zstandard.ZstdCompressor(level=1).compress(b"".join([head.tobytes(), *(np.ascontiguousarray(a).tobytes() for a in arrays)]))


def _unpack(blob: bytes) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    number = int(np.frombuffer(data, "<i8", 1)[0])
    head, at, out = np.frombuffer(data, "<i8", 2 * number, 8).tolist(), 8 + 16 * number, []
    for size, n in zip(head[::2], head[1::2]):
        out.append(np.frombuffer(data, f"<u{size}", n, at))
        at += size * n
    return out


class Parts:
    """Which group a prefix belongs to. ``group``: prefix -> group, -1 if the prefix is above the budget and its longer ones have groups. ``count``: of those."""

    def __init__(self, counts: dict[Prefix, int], budget: int, total: int):
        self.count = {p: n for p, n in counts.items() if n > budget}
        self.group = dict.fromkeys(self.count, -1)
        loads: list[list[int]] = []
        for p, n in sorted(((p, n) for p, n in counts.items() if n <= budget), key=lambda x: (-x[1], x[0])):
            if loads and loads[0][0] + n <= budget:  # into the emptiest
                self.group[p] = loads[0][1]
                heapreplace(loads, [loads[0][0] + n, loads[0][1]])
            else:
                self.group[p] = len(loads)
                loads.append([n, len(loads)])
                heapify(loads)
        self.named = len(loads)
        self.hashed = max(1, -(-2 * total // budget))  # half full, as hashing does not fill them evenly

    def of(self, ids: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The group of each suffix (rows of codes in order); -1 for suffixes that are no longer than a prefix above the budget."""
        out = np.full(len(codes), -1, np.int64)
        rows, key, prefixes = np.arange(len(codes)), np.zeros(len(codes), np.uint64), np.zeros(len(codes), np.int64)
        for depth in range(1, DEPTH + 1):
            there = codes[rows, depth - 1] != 0
            rows, key = rows[there], key[there]
            if not len(rows):
                break
            key = joined(key, ids[codes[rows, depth - 1]])
            out[rows] = self.named + (key % np.uint64(self.hashed)).astype(np.int64)
            new = np.ones(len(rows), bool)
            new[1:] = (codes[rows[1:], :depth] != codes[rows[:-1], :depth]).any(axis=1)
            starts = np.flatnonzero(new)
            known = [self.group.get(tuple(p), -2) for p in ids[codes[rows[starts], :depth]].tolist()]
            prefixes = np.repeat(np.array(known, np.int64), np.diff(np.append(starts, len(rows))))
            out[rows[prefixes > -2]] = prefixes[prefixes > -2]
            rows, key = rows[prefixes == -1], key[prefixes == -1]
        return out


def _longer(salt: int, shared, depth: int):
    """(lang, text) -> (prefix, n): prefixes of ``depth`` words whose first words are a prefix above the budget."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, heavy = shared.value
        first = np.array(sorted({p[0] for p in heavy}), np.uint64)
        for _, rows in _blocks(batches, salt, frequent):
            rows = rows[np.isin(rows[:, 0], first) & (rows[:, depth - 1] != 0), :depth]
            keys, n = np.unique(rows, axis=0, return_counts=True)
            chosen = [k for k, p in enumerate(keys[:, :-1].tolist()) if tuple(p) in heavy]
            yield pa.record_batch([pa.array([keys[k].astype(">u8").tobytes() for k in chosen], pa.binary()), pa.array(n[chosen], pa.int64())], ["prefix", "n"])

    return work


def _sent(salt: int, shared):
    """(lang, text) -> (lang, part, packed): a block's distinct suffixes with their numbers, by group."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, parts = shared.value
        for lang, rows in _blocks(batches, salt, frequent):
            if not len(rows):
                continue
            ids, codes = _coded(rows)
            codes, n = _summed(codes, len(ids))
            group = parts.of(ids, codes)
            by = np.argsort(group, kind="stable")
            by = by[np.searchsorted(group[by], 0) :]
            numbers, starts = np.unique(group[by], return_index=True)
            out: list[list] = [[], []]
            for g, mine in zip(numbers.tolist(), np.split(by, starts[1:])):
                used, inside = np.unique(codes[mine], return_inverse=True)
                out[0].append(g)
                out[1].append(_pack(ids[used], *_narrow(inside.reshape(-1, DEPTH)).T, _narrow(n[mine])))
            yield pa.record_batch([pa.array([lang] * len(out[0])), pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary())], ["lang", "part", "packed"])

    return work


def _nodes(shared, least: int):
    """A group's packed suffixes -> its nodes of two words and more with ``least`` occurrences and more: (lang, words, depth, a, l2, l3), the last two the counts of
    its first two and three words."""

    def work(table: pa.Table) -> pa.Table:
        parts = shared.value
        ids, rows, times = [], [], []
        for blob in table["packed"]:
            used, *columns, n = _unpack(blob.as_py())
            ids.append(used)
            rows.append(np.stack(columns, axis=1))
            times.append(n.astype(np.int64))
        known = np.unique(np.concatenate([*ids, np.zeros(1, np.uint64)]))
        codes = np.concatenate([np.searchsorted(known, u)[r] for u, r in zip(ids, rows)])
        del ids, rows
        codes, n = _summed(codes, len(known), np.concatenate(times))
        new = np.zeros(len(codes), bool)
        new[:1] = True
        upper: list[tuple[np.ndarray, np.ndarray]] = []  # starts and counts of the depths above
        out: list[list] = [[], [], [], [], []]
        new[1:] = codes[1:, 0] != codes[:-1, 0]
        for depth in range(2, DEPTH + 1):
            new[1:] |= codes[1:, depth - 1] != codes[:-1, depth - 1]
            starts = np.flatnonzero(new)
            total = np.add.reduceat(n, starts) if len(starts) else n
            whole = [parts.count.get(tuple(p)) for p in known[codes[starts, :depth]].tolist()] if depth < DEPTH and parts.count else [None] * len(starts)
            here = np.array([w is None for w in whole], bool)
            total = np.where(here, total, np.array([w or 0 for w in whole], np.int64))
            chosen = np.flatnonzero(here & (total >= least) & (codes[starts, depth - 1] != 0))
            words = known[codes[starts[chosen], :depth]].astype(">u8")
            out[0] += [w.tobytes() for w in words]
            out[1] += [depth] * len(chosen)
            out[2] += total[chosen].tolist()
            for k in range(DEPTH - 2):
                if k < depth - 2:
                    at, counts = upper[k]
                    out[3 + k] += counts[np.searchsorted(at, starts[chosen], "right") - 1].tolist()
                else:
                    out[3 + k] += [None] * len(chosen)
            upper.append((starts, total))
        return pa.table([pa.array([table["lang"][0].as_py()] * len(out[0]), pa.string()), pa.array(out[0], pa.binary()), pa.array(out[1], pa.int32()), *(pa.array(c, pa.int64()) for c in out[2:])], ["lang", "words", "depth", "a", "l2", "l3"])

    return work


_NODE = "lang string, words binary, depth int, a long, l2 long, l3 long"


def _bytes(prefix: Prefix) -> bytes:
    return np.array(prefix, ">u8").tobytes()


def phrases(spark: SparkSession, docs: DataFrame, least: int = LEAST, top: int = TOP, budget: int = BUDGET, lang: str = "lang", text: str = "text") -> DataFrame:
    """Each language's ``top`` phrases: ``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``.

    Texts are lower-cased in A-Z and cut into pieces at ``[.,;:!?\\x0A-\\x0D]``, pieces into words at space and tab; counts are of contiguous occurrences inside pieces. A phrase
    of two to four words with ``least`` occurrences (``a``) scores floor(2000000 a / (l + r)) at its lowest cut, l and r its parts' counts (ties: the
    shorter first part). A phrase is left out if a longer one that holds it is 80 % as frequent and more. Ties of score and count go by the
    phrase's bytes. ``n``: all words of the language.

    A null language is ``und``; null and empty texts have no words; repeated rows count as often as they stand there. An empty table gives an empty
    table; other columns are not read. Words travel as 64-bit numbers that are checked to be distinct (a clash would choose others). Of the
    driver's memory: the frequent words' filter (a fixed size) and prefixes above an eighth of the budget (at most ``NAMED * GROUPS`` for each number of words).
    """
    tables = Tables(spark)
    texts = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    counted = texts.mapInArrow(_word_counts, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counted = tables.write(counted)
    salt = 0
    while True:
        words = tables.write(counted.mapInArrow(_named(salt), "lang string, word binary, n long, key binary"))
        if words.groupBy("key").count().filter("count > 1").isEmpty():
            break
        salt += 1
    total = int(words.agg(F.sum("n")).first()[0] or 0)
    budget = max(budget, -(-total // GROUPS))

    usable = words.filter(F.col("n") >= least)
    place = F.shiftrightunsigned(F.conv(F.hex(F.substring("key", 1, 4)), 16, 10).cast("long"), 32 - WORD_BITS)
    frequent = Frequent(_filter(usable.select(place.alias("place")), WORD_BITS))
    many = max(partitions(spark), -(-2 * total // BUDGET))
    pairs = texts.mapInArrow(_pair_counts(salt, spark.sparkContext.broadcast(frequent), many), "part long, packed binary")
    frequent = Frequent(frequent.words, _filter(pairs.groupBy("part").applyInArrow(_frequent_pairs(least), "place long"), PAIR_BITS))

    from_bytes = lambda b: tuple(np.frombuffer(b, ">u8").tolist())
    large = F.col("n") > budget // NAMED
    counts = {from_bytes(r["key"]): r["n"] for r in usable.filter(large).select("key", "n").collect()}  # bounded by NAMED * GROUPS
    for depth in range(2, DEPTH):
        heavy = {p for p, n in counts.items() if len(p) == depth - 1 and n > budget}
        if not heavy:
            break
        shared = spark.sparkContext.broadcast((frequent, heavy))
        longer = texts.mapInArrow(_longer(salt, shared, depth), "prefix binary, n long").groupBy("prefix").agg(F.sum("n").alias("n")).filter(large)
        counts |= {from_bytes(r["prefix"]): r["n"] for r in longer.collect()}
    parts = Parts(counts, budget, total)
    shared = spark.sparkContext.broadcast((frequent, parts))
    sent = texts.mapInArrow(_sent(salt, shared), "lang string, part long, packed binary")
    nodes = sent.groupBy("lang", "part").applyInArrow(_nodes(spark.sparkContext.broadcast(parts), least), _NODE)
    above = [p for p in parts.count if len(p) > 1]  # at most GROUPS for each number of words; their language is their first word's
    if above:
        rows = [(_bytes(p[:1]), _bytes(p), len(p), parts.count[p], parts.count[p[:2]] if len(p) > 2 else None) for p in above]
        named = spark.createDataFrame(rows, "key binary, words binary, depth int, a long, l2 long").join(words.select("key", "lang"), "key")
        nodes = nodes.unionByName(named.drop("key").withColumn("l3", F.lit(None).cast("long")))
    first = usable.select(F.col("key").alias("first"), F.col("n").alias("l1"))
    nodes = nodes.withColumn("first", F.substring("words", 1, 8)).join(first, "first").drop("first")
    nodes = nodes.unionByName(usable.select("lang", F.col("key").alias("words"), F.lit(1).alias("depth"), F.col("n").alias("a")), allowMissingColumns=True)
    nodes = tables.write(nodes)
    return _told(tables, nodes, words, top)


def _told(tables: Tables, nodes: DataFrame, words: DataFrame, top: int) -> DataFrame:
    """The phrases' scores, what stands in longer ones taken out, the best of each language with their words."""
    many = nodes.filter("depth > 1")
    cuts = many.select("lang", "words", "a", F.posexplode(F.filter(F.array("l1", "l2", "l3"), lambda x: x.isNotNull())).alias("k", "l"), "depth")
    cuts = cuts.withColumn("rest", F.expr("substring(words, 8 * (k + 1) + 1, 8 * (depth - k - 1))"))
    scored = cuts.join(nodes.select(F.col("words").alias("rest"), F.col("a").alias("r")), "rest")
    scored = scored.withColumn("score", F.expr("cast(a as decimal(20, 0)) * 2000000 div (cast(l as decimal(20, 0)) + r)"))
    best = scored.groupBy("words").agg(F.first("lang").alias("lang"), F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    parts = F.array(F.expr("substring(words, 1, 8 * (depth - 1))"), F.expr("substring(words, 9)"))
    inside = nodes.filter("depth > 2").select(F.explode(parts).alias("words"), "a").groupBy("words").agg(F.max("a").alias("longer"))
    kept = best.join(inside, "words", "left").filter("longer IS NULL OR 100 * longer < 80 * a").select("lang", "words", "a", "cut.*")
    # ties at the last place stay until the words are known
    close = kept.withColumn("place", F.rank().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a")))).filter(F.col("place") <= top).drop("place")
    close = tables.write(close)
    each = close.select("words", F.posexplode(F.expr("transform(sequence(1, length(words) div 8), i -> substring(words, 8 * i - 7, 8))")).alias("at", "key"))
    named = each.join(words.select("key", F.col("word").cast("string").alias("word")), "key").groupBy("words").agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("named"))
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    out = close.join(named, "words").withColumn("phrase", F.array_join("named.word", " ")).join(totals, "lang")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return out.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
