"""Near-duplicates by a chosen-path similarity join over minwise tokens.

Each of several independent trees starts with all documents and sends every document to two children, named by its minwise tokens at two
coordinates; deeper nodes pick two coordinates each by a hash of their path. Similar sets agree at most coordinates, so they meet
again: a pair at the threshold that branches for ever is missed by a tree with a chance of 1/16 and by three trees once in 4000, while
less similar pairs part. Small nodes are compared exhaustively by sketches of 256 minwise bytes. A large node is first dealt in parts, each with some
members that all parts share. Only the most alike pair of each document is confirmed at first; what then is one component needs no more
pairs. A large node is settled by comparing the documents outside its largest component with all, if that takes few cells; else it branches
again. Pairs that still join two components are confirmed on full sets where they lie together, and only links leave that task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import slices
from .shared import Tables, partitions
from .words import joined, mix, word_numbers

#: Minwise tokens that trees branch on (32 bits each), and those whose low bytes make a document's sketch; the first are the same.
COORDINATES, SKETCH = 64, 256
TREES = 3
#: Nodes up to this size are compared exhaustively; larger ones are dealt in parts of about this size, each with so many shared members.
SMALL, LEADERS = 2048, 32
#: A large node does not branch if its documents outside the largest component are no more than a block, or if its parts times their blocks
#: are no more than this.
BLOCK, CELLS = 512, 64
#: At this depth the documents outside the largest component are compared with all others of the node, however many they are.
DEEPEST = 6
#: Standard deviations below the expected number of equal coordinates at which a pair is not looked at further.
SLACK = 4.0
#: Coordinates that are compared first in larger nodes.
_GLANCE = 64
_FEW_ROWS = 12

_random = np.random.Generator(np.random.PCG64(20))
_TIMES = _random.integers(1, 2**31, SKETCH, np.uint32) * np.uint32(2) + np.uint32(1)
_PLUS = _random.integers(0, 2**32, SKETCH, np.uint32)


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct numbers of the k-word sequences of a text, words lower-cased in A-Z; of all its words if it has fewer than k."""
    numbers = word_numbers((text or "").encode().lower().split())
    if not len(numbers):
        return numbers
    n = min(k, len(numbers))
    out = numbers[: len(numbers) - n + 1]
    for j in range(1, n):
        out = joined(out, numbers[j : len(numbers) - n + 1 + j])
    return np.unique(mix(out + np.uint64(n)))


def signature(tokens: np.ndarray) -> np.ndarray:
    """The minwise token at each coordinate, as 32 bits."""
    short = (tokens >> np.uint64(32)).astype(np.uint32)
    least = np.full(SKETCH, np.iinfo(np.uint32).max, np.uint32)
    for k in range(0, len(short), 256):
        np.minimum(least, (short[k : k + 256, None] * _TIMES + _PLUS).min(axis=0), out=least)
    return (mix(least.astype(np.uint64)) & np.uint64(0xFFFFFFFF)).astype("<u4")


def set_key(tokens: np.ndarray) -> bytes:
    """Equal for equal sets: the size and two sums of 64 bits."""
    both = np.array([tokens.sum(dtype=np.uint64), mix(tokens ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)], "<u8")
    return len(tokens).to_bytes(4, "little") + both.tobytes()


def _signatures(k: int, trees: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coordinate = np.arange(2 * trees, dtype=np.uint64)
        names = joined(mix(coordinate // np.uint64(2) + np.uint64(1)), coordinate)
        for batch in batches:
            for ids, texts in slices(batch.column(0), batch.column(1)):
                sizes, out = [], []
                for text in texts:
                    tokens = shingles(text, k)
                    sizes.append(len(tokens))
                    if len(tokens):
                        sign = signature(tokens)
                        roots = joined(names, sign[: 2 * trees].astype(np.uint64)).view(np.int64)
                        out.append((set_key(tokens), roots.tolist(), sign[:COORDINATES].tobytes(), (sign & 0xFF).astype(np.uint8).tobytes()))
                    else:
                        out.append((None, None, None, None))
                columns = zip(zip(*out), (pa.binary(), pa.list_(pa.int64()), pa.binary(), pa.binary()))
                yield pa.record_batch([ids, pa.array(sizes, pa.int64()), *(pa.array(c, t) for c, t in columns)], ["id", "n_shingles", "key", "roots", "sign", "sketch"])

    return work


def _matrix(column: pa.Array, kind: str, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def _children(trees: int):
    """(node, rep, sign) -> (child, rep), twice, at coordinates that the roots do not use."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free = np.uint64(COORDINATES - 2 * trees)
        for batch in batches:
            nodes = batch.column(0).to_numpy().view(np.uint64)
            sign = _matrix(batch.column(2), "<u4", COORDINATES)
            first = mix(nodes) % free
            second = (first + np.uint64(1) + mix(nodes + np.uint64(1)) % (free - np.uint64(1))) % free
            for c in (first, second):
                c = c + np.uint64(2 * trees)
                child = joined(joined(nodes, c), sign[np.arange(len(nodes)), c.astype(np.int64)].astype(np.uint64))
                yield pa.record_batch([pa.array(child.view(np.int64)), batch.column(1)], ["node", "rep"])

    return work


def _whole_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows sorted by their first column, again as batches that hold all rows of their cells; and the cells' edges."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(0).to_numpy()
        edges = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        if held and held[-1].column(0)[-1].as_py() != keys[0]:
            yield _with_edges(held)
            held = []
        if len(edges):
            yield _with_edges([*held, batch.slice(0, int(edges[-1]))])
            held = [batch.slice(int(edges[-1]))]
        else:
            held.append(batch)
    if held:
        yield _with_edges(held)


def _with_edges(parts: list[pa.RecordBatch]) -> tuple[pa.RecordBatch, np.ndarray]:
    whole = parts[0] if len(parts) == 1 else pa.concat_batches(parts)
    keys = whole.column(0).to_numpy()
    return whole, np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])


def _equal(low: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros(len(a), np.int32)
    for k in range(0, len(a), 4096):
        out[k : k + 4096] = np.count_nonzero(low[a[k : k + 4096]] == low[b[k : k + 4096]], axis=1)
    return out


def least_equal(width: int, percent: int, slack: float = SLACK) -> int:
    """Equal coordinates that a pair at the threshold has but for a chance of about 3 in 10^5."""
    expected = width * percent / 100
    return int(expected - slack * (expected * (1 - percent / 100)) ** 0.5)


def _candidates(low: np.ndarray, edges: np.ndarray, rep: np.ndarray, group: np.ndarray, side: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (i, j, equal coordinates) of rows of one cell and different groups that are alike enough. Rows of side 1 meet those of side 2, of side 3 all."""
    least, glance = least_equal(SKETCH, percent), least_equal(_GLANCE, percent)
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    sizes = np.diff(edges)
    for n in range(2, _FEW_ROWS + 1):
        start = edges[:-1][sizes == n]
        if len(start):
            i, j = np.triu_indices(n, 1)
            left.append((start[:, None] + i).ravel())
            right.append((start[:, None] + j).ravel())
    a, b = np.concatenate(left), np.concatenate(right)
    use = (group[a] != group[b]) & (((side[a] & 1) & (side[b] >> 1)) | ((side[b] & 1) & (side[a] >> 1)) > 0)
    left, right = [a[use]], [b[use]]
    for start, n in zip(edges[:-1][sizes > _FEW_ROWS].tolist(), sizes[sizes > _FEW_ROWS].tolist()):
        g, s = group[start : start + n], side[start : start + n]
        if (g == g[0]).all():
            continue
        seen = np.ascontiguousarray(low[start : start + n, :_GLANCE].T)
        both = bool((s == 3).all())
        members = np.flatnonzero(s & 2)
        seen_members = seen if both else np.ascontiguousarray(seen[:, members])
        for i in np.flatnonzero(s & 1).tolist():
            others = seen_members[:, i + 1 :] if both else seen_members
            near = np.flatnonzero(np.add.reduce(others == seen[:, i : i + 1], axis=0, dtype=np.uint8) >= glance)
            near = near + i + 1 if both else members[near]
            near = near[g[near] != g[i]]
            if len(near):
                left.append(np.full(len(near), start + i))
                right.append(start + near)
    a, b = np.concatenate(left), np.concatenate(right)
    n = _equal(low, a, b)
    use = (n >= least) & (rep[a] != rep[b])
    return a[use], b[use], n[use]


def _least_reachable(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n things the smallest that the pairs (a, b) lead to."""
    out = np.arange(n)
    while True:
        new, m = out.copy(), np.minimum(out[a], out[b])
        np.minimum.at(new, a, m)
        np.minimum.at(new, b, m)
        new = new[new]
        if (new == out).all():
            return out
        out = new


def _sweep(percent: int):
    """Rows (cell, home, side, rep, group, sketch), sorted by cell -> (clump, home, rep, partner, alike) of those with a candidate in
    another group. A clump is what candidates connect within a cell; the partner is the most alike one with a smaller number, if any."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, edges in _whole_cells(batches):
            cell, rep, group = (batch.column(k).to_numpy() for k in (0, 3, 4))
            a, b, n = _candidates(_matrix(batch.column(5), np.uint8, SKETCH), edges, rep, group, batch.column(2).to_numpy(), percent)
            if not len(a):
                continue
            top = _least_reachable(batch.num_rows, a, b)
            clump = joined(cell[top].view(np.uint64), rep[top].view(np.uint64)).view(np.int64)
            later = np.where(rep[a] > rep[b], a, b)
            earlier = rep[a + b - later]
            order = np.lexsort((earlier, -n, later))
            first = order[np.concatenate([[True], np.diff(later[order]) != 0])]
            partner, alike = np.full(batch.num_rows, -1), np.zeros(batch.num_rows, np.int32)
            partner[later[first]], alike[later[first]] = earlier[first], n[first]
            at = np.unique(np.concatenate([a, b]))
            yield pa.record_batch([pa.array(clump[at]), batch.column(1).take(pa.array(at)), pa.array(rep[at]), pa.array(partner[at]), pa.array(alike[at])], ["clump", "home", "rep", "partner", "alike"])

    return work


def _linked(tokens: np.ndarray, others: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets are similar enough."""
    if len(tokens) > len(others):
        tokens, others = others, tokens
    if 100 * len(tokens) < percent * len(others):
        return False
    at = np.searchsorted(others, tokens)
    both = int((others[np.minimum(at, len(others) - 1)] == tokens).sum())
    return 100 * both >= percent * (len(tokens) + len(others) - both)


_LAST = np.iinfo(np.int64).max


def _homes(lists: pa.Array) -> np.ndarray:
    """Each row's numbers, filled up with the last possible one."""
    sizes = np.diff(lists.offsets.to_numpy())
    out = np.full((len(sizes), int(sizes.max())), _LAST)
    out[np.arange(out.shape[1]) < sizes[:, None]] = lists.flatten().to_numpy()
    return out


def _settle(percent: int):
    """Rows (clump, home, rep, group, sketch, homes, tokens), sorted by clump -> links (a, b) that make all groups of a clump meet that do.

    ``homes`` are all nodes in which a document is compared like this: a pair belongs to the first that both share. Groups that
    a link has joined need no more pairs.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, edges in _whole_cells(batches):
            home, rep, group = (batch.column(k).to_numpy().copy() for k in (1, 2, 3))
            a, b, n = _candidates(_matrix(batch.column(4), np.uint8, SKETCH), edges, rep, group, np.full(batch.num_rows, 3, np.int8), percent)
            if not len(a):
                continue
            homes, tokens = _homes(batch.column(5)), [np.frombuffer(x.as_buffer(), "<u8") for x in batch.column(6)]
            sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
            order = np.lexsort((-n, a))
            a, b, n = a[order], b[order], n[order]
            first = np.flatnonzero(np.concatenate([[True], np.diff(a) != 0]))
            out: list[tuple[int, int]] = []
            for r in np.argsort(-n[first], kind="stable").tolist():
                i, left, at_once = int(a[first[r]]), b[first[r] : first[r + 1] if r + 1 < len(first) else None], 1
                if len(homes[0]) > 1:
                    left = left[np.where(np.isin(homes[left], homes[i]), homes[left], _LAST).min(axis=1) == home[i]]
                while len(left := left[group[left] != group[i]]):
                    now, left, at_once = left[:at_once], left[at_once:], min(64, 4 * at_once)
                    at = np.searchsorted(tokens[i], others := np.concatenate([tokens[j] for j in now]))
                    shared = tokens[i][np.minimum(at, sizes[i] - 1)] == others
                    both = np.add.reduceat(shared.astype(np.int64), np.cumsum(sizes[now]) - sizes[now])
                    for j in now[100 * both >= percent * (sizes[i] + sizes[now] - both)].tolist():
                        out.append((int(rep[i]), int(rep[j])))
                        x, y = sorted((group[i], group[j]))
                        group[group == y] = x
            if out:
                yield pa.record_batch([pa.array([min(x) for x in out], pa.int64()), pa.array([max(x) for x in out], pa.int64())], ["a", "b"])

    return work


def _sets(k: int):
    """(text, key, rep) -> (rep, tokens) of the texts whose set has this key."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start = 0
            for reps, texts in slices(batch.column(2), batch.column(0)):
                keys = batch.column(1).slice(start, len(texts)).to_pylist()
                start += len(texts)
                found = [t.tobytes() if set_key(t) == key else None for t, key in ((shingles(x, k), key) for x, key in zip(texts, keys))]
                there = pa.array([f is not None for f in found], pa.bool_())
                yield pa.record_batch([reps.filter(there), pa.array(found, pa.binary()).filter(there)], ["rep", "tokens"])

    return work


def _confirm(percent: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [_linked(np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8"), percent) for x, y in zip(batch.column(2), batch.column(3))]
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    return work


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) -> as few that connect the same, each to the smallest of those that it connects here."""
    for batch in batches:
        names, at = np.unique(np.concatenate([batch.column(k).to_numpy() for k in (0, 1)]), return_inverse=True)
        top = _least_reachable(len(names), *np.split(at, 2))
        use = np.flatnonzero(top != np.arange(len(names)))
        yield pa.record_batch([pa.array(names[top[use]]), pa.array(names[use])], ["a", "b"])


def components(tables: Tables, links: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable over ``links`` (a, b). Labels fall along the links and by jumps, until none changes."""
    few = links.mapInArrow(_contracted, "a long, b long")
    both = tables.write(few.select("a", "b").union(few.select("b", "a")).toDF("id", "other").distinct())
    table = tables.write(both.groupBy("id").agg(F.least(F.min("other"), F.first("id")).alias("component")))
    while True:
        labels = table.select("id", "component")
        near = both.join(labels.toDF("other", "label"), "other").groupBy("id").agg(F.min("label").alias("label"))
        new = labels.join(near, "id").select("id", F.least("component", "label").alias("component"), F.col("component").alias("old"))
        jump = labels.toDF("component", "further")
        new = new.join(jump, "component", "left").select("id", F.least("component", F.coalesce("further", "component")).alias("component"), "old")
        new = tables.write(new)
        tables.drop(table)
        table = new
        if not table.filter("component <> old").limit(1).count():
            tables.drop(both)
            return table.select("id", "component")


def linked(tables: Tables, signs: DataFrame, same: DataFrame, docs: DataFrame, k: int, percent: int, trees: int, small: int, deepest: int) -> DataFrame:
    """(id, component) of the sets that have a link. ``signs``: a row for each document; ``same``: (key, rep, least_id), the row that
    stands for each distinct set; ``docs``: id, text."""
    spark = docs.sparkSession
    parts = partitions(spark)
    sketches = signs.select(F.col("row").alias("rep"), "sketch")

    def swept(cells: DataFrame) -> DataFrame:
        dealt = cells.join(sketches, "rep").select("cell", "home", F.col("side").cast("byte"), "rep", "group", "sketch")
        return dealt.repartition(parts, "cell").sortWithinPartitions("cell").mapInArrow(_sweep(percent), "clump long, home long, rep long, partner long, alike int")

    def sets_of(reps: DataFrame) -> DataFrame:
        """(rep, tokens), one row each; ``reps``: distinct."""
        wanted = same.join(reps, "rep").select("rep", "key", F.col("least_id").alias("id"))
        return docs.join(wanted, "id").select("text", "key", "rep").mapInArrow(_sets(k), "rep long, tokens binary").groupBy("rep").agg(F.first("tokens").alias("tokens"))

    def confirmed(pairs: DataFrame) -> DataFrame:
        sets = sets_of(pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct())
        both = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b").select("a", "b", "x", "y")
        return both.mapInArrow(_confirm(percent), "a long, b long")

    def grouped(df: DataFrame, labels: DataFrame) -> DataFrame:
        return df.join(labels.toDF("rep", "component"), "rep", "left").withColumn("group", F.coalesce("component", "rep")).drop("component")

    def mixed(df: DataFrame, key: str) -> DataFrame:
        """Rows whose ``key`` has more than one group."""
        several = df.groupBy(key).agg(F.min("group").alias("low"), F.max("group").alias("high")).filter("low < high").select(key)
        return df.join(several, key)

    def members(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Of rows (node, rep), those of small nodes and those of large ones, with the node's size; nodes of one go."""
        sizes = rows.groupBy("node").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        live = tables.write(rows.join(sizes, "node"))
        return live.filter(F.col("n") <= small), live.filter(F.col("n") > small)

    whole = F.lit(3).alias("side")
    rows = signs.join(same.select(F.col("rep").alias("row")), "row").select(F.explode("roots").alias("node"), F.col("row").alias("rep"))
    few, many = members(rows)
    none = F.lit(None).cast("long").alias("home")
    cell = lambda part: F.xxhash64("node", part).alias("cell")
    n_parts = F.ceil(F.col("n") / small).cast("int")
    dealt = many.select(cell(F.pmod(F.xxhash64("rep"), n_parts).cast("int")), none, whole, "rep")
    leader = many.groupBy("node", F.pmod(F.xxhash64("rep", "node"), F.lit(LEADERS))).agg(F.min("rep").alias("rep"), F.first("n").alias("n"))
    leader = leader.select("node", "rep", F.explode(F.sequence(F.lit(0), n_parts - 1)).alias("part")).select(cell(F.col("part")), none, whole, "rep")
    first = few.select(F.col("node").alias("cell"), F.col("node").alias("home"), whole, "rep").union(dealt).union(leader).withColumn("group", F.col("rep"))
    touched = tables.write(swept(first))
    # a forest: each document's most alike earlier partner
    forest = touched.filter("partner >= 0").groupBy("rep").agg(F.max(F.struct("alike", -F.col("partner"))).alias("best")).select((-F.col("best")["col2"]).alias("a"), F.col("rep").alias("b"))
    links = tables.write(confirmed(forest))
    labels = components(tables, links)

    # what still holds two components: in small nodes, in large ones beside the largest, and in the children of others
    again = mixed(grouped(touched.filter("home IS NOT NULL").select("clump", "home", "rep"), labels), "clump")
    open_cells = [again.select(F.col("clump").alias("cell"), "home", whole, "rep", "group")]
    for depth in range(1, deepest + 1):
        many = tables.write(grouped(many.select("node", "rep"), labels))
        shares = many.groupBy("node", "group").agg(F.count(F.lit(1)).alias("n")).groupBy("node")
        shares = shares.agg(F.sum("n").alias("n"), F.max(F.struct("n", "group")).alias("main"))
        shares = shares.select("node", F.col("main.group").alias("main"), F.col("n"), (F.col("n") - F.col("main.n")).alias("others")).filter("others > 0")
        shares = shares.withColumns({"parts": n_parts, "blocks": F.ceil(F.col("others") / BLOCK).cast("int")})
        shares = shares.withColumn("ends", (F.col("blocks") <= 1) | (F.col("parts") * F.col("blocks").cast("long") <= CELLS) | F.lit(depth == deepest))
        many = tables.write(many.join(shares, "node"))
        last = many.filter("ends")
        part, block = F.pmod(F.xxhash64("rep"), "parts").cast("int"), F.pmod(F.xxhash64("rep", F.lit(1)), "blocks").cast("int")
        each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        left = last.filter("group <> main").withColumns({"block": block, "side": F.lit(1)}).withColumn("part", each("parts"))
        right = last.withColumns({"part": part, "side": F.lit(2)}).withColumn("block", each("blocks"))
        crossed = F.xxhash64("node", "part", "block").alias("cell"), F.col("node").alias("home"), "side", "rep", "group"
        open_cells += [left.select(*crossed), right.select(*crossed)]
        many = many.filter("NOT ends")
        if depth == deepest or not many.limit(1).count():
            break
        signed = many.select("node", "rep").join(signs.select(F.col("row").alias("rep"), "sign"), "rep").select("node", "rep", "sign")
        few, many = members(signed.mapInArrow(_children(trees), "node long, rep long"))
        few = mixed(grouped(few.select("node", "rep"), labels), "node")
        open_cells.append(few.select(F.col("node").alias("cell"), F.col("node").alias("home"), whole, "rep", "group"))
    crossing = tables.write(swept(reduce(DataFrame.union, open_cells)).select("clump", "home", "rep").distinct())
    known = grouped(crossing.groupBy("rep").agg(F.collect_set("home").alias("homes")), labels)  # at most the trees' paths of one document
    full = known.join(sketches, "rep").join(sets_of(crossing.select("rep").distinct()), "rep")
    full = crossing.join(full, "rep").select("clump", "home", "rep", "group", "sketch", "homes", "tokens")
    more = full.repartition(parts, "clump").sortWithinPartitions("clump").mapInArrow(_settle(percent), "a long, b long")
    return components(tables, links.union(tables.write(more)))


def near_duplicates(
    spark: SparkSession, docs: DataFrame, k: int = 5, percent: int = 80, id: str = "doc_id", text: str = "text", trees: int = TREES, small: int = SMALL, deepest: int = DEEPEST
) -> DataFrame:
    """One row per row of ``docs``: id, ``n_shingles``, ``component_id``, ``kept``.

    Words are cut at ASCII white space and lower-cased in A-Z. Documents whose sets of distinct ``k``-word shingles have a Jaccard
    similarity of ``percent`` or more are linked; a component's id is its smallest document id, and that document is kept.
    Documents with equal sets go through the join once. A document without words (null text too) has an empty set and is
    linked with nothing. Ids are integers; rows with a null id are components of their own (``component_id`` null, kept).
    Rows repeated with one id and one text get the same answer; different texts under one id are documents of their own. Other
    columns are not read; an empty table gives an empty table.
    """
    tables = Tables(spark)
    docs = docs.select(F.col(id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    signs = docs.mapInArrow(_signatures(k, trees), "id long, n_shingles long, key binary, roots array<long>, sign binary, sketch binary")
    signs = tables.write(signs.withColumn("row", F.monotonically_increasing_id()))
    same = signs.filter("key IS NOT NULL AND id IS NOT NULL").groupBy("key").agg(F.min("row").alias("rep"), F.min("id").alias("least_id"))
    same = tables.write(same)
    labels = linked(tables, signs, same, docs, k, percent, trees, small, deepest)
    # a component is named by the smallest document id of its sets
    named = same.join(labels.toDF("rep", "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    names = named.groupBy("component").agg(F.min("least_id").alias("component_id"))
    named = tables.write(named.join(names, "component").select("key", "component_id"))
    out = signs.select("id", "n_shingles", "key").join(named, "key", "left")
    out = out.select("id", "n_shingles", F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"))
    return out.select(F.col("id").alias(id), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
