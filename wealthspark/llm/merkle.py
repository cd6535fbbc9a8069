"""Merkle manifest of a table by time-forward processing.

Rows are leaves; per group every ``FANOUT`` consecutive nodes become one of the next level, and the groups' roots are the leaves of one more
tree. Nodes carry labels in post-order, so that children come before their parents. Going up, each node sends its digest to its
parent through a priority queue ordered by label; a node is met when all its children's digests stand at the queue's front. Going down,
the labels are met in reverse and each node sends its children what their proofs end with. The queue's external part is Spark's sorted
exchange between blocks of ``FANOUT ** POWER`` nodes, its inner part a heap inside a block: a block is all that a task holds.
"""

from __future__ import annotations

import hashlib
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import Tables

FANOUT, POWER = 8, 4


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _last(level: int, at: int, n: int) -> int:
    """The last of ``n`` leaves below a node; with its level behind it this is the node's label."""
    return min((at + 1) * FANOUT**level, n) - 1


def climbed(leaves: list[str], top: int) -> list[list[str]]:
    """The digests of each level up to ``top``. The queue holds (label, child's place, child's digest), at most a run for each level."""
    n, queue = len(leaves), []
    levels = [leaves, *([""] * -(-n // FANOUT**k) for k in range(1, top + 1))]
    for k, leaf in enumerate(leaves if top else ()):
        heappush(queue, ((_last(1, k // FANOUT, n), 1), k, leaf))
        while queue and queue[0][0][0] <= k:
            (last, level), parts = queue[0][0], []
            while queue and queue[0][0] == (last, level):
                parts.append(heappop(queue)[2])
            at = last // FANOUT**level
            levels[level][at] = digest("".join(parts))
            if level < top:
                heappush(queue, ((_last(level + 1, at // FANOUT, n), level + 1), at, levels[level][at]))
    return levels


def descended(levels: list[list[str]], path: str) -> list[str]:
    """The leaves' proofs, given the proof of the node on top: labels from the last to the first."""
    n, out = len(levels[0]), [""] * len(levels[0])
    queue = [(1 - n, 1 - len(levels), path)]
    while queue:
        last, level, path = heappop(queue)
        last, level = -last, -level
        if not level:
            out[last] = path
            continue
        at = last // FANOUT**level
        run = levels[level - 1][at * FANOUT : (at + 1) * FANOUT]
        for k in range(len(run)):
            heappush(queue, (-_last(level - 1, at * FANOUT + k, n), 1 - level, f"{k}:{''.join(run[:k] + run[k + 1 :])}/{path}"))
    return out


def siblings(proof: str) -> str:
    """The digests of a proof, one after the other. A proof has ``place:digests of the others/`` for each level."""
    return "".join(step.partition(":")[2] for step in proof.split("/"))


def folded(leaf: str, proof: str) -> str:
    """The root that a leaf and its proof give."""
    for step in proof.split("/")[:-1]:
        place, _, others = step.partition(":")
        at = 64 * int(place)
        leaf = digest(others[:at] + leaf + others[at:])
    return leaf


def _top(n: int, power: int) -> int:
    """Levels above a block of a level with ``n`` nodes."""
    if n > FANOUT**power:
        return power
    top = 0
    while n > 1:
        n, top = -(-n // FANOUT), top + 1
    return top


def leaf(row: list[Column]) -> Column:
    """SHA-256 of the values, each ``-`` if null, else its UTF-8 byte count, ``:`` and the value."""
    parts = []
    for value in (c.cast("string") for c in row):
        parts.append(F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value)))
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def _numbered(tables: Tables, df: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``index`` within ``key`` (from 0) and ``n`` (rows of the key). Rows are dealt by ranges, so a large key lies in several; a range's
    place follows from the counts of those before it."""
    dealt = tables.write(df.repartitionByRange("key", *order).sortWithinPartitions("key", *order).withColumn("at", F.monotonically_increasing_id()))
    dealt = dealt.withColumn("range", F.shiftright("at", 33))
    sums = dealt.groupBy("key", "range").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("k"))
    key = Window.partitionBy("key")
    before = F.coalesce(F.sum("k").over(key.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sums.select("key", "range", (F.col("first") - before).alias("zero"), F.sum("k").over(key).alias("n"))
    return dealt.join(starts, ["key", "range"]).withColumn("index", F.col("at") - F.col("zero")).drop("at", "range", "zero")


def _raised(nodes: DataFrame, power: int) -> DataFrame:
    """The nodes above blocks: (key, index, n, digest). A key's last node stays as it is."""
    span = FANOUT**power

    def work(table: pa.Table) -> pa.Table:
        table = table.sort_by("index")
        n = table["n"][0].as_py()
        top = climbed(table["digest"].to_pylist(), _top(n, power))[-1][0]
        return pa.table({"key": table["key"][:1], "index": [table["index"][0].as_py() // span], "n": [-(-n // span)], "digest": [top]})

    return nodes.select("key", "index", "n", "digest").groupBy("key", F.floor(F.col("index") / span)).applyInArrow(work, "key string, index long, n long, digest string")


def _proved(nodes: DataFrame, above: DataFrame, power: int, root: str | None = None, proofs: bool = True) -> DataFrame:
    """Each node's proof from the proof of its block's top: ``above`` has (key, index, proof, subroot). With ``root`` the nodes are rows: their other
    columns stay, and the digests of their proofs and what their tampered leaves fold to are added."""
    kept = [] if root is None else [f for f in nodes.schema if f.name not in ("key", "index", "n")]
    fields = "key string, index long, proof string, subroot string"
    if kept:
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", subroot string, proof string, proof_sha256 string, folded_root string"

    def work(table: pa.Table, over: pa.Table) -> pa.Table:
        table = table.sort_by("index")
        paths = descended(climbed(table["digest"].to_pylist(), _top(table["n"][0].as_py(), power)), over["proof"][0].as_py())
        subroot = pa.array([over["subroot"][0].as_py()] * len(paths))
        if not kept:
            return pa.table({"key": table["key"], "index": table["index"], "proof": paths, "subroot": subroot})
        shas = [digest(siblings(p)) for p in paths]
        back = list(map(folded, table["tampered"].to_pylist(), paths))
        shown = pa.array(paths if proofs else [None] * len(paths), pa.string())
        return pa.table({f.name: table[f.name] for f in kept} | {"subroot": subroot, "proof": shown, "proof_sha256": shas, "folded_root": back})

    blocks = nodes.groupBy("key", F.floor(F.col("index") / FANOUT**power).alias("block"))
    return blocks.cogroup(above.withColumnRenamed("index", "block").groupBy("key", "block")).applyInArrow(work, fields)


def _passes(nodes: DataFrame, power: int) -> int:
    """How often blocks must be raised until each key has one node."""
    most, k = nodes.agg(F.max("n")).first()[0] or 0, 0
    while most > 1:
        most, k = -(-most // FANOUT**power), k + 1
    return k


def _tree(tables: Tables, leaves: DataFrame, power: int) -> list[DataFrame]:
    """The leaves and the nodes after each pass; the last table has one node for each key."""
    rounds = [leaves]
    for _ in range(_passes(leaves, power)):
        rounds.append(tables.write(_raised(rounds[-1], power)))
    return rounds


def manifest(
    spark: SparkSession, docs: DataFrame, fields: list[str], group: str, id: str = "doc_id", text: str = "text", tampered: Column | None = None, proofs: bool = True, power: int = POWER
) -> DataFrame:
    """One row per row of ``docs``: id, ``leaf``, ``subroot``, ``root``, ``proof``, ``proof_sha256``, ``folded_root``, ``verified``.

    Leaves digest the ``fields``, ascend by id in each ``group``; the groups' roots ascend by group, null first. ``tampered`` marks rows whose text
    is read with A-Z lower-cased when their proof is checked: ``folded_root`` is what their leaf and proof then give. ``proofs=False`` leaves
    ``proof`` null, so that no proof leaves its task. A block has ``FANOUT ** power`` nodes.
    Nulls in any column are leaves like others; null ids come first and null groups are one group. Rows with one id are ordered by their leaves, so
    equal rows have equal leaves and each its own place. An empty table gives an empty table; other columns are not read.
    """
    tables = Tables(spark)
    lowered = F.translate(F.col(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    columns = [F.col(c) for c in fields]
    changed = [lowered if c == text else F.col(c) for c in fields]
    mark = F.coalesce(tampered, F.lit(False)) if tampered is not None else F.lit(False)
    rows = docs.select(
        F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")).alias("key"), F.col(id).alias("id"), leaf(columns).alias("digest"), F.when(mark, leaf(changed)).alias("changed")
    )
    rows = tables.write(rows.withColumn("row", F.monotonically_increasing_id()))
    rows = rows.select("key", "id", "digest", F.coalesce("changed", "digest").alias("tampered"), "row")
    by_group = _tree(tables, tables.write(_numbered(tables, rows, ["id", "digest", "row"]).drop("row")), power)
    subroots = by_group[-1].select(F.lit("").alias("key"), F.col("key").alias("group"), "digest")
    top = _tree(tables, tables.write(_numbered(tables, subroots, ["group"])), power)
    first = top[-1].first()
    root = first["digest"] if first else ""

    above = top[-1].select("key", "index", F.lit("").alias("proof"), F.lit("").alias("subroot"))
    for nodes in reversed(top[:-1]):
        above = tables.write(_proved(nodes, above, power))
    names = top[0].select("index", F.col("group").alias("key"), F.col("digest").alias("subroot"))
    above = above.select("index", "proof").join(names, "index").select("key", F.lit(0).cast("long").alias("index"), "proof", "subroot")
    for nodes in reversed(by_group[1:-1]):
        above = tables.write(_proved(nodes, above, power))
    out = _proved(by_group[0], above, power, root, proofs)
    return out.select(
        F.col("id").alias(id), F.col("digest").alias("leaf"), "subroot", F.lit(root).alias("root"), "proof", "proof_sha256", "folded_root", (F.col("folded_root") == F.lit(root)).alias("verified")
    )
