"""Samples and splits: reproducible, stratified, for many seeds in one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .order import running


def mixed(id: Column | str, seed: Column | int = 0) -> Column:
    """The order of a seeded shuffle: a hash of id and seed."""
    return F.xxhash64(F.col(id) if isinstance(id, str) else id, seed if isinstance(seed, Column) else F.lit(seed))


def fixed_size(df: DataFrame, n: int, id: str, seed: int = 0, order: Column | None = None) -> DataFrame:
    """SO4: exactly ``n`` rows (or all), the same for the same seed."""
    return df.orderBy(mixed(id, seed) if order is None else order, id).limit(n)


def seeded(df: DataFrame, seeds: list[int]) -> DataFrame:
    """SMP4: the rows once for each seed (a short list), so that all epochs are one job."""
    return df.withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds])))


def _quotas(df: DataFrame, runs: list[str], stratum: str, frac: float) -> DataFrame:
    """Per run and class: trunc(round(n * frac) * n_class / n); a row per class."""
    sizes = df.groupBy(*runs, stratum).agg(F.count(F.lit(1)).alias("n_class"))
    total = sizes.groupBy(*runs).agg(F.sum("n_class").alias("n")) if runs else sizes.agg(F.sum("n_class").alias("n"))
    joined = sizes.join(total, runs) if runs else sizes.crossJoin(F.broadcast(total))  # one row
    quota = F.floor(F.round(F.col("n") * frac) * F.col("n_class") / F.col("n"))
    return joined.select(*runs, stratum, quota.cast("long").alias("quota"))


def numbered(df: DataFrame, order: Column, id: str, name: str, by: list[str]) -> DataFrame:
    """The place of each row within its group, by ``order`` and id; a large group is numbered in ranges."""
    marked = df.withColumns({"_order": F.struct(order.alias("a"), F.col(id).alias("b")), "_one": F.lit(1)})
    return running(marked, "_order", {name: "_one"}, by).drop("_order", "_one")


def stratified(df: DataFrame, stratum: str, id: str, frac: float, runs: tuple[str, ...] = (), order: Column | None = None) -> DataFrame:
    """SMP1: ``is_test``: of n rows, round(n * frac) train, of each class its truncated share; the rest is test. Membership by ``order`` (default: seeded hash of the id)."""
    runs = list(runs)
    order = mixed(id, F.col("seed") if "seed" in runs else 0) if order is None else order
    ranked = numbered(df, order, id, "rank_in_class", [*runs, stratum]).join(_quotas(df, runs, stratum, frac), [*runs, stratum])
    return ranked.withColumn("is_test", (F.col("rank_in_class") > F.col("quota")).cast("int")).drop("quota")


def folds(df: DataFrame, stratum: str, id: str, k: int, runs: tuple[str, ...] = (), order: Column | None = None) -> DataFrame:
    """SMP2: a fold of 1 to k-1 for each training row, dealt in turn within its class; NULL for test rows. Expects the columns of ``stratified``."""
    order = mixed(id, F.col("seed") if "seed" in runs else 0) if order is None else order
    dealt = numbered(df, order, id, "_turn", [*runs, stratum, "is_test"])
    return dealt.withColumn("fold", F.when(F.col("is_test") == 0, (F.col("_turn") - 1) % (k - 1) + 1).cast("int")).drop("_turn")


def roles(df: DataFrame, id: str, k: int, runs: tuple[str, ...] = ()) -> DataFrame:
    """SMP2's wide form: columns fold1 .. fold(k-1) with train, val or NULL, and test with 1 or NULL."""
    wide = {f"fold{j}": F.when(F.col("is_test") == 1, F.lit(None).cast("string")).when(F.col("fold") == j, "val").otherwise("train") for j in range(1, k)}
    return df.select(*runs, id, F.when(F.col("is_test") == 1, 1).alias("test"), *[c.alias(n) for n, c in wide.items()])


def long_roles(df: DataFrame, id: str, k: int, runs: tuple[str, ...] = ()) -> DataFrame:
    """The long split table (run, id, fold, role); PF16 filters it by run and fold."""
    rows = df.withColumn("of", F.explode(F.sequence(F.lit(1), F.lit(k - 1))))
    role = F.when(F.col("is_test") == 1, "test").when(F.col("fold") == F.col("of"), "val").otherwise("train")
    return rows.select(*runs, id, F.col("of").alias("fold"), role.alias("role"))


def split_by_year(df: DataFrame, kind: str, year: str = "year") -> DataFrame:
    """SMP3: the newest year trains, or the oldest for 'oldest'; any other kind than 'all' and 'all300' means newest (as in the source). Others are test rows."""
    pick = F.min(year) if kind == "oldest" else F.max(year)
    return df.crossJoin(F.broadcast(df.agg(pick.alias("_year")))).withColumn("is_test", (F.col(year) != F.col("_year")).cast("int")).drop("_year")  # one row
