"""Errors, inequality, classes: metrics per group as one aggregation each."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import cut
from .order import average_ranks, beside, running

OUTPUTS = ("mean", "std")


def gini(df: DataFrame, column: str, by: Iterable[str] = ()) -> DataFrame:
    """AG8, AG9: Gini coefficient per group: values shifted to be non-negative, plus 1e-7. One row without groups.

    Equal values are counted before they are ranked, and ranks run over ranges of a group, so no task needs a whole group.
    """
    by = list(by)
    counted = df.filter(F.col(column).isNotNull()).groupBy(*by, F.col(column).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("k"))
    ranked = running(counted, "v", {"upto": "k"}, by).withColumn("before", F.col("upto") - F.col("k"))
    # ranks before + 1 .. before + k add up to k * before + k (k + 1) / 2
    ranks = F.col("k") * F.col("before") + F.col("k") * (F.col("k") + 1) / 2
    sums = ranked.groupBy(*by).agg(F.sum("k").alias("n"), F.sum(F.col("k") * F.col("v")).alias("sv"), F.sum(F.col("v") * ranks).alias("sr"), F.min("v").alias("low"))
    # the shift enters both sums in closed form
    n, shift = F.col("n"), 1e-7 - F.least("low", F.lit(0.0))
    sx, sr = F.col("sv") + n * shift, F.col("sr") + shift * n * (n + 1) / 2
    return sums.select(*by, ((2 * sr - (n + 1) * sx) / (n * sx)).alias("gini"))


def regression(t: Column, p: Column, ddof: int = 1) -> dict[str, Column]:
    """AG10, AG11, AG12: aggregates mse, rmse, nrmse (by the deviation of the truth, sample or population), r2, mae."""
    ssr = F.sum((t - p) * (t - p))
    mse = F.avg((t - p) * (t - p))
    deviation = F.stddev_samp(t) if ddof else F.stddev_pop(t)
    return {"mse": mse, "rmse": F.sqrt(mse), "nrmse": F.try_divide(F.sqrt(mse), deviation), "r2": 1 - F.try_divide(ssr, F.var_pop(t) * F.count(t)), "mae": F.avg(F.abs(t - p))}


def performance(df: DataFrame, by: list[str], ddof: int = 1, outputs: Iterable[str] = OUTPUTS) -> DataFrame:
    """AG10 (ddof 1), AG12 (ddof 0): metrics of each output and, as 'overall', their mean, per group; columns ``{metric}_{output}``."""
    outputs = list(outputs)
    aggs = {f"{m}_{o}": c for o in outputs for m, c in regression(F.col(f"true_{o}"), F.col(f"pred_{o}"), ddof).items()}
    out = df.groupBy(*by).agg(*[c.alias(n) for n, c in aggs.items()], F.count(F.lit(1)).alias("n"))
    names = ("mse", "rmse", "nrmse", "r2", "mae")
    return out.withColumns({f"{m}_overall": sum((F.col(f"{m}_{o}") for o in outputs[1:]), F.col(f"{m}_{outputs[0]}")) / len(outputs) for m in names})


def weighted_r2(df: DataFrame, by: list[str], t: str, p: str, weight: str | None = None, regressors: int = 0) -> DataFrame:
    """AG13: R2 from weighted sums (0 where it is not finite) and the adjusted R2 for a number of regressors."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    y, e = F.col(t), F.col(t) - F.col(p)
    s = df.groupBy(*by).agg(F.sum(w * y).alias("s"), F.sum(w * y * y).alias("q"), F.sum(w * e * e).alias("r"), F.sum(w).alias("n"))
    total = F.col("q") - F.col("s") * F.col("s") / F.col("n")
    r2 = F.coalesce(1 - F.try_divide(F.col("r"), total), F.lit(0.0))
    adjusted = 1 - F.try_divide((1 - r2) * (F.col("n") - 1), F.col("n") - regressors - 1)
    return s.select(*by, r2.alias("r2"), F.coalesce(adjusted, F.lit(0.0)).alias("r2_adjusted"))


def r2_over_outputs(df: DataFrame, by: list[str], pairs: list[tuple[str, str]], how: str = "uniform") -> DataFrame:
    """AG13 over several outputs: the plain mean, or the mean weighted by each output's variance."""
    total = lambda t: F.var_pop(t) * F.count(t)
    r2 = [regression(F.col(t), F.col(p))["r2"] for t, p in pairs]
    weights = [F.lit(1.0) if how == "uniform" else total(t) for t, _ in pairs]
    top = sum((r * w for r, w in zip(r2[1:], weights[1:])), r2[0] * weights[0])
    return df.groupBy(*by).agg(F.try_divide(top, sum(weights[1:], weights[0])).alias("r2"))


def class_report(df: DataFrame, by: list[str], t: str, p: str, labels: list) -> DataFrame:
    """AG25: precision, recall, F1 and support of each label per group; an absent class gives 0. The labels are a short list of constants."""
    rows = df.select(*by, F.col(t).alias("t"), F.col(p).alias("p"), F.explode(F.array(*[F.lit(x) for x in labels])).alias("label"))
    hit, said, true = (F.col("t") == F.col("label")) & (F.col("p") == F.col("label")), F.col("p") == F.col("label"), F.col("t") == F.col("label")
    n = rows.groupBy(*by, "label").agg(F.count_if(hit).alias("tp"), F.count_if(said).alias("said"), F.count_if(true).alias("support"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    out = n.withColumns({"precision": ratio(F.col("tp"), F.col("said")), "recall": ratio(F.col("tp"), F.col("support"))})
    f1 = ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return out.select(*by, "label", "precision", "recall", f1.alias("f1"), "support")


def by_class(df: DataFrame, by: list[str], true_class: str, metric: str, t: str, p: str, labels: list) -> DataFrame:
    """AG26: the metric within each true class, one column per class."""
    made = df.groupBy(*by, true_class).agg(regression(F.col(t), F.col(p))[metric].alias("v"))
    return made.groupBy(*by).pivot(true_class, labels).agg(F.first("v")).withColumnsRenamed({str(x): f"Q{x}" for x in labels})


def dash_if_zero(c: Column, digits: int = 2) -> Column:
    """AG26's text form."""
    return F.when(F.coalesce(c, F.lit(0.0)) == 0, "-").otherwise(F.format_string(f"%.{digits}f", c))


def confusion(df: DataFrame, t: str, p: str, normalise: str = "none", by: Iterable[str] = ()) -> DataFrame:
    """AG27: counts of (true, predicted), and their shares by true, by predicted or of all."""
    by = list(by)
    n = df.groupBy(*by, t, p).agg(F.count(F.lit(1)).alias("n"))  # classes times classes rows
    part = {"none": None, "true": [*by, t], "pred": [*by, p], "all": by}[normalise]
    if part is None:
        return n.withColumn("share", F.col("n").cast("double"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*part) if part else Window.partitionBy(F.lit(0))))


def summary(runs: DataFrame, by: list[str], metric: str, digits: int = 2) -> DataFrame:
    """AG17: mean and sample deviation over runs, rounded."""
    return runs.groupBy(*by).agg(F.round(F.avg(metric), digits).alias("mean"), F.round(F.stddev_samp(metric), digits).alias("std"), F.count(metric).alias("runs"))


def summary_blocks(runs: DataFrame, metric: str, blocks: dict[str, str], within: list[str]) -> DataFrame:
    """AG17: for each block (recency, relocation, ...) the mean over runs per configuration, then the mean of those per value of the block's column."""
    out = None
    for name, column in blocks.items():
        keys = [column, *[c for c in within if c != column]]
        one = runs.groupBy(*keys).agg(F.avg(metric).alias("m")).groupBy(F.col(column).cast("string").alias("value"))
        one = one.agg(F.round(F.avg("m"), 2).alias("mean"), F.round(F.stddev_samp("m"), 2).alias("std")).select(F.lit(name).alias("block"), "value", "mean", "std")
        out = one if out is None else out.unionByName(one)
    return out


def mean_complete(runs: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """AG18: means per group; groups with a missing mean go."""
    return runs.groupBy(*by).agg(*[F.avg(m).alias(m) for m in metrics]).dropna()


def ascending(metric: str) -> bool:
    """SO1: errors are better when small, r2 when large."""
    return not metric.startswith("r2")


def ordered(df: DataFrame, by: list[str], metric: str) -> DataFrame:
    """SO1."""
    return df.orderBy(*by, F.col(metric).asc() if ascending(metric) else F.col(metric).desc())


def in_order(df: DataFrame, column: str, order: list[str]) -> DataFrame:
    """SO2: sorted by a given order of values; others come last."""
    spots = F.create_map(*[x for k, v in enumerate(order) for x in (F.lit(v), F.lit(k))])
    return df.orderBy(F.coalesce(spots[F.col(column)], F.lit(len(order))))


def best(df: DataFrame, by: list[str], metric: str, tie: str, least: bool | None = None) -> DataFrame:
    """AG19, AG20: the best row of each group (ties: the smallest ``tie``), by an aggregate that combines before the shuffle."""
    least = ascending(metric) if least is None else least
    value = F.col(metric) if least else -F.col(metric)
    row = F.struct(value.alias("_v"), F.col(tie).alias("_t"), *[F.col(c) for c in df.columns if c not in by])
    return df.filter(F.col(metric).isNotNull()).groupBy(*by).agg(F.min(row).alias("r")).select(*by, *[F.col(f"r.{c}").alias(c) for c in df.columns if c not in by])


def missing_runs(df: DataFrame, by: list[str], runs: int, run: str = "epoch") -> DataFrame:
    """AG21: configurations with fewer than ``runs`` runs."""
    return df.groupBy(*by).agg(F.countDistinct(run).alias("n")).filter(F.col("n") < runs)


def pivoted(df: DataFrame, rows: list[str], column: str, values: list, agg: Column) -> DataFrame:
    """AG22."""
    return df.groupBy(*rows).pivot(column, values).agg(agg)


def dataset_summary(clusters: DataFrame, places: DataFrame, by: str = "ccode") -> DataFrame:
    """AG23: counts, settlement split, extremes, means and deviations of both targets, Pearson r, Gini, places per country; one aggregation per table."""
    c = clusters.groupBy(by).agg(
        F.count(F.lit(1)).alias("clusters"), F.count_if(F.col("rural") == 0).alias("urban"), F.count_if(F.col("rural") == 1).alias("rural"),
        *[f(t).alias(f"{n}_{t}") for t in ("mean_wi", "std_wi") for n, f in (("min", F.min), ("max", F.max), ("avg", F.avg), ("std", F.stddev_samp))], F.corr("mean_wi", "std_wi").alias("pearson"),
    )
    p = places.groupBy(by).agg(F.count(F.lit(1)).alias("places"), F.sum("population").alias("population"))
    return c.join(gini(clusters, "mean_wi", [by]), by).join(p, by, "left")


def transposed(df: DataFrame, key: str, values: list[str]) -> DataFrame:
    """AG23's transposed form: a row per measure, a column per value of ``key``."""
    names = [c for c in df.columns if c != key]
    long = df.select(key, *[F.col(c).cast("double").alias(c) for c in names]).unpivot([key], names, "measure", "value")
    return long.groupBy("measure").pivot(key, values).agg(F.first("value"))


def tuning_summary(df: DataFrame, folds: list[str], times: str, by: list[str]) -> DataFrame:
    """AG47: mean and population deviation of the losses over fold columns, and of comma-joined timings."""
    losses = F.array(*[F.col(c).cast("double") for c in folds])
    seconds = F.transform(F.split(times, ","), lambda s: s.try_cast("double"))

    def stats(values: Column, name: str) -> list[Column]:
        values = F.filter(values, lambda v: v.isNotNull())
        mean = F.try_divide(F.aggregate(values, F.lit(0.0), lambda a, v: a + v), F.size(values))
        square = F.try_divide(F.aggregate(values, F.lit(0.0), lambda a, v: a + v * v), F.size(values))
        return [mean.alias(f"mean_{name}"), F.sqrt(F.greatest(square - mean * mean, F.lit(0.0))).alias(f"std_{name}")]

    return df.select(*by, *stats(losses, "loss"), *stats(seconds, "time"))


def sample_weights(df: DataFrame, method: str, value: str = "mean_wi", rural: str = "cluster_rural", classes: int = 10, most: float = 100.0, beta: float = 0.9) -> DataFrame:
    """FE4, AG48, WN10: column ``weight``. Class sizes come from one small aggregate, joined back.

    wINS 1/n, wISNS 1/sqrt(n), wENS (1-b)/(1-b^n), wx 10 below class 3 and from class 10 on, else 1; balanced_w, balanced_s, balanced_ws: N / (k n) by
    wealth class, by settlement, or the product of both.
    """
    df = df.withColumn("ses", (F.col(value) * classes / F.lit(most)).cast("int"))

    def sizes(column: str) -> DataFrame:
        n = df.groupBy(column).agg(F.count(F.lit(1)).alias(f"n_{column}"))
        total = n.agg(F.sum(f"n_{column}").alias(f"all_{column}"), F.count(F.lit(1)).alias(f"k_{column}"))
        return n.crossJoin(F.broadcast(total))  # total: one row

    balanced = lambda c: F.col(f"all_{c}") / (F.col(f"k_{c}") * F.col(f"n_{c}"))
    used = {"balanced_s": [rural], "balanced_ws": ["ses", rural], "wx": []}.get(method, ["ses"])
    out = df
    for c in used:
        out = out.join(sizes(c), c)
    n = F.col("n_ses") if "ses" in used else None
    weight = {
        "wINS": lambda: 1 / n,
        "wISNS": lambda: 1 / F.sqrt(n),
        "wENS": lambda: (1 - beta) / (1 - F.pow(F.lit(beta), n)),
        "wx": lambda: F.when((F.col("ses") < 3) | (F.col("ses") >= 10), 10.0).otherwise(1.0),
        "balanced_w": lambda: balanced("ses"),
        "balanced_s": lambda: balanced(rural),
        "balanced_ws": lambda: balanced("ses") * balanced(rural),
    }[method]()
    return out.withColumn("weight", weight).select(*df.columns, "weight")


def average_rank(df: DataFrame, metric: str, by: Iterable[str] = ()) -> DataFrame:
    """WN2: rank with ties at their average, missing values last; ``best`` marks one row (the first of rank order, then of the other columns)."""
    by = list(by)
    rows = cut(df.withColumn("_row", F.monotonically_increasing_id()))
    first = F.struct(F.col(metric).isNull().alias("_missing"), metric, *[c for c in df.columns if c not in (*by, metric)], "_row")
    best = rows.groupBy(*by).agg(F.min(first).alias("_first")).select(F.col("_first._row").alias("_row"), F.lit(True).alias("_best"))
    out = beside(rows, average_ranks(rows, metric, "rank", by), [*by, metric]).join(best, "_row", "left")
    return out.select(*df.columns, "rank", F.coalesce("_best", F.lit(False)).alias("best"))


def rescaled(df: DataFrame, column: str, base: DataFrame, base_column: str, name: str = "rescaled") -> DataFrame:
    """WN8: min-max rescale of a column onto the range of another table's column."""
    ends = df.agg(F.min(column).alias("lo"), F.max(column).alias("hi")).crossJoin(base.agg(F.min(base_column).alias("to_lo"), F.max(base_column).alias("to_hi")))
    v = F.try_divide((F.col(column) - F.col("lo")) * (F.col("to_hi") - F.col("to_lo")), F.col("hi") - F.col("lo")) + F.col("to_lo")
    return df.crossJoin(F.broadcast(ends)).withColumn(name, v).select(*df.columns, name)  # ends: one row


def transfer(within: DataFrame, across: DataFrame) -> DataFrame:
    """JN23: (source, target, model, metric) beside the source's and the target's own metric (country, model, metric)."""
    s = within.select(F.col("country").alias("source"), "model", F.col("metric").alias("within_source"))
    t = within.select(F.col("country").alias("target"), "model", F.col("metric").alias("within_target"))
    return across.join(s, ["source", "model"], "left").join(t, ["target", "model"], "left")


def transfer_matrix(within: DataFrame, across: DataFrame, targets: list[str]) -> DataFrame:
    """JN24: same- and cross-country results in one table, a column per target."""
    same = within.select(F.col("country").alias("source"), F.col("country").alias("target"), "model", "metric")
    return same.unionByName(across.select("source", "target", "model", "metric")).groupBy("source", "model").pivot("target", targets).agg(F.avg("metric"))


def transfer_ranking(across: DataFrame, metric: str = "metric", least: bool = True, keep: int = 3) -> DataFrame:
    """ML10: the best sources of each target in order."""
    order = F.col(metric).asc() if least else F.col(metric).desc()
    return across.withColumn("place", F.row_number().over(Window.partitionBy("target").orderBy(order, "source"))).filter(F.col("place") <= keep)


def similar_source(pairs: DataFrame, measure: str, least: bool) -> DataFrame:
    """ML10: the source most similar to each target: the smallest distance, or the largest similarity."""
    f = F.min_by if least else F.max_by
    return pairs.groupBy("target").agg(f("source", F.struct(measure, "source")).alias("source"))


def ordered_pairs(countries: DataFrame, column: str = "country") -> DataFrame:
    """JN19: all ordered pairs of different countries (a short list)."""
    a, b = countries.select(F.col(column).alias("source")).distinct(), countries.select(F.col(column).alias("target")).distinct()
    return a.crossJoin(b).filter("source <> target")


def overlaps(intervals: DataFrame, id: str, lo: str, hi: str) -> DataFrame:
    """JN25: pairs (a < b) of intervals that overlap; ends that only touch do not.

    Cells are as long as the longest interval, so each interval is in two at most: an equi-join. A pair is taken in the cell where its overlap begins.
    """
    longest = intervals.agg(F.coalesce(F.nullif(F.max(F.col(hi) - F.col(lo)), F.lit(0.0)), F.lit(1.0)).alias("size"))
    rows = intervals.select(id, lo, hi).crossJoin(F.broadcast(longest))  # one row
    rows = rows.withColumn("cell", F.explode(F.sequence(F.floor(F.col(lo) / F.col("size")), F.floor(F.col(hi) / F.col("size")))))
    a, b = rows.alias("a"), rows.alias("b")
    on = (F.col("a.cell") == F.col("b.cell")) & (F.col(f"a.{id}") < F.col(f"b.{id}")) & (F.col(f"a.{lo}") < F.col(f"b.{hi}")) & (F.col(f"b.{lo}") < F.col(f"a.{hi}"))
    begins = F.floor(F.greatest(F.col(f"a.{lo}"), F.col(f"b.{lo}")) / F.col("a.size"))
    return a.join(b, on).filter(F.col("a.cell") == begins).select(F.col(f"a.{id}").alias("a"), F.col(f"b.{id}").alias("b"))


def hour_interval(events: DataFrame, intervals: DataFrame, hour: str = "hour") -> DataFrame:
    """JN26: the interval [start, end) that holds the hour; an interval that ends before it starts wraps past midnight. Hours are exploded, so it is an equi-join."""
    hours = F.transform(F.sequence(F.col("start"), F.when(F.col("end") > F.col("start"), F.col("end")).otherwise(F.col("end") + 24) - 1), lambda h: h % 24)
    table = intervals.select("interval", F.explode(hours).alias(hour))
    return events.join(F.broadcast(table), hour, "left")  # at most 24 hours per interval of a day


def two_value_long(df: DataFrame, id: str, t: str, p: str) -> DataFrame:
    """ML11: a row for the truth and one for the prediction."""
    return df.select(id, F.col(t).alias("ground-truth"), F.col(p).alias("prediction")).unpivot([id], ["ground-truth", "prediction"], "kind", "value")
