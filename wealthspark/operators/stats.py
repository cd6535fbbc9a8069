"""Distributions: correlation, histograms, densities, tests, fits. p-values are computed on aggregated rows."""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..sources.tables import cut
from .order import average_ranks, beside, running


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function by its continued fraction."""
    if not 0 < x < 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1))
    f = d
    for m in range(1, 300):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / (1 + top * d), 1 + top / c
            f *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return front * f


@F.pandas_udf(DoubleType())
def correlation_p(r: pd.Series, n: pd.Series) -> pd.Series:
    """Two-sided p of a Pearson r from n pairs; for few rows."""

    def p(r: float, n: float) -> float | None:
        if r is None or n < 3 or math.isnan(r):
            return None
        return 0.0 if abs(r) >= 1 else incomplete_beta((n - 2) / 2, 0.5, 1 - r * r)

    return pd.Series([p(a, b) for a, b in zip(r, n)], dtype="float64")


@F.pandas_udf(DoubleType())
def two_sided_p(z: pd.Series) -> pd.Series:
    """Two-sided p of a standard normal z."""
    return z.map(lambda v: None if v is None or math.isnan(v) else math.erfc(abs(v) / math.sqrt(2)))


@F.pandas_udf(DoubleType())
def normal_cdf(z: pd.Series) -> pd.Series:
    return z.map(lambda v: 0.5 * math.erfc(-v / math.sqrt(2)))


def pearson(df: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """AG14: r, n and p per group."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    return df.groupBy(*by).agg(F.corr(a, b).alias("r"), F.count_if(both).alias("n")).withColumn("p", correlation_p("r", "n"))


def spearman(df: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """AG15: correlation of average ranks within each group. Equal pairs are counted first; the mean rank is (n + 1) / 2."""
    rows = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    pairs = rows.groupBy(*by, a, b).agg(F.count(F.lit(1)).alias("_k"))
    totals = pairs.groupBy(*by).agg(F.sum("_k").alias("_n"))
    out = beside(beside(pairs, average_ranks(rows, a, "_a", by), [*by, a]), average_ranks(rows, b, "_b", by), [*by, b])
    x, y, k = F.col("_a") - (F.col("_n") + 1) / 2, F.col("_b") - (F.col("_n") + 1) / 2, F.col("_k")
    r = F.try_divide(F.sum(k * x * y), F.sqrt(F.sum(k * x * x)) * F.sqrt(F.sum(k * y * y)))
    return beside(out, totals, by).groupBy(*by).agg(r.alias("r"), F.sum("_k").alias("n"))


def mean_correlation(df: DataFrame, by: list[str], run: str, a: str, b: str) -> DataFrame:
    """AG16: means over runs of r, p and n."""
    return pearson(df, [*by, run], a, b).groupBy(*by).agg(F.avg("r").alias("r"), F.avg("p").alias("p"), F.avg("n").alias("n"))


def histogram(df: DataFrame, column: str, bins: int, quantiles: bool = False) -> DataFrame:
    """AG29: counts per bin, empty ones too. Equal width: left-closed, the largest value in the last bin; quantiles: right-closed, the lowest included."""
    points = [k / bins for k in range(bins + 1)]
    if quantiles:
        ends = df.agg(F.percentile(column, points).alias("edges"))
        v = F.col(column)
        bin_ = F.greatest(F.size(F.filter("edges", lambda e: e < v)) - 1, F.lit(0))
    else:
        ends = df.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
        ends = ends.select(F.array(*[F.col("lo") + (F.col("hi") - F.col("lo")) * p for p in points]).alias("edges"))
        lo, hi = F.col("edges")[0], F.col("edges")[bins]
        bin_ = F.least(F.lit(bins - 1), F.coalesce(F.floor(F.try_divide((F.col(column) - lo) * bins, hi - lo)), F.lit(0)))
    n = df.filter(F.col(column).isNotNull()).crossJoin(F.broadcast(ends)).groupBy(bin_.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))  # ends: one row
    all_ = ends.select(F.posexplode(F.slice("edges", 1, bins)).alias("bin", "low"))
    return all_.join(n, "bin", "left").select("bin", "low", F.coalesce("n", F.lit(0)).alias("n"))


def ecdf(df: DataFrame, column: str, at: Iterable[float]) -> DataFrame:
    """AG30: share of values at or below each of some points (ecdf) and above it (ccdf)."""
    points = F.array(*[F.lit(float(v)) for v in at])
    rows = df.filter(F.col(column).isNotNull()).select(F.explode(F.transform(points, lambda p: F.struct(p.alias("spot"), (F.col(column) <= p).cast("int").alias("below")))).alias("e"))
    return rows.groupBy("e.spot").agg(F.avg("e.below").alias("ecdf")).withColumn("ccdf", 1 - F.col("ecdf"))


def poverty_line(df: DataFrame, by: list[str], column: str) -> DataFrame:
    """AG30: the 35th percentile of the values (not the value 35)."""
    return df.groupBy(*by).agg(F.percentile(column, 0.35).alias("line"))


def kde(df: DataFrame, by: list[str], column: str, support: DataFrame) -> DataFrame:
    """AG31: Gaussian density with Scott's bandwidth at the points of ``support`` (column ``spot``, a short table). Equal values are counted first."""
    counted = df.filter(F.col(column).isNotNull()).groupBy(*by, F.col(column).alias("v")).agg(F.count(F.lit(1)).alias("k"))
    stats = df.groupBy(*by).agg(F.stddev_samp(column).alias("s"), F.count(column).alias("n")).withColumn("h", F.col("s") * F.pow(F.col("n"), F.lit(-0.2)))
    joined = counted.join(stats, by) if by else counted.crossJoin(F.broadcast(stats))  # one row
    z = (F.col("spot") - F.col("v")) / F.col("h")
    dense = joined.crossJoin(F.broadcast(support)).groupBy(*by, "spot").agg((F.sum(F.col("k") * F.exp(-0.5 * z * z)) / (F.first("n") * F.first("h") * math.sqrt(2 * math.pi))).alias("density"))
    return dense


def support(spark: SparkSession, df: DataFrame, column: str, points: int = 100) -> DataFrame:
    """Equally spaced points over the range of all values."""
    ends = df.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    steps = F.explode(F.sequence(F.lit(0), F.lit(points - 1)))
    return ends.select("lo", "hi", steps.alias("k")).select((F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("k") / (points - 1)).alias("spot"))


def js_distance(spark: SparkSession, df: DataFrame, group: str, a: str, b: str, column: str, points: int = 100) -> DataFrame:
    """AG32: Jensen-Shannon distance of two groups' densities on a common support, each scaled to sum 1. One row."""
    two = df.filter(F.col(group).isin(a, b))
    d = kde(two, [group], column, support(spark, two, column, points)).groupBy("spot").pivot(group, [a, b]).agg(F.first("density"))
    sums = d.agg(F.sum(f"`{a}`").alias("sa"), F.sum(f"`{b}`").alias("sb"))
    d = d.crossJoin(F.broadcast(sums)).select((F.col(f"`{a}`") / F.col("sa")).alias("p"), (F.col(f"`{b}`") / F.col("sb")).alias("q"))
    m = (F.col("p") + F.col("q")) / 2
    part = lambda v: F.when(v > 0, v * F.log(v / m)).otherwise(0.0)
    return d.agg(F.sqrt((F.sum(part(F.col("p"))) + F.sum(part(F.col("q")))) / 2).alias("distance"))


@F.pandas_udf(DoubleType())
def ks_p(d: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
    """Asymptotic p of a two-sample Kolmogorov-Smirnov statistic."""

    def p(d: float, n: float, m: float) -> float:
        x = math.sqrt(n * m / (n + m)) * d
        if x < 0.2:
            return 1.0
        return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101))))

    return pd.Series([p(*v) for v in zip(d, n, m)], dtype="float64")


def ks(df: DataFrame, group: str, a: str, b: str, column: str) -> DataFrame:
    """AG33: two-sample Kolmogorov-Smirnov statistic and p. One row. Running counts go over distinct values, dealt by ranges."""
    counted = df.filter(F.col(group).isin(a, b) & F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count_if(F.col(group) == a).alias("ka"), F.count_if(F.col(group) == b).alias("kb"))
    run = running(counted, "v", {"fa": "ka", "fb": "kb"})
    total = counted.agg(F.sum("ka").alias("n"), F.sum("kb").alias("m"))
    gap = F.abs(F.col("fa") / F.col("n") - F.col("fb") / F.col("m"))
    out = run.crossJoin(F.broadcast(total)).agg(F.max(gap).alias("statistic"), F.first("n").alias("n"), F.first("m").alias("m"))  # total: one row
    return out.withColumn("p", ks_p("statistic", "n", "m"))


def skew_z(skew: Column, n: Column) -> Column:
    """AG34: D'Agostino's z of a population skewness (n of 8 or more)."""
    n = n.cast("double")
    y = skew * F.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    beta = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = F.sqrt(2 * (beta - 1)) - 1
    y = y / F.sqrt(2 / (w2 - 1))
    return F.log(y + F.sqrt(y * y + 1)) / F.sqrt(0.5 * F.log(w2))


def kurtosis_z(excess: Column, n: Column) -> Column:
    """AG37: Anscombe and Glynn's z of a population excess kurtosis (n of 20 or more is reliable)."""
    n = n.cast("double")
    x = (excess + 3 - 3 * (n - 1) / (n + 1)) / F.sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5)))
    root = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / root * (2 / root + F.sqrt(1 + 4 / (root * root)))
    bottom = 1 + x * F.sqrt(2 / (a - 4))
    return (1 - 2 / (9 * a) - F.signum(bottom) * F.cbrt((1 - 2 / a) / F.abs(bottom))) / F.sqrt(2 / (9 * a))


def skew_test(df: DataFrame, by: list[str], column: str) -> DataFrame:
    """AG34: skewness, its z and p."""
    s = df.groupBy(*by).agg(F.skewness(column).alias("skew"), F.count(column).alias("n"))
    s = s.withColumn("z", F.when(F.col("n") >= 8, skew_z(F.col("skew"), F.col("n"))))
    return s.withColumn("p", two_sided_p("z"))


def normality(df: DataFrame, by: list[str], column: str, alpha: float = 0.05) -> DataFrame:
    """AG37: K2 = skewness z squared + kurtosis z squared, p = exp(-K2 / 2), and the decision. Groups under 8 values: NULL."""
    s = df.groupBy(*by).agg(F.skewness(column).alias("skew"), F.kurtosis(column).alias("kurt"), F.count(column).alias("n"))
    zs, zk = skew_z(F.col("skew"), F.col("n")), kurtosis_z(F.col("kurt"), F.col("n"))
    k2 = F.when(F.col("n") >= 8, zs * zs + zk * zk)
    out = s.select(*by, "n", k2.alias("k2"))
    return out.withColumn("p", F.exp(-F.col("k2") / 2)).withColumn("normal", F.col("p") > alpha)


def anderson_darling(df: DataFrame, by: list[str], column: str) -> DataFrame:
    """AG37: A2 against the normal of the group's mean and sample deviation. Equal values are counted first; ranks run over ranges of a group."""
    rows = df.filter(F.col(column).isNotNull())
    moments = rows.groupBy(*by).agg(F.avg(column).alias("_m"), F.stddev_samp(column).alias("_s"), F.count(F.lit(1)).alias("n"))
    upto = running(rows.groupBy(*by, F.col(column).alias("_v")).agg(F.count(F.lit(1)).alias("_k")), "_v", {"_upto": "_k"}, by)
    out = beside(upto, moments, by).withColumn("z", F.try_divide(F.col("_v") - F.col("_m"), F.col("_s")))
    out = out.withColumns({"lo": F.log(normal_cdf("z")), "hi": F.log(normal_cdf(-F.col("z")))})
    # sum of (2i - 1) ln F(z_i) + (2(n - i) + 1) ln(1 - F(z_i)), i from _upto - _k + 1 to _upto
    k, u, n = F.col("_k"), F.col("_upto"), F.col("n")
    odd = k * (2 * u - k)
    return out.groupBy(*by).agg(F.first("n").alias("n"), (-F.first("n") - F.sum(odd * F.col("lo") + (2 * n * k - odd) * F.col("hi")) / F.first("n")).alias("a2"))


def shapiro_wilk(x: np.ndarray) -> tuple[float, float]:
    """AG37: W and p by Royston's approximation, for 4 to 5000 values."""
    x, n = np.sort(np.asarray(x, float)), len(x)
    normal = _normal_quantile((np.arange(1, n + 1) - 0.375) / (n + 0.25))
    norm2, u = float((normal**2).sum()), 1 / math.sqrt(n)
    a = normal / math.sqrt(norm2)
    last = np.polyval([-2.706056, 4.434685, -2.07119, -0.147981, 0.221157, a[-1]], u)
    if n > 5:
        before = np.polyval([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, a[-2]], u)
        phi = (norm2 - 2 * normal[-1] ** 2 - 2 * normal[-2] ** 2) / (1 - 2 * last**2 - 2 * before**2)
        a = normal / math.sqrt(phi)
        a[-1], a[-2], a[0], a[1] = last, before, -last, -before
    else:
        phi = (norm2 - 2 * normal[-1] ** 2) / (1 - 2 * last**2)
        a = normal / math.sqrt(phi)
        a[-1], a[0] = last, -last
    w = min(1.0, float((a @ x) ** 2 / ((x - x.mean()) ** 2).sum())) if x[-1] > x[0] else 1.0
    if w >= 1:
        return 1.0, 1.0
    if n <= 11:
        g = -2.273 + 0.459 * n
        mean, dev = np.polyval([-0.0006714, 0.025054, -0.39978, 0.544], n), math.exp(np.polyval([-0.0020322, 0.062767, -0.77857, 1.3822], n))
        z = (-math.log(max(g - math.log(1 - w), 1e-300)) - mean) / dev
    else:
        k = math.log(n)
        mean, dev = np.polyval([0.0038915, -0.083751, -0.31082, -1.5861], k), math.exp(np.polyval([0.0030302, -0.082676, -0.4803], k))
        z = (math.log(1 - w) - mean) / dev
    return w, 0.5 * math.erfc(z / math.sqrt(2))


def _normal_quantile(p: np.ndarray) -> np.ndarray:
    """Inverse of the normal distribution function by bisection and Newton steps."""
    cdf = np.vectorize(lambda v: 0.5 * math.erfc(-v / math.sqrt(2)))
    x = np.zeros(len(p))
    for _ in range(60):
        step = (cdf(x) - p) / np.maximum(np.exp(-x * x / 2) / math.sqrt(2 * math.pi), 1e-12)
        x = x - np.clip(step, -0.5, 0.5)
        if np.abs(step).max() < 1e-13:
            break
    return x


def shapiro(df: DataFrame, by: list[str], column: str, most: int = 5000) -> DataFrame:
    """AG37: Shapiro-Wilk per group of 4 to ``most`` values (the test is not defined beyond); other groups give NULL and are never gathered."""
    sizes = df.groupBy(*by).agg(F.count(column).alias("n"))
    small = df.join(sizes.filter(F.col("n").between(4, most)), by).select(*by, F.col(column).cast("double").alias("v"), "n")
    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in by)

    def test(pdf: pd.DataFrame) -> pd.DataFrame:
        w, p = shapiro_wilk(pdf["v"].dropna().to_numpy())
        return pdf[by].head(1).assign(w=w, p=p)

    return sizes.join(small.groupBy(*by).applyInPandas(test, f"{kinds}, w double, p double"), by, "left")


def gaussian_share(households: DataFrame, cluster: list[str], value: str, quintile: str, least: int = 8, alpha: float = 0.05) -> DataFrame:
    """AG38: per quintile the share of clusters (of ``least`` households or more) whose values look normal."""
    q = households.groupBy(*cluster).agg(F.first(quintile).alias("quintile"))
    return normality(households, cluster, value, alpha).filter(F.col("n") >= least).join(q, cluster).groupBy("quintile").agg(F.avg(F.col("normal").cast("int")).alias("share"), F.count(F.lit(1)).alias("clusters"))


def student_quantile(p: float, dof: float) -> float:
    """The t that a Student variable stays below with probability p (over one half)."""
    lo, hi = 0.0, 1e3
    for _ in range(200):
        mid = (lo + hi) / 2
        below = 1 - 0.5 * incomplete_beta(dof / 2, 0.5, dof / (dof + mid * mid))
        lo, hi = (mid, hi) if below < p else (lo, mid)
    return (lo + hi) / 2


def polynomial(df: DataFrame, x: str, y: str, order: int = 2) -> dict[str, object]:
    """AG39: least squares by power sums from one aggregate row: coefficients (highest first), rmse, r2 and what the band needs. x is centred and scaled."""
    m = df.agg(F.avg(x).alias("m"), F.stddev_samp(x).alias("s"), F.count(F.lit(1)).alias("n"), F.min(x).alias("lo"), F.max(x).alias("hi"), F.avg(y).alias("ym"), F.var_pop(y).alias("yv")).first()
    z = (F.col(x) - m["m"]) / (m["s"] or 1.0)
    row = df.agg(*[F.sum(F.pow(z, F.lit(float(k)))).alias(f"x{k}") for k in range(2 * order + 1)], *[F.sum(F.col(y) * F.pow(z, F.lit(float(k)))).alias(f"y{k}") for k in range(order + 1)], F.sum(F.col(y) * F.col(y)).alias("yy")).first()
    a = np.array([[row[f"x{i + j}"] for j in range(order + 1)] for i in range(order + 1)])
    b = np.array([row[f"y{i}"] for i in range(order + 1)])
    c = np.linalg.solve(a, b)
    ssr = max(0.0, row["yy"] - 2 * c @ b + c @ a @ c)
    poly = np.poly1d([0.0])
    for k, v in enumerate(c):
        poly = poly + v * np.poly1d([1 / (m["s"] or 1.0), -m["m"] / (m["s"] or 1.0)]) ** k
    n = m["n"]
    return {"coefficients": [float(v) for v in poly.coeffs], "rmse": math.sqrt(ssr / n), "r2": float(1 - ssr / (m["yv"] * n)), "n": n, "mean": m["m"], "sxx": (m["s"] or 0.0) ** 2 * (n - 1), "lo": m["lo"], "hi": m["hi"], "ssr": float(ssr)}


def polynomial_band(spark: SparkSession, fit: dict[str, object], points: int = 100, confidence: float = 95) -> DataFrame:
    """AG39: the fitted line at equally spaced points and the half-width of its confidence band (with n - 2 degrees of freedom, as in the source)."""
    x = np.linspace(fit["lo"], fit["hi"], points)
    t = student_quantile(1 - (1 - confidence / 100) / 2, fit["n"] - 2)
    half = t * math.sqrt(fit["ssr"] / (fit["n"] - 2)) * np.sqrt(1 / fit["n"] + (x - fit["mean"]) ** 2 / fit["sxx"])
    return spark.createDataFrame([(float(a), float(b), float(c)) for a, b, c in zip(x, np.polyval(fit["coefficients"], x), half)], "x double, y double, half double")


def linear(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """AG40."""
    return df.groupBy(*by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"), F.corr(x, y).alias("r"))


def power_law(df: DataFrame, column: str, samples: int = 128, block: int = 32) -> DataFrame:
    """AG41: exponent of a power-law tail. Every distinct value is tried as least value, alpha = 1 + n / sum ln(x / least), and the one whose tail is closest to
    its power law (Kolmogorov-Smirnov; ties: the smaller least value) is taken. One row; none if fewer than two values are positive.

    Counts and sums of logarithms from the top down give every candidate's alpha in one pass. Its distance at some ``samples`` of the values, spread over ranks and
    over the tail, is a lower bound of its distance. Candidates go in blocks, the smallest bound first, against all values, until
    no bound is below the least distance found: the result is that of all candidates against all values.
    """
    counted = df.filter(F.col(column) > 0).groupBy(F.col(column).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("k"))
    down = running(counted.withColumns({"down": -F.col("v"), "logs": F.col("k") * F.log("v")}), "down", {"n": "k", "sum_logs": "logs"})
    fit = F.col("sum_logs") - F.col("n") * F.log("v")
    tails = cut(down.select("v", "k", "n", F.when(fit > 1e-12 * F.col("n"), 1 + F.col("n") / fit).alias("alpha")))
    total = tails.agg(F.max("n")).first()[0]
    out = "alpha double, least double, distance double, n long"
    if not total:
        return df.sparkSession.createDataFrame([], out)

    def gap(v: Column, at: Column) -> Column:
        """The distance of a candidate (columns least, alpha, tail) at a value v that ``at`` values reach or exceed the next of."""
        return F.abs((F.col("tail") - at) / F.col("tail") - (1 - F.pow(v / F.col("least"), 1 - F.col("alpha"))))

    # ranks of samples from the top: evenly, and more and more sparsely from the largest value on
    ranks = sorted({int(total * k / samples) for k in range(samples)} | {int(total ** (k / samples)) for k in range(samples + 1)})
    chosen = [tuple(r) for r in tails.withColumn("of", F.explode(F.array(*map(F.lit, ranks)))).filter("n - k <= of AND of < n").select("v", (F.col("n") - F.col("k")).alias("above")).distinct().collect()]
    candidates = tails.filter("alpha IS NOT NULL").select(F.col("v").alias("least"), "alpha", F.col("n").alias("tail"))
    points = F.array(*[F.struct(F.lit(v).alias("v"), F.lit(int(a)).alias("above")) for v, a in chosen])
    bounded = candidates.withColumn("s", F.explode(points)).filter("s.v >= least").withColumn("bound", gap(F.col("s.v"), F.col("s.above")))
    bounded = cut(candidates.join(bounded.groupBy("least").agg(F.max("bound").alias("bound")), "least", "left").fillna(0.0, ["bound"]))
    best, after = None, (-1.0, 0.0)
    while True:
        order = F.struct("bound", "least")
        todo = bounded.filter(order > F.struct(F.lit(after[0]), F.lit(after[1])))
        todo = todo if best is None else todo.filter(F.col("bound") <= best[0])
        some = todo.orderBy("bound", "least").limit(block).collect()
        if not some:
            break
        tried = F.array(*[F.struct(F.lit(r["least"]).alias("least"), F.lit(r["alpha"]).alias("alpha"), F.lit(r["tail"]).alias("tail")) for r in some])
        met = tails.select("v", (F.col("n") - F.col("k")).alias("above"), F.inline(tried)).filter("v >= least")
        for r in met.groupBy("least", "alpha", "tail").agg(F.max(gap(F.col("v"), F.col("above"))).alias("distance")).collect():
            found = (r["distance"], r["least"], r["alpha"], r["tail"])
            best = found if best is None else min(best, found)
        after = (some[-1]["bound"], some[-1]["least"])
        block *= 2
    rows = [(best[2], best[1], best[0], best[3])] if best else []
    return df.sparkSession.createDataFrame(rows, out)


def attribution(df: DataFrame, by: list[str], value: str = "attribution") -> DataFrame:
    """AG49: mean absolute attribution per feature (and output)."""
    return df.groupBy(*by).agg(F.avg(F.abs(value)).alias("importance"))
