"""Wealth scores, classes and bins, labels and keys, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Texts that stand for a missing value.
MISSING = ["", "none", " ", "nan", "None"]
#: Household codes that stand for an unknown answer.
UNKNOWN_CODES = [96, 99]
#: The variables of expensive and of cheap utensils.
EXPENSIVE = ["hv212", "hv243e", "hv211", "hv243d", "hv243a"]
CHEAP = ["hv208", "hv209", "hv221", "hv210", "hv212"]
#: Wealth classes by lower bound, left-closed; the last one ends at 101.
CLASSES = [(0.0, 25.0, "poor"), (25.0, 50.0, "lower_middle"), (50.0, 75.0, "upper_middle"), (75.0, 101.0, "rich")]


def nullify(c: Column) -> Column:
    """Texts that mean 'missing', and NaN, become NULL."""
    text = c.cast("string")
    return F.when(~text.isin([*MISSING, "NaN"]), c)


def key(ccode: Column, year: Column, cluster: Column) -> Column:
    """PF8: country, year padded with blanks to 4, cluster padded with zeros to 10."""
    return F.format_string("%s%4d%010d", ccode, year.cast("int"), cluster.cast("long"))


def iwi(betas: dict[str, float | dict[str, float]], tiers: tuple[str, ...] = ("hv201", "hv205", "hv213"), rooms: str = "hv216") -> Column:
    """SC12: constant + sum of beta * x over the index's variables.

    A code 96 or 99 adds nothing. Variables of ``tiers`` are given as ``{name}_tier`` (1 low, 2 middle, 3 high, NULL unknown: 0) and add the tier's beta; rooms 0 and 1
    count as 1, 3 and more as 3. Any expensive asset adds 'expensive'; any cheap one, any expensive one or a high tier of
    hv205 or hv213 adds 'cheap'. Missing assets count as absent.
    """
    total = F.lit(float(betas["constant"]))
    for name, beta in betas.items():
        if name in ("constant", "cheap", "expensive"):
            continue
        x = F.col(name)
        if isinstance(beta, dict):
            step = F.col(f"{name}_tier") if name in tiers else F.when(x <= 1, 1).when(x == 2, 2).otherwise(3)
            add = F.when(step == 1, float(beta["1"])).when(step == 2, float(beta["2"])).when(step == 3, float(beta["3"])).otherwise(0.0)
        else:
            add = F.lit(float(beta)) * x.cast("double")
        total = total + F.when(x.isin(UNKNOWN_CODES), 0.0).otherwise(F.coalesce(add, F.lit(0.0)))
    any_of = lambda names: F.greatest(*[F.coalesce((F.col(n) == 1).cast("int"), F.lit(0)) for n in names]) == 1
    expensive = any_of(EXPENSIVE)
    high = F.coalesce(F.col("hv205_tier") == 3, F.lit(False)) | F.coalesce(F.col("hv213_tier") == 3, F.lit(False))
    total = total + F.when(expensive, float(betas["expensive"])).otherwise(0.0)
    return total + F.when(expensive | any_of(CHEAP) | high, float(betas["cheap"])).otherwise(0.0)


def with_tiers(df: DataFrame, tiers: DataFrame, variables: tuple[str, ...] = ("hv201", "hv205", "hv213")) -> DataFrame:
    """The quality tier of each coded variable from the dimension (variable, country, year, tier low/mid/high, code): ``{name}_tier`` 1, 2, 3 or NULL."""
    number = F.when(F.col("tier") == "low", 1).when(F.col("tier") == "mid", 2).when(F.col("tier") == "high", 3)
    keys = [c for c in ("country", "year") if c in df.columns and c in tiers.columns]
    for v in variables:
        one = tiers.filter(F.col("variable") == v).select(*keys, F.col("code").alias(v), number.alias(f"{v}_tier"))
        one = one.groupBy(*keys, v).agg(F.min(f"{v}_tier").alias(f"{v}_tier"))  # the first tier that lists the code
        df = df.join(one, [*keys, v], "left")
    return df


def wealth_class(v: Column) -> Column:
    """SC13: the class's name, number (1 to 4) and interval; NULL outside [0, 101)."""
    out = F.lit(None).cast("struct<id:int,name:string,bin:string>")
    for k, (lo, hi, name) in enumerate(CLASSES, 1):
        out = F.when((v >= lo) & (v < hi), F.struct(F.lit(k).alias("id"), F.lit(name).alias("name"), F.lit(f"[{lo:g}, {hi:g})").alias("bin"))).otherwise(out)
    return out


def n_bin(v: Column, most: Column | float, n: int) -> Column:
    """SC14: bin 0 to n-1 of width ceil(most / n), left-closed, the last one a unit wider; NULL outside."""
    most = most if isinstance(most, Column) else F.lit(float(most))
    step = F.ceil(most / n)
    return F.when((v >= 0) & (v < step * n + 1), F.least(F.floor(v / step), F.lit(n - 1))).cast("int")


def width_bin(v: Column, lo: Column, hi: Column, n: int) -> Column:
    """SC15: equal-width bin 0 to n-1 over [lo, hi], right-closed, the low edge included; 0 if lo = hi."""
    raw = F.ceil(F.try_divide((v - lo) * n, hi - lo)) - 1
    return F.coalesce(F.greatest(F.lit(0), F.least(F.lit(n - 1), raw)), F.when(v.isNotNull(), 0)).cast("int")


def edge_bin(v: Column, edges: Column, n: int, lowest: bool = True) -> Column:
    """SC16: bin 0 to n-1 between edges (an array of n + 1), right-closed; ``lowest``: the first edge belongs to bin 0. NULL outside."""
    out = F.lit(None).cast("int")
    for k in range(n - 1, -1, -1):
        low = (v >= edges[k]) if k == 0 and lowest else (v > edges[k])
        out = F.when(low & (v <= edges[k + 1]), k).otherwise(out)
    return out


def class_number(v: Column, k: int, most: float = 100.0) -> Column:
    """FE4's class: trunc(v * k / most)."""
    return (v * k / F.lit(most)).cast("int")


def normalised_difference(a: Column, b: Column) -> Column:
    """SC29: (a - b) / (a + b); NULL if the sum is 0."""
    return F.try_divide(a - b, a + b)


def stars(p: Column) -> Column:
    """SC19: three-level symbol of a p-value."""
    return F.when(p <= 0.001, "***").when(p <= 0.01, "**").when(p <= 0.05, "*").otherwise("")


def significance(p: Column) -> Column:
    """SC19: five-level symbol; '-' if there is no p-value."""
    return F.when(p <= 0.0001, "****").when(p <= 0.001, "***").when(p <= 0.01, "**").when(p <= 0.05, "*").when(p > 0.05, "ns").otherwise("-")


def zero_if_missing(c: Column) -> Column:
    """SC27."""
    return F.coalesce(F.nanvl(c.cast("double"), F.lit(0.0)), F.lit(0.0))


def count_with_share(n: Column, total: Column) -> Column:
    """SC21: "308 (34%)"."""
    return F.format_string("%d (%.0f%%)", n.cast("long"), F.coalesce(F.try_divide(n * 100.0, total), F.lit(0.0)))


def value_and_year(text: Column) -> Column:
    """SC21: '35.7 (2018)' to (value, year); NULLs if it is not of that form."""
    pattern = r"^\s*(-?[0-9.]+)\s*\((\d{4})\)\s*$"
    return F.struct(F.regexp_extract(text, pattern, 1).try_cast("double").alias("value"), F.regexp_extract(text, pattern, 2).try_cast("int").alias("year"))


def short_years(text: Column) -> Column:
    """SC22: '2018-2019' to '2018-19'."""
    return F.regexp_replace(text, r"(\d{4})-\d{2}(\d{2})", "$1-$2")


def settlement(rural: Column) -> Column:
    """SC22."""
    return F.when(rural == 1, "rural").when(rural == 0, "urban")


def wkt_ends(text: Column) -> Column:
    """SC9: first and last point of 'LINESTRING (lon lat, ...)' as 'POINT (lon lat)' with coordinates rounded to 5 decimals; NULL if malformed."""
    number = r"(-?[0-9.]+(?:[eE][-+]?[0-9]+)?)"
    first, last = rf"^LINESTRING\s*\(\s*{number}\s+{number}", rf"{number}\s+{number}\s*\)\s*$"

    def point(pattern: str) -> Column:
        lon, lat = (F.round(F.regexp_extract(text, pattern, k).try_cast("double"), 5) for k in (1, 2))
        return F.when(lon.isNotNull() & lat.isNotNull(), F.concat(F.lit("POINT ("), number_text(lon), F.lit(" "), number_text(lat), F.lit(")")))

    return F.struct(point(first).alias("start"), point(last).alias("end"))


def number_text(v: Column) -> Column:
    """A coordinate as text, as the source writes it: plain digits down to 0.0001, below that with an exponent of two digits (``5e-05``)."""
    text = v.cast("string")
    plain = F.regexp_replace(v.cast("decimal(30, 20)").cast("string"), "0+$", "")
    small = F.regexp_replace(F.regexp_replace(text, r"\.0E", "E"), r"E-(\d)$", "E-0$1")
    return F.when((v == 0) | (F.abs(v) >= 1e-3), text).when(F.abs(v) >= 1e-4, plain).otherwise(F.regexp_replace(small, "E", "e"))


def repaired_line(text: Column, lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """SC9: rows whose text does not start with LINE get one from their coordinate columns."""
    made = F.concat(F.lit("LINESTRING ("), number_text(lon1), F.lit(" "), number_text(lat1), F.lit(", "), number_text(lon2), F.lit(" "), number_text(lat2), F.lit(")"))
    return F.when(F.coalesce(text.startswith("LINE"), F.lit(False)), text).otherwise(made)


def time_parts(df: DataFrame, column: str = "date_time") -> DataFrame:
    """SC10: year, month, date, time and full day name of a timestamp (or its text)."""
    t = F.col(column).cast("timestamp_ntz")
    return df.withColumns({"year": F.year(t), "month": F.month(t), "date": F.to_date(t), "time": F.date_format(t, "HH:mm"), "day": F.date_format(t, "EEEE")})


def local_time(t: Column, zone: Column | str) -> Column:
    """SC11: local hour and whether it is a workday (Monday to Friday) of a UTC timestamp in a zone."""
    local = F.from_utc_timestamp(t, zone)
    return F.struct(local.alias("local"), F.hour(local).alias("hour"), (~F.dayofweek(local).isin(1, 7)).alias("workday"))


def recency(config: Column) -> Column:
    """SRC11: the recency code of a configuration's name; the first rule that holds decides."""
    parts = F.size(F.split(config, "_"))
    year = F.array_contains(F.regexp_extract_all(config, F.lit(r"(\d+)"), 1), "2016")
    has = lambda s: config.contains(s)
    return (
        F.when((parts == 4) & has("_oldest_"), "O-N").when((parts == 4) & has("_all_"), "ON").when(year & has("_all300_"), "O300")
        .when(has("_all300_"), "N300").when(year & has("_all_"), "O").when(has("_all_"), "N")
    )


def run_facts(path: Column) -> Column:
    """SRC10, ML8: what a result's path tells: model, augmented, weighted, features, epoch, seed."""
    cnn, trees, plain, weighted = path.contains("cnn"), path.contains("xgb-"), path.contains("noaug_"), path.contains("weighted")
    image = F.when(cnn & plain, "CNN").when(cnn, "CNN_a")
    boosted = F.when(trees & weighted, "CB_w").when(trees, "CB")
    source = F.regexp_extract(path, r"xgb-([^/]*)", 1)
    single = F.when(source.isin("OCI", "FBM", "NTLL", "FBMV", "FBP", "OSM"), source)
    features = F.when(cnn & (~trees | single.isNotNull()), "images").when(~cnn & trees & single.isNull(), "metadata").when(cnn & trees, "images+metadata").otherwise(single)
    return F.struct(
        F.concat_ws("+", image, boosted).alias("model"), F.when(path.contains("aug_") & ~plain, "yes").otherwise("no").alias("augmented"), F.when(weighted, "yes").otherwise("no").alias("weighted"), features.alias("features"),
        F.regexp_extract(path, r"epoch(\d+)", 1).try_cast("int").alias("epoch"), F.regexp_extract(path, r"rs(\d+)", 1).try_cast("long").alias("seed"),
    )
