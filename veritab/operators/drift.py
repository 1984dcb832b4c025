"""Drift of a column between a table and a reference, and `compare` for whole tables."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import pandas as pd
from numpy.polynomial.hermite_e import herme2poly
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.statistics import anderson_sf, chi2_sf, cvm_sf, ks_sf
from ..plans.checks import NUMERIC, Check, count_if, graded, rows
from .distribution import _bins, frequencies
from .quantiles import exact_quantiles


def _grade(df: DataFrame, check: str, column: str, issue: str, value: Column, threshold: float) -> DataFrame:
    """At the threshold an issue is medium, at 1.5 times it high, at twice critical."""
    out = graded(df, check, column, issue, F.when(value >= threshold, 1).otherwise(0), F.lit(1), value, grade="medium")
    return out.withColumn("severity", F.when(F.col("severity").isNotNull(), F.when(F.col("actual") >= 2 * threshold, "critical").when(F.col("actual") >= 1.5 * threshold, "high").otherwise("medium")))


def _pair(df: DataFrame, reference: DataFrame, a: Column, b: Column) -> DataFrame:
    return df.agg(a.alias("a")).crossJoin(reference.agg(b.alias("b")))  # one row each


def mean_drift(column: str, reference: DataFrame, threshold_pct: float | None = 10.0, threshold_abs: float | None = None) -> Check:
    def plan(df: DataFrame) -> DataFrame:
        both = _pair(df, reference, F.avg(column), F.avg(column))
        gap = F.abs(F.col("a") - F.col("b"))
        value = gap if threshold_abs is not None else F.try_divide(gap, F.abs("b")) * 100
        return _grade(both, "mean_drift", column, "mean_drift", value, threshold_abs if threshold_abs is not None else threshold_pct)

    return Check("mean_drift", plan)


def variance_drift(column: str, reference: DataFrame, threshold_pct: float = 20.0, use_std: bool = True) -> Check:
    f = F.stddev_samp if use_std else F.var_samp
    return Check("variance_drift", lambda df: _grade(_pair(df, reference, f(column), f(column)), "variance_drift", column, "variance_drift", F.try_divide(F.abs(F.col("a") - F.col("b")), F.abs("b")) * 100, threshold_pct))


def quantile_drift(column: str, reference: DataFrame, quantiles: Sequence[float] = (0.25, 0.5, 0.75), threshold_pct: float = 15.0) -> Check:
    def plan(df: DataFrame) -> DataFrame:
        both = exact_quantiles(df, {"a": (column, quantiles)}).crossJoin(exact_quantiles(reference, {"b": (column, quantiles)}))  # one row each
        each = [_grade(both, "quantile_drift", column, f"quantile_{q:g}_drift", F.try_divide(F.abs(F.col("a")[i] - F.col("b")[i]), F.abs(F.col("b")[i])) * 100, threshold_pct) for i, q in enumerate(quantiles)]
        return reduce(DataFrame.unionByName, each)

    return Check("quantile_drift", plan)


def range_drift(column: str, reference: DataFrame, allow_expansion: bool = False, threshold_pct: float = 10.0) -> Check:
    """Change of the least and the greatest value; a reference of 0 is left out; with ``allow_expansion`` only a narrower range counts."""

    def plan(df: DataFrame) -> DataFrame:
        made = []
        for f, name, wider in ((F.min, "min", lambda a, b: a < b), (F.max, "max", lambda a, b: a > b)):
            both = _pair(df, reference, f(column), f(column))
            value = F.try_divide(F.abs(F.col("a") - F.col("b")), F.abs("b")) * 100
            value = F.when(F.lit(allow_expansion) & wider(F.col("a"), F.col("b")), 0.0).otherwise(value)
            made.append(_grade(both, "range_drift", column, f"{name}_drift", value, threshold_pct))
        return made[0].unionByName(made[1])

    return Check("range_drift", plan)


def categories(df: DataFrame, reference: DataFrame, column: str) -> DataFrame:
    """``v, p, q, a, b``: shares and counts of each value in both tables, null among them."""
    a, b = frequencies(df, column), frequencies(reference, column)
    both = a.join(b.select(F.col("v").alias("w"), F.col("n").alias("m"), F.col("p").alias("q")), F.col("v").eqNullSafe(F.col("w")), "full")
    zero = F.lit(0.0)
    return both.select(F.coalesce("v", "w").alias("v"), F.coalesce("p", zero).alias("p"), F.coalesce("q", zero).alias("q"), F.coalesce("n", F.lit(0)).alias("a"), F.coalesce("m", F.lit(0)).alias("b"))


def quantile_bins(df: DataFrame, reference: DataFrame, column: str, n_bins: int) -> DataFrame:
    """``bin, p, q``: shares in bins between the reference's quantiles (distinct edges, the last bin closed); values beyond the edges are left out, on both sides."""
    edges = exact_quantiles(reference, {"edges": (column, [i / n_bins for i in range(n_bins + 1)])}).select(F.array_distinct("edges").alias("edges"))
    both = df.select(F.col(column).cast("double").alias("x"), F.lit(0).alias("side")).union(reference.select(F.col(column).cast("double"), F.lit(1))).where("x is not null")
    wide = both.crossJoin(F.broadcast(edges)).where((F.col("x") >= F.col("edges")[0]) & (F.col("x") <= F.element_at("edges", -1)))
    place = F.least(F.size(F.filter("edges", lambda e: e <= F.col("x"))), F.size("edges") - 1)
    counts = wide.groupBy(place.alias("bin")).agg(count_if(F.col("side") == 0).alias("a"), count_if(F.col("side") == 1).alias("b"))
    every = edges.select(F.explode(F.sequence(F.lit(1), F.greatest(F.size("edges") - 1, F.lit(1)))).alias("bin")).join(counts, "bin", "left").fillna(0, ["a", "b"])
    totals = every.agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
    return every.crossJoin(F.broadcast(totals)).select("bin", F.coalesce(F.try_divide("a", "na"), F.lit(0.0)).alias("p"), F.coalesce(F.try_divide("b", "nb"), F.lit(0.0)).alias("q"))


def _psi_terms(df: DataFrame, reference: DataFrame, column: str, n_bins: int, categorical: bool, floor: float) -> DataFrame:
    shares = categories(df, reference, column) if categorical else quantile_bins(df, reference, column, n_bins)
    p, q = F.greatest("p", F.lit(floor)), F.greatest("q", F.lit(floor))
    return shares.select(((p - q) * F.log(p / q)).alias("term"))


def psi(column: str, reference: DataFrame, threshold: float = 0.25, n_bins: int = 10, is_categorical: bool = False, min_frequency: float = 1e-4) -> Check:
    """Population stability index: sum of (p - q) ln(p / q) over the reference's quantile bins or the values, shares of ``min_frequency`` at least."""
    return Check("psi", lambda df: _grade(_psi_terms(df, reference, column, n_bins, is_categorical, min_frequency).agg(F.sum("term").alias("psi")), "psi", column, "psi_drift", F.col("psi"), threshold))


def csi(column: str, reference: DataFrame, threshold_per_bin: float = 0.05, n_bins: int = 10, is_categorical: bool = False) -> Check:
    """Bins whose own term is above the threshold."""

    def plan(df: DataFrame) -> DataFrame:
        one = _psi_terms(df, reference, column, n_bins, is_categorical, 1e-4).agg(count_if(F.col("term") > threshold_per_bin).alias("bad"), rows().alias("total"), F.max("term").alias("top"))
        return graded(one, "csi", column, "csi_drift", F.col("bad"), F.col("total"), F.col("top"))

    return Check("csi", plan)


def ecdf(df: DataFrame, reference: DataFrame, column: str) -> DataFrame:
    """``x, F, G, width``: both distribution functions at each distinct value, and the distance to the next.

    Values are counted first, by partial sums; the counts are range-partitioned and accumulated range by range, ranges shifted by the sums of those before.
    """
    both = df.select(F.col(column).cast("double").alias("x"), F.lit(1).alias("a"), F.lit(0).alias("b")).union(reference.select(F.col(column).cast("double"), F.lit(0), F.lit(1))).where("x is not null and not isnan(x)")
    counts = both.groupBy("x").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).repartitionByRange("x").withColumn("__part", F.spark_partition_id())
    sums = counts.groupBy("__part").agg(F.sum("a").alias("sa"), F.sum("b").alias("sb"), F.min("x").alias("first"))
    before, own = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("__part").orderBy("x")
    starts = sums.select("__part", F.coalesce(F.sum("sa").over(before), F.lit(0)).alias("ca"), F.coalesce(F.sum("sb").over(before), F.lit(0)).alias("cb"), F.lead("first").over(Window.orderBy("__part")).alias("next"))
    totals = sums.agg(F.sum("sa").alias("na"), F.sum("sb").alias("nb"))
    upto = own.rowsBetween(Window.unboundedPreceding, 0)
    wide = counts.withColumn("ra", F.sum("a").over(upto)).withColumn("rb", F.sum("b").over(upto)).withColumn("after", F.lead("x").over(own))
    wide = wide.join(F.broadcast(starts), "__part").crossJoin(F.broadcast(totals))
    return wide.select("x", "a", "b", "na", "nb", ((F.col("ca") + F.col("ra")) / F.col("na")).alias("F"), ((F.col("cb") + F.col("rb")) / F.col("nb")).alias("G"), (F.coalesce("after", "next") - F.col("x")).alias("width"))


def ks_statistic(df: DataFrame, reference: DataFrame, column: str) -> DataFrame:
    """One row: ``d``, ``na``, ``nb``."""
    return ecdf(df, reference, column).agg(F.max(F.abs(F.col("F") - F.col("G"))).alias("d"), F.max("na").alias("na"), F.max("nb").alias("nb"))


def _ks_p(d: Column, n: Column, m: Column) -> Column:
    """The asymptotic p-value as an expression of one row."""
    x = d * F.sqrt(n * m / (n + m))
    terms = F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), lambda acc, k: acc + F.when(k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2.0 * k * k * x * x))
    return F.when(x < 0.2, 1.0).otherwise(F.least(F.greatest(2 * terms, F.lit(0.0)), F.lit(1.0)))


def ks_test(column: str, reference: DataFrame, p_value_threshold: float = 0.05, statistic_threshold: float | None = None, name: str = "ks_test") -> Check:
    """Two-sample Kolmogorov-Smirnov over all rows; the p-value is asymptotic."""

    def plan(df: DataFrame) -> DataFrame:
        one = ks_statistic(df, reference, column)
        bad = F.col("d") > statistic_threshold if statistic_threshold is not None else _ks_p(F.col("d"), F.col("na"), F.col("nb")) < p_value_threshold
        return graded(one, name, column, "distribution_drift", F.when(bad, 1).otherwise(0), F.lit(1), F.col("d"), grade="high")

    return Check(name, plan)


def chi_square_drift(column: str, reference: DataFrame, p_value_threshold: float = 0.05, min_expected_frequency: float = 5.0) -> Check:
    """Counts against those of the reference scaled to as many rows; values expected less than ``min_expected_frequency`` times are left out and the rest scaled anew."""

    def plan(df: DataFrame) -> DataFrame:
        one = _chi_square(df, reference, column, min_expected_frequency)
        return graded(one, "chi_square_drift", column, "category_drift", F.when(F.col("p") < p_value_threshold, 1).otherwise(0), F.lit(1), F.col("value"), grade="high")

    return Check("chi_square_drift", plan)


@F.pandas_udf(T.DoubleType())
def _chi_square_p(x: pd.Series, k: pd.Series) -> pd.Series:
    return pd.Series([chi2_sf(a, b - 1) if b > 1 else 1.0 for a, b in zip(x, k, strict=True)], dtype=float)


@F.pandas_udf(T.DoubleType())
def _cvm_p(x: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
    return pd.Series([cvm_sf(*v) for v in zip(x, n, m, strict=True)], dtype=float)


@F.pandas_udf(T.DoubleType())
def _anderson_p(x: pd.Series) -> pd.Series:
    return pd.Series([anderson_sf(v) for v in x], dtype=float)


def _chi_square(df: DataFrame, reference: DataFrame, column: str, min_expected_frequency: float = 5.0) -> DataFrame:
    """One row: the statistic ``value`` and its ``p``."""
    shares = categories(df, reference, column)
    n = shares.agg(F.sum("a").alias("n"))
    kept = shares.crossJoin(F.broadcast(n)).select("a", (F.col("q") * F.col("n")).alias("e")).where(F.col("e") >= min_expected_frequency)
    totals = kept.agg(F.sum("a").alias("ta"), F.sum("e").alias("te"))
    e = F.col("e") * F.col("ta") / F.col("te")
    one = kept.crossJoin(F.broadcast(totals)).agg(F.coalesce(F.sum((F.col("a") - e) ** 2 / e), F.lit(0.0)).alias("value"), rows().alias("k"))
    return one.select("value", _chi_square_p("value", "k").alias("p"))


def wasserstein_drift(column: str, reference: DataFrame, threshold: float, normalize: bool = False) -> Check:
    """Integral of the distance between the distribution functions, over the reference's standard deviation if ``normalize``."""

    def plan(df: DataFrame) -> DataFrame:
        one = ecdf(df, reference, column).agg(F.sum(F.abs(F.col("F") - F.col("G")) * F.col("width")).alias("w")).crossJoin(reference.agg(F.stddev_pop(column).alias("s")))
        return _grade(one, "wasserstein_drift", column, "wasserstein_drift", F.try_divide("w", "s") if normalize else F.col("w"), threshold)

    return Check("wasserstein_drift", plan)


def _js(p: Column, q: Column) -> Column:
    m = (p + q) / 2
    return F.sum(F.when(p > 0, p * F.log(p / m)).otherwise(0.0) + F.when(q > 0, q * F.log(q / m)).otherwise(0.0)) / 2


def js_divergence(column: str, reference: DataFrame, threshold: float = 0.1, n_bins: int = 10, is_categorical: bool = False) -> Check:
    """Jensen-Shannon distance: the square root of the divergence, natural logarithm, over joint equal-width bins or values."""

    def plan(df: DataFrame) -> DataFrame:
        shares = categories(df, reference, column) if is_categorical else _bins(df, reference, column, n_bins)
        one = shares.agg(F.sqrt(F.greatest(_js(F.col("p"), F.col("q")), F.lit(0.0))).alias("js"))
        return _grade(one, "js_divergence", column, "js_drift", F.col("js"), threshold)

    return Check("js_divergence", plan)


def feature_drift(columns: Sequence[str], reference: DataFrame, method: str = "psi", threshold: float = 0.25, categorical_columns: Sequence[str] = ()) -> Check:
    """One method over several columns, a result row each."""

    def plan(df: DataFrame) -> DataFrame:
        made = []
        for c in columns:
            cat = c in categorical_columns
            one = {
                "psi": lambda: psi(c, reference, threshold, is_categorical=cat),  # noqa: B023
                "ks": lambda: ks_test(c, reference, statistic_threshold=threshold),  # noqa: B023
                "wasserstein": lambda: wasserstein_drift(c, reference, threshold, True),  # noqa: B023
                "chi_square": lambda: chi_square_drift(c, reference),  # noqa: B023
            }[method]()
            made.append(one.plan(df).withColumn("check_name", F.lit("feature_drift")))
        return reduce(DataFrame.unionByName, made)

    return Check("feature_drift", plan)


def _statistic(df: DataFrame, reference: DataFrame, column: str, method: str, categorical: bool, n_bins: int = 10) -> DataFrame:
    """One row with the ``value`` of a drift statistic, and ``p`` where it has one."""
    p, q = F.col("p"), F.col("q")
    none = F.lit(None).cast("double").alias("p")
    if method in ("js", "hellinger", "bhattacharyya", "tv", "kl"):
        shares = categories(df, reference, column) if categorical else _bins(df, reference, column, n_bins)
        overlap = F.sum(F.sqrt(p * q))
        value = {
            "js": F.sqrt(F.greatest(_js(p, q), F.lit(0.0))),
            "hellinger": F.sqrt(F.greatest(1 - overlap, F.lit(0.0))),
            "bhattacharyya": -F.log(F.greatest(overlap, F.lit(1e-300))),
            "tv": F.sum(F.abs(p - q)) / 2,
            "kl": F.sum(F.when(p > 0, p * F.log(p / F.greatest(q, F.lit(1e-10)))).otherwise(0.0)),
        }[method]
        return shares.agg(value.alias("value")).select("value", none)
    if method == "psi":
        return _psi_terms(df, reference, column, n_bins, categorical, 1e-4).agg(F.sum("term").alias("value")).select("value", none)
    if method == "chi2":
        return _chi_square(df, reference, column)
    curve = ecdf(df, reference, column)
    gap = F.col("F") - F.col("G")
    if method == "ks":
        return ks_statistic(df, reference, column).select(F.col("d").alias("value"), _ks_p(F.col("d"), F.col("na"), F.col("nb")).alias("p"))
    if method == "wasserstein":
        return curve.agg(F.sum(F.abs(gap) * F.col("width")).alias("w")).crossJoin(reference.agg(F.stddev_pop(column).alias("s"))).select(F.try_divide("w", "s").alias("value"), none)
    if method == "energy":
        return curve.agg(F.sqrt(2 * F.sum(gap * gap * F.col("width"))).alias("e")).crossJoin(reference.agg(F.stddev_pop(column).alias("s"))).select(F.try_divide("e", F.sqrt("s")).alias("value"), none)
    n, m, h = F.col("na"), F.col("nb"), (F.col("a") + F.col("b")) / (F.col("na") + F.col("nb"))
    if method == "cvm":
        t = F.max(n * m / (n + m)) * F.sum(gap * gap * h)
        return curve.agg(t.alias("value"), F.max("na").alias("na"), F.max("nb").alias("nb")).select("value", _cvm_p("value", "na", "nb").alias("p"))
    if method == "anderson":
        pooled = (n * F.col("F") + m * F.col("G")) / (n + m)
        t = F.max(n * m / (n + m)) * F.sum(F.when((pooled > 0) & (pooled < 1), gap * gap * h / (pooled * (1 - pooled))).otherwise(0.0))
        return curve.agg(t.alias("value")).select("value", _anderson_p("value").alias("p"))
    if method == "mmd":
        return _mmd(df, reference, column)
    raise ValueError(f"no drift method {method}")


#: Width of a cell of values, in standard deviations of the reference; moments kept of each cell; cells that a cell meets on either side (beyond, the kernel is below 1e-17).
MMD_WIDTH, MMD_MOMENTS, MMD_REACH = 0.25, 12, 36


def _mmd(df: DataFrame, reference: DataFrame, column: str) -> DataFrame:
    """Maximum mean discrepancy under a Gaussian kernel as wide as the reference's standard deviation, over all rows and all pairs (a row with itself among them).

    A fast Gauss transform: one aggregation gives each cell the moments of its values' offsets, and cells within reach meet by the Taylor series of the kernel about the distance
    of their centres. Its error is below 1e-9; the work follows the rows and the cells that have any.
    """

    def values(t: DataFrame) -> DataFrame:
        return t.select(F.col(column).cast("double").alias("x")).where("x is not null and not isnan(x)")

    one = values(reference).agg(F.avg("x").alias("mean"), F.greatest(F.stddev_pop("x"), F.lit(1e-9)).alias("s"), rows().alias("nb")).crossJoin(values(df).agg(rows().alias("na")))
    both = values(df).withColumn("side", F.lit(0)).union(values(reference).withColumn("side", F.lit(1))).crossJoin(F.broadcast(one))
    z = (F.col("x") - F.col("mean")) / F.col("s")
    share = F.when(F.col("side") == 0, F.try_divide(F.lit(1.0), F.col("na"))).otherwise(F.try_divide(F.lit(-1.0), F.col("nb")))
    dealt = both.select(z.alias("z"), F.rint(z / MMD_WIDTH).alias("cell"), share.alias("m0")).withColumn("e", F.col("z") - F.col("cell") * MMD_WIDTH)
    for k in range(1, MMD_MOMENTS):
        dealt = dealt.withColumn(f"m{k}", F.col(f"m{k - 1}") * F.col("e") / k)
    cells = dealt.groupBy("cell").agg(*[F.sum(f"m{k}").alias(f"m{k}") for k in range(MMD_MOMENTS)])
    # beyond 2^53 cells added numbers are rounded to the same cell, which is met once
    near = cells.withColumn("other", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(-MMD_REACH), F.lit(MMD_REACH)), lambda i: F.col("cell") + i))))
    far = cells.select(F.col("cell").alias("other"), *[F.col(f"m{k}").alias(f"w{k}") for k in range(MMD_MOMENTS)])
    d = (F.col("cell") - F.col("other")) * MMD_WIDTH
    total = F.lit(0.0)
    for j in range(MMD_MOMENTS):
        hermite = reduce(lambda acc, c: acc * d + float(c), reversed(herme2poly([0.0] * j + [1.0])), F.lit(0.0))
        total = total + (-1) ** j * hermite * reduce(lambda x, y: x + y, [(-1) ** (j - k) * F.col(f"m{k}") * F.col(f"w{j - k}") for k in range(j + 1)])
    return near.join(far, "other").agg(F.sum(F.exp(-d * d / 2) * total).alias("value")).select(F.greatest("value", F.lit(0.0)).alias("value"), F.lit(None).cast("double").alias("p"))


# Thresholds of the methods; those of tests are p-values, below which there is drift.
THRESHOLDS = {"ks": 0.05, "psi": 0.1, "chi2": 0.05, "js": 0.1, "kl": 0.1, "wasserstein": 0.1, "cvm": 0.05, "anderson": 0.05, "hellinger": 0.1, "bhattacharyya": 0.1, "tv": 0.1, "energy": 0.1, "mmd": 0.1}
BY_P_VALUE = ("ks", "chi2", "cvm", "anderson")


def compare(baseline: DataFrame, current: DataFrame, columns: Sequence[str] | None = None, method: str = "auto", threshold: float | None = None) -> DataFrame:
    """``column_name, method, statistic, threshold, drifted`` of each column of both tables. ``auto``: PSI of numbers, chi squared of the rest, nested values as JSON."""
    made = []
    for f in baseline.schema.fields:
        if f.name not in current.columns or columns is not None and f.name not in columns:
            continue
        numeric = isinstance(f.dataType, NUMERIC)
        own = ("psi" if numeric else "chi2") if method == "auto" else method
        if not numeric and own in ("ks", "psi", "kl", "wasserstein", "cvm", "anderson", "energy", "mmd"):
            own = "chi2"
        nested = isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType))
        tables = [t.select((F.to_json(f.name) if nested else F.col(f.name)).alias(f.name)) for t in (current, baseline)]
        limit = threshold if threshold is not None else THRESHOLDS[own]
        drifted = F.col("p") < limit if own in BY_P_VALUE else F.col("value") >= limit
        made.append(_statistic(*tables, f.name, own, not numeric).select(F.lit(f.name).alias("column_name"), F.lit(own).alias("method"), F.round("value", 4).alias("statistic"), F.lit(float(limit)).alias("threshold"), drifted.alias("drifted")))
    return reduce(DataFrame.unionByName, made)


def ks_p_value(statistic: float, n: int, m: int) -> float:
    return ks_sf(statistic, n, m) if math.isfinite(statistic) else math.nan
