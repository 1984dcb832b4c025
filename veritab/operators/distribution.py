"""Values against ranges, sets, fences and expected distributions."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.checks import RANGES, Check, Measure, count_if, fused, graded, outside, per_column, pick, rows
from .quantiles import beside_quantiles, exact_quantiles

# Words in a column's name, and the range that its values should have; the first that fits holds.
NAMED_RANGES: dict[str, tuple[float | None, float | None]] = {
    "age": (0, 150),
    "price": (0, None),
    "quantity": (0, None),
    "count": (0, None),
    "amount": (0, None),
    "percentage": (0, 100),
    "percent": (0, 100),
    "pct": (0, 100),
    "rate": (0, 100),
    "score": (0, 100),
    "rating": (0, 5),
    "year": (1900, 2100),
    "month": (1, 12),
    "day": (1, 31),
    "hour": (0, 23),
    "minute": (0, 59),
    "second": (0, 59),
}


def _bad_range(x: Column, low: float | None, high: float | None, inclusive: bool = True) -> Column:
    bad = F.lit(False)
    if low is not None:
        bad = bad | (x < low if inclusive else x <= low)
    if high is not None:
        bad = bad | (x > high if inclusive else x >= high)
    return bad


def between(columns: str | Sequence[str] | None = None, min_value: float | None = None, max_value: float | None = None, inclusive: bool = True) -> Check:
    return per_column("between", columns, "numeric", lambda c, x: Measure("between", c, "out_of_range", count_if(_bad_range(x, min_value, max_value, inclusive)), F.count(x), grade=RANGES))


def named_range(columns: str | Sequence[str] | None = None) -> Check:
    """Ranges that follow from words in the columns' names."""

    def plan(df: DataFrame) -> list[Measure]:
        found = [(c, next((r for k, r in NAMED_RANGES.items() if k in c.lower()), None)) for c in pick(df, columns, "numeric")]
        return [Measure("range", c, "out_of_range", count_if(_bad_range(F.col(c), *r)), F.count(c), grade=RANGES) for c, r in found if r]

    return Check("range", plan)


def positive(columns: str | Sequence[str] | None = None) -> Check:
    return per_column("positive", columns, "numeric", lambda c, x: Measure("positive", c, "not_positive", count_if(x <= 0), F.count(x)))


def non_negative(columns: str | Sequence[str] | None = None) -> Check:
    return per_column("non_negative", columns, "numeric", lambda c, x: Measure("non_negative", c, "negative", count_if(x < 0), F.count(x)))


def in_set(columns: str | Sequence[str], allowed_values: Sequence) -> Check:
    return per_column("in_set", columns, "any", lambda c, x: Measure("in_set", c, "not_in_set", count_if(~x.isin(list(allowed_values))), F.count(x)))


def not_in_set(columns: str | Sequence[str], forbidden_values: Sequence) -> Check:
    return per_column("not_in_set", columns, "any", lambda c, x: Measure("not_in_set", c, "forbidden_value", count_if(x.isin(list(forbidden_values))), F.count(x), grade="high"))


def _steps(name: str, column: str, order_by: Sequence[str], bad, issue: str) -> Check:
    """Rows against the row before them in a stated order. ``lag`` needs one global order; to keep it off a single task, the order is cut in ranges of the first order
    column and each range's first row meets the last value before it."""

    def plan(df: DataFrame) -> DataFrame:
        rows_ = ordered_lag(df.select(column, *[c for c in order_by if c != column]), column, order_by)
        one = rows_.agg(count_if(bad(F.col(column), F.col("before"))).alias("bad"), rows().alias("total"))
        return graded(one, name, column, issue, F.col("bad"), F.col("total"))

    return Check(name, plan)


def ordered_lag(df: DataFrame, column: str, order_by: Sequence[str], out: str = "before") -> DataFrame:
    """``df`` with the value of ``column`` on the row before, in the order of ``order_by``, computed range by range in parallel.

    Rows are range-partitioned; ``lag`` runs within a partition; a partition's first row takes the last value of the nearest partition before that has rows. What crosses
    partitions is one row for each.
    """
    ranged = df.repartitionByRange(*[F.col(c).asc_nulls_first() for c in order_by]).withColumn("__part", F.spark_partition_id())
    own = Window.partitionBy("__part").orderBy(*order_by)
    marked = ranged.withColumn("__lag", F.lag(F.struct(column)).over(own)).withColumn("__first", F.row_number().over(own) == 1)
    ends = ranged.groupBy("__part").agg(F.max_by(F.struct(column), F.struct(*order_by)).alias("__end"))
    carried = ends.withColumn("__carry", F.lag("__end").over(Window.orderBy("__part"))).select("__part", "__carry")
    joined = marked.join(F.broadcast(carried), "__part", "left")
    value = F.when(F.col("__first"), F.col("__carry")).otherwise(F.col("__lag"))
    return joined.withColumn(out, value[column]).drop("__part", "__lag", "__first", "__carry")


def increasing(column: str, order_by: Sequence[str], strict: bool = False) -> Check:
    return _steps("increasing", column, order_by, lambda x, p: x <= p if strict else x < p, "not_increasing")


def decreasing(column: str, order_by: Sequence[str], strict: bool = False) -> Check:
    return _steps("decreasing", column, order_by, lambda x, p: x >= p if strict else x > p, "not_decreasing")


def with_statistics(df: DataFrame, statistics: Mapping[str, Column]) -> DataFrame:
    """``df`` beside the one row of its statistics."""
    return df.crossJoin(F.broadcast(df.agg(*[v.alias(k) for k, v in statistics.items()])))  # one row


def outlier(columns: str | Sequence[str] | None = None, iqr_multiplier: float = 1.5) -> Check:
    """Values outside the fences q1 - m iqr and q3 + m iqr, quartiles by linear interpolation; four values at least, and an iqr above 0."""

    def plan(df: DataFrame) -> DataFrame:
        names = pick(df, columns, "numeric")
        wide = beside_quantiles(df.select(*names), {f"__q{i}": (c, [0.25, 0.75]) for i, c in enumerate(names)}, {f"__n{i}": F.count(c) for i, c in enumerate(names)})
        made = []
        for i, c in enumerate(names):
            low, high = F.col(f"__q{i}")[0], F.col(f"__q{i}")[1]
            span = high - low
            bad = (F.col(f"__n{i}") >= 4) & (span > 0) & ((F.col(c) < low - iqr_multiplier * span) | (F.col(c) > high + iqr_multiplier * span))
            made.append(Measure("outlier", c, "outlier", count_if(bad), F.count(c)))
        return fused(wide, made)

    return Check("outlier", plan)


def zscore_outlier(columns: str | Sequence[str] | None = None, threshold: float = 3.0) -> Check:
    def plan(df: DataFrame) -> DataFrame:
        names = pick(df, columns, "numeric")
        wide = with_statistics(df.select(*names), {f"__m{i}": F.avg(c) for i, c in enumerate(names)} | {f"__s{i}": F.stddev_samp(c) for i, c in enumerate(names)})
        return fused(wide, [Measure("zscore_outlier", c, "zscore_outlier", count_if(F.abs(F.col(c) - F.col(f"__m{i}")) > threshold * F.col(f"__s{i}")), F.count(c)) for i, c in enumerate(names)])

    return Check("zscore_outlier", plan)


def quantile(columns: str | Sequence[str] | None = None, q: float = 0.5, min_value: float | None = None, max_value: float | None = None) -> Check:
    return quantiles_between("quantile", "quantile_out_of_range", columns, q, min_value, max_value)


def quantiles_between(name: str, issue: str, columns: str | Sequence[str] | None, q: float, low: float | None, high: float | None) -> Check:
    """A check that a quantile of each column lies between bounds."""

    def plan(df: DataFrame) -> DataFrame:
        names = pick(df, columns, "numeric")
        one = exact_quantiles(df, {f"q{i}": (F.col(f"`{c}`"), [q]) for i, c in enumerate(names)})
        each = [graded(one, name, c, issue, outside(F.col(f"q{i}")[0], low, high), F.lit(1), F.col(f"q{i}")[0], grade="medium") for i, c in enumerate(names)]
        return reduce(DataFrame.unionByName, each)

    return Check(name, plan)


def _bins(df: DataFrame, reference: DataFrame, column: str, n_bins: int) -> DataFrame:
    """``bin, p, q``: shares of both tables' values in equal-width bins over their joint range."""
    both = df.select(F.col(column).cast("double").alias("x"), F.lit(0).alias("side")).union(reference.select(F.col(column).cast("double"), F.lit(1))).where("x is not null")
    wide = with_statistics(both, {"lo": F.min("x"), "hi": F.max("x")})
    width = (F.col("hi") - F.col("lo")) / n_bins
    place = F.when(width > 0, F.least(F.floor((F.col("x") - F.col("lo")) / width), F.lit(n_bins - 1))).otherwise(0)
    counts = wide.groupBy(place.cast("int").alias("bin")).agg(count_if(F.col("side") == 0).alias("a"), count_if(F.col("side") == 1).alias("b"))
    every = df.sparkSession.range(n_bins).select(F.col("id").cast("int").alias("bin")).join(counts, "bin", "left").fillna(0, ["a", "b"])
    totals = every.agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
    return every.crossJoin(F.broadcast(totals)).select("bin", (F.col("a") / F.col("na")).alias("p"), (F.col("b") / F.col("nb")).alias("q"))


def distribution(column: str, reference: DataFrame, threshold: float = 0.1, n_bins: int = 10) -> Check:
    """Jensen-Shannon divergence (natural logarithm) of two histograms, 1e-10 added to each share."""

    def plan(df: DataFrame) -> DataFrame:
        s = _bins(df, reference, column, n_bins).select((F.col("p") + 1e-10).alias("p"), (F.col("q") + 1e-10).alias("q"))
        m = (F.col("p") + F.col("q")) / 2
        one = s.agg(F.sum(0.5 * F.col("p") * F.log(F.col("p") / m) + 0.5 * F.col("q") * F.log(F.col("q") / m)).alias("js"))
        return graded(one, "distribution", column, "distribution_shift", outside(F.col("js"), None, threshold), F.lit(1), F.col("js"), grade="medium")

    return Check("distribution", plan)


def frequencies(df: DataFrame, column: str) -> DataFrame:
    """``v, n, p`` of each value, null among them."""
    counts = df.groupBy(F.col(column).alias("v")).agg(rows().alias("n"))
    return counts.crossJoin(F.broadcast(df.agg(rows().alias("total")))).select("v", "n", (F.col("n") / F.col("total")).alias("p"))


def kl_divergence(column: str, reference: DataFrame, max_divergence: float = 0.1) -> Check:
    """Sum of p ln(p / q) over the values of both tables, 1e-10 where one lacks a value."""

    def plan(df: DataFrame) -> DataFrame:
        a, b = frequencies(df, column).select("v", "p"), frequencies(reference, column).select(F.col("v").alias("w"), F.col("p").alias("q"))
        p, q = F.coalesce("p", F.lit(1e-10)), F.coalesce("q", F.lit(1e-10))
        one = a.join(b, F.col("v").eqNullSafe(F.col("w")), "full").agg(F.sum(p * F.log(p / q)).alias("kl"))
        out = graded(one, "kl_divergence", column, "distribution_divergence", outside(F.col("kl"), None, max_divergence), F.lit(1), F.col("kl"), grade="medium")
        return out.withColumn("severity", F.when(F.col("severity").isNotNull(), F.when(F.col("actual") > 3 * max_divergence, "critical").when(F.col("actual") > 2 * max_divergence, "high").otherwise("medium")))

    return Check("kl_divergence", plan)


def normal_quantile(p: float) -> float:
    from statistics import NormalDist

    return NormalDist().inv_cdf(p)


def chi_square_critical(df: int, alpha: float) -> float:
    """The upper quantile of chi squared by the Wilson-Hilferty cube."""
    return df * (1 - 2 / (9 * df) + normal_quantile(1 - alpha) * math.sqrt(2 / (9 * df))) ** 3


def chi_square(column: str, expected_frequencies: Mapping[object, float] | None = None, significance_level: float = 0.05) -> Check:
    """Sum of (o - e) squared / e over the values, against the critical value; without expectations, all values are expected alike."""

    def plan(df: DataFrame) -> DataFrame:
        counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(rows().alias("o"))
        if expected_frequencies:
            kind = df.schema[column].dataType.simpleString()
            total = sum(expected_frequencies.values())
            expected = df.sparkSession.createDataFrame([(k, x / total) for k, x in expected_frequencies.items()], f"v {kind}, share double")
            counts = counts.join(expected, "v", "full").fillna(0, ["o"]).fillna(1e-10, ["share"])
        totals = counts.agg(F.sum("o").alias("n"), F.count("*").alias("k"))
        share = F.col("share") if expected_frequencies else 1 / F.col("k")
        e = share * F.col("n")
        one = counts.crossJoin(F.broadcast(totals)).agg(F.sum((F.col("o") - e) ** 2 / e).alias("chi2"), F.max("k").alias("k"))
        z, d = normal_quantile(1 - significance_level), F.greatest(F.col("k") - 1, F.lit(1))
        critical = d * F.pow(1 - 2 / (9 * d) + z * F.sqrt(2 / (9 * d)), F.lit(3))
        return graded(one, "chi_square", column, "unexpected_distribution", F.when(F.col("chi2") > critical, 1).otherwise(0), F.lit(1), F.col("chi2"), grade="medium")

    return Check("chi_square", plan)


def most_common_value(column: str, expected_values: Sequence, top_n: int = 1) -> Check:
    """The most frequent values that aren't expected; ties by value."""

    def plan(df: DataFrame) -> DataFrame:
        top = df.groupBy(F.col(column).alias("v")).agg(rows().alias("n")).orderBy(F.desc("n"), "v").limit(top_n)
        one = top.agg(count_if(~F.col("v").isin(list(expected_values))).alias("bad"), rows().alias("total"))
        return graded(one, "most_common_value", column, "unexpected_common_value", F.col("bad"), F.col("total"), grade="medium")

    return Check("most_common_value", plan)
