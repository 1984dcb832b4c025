"""Cardinality, entropy and frequencies of a column."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.checks import Check, Measure, graded, outside, rows


def cardinality(column: str, min_cardinality: float = 0.0, max_cardinality: float = 1.0, min_unique_count: int | None = None, max_unique_count: int | None = None) -> Check:
    n = F.count_distinct(column)
    share = F.try_divide(n, F.count(column))
    made = [Measure("cardinality", column, "cardinality_ratio", outside(share, min_cardinality, max_cardinality), F.lit(1), share, grade="medium")]
    if min_unique_count is not None or max_unique_count is not None:
        made.append(Measure("cardinality", column, "unique_count", outside(n, min_unique_count, max_unique_count), F.lit(1), n, grade="medium"))
    return Check("cardinality", lambda df: made)


def uniqueness_ratio(column: str, min_uniqueness: float = 0.0, max_uniqueness: float = 1.0) -> Check:
    share = F.try_divide(F.count_distinct(column), F.count(column))
    return Check("uniqueness_ratio", lambda df: [Measure("uniqueness_ratio", column, "uniqueness_ratio", outside(share, min_uniqueness, max_uniqueness), F.lit(1), share, grade="medium")])


def value_counts(df: DataFrame, *columns: str) -> DataFrame:
    """``n`` and ``p`` of each combination of non-null values."""
    counts = df.dropna(subset=list(columns)).groupBy(*columns).agg(rows().alias("n"))
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("__total")))).withColumn("p", F.col("n") / F.col("__total")).drop("__total")


def _entropy(p: Column) -> Column:
    return F.sum(-p * F.log2(p))


def entropy(column: str, min_entropy: float = 0.0, max_entropy: float | None = None, min_normalized: float | None = None, max_normalized: float | None = None) -> Check:
    """Bits of a value's entropy; normalised, divided by those of as many equally frequent values."""

    def plan(df: DataFrame) -> DataFrame:
        one = value_counts(df, column).agg(_entropy(F.col("p")).alias("h"), rows().alias("k"))
        out = graded(one, "entropy", column, "entropy_out_of_range", outside(F.col("h"), min_entropy, max_entropy), F.lit(1), F.col("h"), grade="medium")
        share = F.when(F.col("k") > 1, F.col("h") / F.log2("k")).otherwise(0.0)
        return out.unionByName(graded(one, "entropy", column, "normalized_entropy_out_of_range", outside(share, min_normalized, max_normalized), F.lit(1), share, grade="medium"))

    return Check("entropy", plan)


def information_gain(column: str, target_column: str, min_information_gain: float = 0.0, max_information_gain: float | None = None) -> Check:
    """H(target) - H(target | feature) = H(target) + H(feature) - H(both), each from one count."""

    def plan(df: DataFrame) -> DataFrame:
        pairs = df.dropna(subset=[column, target_column]).groupBy(column, target_column).agg(rows().alias("n"))

        def h(*by: str) -> DataFrame:
            sums = pairs.groupBy(*by).agg(F.sum("n").alias("n"))
            return sums.crossJoin(F.broadcast(pairs.agg(F.sum("n").alias("t")))).agg(_entropy(F.col("n") / F.col("t")).alias("_".join(["h", *[str(len(by))], by[0]])))

        a, b, c = h(target_column), h(column), h(column, target_column)
        one = a.crossJoin(b).crossJoin(c)
        gain = F.col(a.columns[0]) + F.col(b.columns[0]) - F.col(c.columns[0])
        return graded(one, "information_gain", f"{column},{target_column}", "information_gain", outside(gain, min_information_gain, max_information_gain), F.lit(1), gain, grade="medium")

    return Check("information_gain", plan)


def value_frequency(
    column: str, min_top: float | None = None, max_top: float | None = None, min_bottom: float | None = None, max_bottom: float | None = None,
    top_n_max_ratio: float | None = None, top_n: int = 5, expected_frequencies: Mapping[object, float] | None = None, tolerance: float = 0.1,
) -> Check:
    """Shares of the commonest and rarest value, of the ``top_n`` commonest together, and expected shares that are missed by more than ``tolerance``."""

    def plan(df: DataFrame) -> DataFrame:
        counts = value_counts(df, column)
        ends = counts.agg(F.max("p").alias("top"), F.min("p").alias("bottom"))
        made = [
            graded(ends, "value_frequency", column, "top_frequency", outside(F.col("top"), min_top, max_top), F.lit(1), F.col("top"), grade="medium"),
            graded(ends, "value_frequency", column, "bottom_frequency", outside(F.col("bottom"), min_bottom, max_bottom), F.lit(1), F.col("bottom"), grade="medium"),
        ]
        if top_n_max_ratio is not None:
            head = counts.orderBy(F.desc("p"), column).limit(top_n).agg(F.sum("p").alias("s"))
            made.append(graded(head, "value_frequency", column, "top_n_concentration", outside(F.col("s"), None, top_n_max_ratio), F.lit(1), F.col("s"), grade="medium"))
        if expected_frequencies:
            wanted = df.sparkSession.createDataFrame(list(expected_frequencies.items()), f"v {df.schema[column].dataType.simpleString()}, want double")
            gap = F.abs(F.coalesce("p", F.lit(0.0)) - F.col("want"))
            one = wanted.join(counts, wanted["v"] == counts[column], "left").agg(F.count_if(gap > tolerance).alias("bad"), rows().alias("total"))
            made.append(graded(one, "value_frequency", column, "unexpected_frequency", F.col("bad"), F.col("total"), grade="medium"))
        out = made[0]
        for m in made[1:]:
            out = out.unionByName(m)
        return out

    return Check("value_frequency", plan)


def distribution_shape(column: str, expected_shape: str = "any", shape_tolerance: float = 0.2, min_gini: float | None = None, max_gini: float | None = None) -> Check:
    """Gini coefficient of the values' frequencies, from their counts of counts, so that the ranked table is small; for ``uniform``, the mean deviation from 1 / k."""

    def plan(df: DataFrame) -> DataFrame:
        counts = value_counts(df, column)
        levels = counts.groupBy("n").agg(rows().alias("m"))
        before = Window.orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
        ranked = levels.withColumn("r", F.coalesce(F.sum("m").over(before), F.lit(0)))
        weighted = F.sum(F.col("n") * (F.col("m") * F.col("r") + F.col("m") * (F.col("m") + 1) / 2))
        one = ranked.agg(weighted.alias("w"), F.sum("m").alias("k"), F.sum(F.col("n") * F.col("m")).alias("t"))
        gini = 2 * F.col("w") / (F.col("k") * F.col("t")) - (F.col("k") + 1) / F.col("k")
        out = graded(one, "distribution_shape", column, "gini_out_of_range", outside(gini, min_gini, max_gini), F.lit(1), gini, grade="medium")
        if expected_shape != "uniform":
            return out
        even = counts.crossJoin(F.broadcast(counts.agg(rows().alias("k")))).agg(F.avg(F.abs(F.col("p") - 1 / F.col("k"))).alias("d"))
        return out.unionByName(graded(even, "distribution_shape", column, "not_uniform", outside(F.col("d"), None, shape_tolerance), F.lit(1), F.col("d"), grade="medium"))

    return Check("distribution_shape", plan)


def top_values(df: DataFrame, column: str, n: int = 10, ascending: bool = False) -> DataFrame:
    """The commonest (or rarest) values with counts and shares; ties by value."""
    order: Sequence = [F.asc("n") if ascending else F.desc("n"), column]
    return value_counts(df, column).orderBy(*order).limit(n)
