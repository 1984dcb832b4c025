"""Aggregation, joins, windows and set operations as table functions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.checks import count_if, rows
from .quantiles import exact_quantiles

AGGREGATES = {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max, "count": F.count, "std": F.stddev_samp, "var": F.var_samp, "median": lambda c: F.percentile(c, F.lit(0.5)), "first": F.first, "last": F.last, "n_unique": F.count_distinct, "null_count": lambda c: count_if(F.col(c).isNull())}


def expressions(spec: Mapping[str, tuple[str, str]]) -> list[Column]:
    """Columns from ``{alias: (function, column)}``."""
    return [(rows() if f == "count" and c == "*" else AGGREGATES[f](c)).alias(alias) for alias, (f, c) in spec.items()]


def aggregate(df: DataFrame, group_by: Sequence[str], spec: Mapping[str, tuple[str, str]]) -> DataFrame:
    return df.groupBy(*group_by).agg(*expressions(spec))


def aggregate_with_join(left: DataFrame, right: DataFrame, left_on: str, right_on: str, spec: Mapping[str, tuple[str, str]], how: str = "left") -> DataFrame:
    """The left rows with the right side's aggregates by key; the right side is aggregated first, so the join has one row for each key."""
    small = right.groupBy(F.col(right_on).alias("__key")).agg(*expressions(spec))
    return left.join(small, left[left_on] == small["__key"], how).drop("__key")


def compare_aggregates(source: DataFrame, aggregated: DataFrame, key: str, source_column: str, agg_column: str, tolerance: float = 0.0) -> DataFrame:
    """Keys of ``aggregated`` whose value differs from the sum of the source; a missing sum is 0."""
    own = source.groupBy(key).agg(F.sum(source_column).alias("expected"))
    joined = aggregated.join(own, key, "left").withColumn("expected", F.coalesce("expected", F.lit(0)))
    return joined.where(F.abs(F.col(agg_column) - F.col("expected")) > tolerance).select(key, agg_column, "expected")


def incremental_aggregate(existing: DataFrame, new_data: DataFrame, group_by: Sequence[str], sum_columns: Sequence[str], count_column: str) -> DataFrame:
    """An aggregate of sums and counts brought up to date with new rows."""
    fresh = new_data.select(*group_by, *sum_columns, F.lit(1).cast("long").alias(count_column))
    old = existing.select(*group_by, *sum_columns, count_column)
    return old.unionByName(fresh).groupBy(*group_by).agg(*[F.sum(c).alias(c) for c in [*sum_columns, count_column]])


def window_aggregate(df: DataFrame, partition_by: Sequence[str], spec: Mapping[str, tuple[str, str]], order_by: Sequence[str] | None = None) -> DataFrame:
    """Each row with aggregates over its partition, running ones if an order is given."""
    w = Window.partitionBy(*partition_by)
    w = w.orderBy(*order_by).rowsBetween(Window.unboundedPreceding, 0) if order_by else w
    return df.withColumns({alias: (rows() if c == "*" else AGGREGATES[f](c)).over(w) for alias, (f, c) in spec.items()})


def semi_join_filter(main: DataFrame, filter_by: DataFrame, on: str | Sequence[str], anti: bool = False) -> DataFrame:
    return main.join(filter_by, [on] if isinstance(on, str) else list(on), "left_anti" if anti else "left_semi")


def multi_table_aggregate(tables: Mapping[str, DataFrame], joins: Sequence[tuple[str, str, str, str]], group_by: Sequence[str], spec: Mapping[str, tuple[str, str]]) -> DataFrame:
    """A chain of left joins (left table, left key, right table, right key) and an aggregation."""
    out = tables[joins[0][0]]
    for _, left_key, right, right_key in joins:
        out = out.join(tables[right], F.col(left_key) == F.col(right_key), "left")
    return aggregate(out, group_by, spec)


def group_sets(df: DataFrame, columns: Sequence[str], spec: Mapping[str, tuple[str, str]], kind: str = "rollup") -> DataFrame:
    """Rollup or cube over the columns."""
    return (df.rollup(*columns) if kind == "rollup" else df.cube(*columns)).agg(*expressions(spec))


def top_k(df: DataFrame, partition_by: Sequence[str], order_by: Sequence[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each partition."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*partition_by).orderBy(*order_by))).where(F.col("place") <= k)


def matching(df: DataFrame, condition: str) -> DataFrame:
    """``n`` rows where an SQL condition holds."""
    return df.agg(count_if(F.expr(condition)).alias("n"))


def value_page(df: DataFrame, column: str, order_by: Sequence[str], limit: int, offset: int = 0) -> DataFrame:
    return df.orderBy(*order_by).select(column).offset(offset).limit(limit)


def quantiles(df: DataFrame, column: str, qs: Sequence[float]) -> DataFrame:
    """``q, value`` by linear interpolation."""
    return exact_quantiles(df, {"v": (column, qs)}).select(F.posexplode("v").alias("i", "value")).select(F.element_at(F.array(*map(F.lit, qs)), F.col("i") + 1).alias("q"), "value")


def quality_report(df: DataFrame) -> DataFrame:
    """``completeness, uniqueness, overall``: means over the columns of value and distinct shares, and the mean of both; an empty table is complete and unique."""
    one = df.agg(rows().alias("n"), *[F.count(c).alias(f"c{i}") for i, c in enumerate(df.columns)], *[F.count_distinct(c).alias(f"d{i}") for i, c in enumerate(df.columns)])
    k = len(df.columns)
    c, d = sum((F.col(f"c{i}") for i in range(k)), F.lit(0)), sum((F.col(f"d{i}") for i in range(k)), F.lit(0))
    share = [F.coalesce(F.try_divide(x, F.col("n") * k), F.lit(1.0)) for x in (c, d)]
    return one.select(share[0].alias("completeness"), share[1].alias("uniqueness"), ((share[0] + share[1]) / 2).alias("overall"))


def partition_sizes(df: DataFrame) -> DataFrame:
    return df.groupBy(F.spark_partition_id().alias("partition")).agg(rows().alias("n"))


def partition_skew(df: DataFrame, threshold: float = 3.0) -> DataFrame:
    """``skew``: the largest over the smallest partition with rows; ``skewed`` if above the threshold."""
    one = partition_sizes(df).agg(F.try_divide(F.max("n").cast("double"), F.min("n").cast("double")).alias("skew"))
    return one.select("skew", (F.col("skew") > threshold).alias("skewed"))


def count_outside_range(df: DataFrame, column: str, low: float | None, high: float | None) -> DataFrame:
    """``n`` rows that aren't inside; nulls count as outside."""
    x, good = F.col(column), F.lit(True)
    good = good & (x >= low) if low is not None else good
    good = good & (x <= high) if high is not None else good
    return df.agg((rows() - count_if(good)).alias("n"))


def count_not_matching(df: DataFrame, column: str, pattern: str) -> DataFrame:
    """``n`` rows in which the pattern isn't found; nulls count."""
    return df.agg((rows() - count_if(F.col(column).rlike(pattern))).alias("n"))
