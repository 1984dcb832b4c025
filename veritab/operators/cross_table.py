"""Statistics of one table against those of another."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.checks import Check, count_if, graded, rows

AGGREGATES = {"sum": F.sum, "mean": F.avg, "avg": F.avg, "min": F.min, "max": F.max, "count": F.count, "std": F.stddev_samp}


def _compared(name: str, column: str, issue: str, a: DataFrame, b: DataFrame, tolerance: Column) -> DataFrame:
    both = a.crossJoin(b)  # one row each
    gap = F.coalesce(F.abs(F.col("a") - F.col("b")), F.lit(float("inf")))
    return graded(both, name, column, issue, F.when(gap > tolerance, 1).otherwise(0), F.lit(1), F.col("a"), grade="high")


def cross_table_aggregate(column: str, reference: DataFrame, reference_column: str | None = None, aggregate: str = "sum", tolerance: float = 0.0, relative: bool = False) -> Check:
    f = AGGREGATES[aggregate]

    def plan(df: DataFrame) -> DataFrame:
        limit = F.abs(F.col("b")) * tolerance if relative else F.lit(tolerance)
        return _compared("cross_table_aggregate", column, "aggregate_mismatch", df.agg(f(column).alias("a")), reference.agg(f(reference_column or column).alias("b")), limit)

    return Check("cross_table_aggregate", plan)


def cross_table_distinct_count(column: str, reference: DataFrame, reference_column: str | None = None, tolerance: int = 0) -> Check:
    """Distinct values of both, null counting as one."""

    def n(c: str, name: str) -> Column:
        return (F.count_distinct(c) + F.when(count_if(F.col(c).isNull()) > 0, 1).otherwise(0)).alias(name)

    return Check("cross_table_distinct_count", lambda df: _compared("cross_table_distinct_count", column, "distinct_count_mismatch", df.agg(n(column, "a")), reference.agg(n(reference_column or column, "b")), F.lit(tolerance)))


def grouped_aggregate(source_column: str, reference: DataFrame, reference_column: str, group_by: Sequence[str], aggregate: str = "sum", tolerance: float = 0.0) -> Check:
    """Reference rows whose value differs from their group's aggregate in the source; a missing group counts as 0."""

    def plan(df: DataFrame) -> DataFrame:
        own = df.groupBy(*group_by).agg(AGGREGATES[aggregate](source_column).alias("__own"))
        joined = reference.join(own, list(group_by), "left")
        bad = F.abs(F.coalesce("__own", F.lit(0)) - F.coalesce(F.col(reference_column), F.lit(0))) > tolerance
        return graded(joined.agg(count_if(bad).alias("bad"), rows().alias("total")), "optimized_cross_table_aggregate", source_column, "aggregate_mismatch", F.col("bad"), F.col("total"))

    return Check("optimized_cross_table_aggregate", plan)


def cross_table_row_count(reference: DataFrame, tolerance: int = 0) -> Check:
    return Check("cross_table_row_count", lambda df: _compared("cross_table_row_count", "*", "row_count_mismatch", df.agg(rows().alias("a")), reference.agg(rows().alias("b")), F.lit(tolerance)))


def cross_table_row_count_factor(reference: DataFrame, factor: float, tolerance_ratio: float = 0.0) -> Check:
    def plan(df: DataFrame) -> DataFrame:
        expected = reference.agg((rows() * factor).alias("b"))
        return _compared("cross_table_row_count_factor", "*", "row_count_factor_mismatch", df.agg(rows().alias("a")), expected, F.col("b") * tolerance_ratio)

    return Check("cross_table_row_count_factor", plan)
