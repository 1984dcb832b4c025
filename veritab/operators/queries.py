"""Checks over SQL: conditions on rows, and results of queries. In a query, ``{data}`` is the checked table; other tables are passed by name."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.checks import Check, Measure, count_if, graded, outside, rows

_RELATIONS: dict[str, Callable[[Column, Column, float], Column]] = {
    "equal": lambda a, b, t: F.abs(a - b) <= t,
    "not_equal": lambda a, b, t: F.abs(a - b) > t,
    "greater": lambda a, b, t: a > b,
    "less": lambda a, b, t: a < b,
    "greater_equal": lambda a, b, t: a >= b,
    "less_equal": lambda a, b, t: a <= b,
}


def sql(df: DataFrame, query: str, **tables: DataFrame) -> DataFrame:
    """The query's result. Names don't leak: tables are bound for this query alone."""
    return df.sparkSession.sql(query, data=df, **tables)


def _scalar(df: DataFrame, query: str, column: str | None, tables: dict) -> DataFrame:
    """One row with the first row's value ``v``; null if there is no row."""
    out = sql(df, query, **tables)
    return out.limit(1).agg(F.first(F.col(column or out.columns[0])).cast("double").alias("v"))


def _bad(value: Column, expected: float | None, low: float | None, high: float | None, tolerance: float | None) -> Column:
    off = F.coalesce(F.abs(value - expected) > (tolerance or 0.0), F.lit(True)) if expected is not None else F.lit(False)
    return F.when(off | (outside(value, low, high) == 1), 1).otherwise(0)


def query_aggregate(query: str, column: str, expected_value: float | None = None, min_value: float | None = None, max_value: float | None = None, tolerance: float | None = None, **tables: DataFrame) -> Check:
    def plan(df: DataFrame) -> DataFrame:
        return graded(_scalar(df, query, column, tables), "query_aggregate", column, "query_aggregate", _bad(F.col("v"), expected_value, min_value, max_value, tolerance), F.lit(1), F.col("v"), grade="high")

    return Check("query_aggregate", plan)


def query_group_aggregate(query: str, group_column: str, aggregate_column: str, min_value: float | None = None, max_value: float | None = None, expected_groups: Sequence | None = None, **tables: DataFrame) -> Check:
    """Groups whose value is out of bounds, and expected groups that are missing."""

    def plan(df: DataFrame) -> DataFrame:
        out = sql(df, query, **tables)
        one = out.agg(F.sum(outside(F.col(aggregate_column), min_value, max_value)).alias("bad"), rows().alias("total"))
        made = graded(one, "query_group_aggregate", aggregate_column, "group_out_of_range", F.col("bad"), F.col("total"))
        if expected_groups is None:
            return made
        kind = out.schema[group_column].dataType.simpleString()
        wanted = df.sparkSession.createDataFrame([(g,) for g in expected_groups], f"g {kind}")
        missing = wanted.join(out.select(F.col(group_column).alias("g")).distinct(), "g", "left_anti").agg(rows().alias("bad"))
        return made.unionByName(graded(missing, "query_group_aggregate", group_column, "missing_group", F.col("bad"), F.lit(len(expected_groups))))

    return Check("query_group_aggregate", plan)


def query_aggregate_compare(query: str, compare_query: str, column: str, relationship: str = "equal", tolerance: float = 0.0, **tables: DataFrame) -> Check:
    def plan(df: DataFrame) -> DataFrame:
        both = _scalar(df, query, column, tables).withColumnRenamed("v", "a").crossJoin(_scalar(df, compare_query, column, tables).withColumnRenamed("v", "b"))
        ok = F.coalesce(_RELATIONS[relationship](F.col("a"), F.col("b"), tolerance), F.lit(False))
        return graded(both, "query_aggregate_compare", column, "aggregate_comparison", F.when(ok, 0).otherwise(1), F.lit(1), F.col("a"), grade="high")

    return Check("query_aggregate_compare", plan)


def query_column_values(query: str, column: str, expected_values: Sequence | None = None, forbidden_values: Sequence | None = None, allow_subset: bool = True, **tables: DataFrame) -> Check:
    """Distinct values of the result that aren't expected or are forbidden, and, not ``allow_subset``, expected ones that are missing."""

    def plan(df: DataFrame) -> DataFrame:
        values = sql(df, query, **tables).select(F.col(column).alias("v")).where("v is not null").distinct()
        bad = F.lit(False)
        bad = bad | ~F.col("v").isin(list(expected_values)) if expected_values is not None else bad
        bad = bad | F.col("v").isin(list(forbidden_values)) if forbidden_values is not None else bad
        made = graded(values.agg(count_if(bad).alias("bad"), rows().alias("total")), "query_column_values", column, "unexpected_value", F.col("bad"), F.col("total"))
        if allow_subset or expected_values is None:
            return made
        hit = values.agg(count_if(F.col("v").isin(list(expected_values))).alias("hit"))
        return made.unionByName(graded(hit, "query_column_values", column, "missing_value", F.lit(len(set(expected_values))) - F.col("hit"), F.lit(len(set(expected_values)))))

    return Check("query_column_values", plan)


def query_column_unique(query: str, column: str, **tables: DataFrame) -> Check:
    def plan(df: DataFrame) -> DataFrame:
        one = sql(df, query, **tables).groupBy(column).count().agg(F.sum(F.col("count") - 1).alias("bad"), F.sum("count").alias("total"))
        return graded(one, "query_column_unique", column, "duplicate_value", F.col("bad"), F.col("total"))

    return Check("query_column_unique", plan)


def query_column_not_null(query: str, column: str, **tables: DataFrame) -> Check:
    def plan(df: DataFrame) -> DataFrame:
        one = sql(df, query, **tables).agg(count_if(F.col(column).isNull()).alias("bad"), rows().alias("total"))
        return graded(one, "query_column_not_null", column, "null", F.col("bad"), F.col("total"))

    return Check("query_column_not_null", plan)


def custom_expression(filter_expr: str) -> Check:
    """Rows where the SQL condition is false; null passes."""
    return Check("custom_expression", lambda df: [Measure("custom_expression", "*", "expression_failed", count_if(~F.expr(filter_expr)))])


def conditional_expression(condition: str, then_expr: str) -> Check:
    return Check("conditional_expression", lambda df: [Measure("conditional_expression", "*", "conditional_failed", count_if(F.expr(condition) & ~F.expr(then_expr)), count_if(F.expr(condition)))])


def multi_condition(conditions: Sequence[str], logic: str = "and") -> Check:
    def plan(df: DataFrame) -> list[Measure]:
        whole = reduce(lambda a, b: a & b if logic == "and" else a | b, map(F.expr, conditions))
        return [Measure("multi_condition", "*", "conditions_failed", count_if(~whole))]

    return Check("multi_condition", plan)


def row_level(row_validator: Callable[[dict], bool], columns: Sequence[str] | None = None) -> Check:
    """Rows that a Python predicate rejects or fails on, by an Arrow-batched function over the columns that it needs."""

    @F.pandas_udf("boolean")
    def accepted(rows_: pd.DataFrame) -> pd.Series:
        def one(row: dict) -> bool:
            try:
                return bool(row_validator(row))
            except Exception:  # noqa: BLE001 - a row that the predicate can't take is a bad row
                return False

        return pd.Series([one(r) for r in rows_.to_dict("records")], dtype=bool)

    def plan(df: DataFrame) -> DataFrame:
        one = df.select(accepted(F.struct(*(columns or df.columns))).alias("ok")).agg(count_if(~F.col("ok")).alias("bad"), rows().alias("total"))
        return graded(one, "row_level", ",".join(columns or ["*"]), "row_rejected", F.col("bad"), F.col("total"))

    return Check("row_level", plan)


def query_returns_single_value(query: str, expected_value: float, tolerance: float | None = None, value_column: str | None = None, **tables: DataFrame) -> Check:
    def plan(df: DataFrame) -> DataFrame:
        return graded(_scalar(df, query, value_column, tables), "query_returns_single_value", value_column or "*", "unexpected_value", _bad(F.col("v"), expected_value, None, None, tolerance), F.lit(1), F.col("v"), grade="high")

    return Check("query_returns_single_value", plan)


def query_returns_no_rows(query: str, **tables: DataFrame) -> Check:
    def plan(df: DataFrame) -> DataFrame:
        both = sql(df, query, **tables).agg(rows().alias("bad")).crossJoin(df.agg(rows().alias("total")))
        return graded(both, "query_returns_no_rows", "*", "unexpected_rows", F.col("bad"), F.col("total"))

    return Check("query_returns_no_rows", plan)


def query_row_count(query: str, expected_count: int | None = None, min_count: int | None = None, max_count: int | None = None, name: str = "query_row_count", **tables: DataFrame) -> Check:
    low, high = (expected_count, expected_count) if expected_count is not None else (min_count, max_count)

    def plan(df: DataFrame) -> DataFrame:
        one = sql(df, query, **tables).agg(rows().alias("n"))
        return graded(one, name, "*", "query_row_count", outside(F.col("n"), low, high), F.lit(1), F.col("n"), grade="high")

    return Check(name, plan)


def query_returns_rows(query: str, min_rows: int = 1, max_rows: int | None = None, **tables: DataFrame) -> Check:
    return query_row_count(query, None, min_rows, max_rows, "query_returns_rows", **tables)


def query_result_matches(query: str, expected: DataFrame, **tables: DataFrame) -> Check:
    """Rows of the result that aren't expected, and expected rows that are missing, repeated rows counted."""

    def plan(df: DataFrame) -> DataFrame:
        out = sql(df, query, **tables)
        both = out.exceptAll(expected).agg(rows().alias("extra")).crossJoin(expected.exceptAll(out).agg(rows().alias("missing"))).crossJoin(expected.agg(rows().alias("total")))
        return graded(both, "query_result_matches", "*", "result_mismatch", F.col("extra") + F.col("missing"), F.col("total"), grade="high")

    return Check("query_result_matches", plan)


def query_row_count_ratio(query: str, min_ratio: float | None = None, max_ratio: float | None = None, **tables: DataFrame) -> Check:
    def plan(df: DataFrame) -> DataFrame:
        both = sql(df, query, **tables).agg(rows().alias("n")).crossJoin(df.agg(rows().alias("total")))
        share = F.try_divide(F.col("n"), F.col("total"))
        return graded(both, "query_row_count_ratio", "*", "row_count_ratio", outside(share, min_ratio, max_ratio), F.lit(1), share, grade="medium")

    return Check("query_row_count_ratio", plan)


def query_row_count_compare(query: str, compare_query: str, relationship: str = "equal", tolerance: int = 0, **tables: DataFrame) -> Check:
    def plan(df: DataFrame) -> DataFrame:
        both = sql(df, query, **tables).agg(rows().alias("a")).crossJoin(sql(df, compare_query, **tables).agg(rows().alias("b")))
        return graded(both, "query_row_count_compare", "*", "row_count_comparison", F.when(_RELATIONS[relationship](F.col("a"), F.col("b"), tolerance), 0).otherwise(1), F.lit(1), F.col("a"), grade="high")

    return Check("query_row_count_compare", plan)
