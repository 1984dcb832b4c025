"""Distinct values, duplicates and keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.checks import DUPLICATES, TEMPORAL, NUMERIC, Check, Measure, count_if, graded, outside, per_column, pick, rows


def _n_unique(x: Column, null_as_value: bool) -> Column:
    """Distinct values; null is one of them if asked for."""
    n = F.count_distinct(x)
    return n + F.when(count_if(x.isNull()) > 0, 1).otherwise(0) if null_as_value else n


def unique(columns: str | Sequence[str] | None = None, null_as_value: bool = False) -> Check:
    """Surplus rows of repeated non-null values."""
    return per_column("unique", columns, "any", lambda c, x: Measure("unique", c, "unique_violation", F.greatest(F.count(x) - _n_unique(x, null_as_value), F.lit(0)), F.count(x)))


def unique_ratio(columns: str | Sequence[str] | None = None, min_ratio: float | None = None, max_ratio: float | None = None, null_as_value: bool = False) -> Check:
    def measure(c: str, x: Column) -> Measure:
        share = F.try_divide(_n_unique(x, null_as_value).cast("double"), F.count(x).cast("double"))
        return Measure("unique_ratio", c, "unique_ratio_out_of_range", outside(share, min_ratio, max_ratio), F.lit(1), share, grade="medium")

    return per_column("unique_ratio", columns, "any", measure)


def distinct_count(columns: str | Sequence[str] | None = None, min_count: int | None = None, max_count: int | None = None, null_as_value: bool = False) -> Check:
    def measure(c: str, x: Column) -> Measure:
        n = _n_unique(x, null_as_value)
        return Measure("distinct_count", c, "distinct_count_out_of_range", outside(n, min_count, max_count), F.lit(1), n, grade="medium")

    return per_column("distinct_count", columns, "any", measure)


def distinct_count_between(column: str, min_count: int | None = None, max_count: int | None = None) -> Check:
    """As ``distinct_count``, null counting as a value."""
    n = _n_unique(F.col(column), True)
    return Check("distinct_count_between", lambda df: [Measure("distinct_count_between", column, "distinct_count_out_of_range", outside(n, min_count, max_count), F.lit(1), n, grade="medium")])


def approximate_distinct_count(columns: str | Sequence[str] | None = None, min_count: int | None = None, max_count: int | None = None, precision: int = 12) -> Check:
    """A HyperLogLog estimate against bounds that are widened by two standard errors."""
    error = 1.04 / 2 ** (precision / 2)

    def measure(c: str, x: Column) -> Measure:
        n = F.approx_count_distinct(x, max(error, 0.01))
        return Measure("approximate_distinct_count", c, "distinct_count_out_of_range", outside(n, None if min_count is None else min_count * (1 - 2 * error), None if max_count is None else max_count * (1 + 2 * error)), F.lit(1), n, grade="medium")

    return per_column("approximate_distinct_count", columns, "any", measure)


def approximate_unique_ratio(columns: str | Sequence[str] | None = None, min_ratio: float | None = None, max_ratio: float | None = None, precision: int = 12) -> Check:
    def measure(c: str, x: Column) -> Measure:
        share = F.least(F.try_divide(F.approx_count_distinct(x, max(1.04 / 2 ** (precision / 2), 0.01)).cast("double"), F.count(x).cast("double")), F.lit(1.0))
        return Measure("approximate_unique_ratio", c, "unique_ratio_out_of_range", outside(share, min_ratio, max_ratio), F.lit(1), share, grade="medium")

    return per_column("approximate_unique_ratio", columns, "any", measure)


def streaming_distinct_count(columns: str | Sequence[str] | None = None, min_count: int | None = None, max_count: int | None = None, precision: int = 12) -> Check:
    """A mergeable sketch's estimate, as batches of a stream would be united."""

    def measure(c: str, x: Column) -> Measure:
        n = F.hll_sketch_estimate(F.hll_sketch_agg(x.cast("string"), precision))
        return Measure("streaming_distinct_count", c, "distinct_count_out_of_range", outside(n, min_count, max_count), F.lit(1), n, grade="medium")

    return per_column("streaming_distinct_count", columns, "any", measure)


def _values(df: DataFrame, column: str) -> DataFrame:
    return df.select(F.col(column).alias("v")).where("v is not null").distinct()


def _frame(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    kind = df.schema[column].dataType
    return df.sparkSession.createDataFrame([(v,) for v in values], f"v {kind.simpleString()}").distinct()


def _set_row(check: str, column: str, issue: str, bad: DataFrame, total: DataFrame) -> DataFrame:
    both = bad.agg(F.count("*").alias("bad")).crossJoin(total.agg(F.count("*").alias("total")))  # one row each
    return graded(both, check, column, issue, F.col("bad"), F.col("total"))


def distinct_values_in_set(column: str, allowed_values: Sequence) -> Check:
    """Distinct values that aren't allowed."""

    def plan(df: DataFrame) -> DataFrame:
        found = _values(df, column)
        return _set_row("distinct_values_in_set", column, "unexpected_value", found.join(_frame(df, column, allowed_values), "v", "left_anti"), found)

    return Check("distinct_values_in_set", plan)


def distinct_values_equal_set(column: str, expected_values: Sequence) -> Check:
    """Values that are expected and missing, and values that aren't expected."""

    def plan(df: DataFrame) -> DataFrame:
        found, expected = _values(df, column), _frame(df, column, expected_values)
        extra = _set_row("distinct_values_equal_set", column, "unexpected_value", found.join(expected, "v", "left_anti"), found)
        return extra.unionByName(_set_row("distinct_values_equal_set", column, "missing_value", expected.join(found, "v", "left_anti"), expected))

    return Check("distinct_values_equal_set", plan)


def distinct_values_contain_set(column: str, required_values: Sequence) -> Check:
    def plan(df: DataFrame) -> DataFrame:
        required = _frame(df, column, required_values)
        return _set_row("distinct_values_contain_set", column, "missing_value", required.join(_values(df, column), "v", "left_anti"), required)

    return Check("distinct_values_contain_set", plan)


def duplicate(subset: Sequence[str] | None = None) -> Check:
    """All rows whose key occurs more than once."""

    def plan(df: DataFrame) -> DataFrame:
        counts = df.groupBy(*(subset or df.columns)).count()
        one = counts.agg(F.sum(F.when(F.col("count") > 1, F.col("count")).otherwise(0)).alias("bad"), F.sum("count").alias("total"))
        return graded(one, "duplicate", ",".join(subset or ["*"]), "duplicate_row", F.col("bad"), F.col("total"), grade=DUPLICATES)

    return Check("duplicate", plan)


def duplicate_within_group(group_by: Sequence[str], check_column: str) -> Check:
    """Surplus rows of values that repeat within a group, by a partial count of (group, value)."""

    def plan(df: DataFrame) -> DataFrame:
        one = df.groupBy(*group_by, check_column).count().agg(F.sum(F.col("count") - 1).alias("bad"), F.sum("count").alias("total"))
        return graded(one, "duplicate_within_group", check_column, "duplicate_within_group", F.col("bad"), F.col("total"), grade=DUPLICATES)

    return Check("duplicate_within_group", plan)


def primary_key(column: str) -> Check:
    x = F.col(column)
    return Check(
        "primary_key",
        lambda df: [
            Measure("primary_key", column, "primary_key_null", count_if(x.isNull()), grade="critical"),
            Measure("primary_key", column, "primary_key_duplicate", F.count(x) - F.count_distinct(x), F.count(x), grade="critical"),
        ],
    )


def _surplus(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.groupBy(*columns).count().agg(F.sum(F.col("count") - 1).alias("bad"), F.sum("count").alias("total"))


def compound_key(columns: Sequence[str], allow_nulls: bool = False) -> Check:
    """Rows with a null part, and surplus rows of a repeated key."""
    name = ",".join(columns)

    def plan(df: DataFrame) -> DataFrame:
        out = graded(_surplus(df, columns), "compound_key", name, "compound_key_duplicate", F.col("bad"), F.col("total"), grade="critical")
        if allow_nulls:
            return out
        nulls = df.agg(count_if(F.greatest(*[F.col(c).isNull().cast("int") for c in columns]) == 1 if len(columns) > 1 else F.col(columns[0]).isNull()).alias("bad"), rows().alias("total"))
        return out.unionByName(graded(nulls, "compound_key", name, "compound_key_null", F.col("bad"), F.col("total"), grade="critical"))

    return Check("compound_key", plan)


def _repeats(columns: Sequence[str], ignore_nulls: bool) -> Column:
    values = F.array(*[F.col(c).cast("string") for c in columns])
    values = F.filter(values, lambda x: x.isNotNull()) if ignore_nulls else values
    return F.size(F.array_distinct(values)) < F.size(values)


def unique_within_record(columns: Sequence[str], ignore_nulls: bool = True) -> Check:
    """Rows in which two of the columns have the same value."""
    return Check("unique_within_record", lambda df: [Measure("unique_within_record", ",".join(columns), "repeated_within_record", count_if(_repeats(columns, ignore_nulls)))])


def all_columns_unique_within_record(ignore_nulls: bool = True, type_safe: bool = True) -> Check:
    """Rows that repeat a value within a group of columns of like type, or, not ``type_safe``, among all columns as text."""

    def plan(df: DataFrame) -> list[Measure]:
        kinds = {"numeric": NUMERIC, "temporal": TEMPORAL}
        groups: dict[str, list[str]] = {}
        for f in df.schema.fields:
            kind = next((k for k, ts in kinds.items() if isinstance(f.dataType, ts)), f.dataType.typeName())
            groups.setdefault(kind if type_safe else "all", []).append(f.name)

        def same(cs: list[str], kind: str) -> Column:
            values = F.array(*[F.col(c).cast("double") if kind == "numeric" else F.col(c).cast("string") for c in cs])
            values = F.filter(values, lambda x: x.isNotNull()) if ignore_nulls else values
            return F.size(F.array_distinct(values)) < F.size(values)

        return [Measure("all_columns_unique_within_record", k, "repeated_within_record", count_if(same(cs, k))) for k, cs in sorted(groups.items()) if len(cs) > 1]

    return Check("all_columns_unique_within_record", plan)


def column_pair_unique(column_a: str, column_b: str, ignore_nulls: bool = True) -> Check:
    """Rows whose two columns are equal."""
    a, b = F.col(column_a), F.col(column_b)
    return Check("column_pair_unique", lambda df: [Measure("column_pair_unique", f"{column_a},{column_b}", "equal_pair", count_if(a == b if ignore_nulls else a.eqNullSafe(b)))])


def count_duplicates(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``surplus`` rows (all but one of each key) and ``n_rows``."""
    return _surplus(df, columns or df.columns).select(F.coalesce("bad", F.lit(0)).alias("surplus"), F.coalesce("total", F.lit(0)).alias("n_rows"))


def duplicate_values(df: DataFrame, columns: Sequence[str], limit: int = 10) -> DataFrame:
    """The keys that occur most often, more than once; ties by key."""
    return df.groupBy(*columns).agg(rows().alias("n")).where("n > 1").orderBy(F.desc("n"), *pick(df, columns)).limit(limit)
