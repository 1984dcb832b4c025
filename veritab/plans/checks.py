"""Checks, the measures that they ask for, and the plan that answers all measures of a suite by one aggregation."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Shares above which an issue is critical, high or medium; below, it is low.
USUAL = (0.5, 0.2, 0.05)
STRICT = (0.01, 0.001, 0.0001)
RANGES = (0.1, 0.05, 0.01)
DUPLICATES = (0.3, 0.1, 0.01)
LEVELS = ("low", "medium", "high", "critical")

RESULT = "check_name string, column_name string, issue string, n_bad long, n_rows long, actual double, severity string"


@dataclass(frozen=True)
class Measure:
    """One result row: ``bad`` of ``total`` rows (aggregates), and a value of interest. It is an issue if ``bad`` is over ``limit`` times ``total``.

    ``grade``: a severity, or the shares from which severities follow; ``at_least`` tells whether a share equal to one of them already reaches its severity.
    """

    check: str
    column: str
    issue: str
    bad: Column
    total: Column = field(default_factory=lambda: F.count(F.lit(1)))
    actual: Column | None = None
    limit: float = 0.0
    grade: tuple[float, float, float] | str = USUAL
    at_least: bool = False


@dataclass(frozen=True)
class Check:
    """``plan`` gives measures of the table, to be answered with those of other checks by one scan, or a DataFrame of result rows of its own."""

    name: str
    plan: Callable[[DataFrame], list[Measure] | DataFrame]

    def with_mostly(self, mostly: float) -> Check:
        """Tolerates a share of ``1 - mostly`` of bad rows."""

        def plan(df: DataFrame) -> list[Measure] | DataFrame:
            made = self.plan(df)
            return [replace(m, limit=1 - mostly) for m in made] if isinstance(made, list) else made.withColumn("severity", F.when(F.col("n_bad") > (1 - mostly) * F.col("n_rows"), F.col("severity")))

        return replace(self, plan=plan)

    def with_severity(self, level: str) -> Check:
        """Issues of this check all have the given severity."""

        def plan(df: DataFrame) -> list[Measure] | DataFrame:
            made = self.plan(df)
            return [replace(m, grade=level) for m in made] if isinstance(made, list) else made.withColumn("severity", F.when(F.col("severity").isNotNull(), F.lit(level)))

        return replace(self, plan=plan)


def count_if(condition: Column) -> Column:
    """Rows where the condition is true; null counts as not true."""
    return F.count_if(condition)


def rows() -> Column:
    return F.count(F.lit(1))


def severity(bad: Column, total: Column, limit: float, grade: tuple[float, float, float] | str, at_least: bool = False) -> Column:
    if isinstance(grade, str):
        level = F.lit(grade)
    else:
        share = F.coalesce(F.try_divide(bad.cast("double"), total.cast("double")), F.lit(1.0))
        over = [share >= g if at_least else share > g for g in grade]
        level = F.when(over[0], "critical").when(over[1], "high").when(over[2], "medium").otherwise("low")
    return F.when((bad > 0) & (bad > limit * total), level)


def graded(df: DataFrame, check: str, column: str | Column, issue: str | Column, bad: Column, total: Column, actual: Column | None = None, limit: float = 0.0, grade: tuple | str = USUAL, at_least: bool = False) -> DataFrame:
    """Result rows from the rows of ``df``."""
    n_bad, n_rows = F.coalesce(bad.cast("long"), F.lit(0)), F.coalesce(total.cast("long"), F.lit(0))
    return df.select(
        F.lit(check).alias("check_name"),
        (F.lit(column) if isinstance(column, str) else column).alias("column_name"),
        (F.lit(issue) if isinstance(issue, str) else issue).alias("issue"),
        n_bad.alias("n_bad"),
        n_rows.alias("n_rows"),
        (F.lit(None) if actual is None else F.round(actual.cast("double"), 4)).cast("double").alias("actual"),
        severity(n_bad, n_rows, limit, grade, at_least).alias("severity"),
    )


def fused(df: DataFrame, measures: Sequence[Measure]) -> DataFrame:
    """All measures by one aggregation over one scan: a row each."""
    values = [x for i, m in enumerate(measures) for x in (m.bad.cast("long").alias(f"b{i}"), m.total.cast("long").alias(f"t{i}"), (F.lit(None) if m.actual is None else m.actual).cast("double").alias(f"a{i}"))]
    one = df.agg(*values)
    made = []
    for i, m in enumerate(measures):
        bad, total = F.coalesce(F.col(f"b{i}"), F.lit(0).cast("long")), F.coalesce(F.col(f"t{i}"), F.lit(0).cast("long"))
        made.append(
            F.struct(
                F.lit(m.check).alias("check_name"), F.lit(m.column).alias("column_name"), F.lit(m.issue).alias("issue"), bad.alias("n_bad"), total.alias("n_rows"),
                F.round(F.col(f"a{i}"), 4).alias("actual"), severity(bad, total, m.limit, m.grade, m.at_least).alias("severity"),
            )
        )
    return one.select(F.inline(F.array(*made)))


def run(df: DataFrame, checks: Iterable[Check]) -> DataFrame:
    """A result row for each measure of all checks. Those that are measures share one scan."""
    made = [c.plan(df) for c in checks]
    shared = [m for x in made if isinstance(x, list) for m in x]
    tables = [x for x in made if not isinstance(x, list)]
    if shared:
        tables = [fused(df, shared), *tables]
    if not tables:
        return df.sparkSession.createDataFrame([], RESULT)
    return reduce(DataFrame.unionByName, tables)


def issues(df: DataFrame, checks: Iterable[Check], least: str = "low") -> DataFrame:
    """The results that are issues, of severity ``least`` at least."""
    return run(df, checks).where(F.col("severity").isin(*LEVELS[LEVELS.index(least) :]))


def literal_rows(df: DataFrame, check: str, found: Sequence[tuple[str, str]], grade: str = "critical", passed: tuple[str, str] = ("*", "ok")) -> DataFrame:
    """Result rows of a check that looks at the schema alone: one for each (column, issue), or a passing one."""
    session = df.sparkSession
    data = [(check, c, i, 1, 1, None, grade) for c, i in found] or [(check, *passed, 0, 1, None, None)]
    return session.createDataFrame(data, RESULT)


NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
FLOATS = (T.FloatType, T.DoubleType)
TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType)


def pick(df: DataFrame, columns: str | Sequence[str] | None, kind: str = "any") -> list[str]:
    """The given columns, or all of a kind: any, numeric, float, string or temporal."""
    if columns is not None:
        return [columns] if isinstance(columns, str) else list(columns)
    kinds = {"numeric": NUMERIC, "float": FLOATS, "string": (T.StringType,), "temporal": TEMPORAL}.get(kind, T.DataType)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kinds)]


def per_column(name: str, columns: str | Sequence[str] | None, kind: str, measure: Callable[[str, Column], Measure | list[Measure]]) -> Check:
    """A check that measures each column by itself."""

    def plan(df: DataFrame) -> list[Measure]:
        made = [measure(c, F.col(f"`{c}`")) for c in pick(df, columns, kind)]
        return [m for x in made for m in (x if isinstance(x, list) else [x])]

    return Check(name, plan)


def outside(value: Column, low: float | None, high: float | None) -> Column:
    """1 if a single value lies outside the bounds, else 0; null is inside."""
    low_bad = (value < low) if low is not None else F.lit(False)
    high_bad = (value > high) if high is not None else F.lit(False)
    return F.when(low_bad | high_bad, 1).otherwise(0)
