"""Missing values: nulls, blanks, NaN, infinities, defaults."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import functions as F

from ..plans.checks import STRICT, USUAL, Check, Measure, count_if, per_column, rows

# What programs store in place of a missing value.
DEFAULT_STRINGS = ("", "N/A", "n/a", "NA", "null", "NULL", "None", "none", "undefined", "UNDEFINED", "-", "--", "unknown", "UNKNOWN")
DEFAULT_NUMBERS = (0, -1, 999, 9999, -999, -9999)
INFINITY = float("inf")


def null(columns: str | Sequence[str] | None = None) -> Check:
    """Nulls of each column."""
    return per_column("null", columns, "any", lambda c, x: Measure("null", c, "null", count_if(x.isNull())))


def not_null(columns: str | Sequence[str] | None = None) -> Check:
    """The same count by a stricter scale."""
    return per_column("not_null", columns, "any", lambda c, x: Measure("not_null", c, "not_null_violation", count_if(x.isNull()), grade=STRICT))


def completeness_ratio(columns: str | Sequence[str] | None = None, min_ratio: float = 0.95) -> Check:
    """Nulls, if values are fewer than ``min_ratio`` of the rows."""
    return per_column("completeness_ratio", columns, "any", lambda c, x: Measure("completeness_ratio", c, "low_completeness", count_if(x.isNull()), actual=F.count(x) / rows(), limit=1 - min_ratio, grade=USUAL))


def conditional_null(column: str, condition_column: str, condition_values: Sequence) -> Check:
    """Nulls among the rows whose condition column has one of the values."""
    there = F.col(condition_column).isin(list(condition_values))
    return Check("conditional_null", lambda df: [Measure("conditional_null", column, "conditional_null", count_if(there & F.col(column).isNull()), count_if(there), grade="high")])


def default_value(columns: str | Sequence[str] | None = None, default_values: Sequence | None = None, max_ratio: float = 0.1) -> Check:
    """Values that stand for a missing one, if over ``max_ratio`` of the rows."""

    def plan(df):
        kinds = dict(df.dtypes)
        names = [columns] if isinstance(columns, str) else columns or [c for c, t in kinds.items() if t == "string" or t in ("tinyint", "smallint", "int", "bigint", "float", "double") or t.startswith("decimal")]
        given = {c: list(default_values or (DEFAULT_STRINGS if kinds[c] == "string" else DEFAULT_NUMBERS)) for c in names}
        return [Measure("default_value", c, "default_value", count_if(F.col(c).isin(given[c])), limit=max_ratio) for c in names]

    return Check("default_value", plan)


def empty_string(columns: str | Sequence[str] | None = None) -> Check:
    return per_column("empty_string", columns, "string", lambda c, x: Measure("empty_string", c, "empty_string", count_if(x == "")))


def whitespace_only(columns: str | Sequence[str] | None = None) -> Check:
    """Values with nothing but white space, the empty string included."""
    return per_column("whitespace_only", columns, "string", lambda c, x: Measure("whitespace_only", c, "whitespace_only", count_if(~x.rlike(r"(?U)\S"))))


def nan(columns: str | Sequence[str] | None = None) -> Check:
    return per_column("nan", columns, "float", lambda c, x: Measure("nan", c, "nan", count_if(F.isnan(x)), F.count(x)))


def not_nan(columns: str | Sequence[str] | None = None) -> Check:
    return per_column("not_nan", columns, "float", lambda c, x: Measure("not_nan", c, "nan_violation", count_if(F.isnan(x)), grade="high"))


def nan_ratio(columns: str | Sequence[str] | None = None, max_ratio: float = 0.0) -> Check:
    return per_column("nan_ratio", columns, "float", lambda c, x: Measure("nan_ratio", c, "high_nan_ratio", count_if(F.isnan(x)), F.count(x), limit=max_ratio))


def infinity(columns: str | Sequence[str] | None = None) -> Check:
    return per_column("infinity", columns, "float", lambda c, x: Measure("infinity", c, "infinity", count_if(F.abs(x) == INFINITY), F.count(x)))


def finite(columns: str | Sequence[str] | None = None) -> Check:
    """NaN and infinities together."""
    return per_column("finite", columns, "float", lambda c, x: Measure("finite", c, "non_finite", count_if(F.isnan(x) | (F.abs(x) == INFINITY)), grade="high"))
