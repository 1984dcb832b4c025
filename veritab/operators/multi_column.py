"""Rules over several columns of a row, and statistics of pairs."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.checks import Check, Measure, count_if, outside, rows
from .schemas import OPERATORS


def _one(name: str, columns: Sequence[str], issue: str, bad: Column, total: Column | None = None) -> Check:
    return Check(name, lambda df: [Measure(name, ",".join(columns), issue, count_if(bad), total if total is not None else rows())])


def _differs(value: Column, result_column, expected_value, low, high, tolerance: float) -> Column:
    if result_column is not None:
        return F.abs(value - F.col(result_column)) > tolerance
    if expected_value is not None:
        return F.abs(value - expected_value) > tolerance
    bad = F.lit(False)
    bad = bad | (value < low - tolerance) if low is not None else bad
    return bad | (value > high + tolerance) if high is not None else bad


def _cols(columns: Sequence[str]) -> list[Column]:
    return [F.col(c) for c in columns]


def column_sum(columns: Sequence[str], result_column: str | None = None, expected_value: float | None = None, min_value: float | None = None, max_value: float | None = None, tolerance: float = 0.0) -> Check:
    """Rows whose sum isn't as expected; a null part makes the sum null, which passes."""
    return _one("column_sum", columns, "sum_mismatch", _differs(reduce(lambda a, b: a + b, _cols(columns)), result_column, expected_value, min_value, max_value, tolerance))


def column_product(columns: Sequence[str], result_column: str | None = None, expected_value: float | None = None, min_value: float | None = None, max_value: float | None = None, tolerance: float = 0.0) -> Check:
    return _one("column_product", columns, "product_mismatch", _differs(reduce(lambda a, b: a * b, _cols(columns)), result_column, expected_value, min_value, max_value, tolerance))


def column_difference(columns: Sequence[str], result_column: str | None = None, expected_value: float | None = None, min_value: float | None = None, max_value: float | None = None, tolerance: float = 0.0) -> Check:
    return _one("column_difference", columns, "difference_mismatch", _differs(reduce(lambda a, b: a - b, _cols(columns)), result_column, expected_value, min_value, max_value, tolerance))


def column_ratio(columns: Sequence[str], result_column: str | None = None, min_value: float | None = None, max_value: float | None = None, tolerance: float = 0.0, handle_zero_division: str = "skip") -> Check:
    """The first over the second; a zero divisor passes, or is bad if ``fail``."""
    bad = _differs(F.try_divide(*_cols(columns)), result_column, None, min_value, max_value, tolerance)
    return _one("column_ratio", columns, "ratio_mismatch", F.coalesce(bad, F.lit(False)) | (F.col(columns[1]) == 0) if handle_zero_division == "fail" else bad)


def column_percentage(columns: Sequence[str], result_column: str | None = None, min_value: float | None = None, max_value: float | None = None, tolerance: float = 0.0) -> Check:
    return _one("column_percentage", columns, "percentage_mismatch", _differs(F.try_divide(F.col(columns[0]) * 100, F.col(columns[1])), result_column, None, min_value, max_value, tolerance))


def column_comparison(columns: Sequence[str], operator: str) -> Check:
    return _one("column_comparison", columns, "comparison_violation", ~OPERATORS[operator](*_cols(columns)))


def column_chain_comparison(columns: Sequence[str], operators: Sequence[str]) -> Check:
    """Rows in which some neighbouring pair breaks its comparison; pairs with a null pass."""
    broken = [F.coalesce(~OPERATORS[o](F.col(a), F.col(b)), F.lit(False)) for a, b, o in zip(columns, columns[1:], operators, strict=False)]
    return _one("column_chain_comparison", columns, "chain_comparison_violation", reduce(lambda x, y: x | y, broken))


def column_max(columns: Sequence[str], result_column: str, tolerance: float = 0.0) -> Check:
    return _one("column_max", columns, "max_mismatch", F.abs(F.greatest(*_cols(columns)) - F.col(result_column)) > tolerance)


def column_min(columns: Sequence[str], result_column: str, tolerance: float = 0.0) -> Check:
    return _one("column_min", columns, "min_mismatch", F.abs(F.least(*_cols(columns)) - F.col(result_column)) > tolerance)


def column_mean(columns: Sequence[str], result_column: str, tolerance: float = 0.001) -> Check:
    total = reduce(lambda a, b: a + b, [F.coalesce(c.cast("double"), F.lit(0.0)) for c in _cols(columns)])
    n = reduce(lambda a, b: a + b, [c.isNotNull().cast("int") for c in _cols(columns)])
    return _one("column_mean", columns, "mean_mismatch", F.abs(F.try_divide(total, n) - F.col(result_column)) > tolerance)


def column_consistency(rules: Sequence[tuple[str, str]]) -> Check:
    """For each rule (when, then), both SQL conditions: rows where the first holds and the second doesn't, among those where the first holds."""
    return Check("column_consistency", lambda df: [Measure("column_consistency", f"{w} => {t}", "inconsistent", count_if(F.expr(w) & ~F.coalesce(F.expr(t), F.lit(False))), count_if(F.expr(w))) for w, t in rules])


def _filled(columns: Sequence[str]) -> Column:
    return reduce(lambda a, b: a + b, [c.isNotNull().cast("int") for c in _cols(columns)])


def column_mutual_exclusivity(columns: Sequence[str], allow_none: bool = False, allow_multiple: int = 1) -> Check:
    n = _filled(columns)
    return _one("column_mutual_exclusivity", columns, "not_exclusive", (n > allow_multiple) if allow_none else (n > allow_multiple) | (n < 1))


def column_coexistence(columns: Sequence[str]) -> Check:
    n = _filled(columns)
    return _one("column_coexistence", columns, "partial_presence", (n > 0) & (n < len(columns)))


def column_dependency(condition_column: str, condition_values: Sequence, required_columns: Sequence[str]) -> Check:
    when = F.col(condition_column).isin(list(condition_values))
    return _one("column_dependency", [condition_column, *required_columns], "missing_dependency", when & (_filled(required_columns) < len(required_columns)), count_if(when))


def column_implication(antecedent_column: str, antecedent_values: Sequence, consequent_column: str, consequent_values: Sequence) -> Check:
    when = F.col(antecedent_column).isin(list(antecedent_values))
    return _one("column_implication", [antecedent_column, consequent_column], "implication_violation", when & ~F.coalesce(F.col(consequent_column).isin(list(consequent_values)), F.lit(False)), count_if(when))


def _pair(name: str, a: str, b: str, issue: str, value: Column, low, high) -> Check:
    return Check(name, lambda df: [Measure(name, f"{a},{b}", issue, outside(value, low, high), F.lit(1), value, grade="medium")])


def column_correlation(column_a: str, column_b: str, min_correlation: float | None = None, max_correlation: float | None = None, expected_correlation: float | None = None, tolerance: float = 0.1) -> Check:
    """Pearson's correlation over the rows with both values; three at least."""
    a, b = F.col(column_a).cast("double"), F.col(column_b).cast("double")
    value = F.when(count_if(a.isNotNull() & b.isNotNull()) >= 3, F.corr(a, b))
    low, high = (expected_correlation - tolerance, expected_correlation + tolerance) if expected_correlation is not None else (min_correlation, max_correlation)
    return _pair("column_correlation", column_a, column_b, "correlation_out_of_range", value, low, high)


def column_covariance(column_a: str, column_b: str, min_value: float | None = None, max_value: float | None = None) -> Check:
    return _pair("column_covariance", column_a, column_b, "covariance_out_of_range", F.covar_samp(F.col(column_a).cast("double"), F.col(column_b).cast("double")), min_value, max_value)


def multi_column_variance(columns: Sequence[str], max_variance_ratio: float | None = None, min_variance: float | None = None, max_variance: float | None = None) -> Check:
    def plan(df: DataFrame) -> list[Measure]:
        each = {c: F.var_samp(c) for c in columns}
        made = [Measure("multi_column_variance", c, "variance_out_of_range", outside(v, min_variance, max_variance), F.lit(1), v, grade="medium") for c, v in each.items()]
        if max_variance_ratio is not None:
            ratio = F.try_divide(F.greatest(*each.values()), F.least(*each.values()))
            made.append(Measure("multi_column_variance", ",".join(columns), "variance_ratio", outside(ratio, None, max_variance_ratio), F.lit(1), ratio, grade="medium"))
        return made

    return Check("multi_column_variance", plan)
