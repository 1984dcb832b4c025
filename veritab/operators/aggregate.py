"""Statistics of a column between bounds."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.checks import Check, Measure, count_if, outside, per_column
from .distribution import quantiles_between


def _between(name: str, columns, low, high, statistic: Callable[[Column], Column]) -> Check:
    def measure(c: str, x: Column) -> Measure:
        value = statistic(x)
        return Measure(name, c, name.replace("_between", "_out_of_range"), outside(value, low, high), F.lit(1), value, grade="medium")

    return per_column(name, columns, "numeric", measure)


def mean_between(columns: str | Sequence[str] | None = None, min_value: float | None = None, max_value: float | None = None) -> Check:
    return _between("mean_between", columns, min_value, max_value, F.avg)


def median_between(columns: str | Sequence[str] | None = None, min_value: float | None = None, max_value: float | None = None) -> Check:
    return quantiles_between("median_between", "median_out_of_range", columns, 0.5, min_value, max_value)


def min_between(columns: str | Sequence[str] | None = None, min_value: float | None = None, max_value: float | None = None) -> Check:
    return _between("min_between", columns, min_value, max_value, F.min)


def max_between(columns: str | Sequence[str] | None = None, min_value: float | None = None, max_value: float | None = None) -> Check:
    return _between("max_between", columns, min_value, max_value, F.max)


def std_between(columns: str | Sequence[str] | None = None, min_value: float | None = None, max_value: float | None = None) -> Check:
    return _between("std_between", columns, min_value, max_value, F.stddev_samp)


def variance_between(columns: str | Sequence[str] | None = None, min_value: float | None = None, max_value: float | None = None) -> Check:
    return _between("variance_between", columns, min_value, max_value, F.var_samp)


def sum_between(columns: str | Sequence[str] | None = None, min_value: float | None = None, max_value: float | None = None) -> Check:
    return _between("sum_between", columns, min_value, max_value, F.sum)


def mixed_type(columns: str | Sequence[str] | None = None) -> Check:
    """Text columns in which between a tenth and nine tenths of the values are numbers: the fewer kind is bad."""

    def measure(c: str, x: Column) -> Measure:
        numbers, others = count_if(x.rlike(r"^-?\d+\.?\d*\z")), count_if(~x.rlike(r"^-?\d+\.?\d*\z"))
        share = numbers / F.count(x)
        return Measure("type", c, "mixed_type", F.when((share > 0.1) & (share < 0.9), F.least(numbers, others)).otherwise(0), F.count(x))

    return per_column("type", columns, "string", measure)
