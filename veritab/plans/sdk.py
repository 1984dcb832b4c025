"""Ways to write checks of one's own, and a registry of all by name."""

from __future__ import annotations

import inspect
from collections.abc import Callable, Sequence
from importlib import import_module

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.schemas import OPERATORS
from .checks import USUAL, Check, Measure, count_if, per_column, rows, run

MODULES = ("completeness", "uniqueness", "aggregate", "distribution", "strings", "dates", "schemas", "multi_column", "cross_table", "queries", "referential", "anomaly", "drift", "profiling", "timeseries", "geospatial", "business", "ml_feature", "privacy")


def simple_column(name: str, predicate: Callable[[Column], Column], columns: str | Sequence[str] | None = None, kind: str = "any") -> Check:
    """Non-null values that the predicate rejects."""
    return per_column(name, columns, kind, lambda c, x: Measure(name, c, f"{name}_failed", count_if(~predicate(x)), F.count(x)))


def simple_pattern(name: str, pattern: str, columns: str | Sequence[str] | None = None) -> Check:
    return simple_column(name, lambda x: x.rlike(pattern), columns, "string")


def simple_range(name: str, low: float | None = None, high: float | None = None, columns: str | Sequence[str] | None = None) -> Check:
    return simple_column(name, lambda x: (x >= low if low is not None else F.lit(True)) & (x <= high if high is not None else F.lit(True)), columns, "numeric")


def simple_comparison(name: str, column: str, operator: str, other: object) -> Check:
    """A column against a value, or against another column given as ``F.col``."""
    return simple_column(name, lambda x: OPERATORS[operator](x, other if isinstance(other, Column) else F.lit(other)), column)


def composite(name: str, checks: Sequence[Check]) -> Check:
    """All results of several checks under one name."""
    return Check(name, lambda df: run(df, checks).withColumn("check_name", F.lit(name)))


class CheckBuilder:
    """``CheckBuilder("x").column("a").violates(lambda c: c < 0).mostly(0.99).severity("high").build()``, or ``.aggregate(...)`` for a statistic with bounds."""

    def __init__(self, name: str):
        self.name, self._columns, self._bad, self._aggregate = name, None, None, None
        self._limit, self._grade = 0.0, USUAL

    def column(self, *names: str) -> CheckBuilder:
        self._columns = names
        return self

    def violates(self, predicate: Callable[[Column], Column]) -> CheckBuilder:
        self._bad = predicate
        return self

    def aggregate(self, statistic: Callable[[Column], Column], fails: Callable[[Column], Column]) -> CheckBuilder:
        self._aggregate = (statistic, fails)
        return self

    def mostly(self, share: float) -> CheckBuilder:
        self._limit = 1 - share
        return self

    def severity(self, level: str) -> CheckBuilder:
        self._grade = level
        return self

    def build(self) -> Check:
        def measure(c: str, x: Column) -> Measure:
            if self._aggregate:
                value = self._aggregate[0](x)
                return Measure(self.name, c, f"{self.name}_failed", F.when(self._aggregate[1](value), 1).otherwise(0), F.lit(1), value, grade=self._grade)
            return Measure(self.name, c, f"{self.name}_failed", count_if(self._bad(x)), rows(), limit=self._limit, grade=self._grade)

        if not (self._bad or self._aggregate):
            raise ValueError("nothing to check")
        return per_column(self.name, self._columns, "any", measure)


_EXTRA: dict[str, Callable[..., Check]] = {}


def register(name: str) -> Callable:
    """A decorator that adds a function returning a `Check` to the registry."""

    def add(f: Callable[..., Check]) -> Callable[..., Check]:
        _EXTRA[name] = f
        return f

    return add


def registry() -> dict[str, Callable]:
    """All functions of the operator modules and all registered ones, by name."""
    out = {}
    for module in MODULES:
        loaded = import_module(f"veritab.operators.{module}")
        out |= {n: f for n, f in vars(loaded).items() if inspect.isfunction(f) and f.__module__ == loaded.__name__ and not n.startswith("_")}
    return out | _EXTRA


class Hooks:
    """Functions to call before and after a run."""

    def __init__(self) -> None:
        self.before: list[Callable] = []
        self.after: list[Callable] = []

    def run(self, df, checks):
        for f in self.before:
            f(df, checks)
        out = run(df, checks)
        for f in self.after:
            f(out)
        return out
