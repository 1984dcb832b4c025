"""Features for models: correlation, leakage, nulls and scale."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.checks import Check, Measure, count_if, graded, outside, pick
from .anomaly import moments
from .profiling import value_counts
from .timeseries import numbered


def feature_correlation_matrix(columns: Sequence[str] | None = None, max_correlation: float = 0.9, max_vif: float | None = None, min_samples: int = 30) -> Check:
    """Pearson's correlation of each pair, all by one aggregation; ``max_vif`` adds each column's variance inflation, from the inverse of the matrix on the driver."""

    def plan(df: DataFrame) -> list[Measure] | DataFrame:
        names = pick(df, columns, "numeric")
        made = []
        for a, b in combinations(names, 2):
            x, y = F.col(a).cast("double"), F.col(b).cast("double")
            value = F.when(count_if(x.isNotNull() & y.isNotNull()) >= min_samples, F.corr(x, y))
            made.append(Measure("feature_correlation_matrix", f"{a},{b}", "high_correlation", outside(F.abs(value), None, max_correlation), F.lit(1), value, grade="medium"))
        if max_vif is None:
            return made
        _, _, covariance = moments(df, names)
        s = np.sqrt(np.diag(covariance))
        s[s == 0] = 1.0
        vif = np.diag(np.linalg.pinv(covariance / np.outer(s, s)))
        return made + [Measure("feature_correlation_matrix", c, "variance_inflation", F.max(F.lit(int(v > max_vif))), F.lit(1), F.max(F.lit(float(v))), grade="medium") for c, v in zip(names, vif, strict=True)]

    return Check("feature_correlation_matrix", plan)


def mutual_information(df: DataFrame, a: str, b: str, bins: int = 10) -> DataFrame:
    """One row ``mi``, in nats, of two numeric columns cut in ``bins`` equal widths."""
    clean = df.select(F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b")).dropna()
    wide = clean.crossJoin(F.broadcast(clean.agg(F.min("a").alias("a0"), F.max("a").alias("a1"), F.min("b").alias("b0"), F.max("b").alias("b1"))))

    def cut(x: str) -> Column:
        width = (F.col(f"{x}1") - F.col(f"{x}0")) / bins
        return F.when(width > 0, F.least(F.floor((F.col(x) - F.col(f"{x}0")) / width), F.lit(bins - 1))).otherwise(0)

    joint = value_counts(wide.select(cut("a").alias("x"), cut("b").alias("y")), "x", "y").select("x", "y", "p")
    px, py = joint.groupBy("x").agg(F.sum("p").alias("px")), joint.groupBy("y").agg(F.sum("p").alias("py"))
    return joint.join(F.broadcast(px), "x").join(F.broadcast(py), "y").agg(F.sum(F.col("p") * F.log(F.col("p") / (F.col("px") * F.col("py")))).alias("mi"))


def target_leakage(target_column: str, columns: Sequence[str] | None = None, max_correlation: float = 0.95, max_mutual_information: float | None = None) -> Check:
    """Features whose correlation with the target (or mutual information with it) is suspiciously high."""

    def plan(df: DataFrame) -> list[Measure] | DataFrame:
        names = [c for c in pick(df, columns, "numeric") if c != target_column]
        made = []
        for c in names:
            value = F.corr(F.col(c).cast("double"), F.col(target_column).cast("double"))
            made.append(Measure("target_leakage", c, "target_correlation", outside(F.abs(value), None, max_correlation), F.lit(1), value, grade="critical"))
        if max_mutual_information is None:
            return made
        from ..plans.checks import fused

        tables = [fused(df, made)] + [graded(mutual_information(df, c, target_column), "target_leakage", c, "target_mutual_information", outside(F.col("mi"), None, max_mutual_information), F.lit(1), F.col("mi"), grade="high") for c in names]
        return reduce(DataFrame.unionByName, tables)

    return Check("target_leakage", plan)


def temporal_leakage(target_column: str, feature_column: str, timestamp_column: str, max_correlation: float = 0.95) -> Check:
    """Correlation of a feature with the target of the next row in time."""

    def plan(df: DataFrame) -> DataFrame:
        placed = numbered(df.select(timestamp_column, feature_column, target_column).dropna(), [timestamp_column, feature_column, target_column])
        later = placed.select((F.col("i") - 1).alias("i"), F.col(target_column).cast("double").alias("next"))
        one = placed.join(later, "i").agg(F.corr(F.col(feature_column).cast("double"), F.col("next")).alias("c"))
        return graded(one, "target_leakage", feature_column, "temporal_leakage", outside(F.abs("c"), None, max_correlation), F.lit(1), F.col("c"), grade="critical")

    return Check("target_leakage", plan)


def feature_null_impact(columns: Sequence[str] | None = None, max_null_ratio: float = 0.5, null_correlation_threshold: float = 0.7) -> Check:
    """Nulls of each feature, and pairs of features that tend to be null together."""

    def plan(df: DataFrame) -> list[Measure]:
        names = pick(df, columns)
        made = [Measure("feature_null_impact", c, "high_null_ratio", count_if(F.col(c).isNull()), limit=max_null_ratio) for c in names]
        for a, b in combinations(names, 2):
            value = F.corr(F.col(a).isNull().cast("double"), F.col(b).isNull().cast("double"))
            made.append(Measure("feature_null_impact", f"{a},{b}", "null_correlation", outside(F.abs(F.when(F.isnan(value), None).otherwise(value)), None, null_correlation_threshold), F.lit(1), F.when(F.isnan(value), None).otherwise(value), grade="medium"))
        return made

    return Check("feature_null_impact", plan)


def feature_scale(columns: Sequence[str] | None = None, max_scale_ratio: float = 100.0, max_magnitude: float = 1e6, check_standard_scale: bool = False, mean_tolerance: float = 0.5, std_tolerance: float = 0.5) -> Check:
    """Ranges that differ too much between features, values that are too large, and means and deviations (population) that aren't 0 and 1."""

    def plan(df: DataFrame) -> list[Measure]:
        names = pick(df, columns, "numeric")
        made, spans = [], []
        for c in names:
            x = F.col(c).cast("double")
            spans.append(F.max(x) - F.min(x))
            size = F.greatest(F.abs(F.max(x)), F.abs(F.min(x)))
            made.append(Measure("feature_scale", c, "large_magnitude", outside(size, None, max_magnitude), F.lit(1), size, grade="medium"))
            if check_standard_scale:
                off = (F.abs(F.avg(x)) > mean_tolerance) | (F.abs(F.stddev_pop(x) - 1) > std_tolerance)
                made.append(Measure("feature_scale", c, "not_standard", F.when(off, 1).otherwise(0), F.lit(1), F.avg(x), grade="low"))
        if len(spans) > 1:
            ratio = F.try_divide(F.greatest(*spans), F.least(*[F.nullif(s, F.lit(0.0)) for s in spans]))
            made.append(Measure("feature_scale", ",".join(names), "scale_ratio", outside(ratio, None, max_scale_ratio), F.lit(1), ratio, grade="medium"))
        return made

    return Check("feature_scale", plan)

