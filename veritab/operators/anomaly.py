"""Outliers of one column by fences, and of several by distance or reconstruction error."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.statistics import chi2_ppf, t_ppf
from ..plans.checks import Check, count_if, graded, pick, rows
from .distribution import with_statistics
from .quantiles import beside_quantiles

ASCENDING = (0.1, 0.05, 0.01)


def _shares(df: DataFrame, name: str, column: str, bad: Column, max_ratio: float, total: Column | None = None) -> DataFrame:
    one = df.agg(count_if(bad).alias("bad"), (total if total is not None else rows()).alias("total"))
    return graded(one, name, column, "anomaly", F.col("bad"), F.col("total"), limit=max_ratio, grade=ASCENDING, at_least=True)


def _quartiles(df: DataFrame, column: str, low: float = 0.25, high: float = 0.75) -> DataFrame:
    clean = df.select(F.col(column).cast("double").alias("x")).where("x is not null and not isnan(x)")
    return beside_quantiles(clean, {"q": ("x", [low, high])}, {"n": F.count("x")})


def iqr_anomaly(column: str, iqr_multiplier: float = 1.5, max_anomaly_ratio: float = 0.1, detect_lower: bool = True, detect_upper: bool = True) -> Check:
    def plan(df: DataFrame) -> DataFrame:
        x, lo, hi = F.col("x"), F.col("q")[0], F.col("q")[1]
        bad = (F.lit(detect_lower) & (x < lo - iqr_multiplier * (hi - lo))) | (F.lit(detect_upper) & (x > hi + iqr_multiplier * (hi - lo)))
        return _shares(_quartiles(df, column), "iqr_anomaly", column, bad & (F.col("n") >= 4), max_anomaly_ratio)

    return Check("iqr_anomaly", plan)


def mad_anomaly(column: str, threshold: float = 3.5, max_anomaly_ratio: float = 0.1) -> Check:
    """0.6745 |x - median| / MAD above the threshold; where MAD is 0, the mean deviation times 1.2533 stands for it."""

    def plan(df: DataFrame) -> DataFrame:
        clean = df.select(F.col(column).cast("double").alias("x")).where("x is not null and not isnan(x)")
        away = beside_quantiles(clean, {"m": ("x", [0.5])}).select(F.abs(F.col("x") - F.col("m")[0]).alias("d"))
        wide = beside_quantiles(away, {"mad": ("d", [0.5])}, {"mean": F.avg("d"), "n": F.count("d")}).withColumn("mad", F.col("mad")[0])
        score = F.when(F.col("mad") > 0, 0.6745 * F.col("d") / F.col("mad")).otherwise(F.try_divide("d", 1.253314 * F.col("mean")))
        return _shares(wide, "mad_anomaly", column, (score > threshold) & (F.col("n") >= 3), max_anomaly_ratio)

    return Check("mad_anomaly", plan)


def tukey_fences(column: str, detect_mild: bool = True, detect_extreme: bool = True, max_anomaly_ratio: float = 0.1) -> Check:
    """Mild: beyond 1.5 interquartile ranges but not 3; extreme: beyond 3."""

    def plan(df: DataFrame) -> DataFrame:
        wide, x, lo, hi = _quartiles(df, column), F.col("x"), F.col("q")[0], F.col("q")[1]

        def beyond(k: float) -> Column:
            return (x < lo - k * (hi - lo)) | (x > hi + k * (hi - lo))

        parts = ([("mild_outlier", beyond(1.5) & ~beyond(3.0))] if detect_mild else []) + ([("extreme_outlier", beyond(3.0))] if detect_extreme else [])
        made = [_shares(wide, "tukey_fences", column, bad, max_anomaly_ratio).withColumn("issue", F.lit(issue)) for issue, bad in parts]
        return reduce(DataFrame.unionByName, made)

    return Check("tukey_fences", plan)


def percentile_anomaly(column: str, lower_percentile: float = 1.0, upper_percentile: float = 99.0, max_anomaly_ratio: float = 0.1) -> Check:
    def plan(df: DataFrame) -> DataFrame:
        wide = _quartiles(df, column, lower_percentile / 100, upper_percentile / 100)
        return _shares(wide, "percentile_anomaly", column, ((F.col("x") < F.col("q")[0]) | (F.col("x") > F.col("q")[1])) & (F.col("n") >= 10), max_anomaly_ratio)

    return Check("percentile_anomaly", plan)


def grubbs_test(column: str, alpha: float = 0.05, max_iterations: int = 10, max_anomaly_ratio: float = 0.1) -> Check:
    """Removes the value farthest from the mean while it is too far for its number. Needs only the moments and the ``max_iterations`` extremes of either side, which are bounded."""

    def plan(df: DataFrame) -> DataFrame:
        clean = df.select(F.col(column).cast("double").alias("x")).where("x is not null and not isnan(x)")
        m = clean.agg(rows().alias("n"), F.avg("x").alias("mean"), F.var_pop("x").alias("v")).first()
        low = [r["x"] for r in clean.orderBy("x").limit(max_iterations).collect()]
        high = [r["x"] for r in clean.orderBy(F.desc("x")).limit(max_iterations).collect()]
        n, mean, m2, found = m["n"], m["mean"] or 0.0, (m["v"] or 0.0) * m["n"], 0
        total = n
        while found < max_iterations and n >= 3 and m2 > 0 and low and high:
            far = low[0] if mean - low[0] > high[0] - mean else high[0]
            t = t_ppf(1 - alpha / (2 * n), n - 2)
            critical = (n - 1) / math.sqrt(n) * math.sqrt(t * t / (n - 2 + t * t))
            if abs(far - mean) / math.sqrt(m2 / (n - 1)) <= critical:
                break
            (low if far == low[0] else high).pop(0)
            rest = (n * mean - far) / (n - 1)
            m2 = max(m2 - (far - mean) * (far - rest), 0.0)
            n, mean, found = n - 1, rest, found + 1
        one = df.sparkSession.range(1).select(F.lit(found).alias("bad"), F.lit(total).alias("total"))
        return graded(one, "grubbs_test", column, "anomaly", F.col("bad"), F.col("total"), limit=max_anomaly_ratio, grade=ASCENDING, at_least=True)

    return Check("grubbs_test", plan)


def zscore_multivariate(columns: Sequence[str] | None = None, threshold: float = 3.0, method: str = "any", max_anomaly_ratio: float = 0.1) -> Check:
    """Population z-scores of each column: any, all, or their mean above the threshold. Rows with a null are left out."""

    def plan(df: DataFrame) -> DataFrame:
        names = pick(df, columns, "numeric")
        clean = df.select(*names).dropna()
        wide = with_statistics(clean, {f"__m{i}": F.avg(c) for i, c in enumerate(names)} | {f"__s{i}": F.stddev_pop(c) for i, c in enumerate(names)})
        z = [F.coalesce(F.try_divide(F.abs(F.col(c) - F.col(f"__m{i}")), F.col(f"__s{i}")), F.lit(0.0)) for i, c in enumerate(names)]
        score = {"any": F.greatest(*z, F.lit(0.0)), "all": F.least(*z, F.lit(1e300)), "mean": reduce(lambda a, b: a + b, z) / len(z)}[method]
        return _shares(wide, "zscore_multivariate", ",".join(names), score > threshold, max_anomaly_ratio)

    return Check("zscore_multivariate", plan)


def moments(df: DataFrame, columns: Sequence[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows without a null, means and sample covariance, by one aggregation; only the moments come to the driver."""
    clean = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)]).dropna()
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    row = clean.agg(rows(), *[F.avg(f"c{i}") for i in range(len(columns))], *[F.covar_samp(f"c{i}", f"c{j}") for i, j in pairs]).first()
    k = len(columns)
    covariance = np.zeros((k, k))
    for (i, j), v in zip(pairs, row[1 + k :], strict=True):
        covariance[i, j] = covariance[j, i] = v or 0.0
    return row[0], np.array([x or 0.0 for x in row[1 : 1 + k]]), covariance


def quadratic(columns: Sequence[str], mean: np.ndarray, matrix: np.ndarray) -> Column:
    """(x - mean)' matrix (x - mean) as an expression of a row."""
    d = [F.col(c).cast("double") - float(m) for c, m in zip(columns, mean, strict=True)]
    terms = [d[i] * d[j] * float(matrix[i, j] * (1 if i == j else 2)) for i in range(len(d)) for j in range(i, len(d))]
    return reduce(lambda a, b: a + b, terms)


def trimmed_moments(df: DataFrame, columns: Sequence[str], steps: int, keep: float) -> tuple[np.ndarray, np.ndarray]:
    """Robust mean and covariance by concentration: moments of the ``keep`` of rows nearest to the moments before, ``steps`` times, over all rows."""
    _, mean, covariance = moments(df, columns)
    k = len(columns)
    for _ in range(steps):
        distance = quadratic(columns, mean, np.linalg.pinv(covariance))
        near = with_statistics(df.select(*columns).dropna().withColumn("__d", distance), {"__cut": F.percentile_approx("__d", keep, 10_000)}).where("__d <= __cut")
        _, mean, covariance = moments(near, columns)
    return mean, covariance * (keep_factor(k, keep) if steps else 1.0)


def keep_factor(k: int, keep: float) -> float:
    """What the covariance of the nearest ``keep`` of normal data falls short of all of it."""
    from ..functions.statistics import gamma_p

    return keep / max(gamma_p(k / 2 + 1, chi2_ppf(keep, k) / 2), 1e-9)


def mahalanobis(columns: Sequence[str] | None = None, threshold_percentile: float = 97.5, robust: bool = False, max_anomaly_ratio: float = 0.1, name: str = "mahalanobis") -> Check:
    """Squared Mahalanobis distance beyond the chi squared quantile of as many degrees as columns."""

    def plan(df: DataFrame) -> DataFrame:
        names = pick(df, columns, "numeric")
        mean, covariance = trimmed_moments(df, names, 2, 0.75) if robust else moments(df, names)[1:]
        clean = df.select(*names).dropna()
        return _shares(clean, name, ",".join(names), quadratic(names, mean, np.linalg.pinv(covariance)) > chi2_ppf(threshold_percentile / 100, len(names)), max_anomaly_ratio)

    return Check(name, plan)


def elliptic_envelope(columns: Sequence[str] | None = None, contamination: float = 0.05, max_anomaly_ratio: float = 0.1) -> Check:
    """The ``contamination`` share of rows farthest by robust distance; so the share is known, and the limit tells whether it is an issue."""

    def plan(df: DataFrame) -> DataFrame:
        names = pick(df, columns, "numeric")
        mean, covariance = trimmed_moments(df, names, 2, 0.75)
        scored = df.select(*names).dropna().withColumn("__d", quadratic(names, mean, np.linalg.pinv(covariance)))
        wide = beside_quantiles(scored, {"__cut": ("__d", [1 - contamination])}).withColumn("__cut", F.col("__cut")[0])
        return _shares(wide, "elliptic_envelope", ",".join(names), F.col("__d") > F.col("__cut"), max_anomaly_ratio)

    return Check("elliptic_envelope", plan)


def pca_anomaly(columns: Sequence[str] | None = None, n_components: int | None = None, error_percentile: float = 95.0, max_anomaly_ratio: float = 0.1) -> Check:
    """Standardised rows whose distance from the first principal components is beyond a percentile of all. The components come from the correlation matrix on the driver."""

    def plan(df: DataFrame) -> DataFrame:
        names = pick(df, columns, "numeric")
        _, mean, covariance = moments(df, names)
        s = np.sqrt(np.diag(covariance))
        s[s == 0] = 1.0
        values, vectors = np.linalg.eigh(covariance / np.outer(s, s))
        order = np.argsort(values)[::-1]
        k = n_components or max(1, int(np.searchsorted(np.cumsum(values[order]) / values.sum(), 0.95) + 1))
        rest = vectors[:, order[min(k, len(names) - 1) :]]
        matrix = (rest @ rest.T) / np.outer(s, s)
        scored = df.select(*names).dropna().withColumn("__e", quadratic(names, mean, matrix))
        wide = beside_quantiles(scored, {"__cut": ("__e", [error_percentile / 100])}).withColumn("__cut", F.col("__cut")[0])
        return _shares(wide, "pca_anomaly", ",".join(names), F.col("__e") > F.col("__cut"), max_anomaly_ratio)

    return Check("pca_anomaly", plan)
