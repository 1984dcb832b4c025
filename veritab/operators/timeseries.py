"""Time series: completeness, gaps, order, seasonality and trend.

Windows over a whole series would run in one task, so differences to the row before are made range by range (`ordered_lag`), and places in the series by counts of ranges
(`numbered`). Checks take the name of the timestamp column, and of the value column where there is one.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from ..plans.checks import Check, Measure, count_if, graded, outside, rows
from .distribution import ordered_lag
from .quantiles import exact_quantiles


def _seconds(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp")) / 1e6


def numbered(df: DataFrame, order_by: list[str], out: str = "i") -> DataFrame:
    """``df`` with each row's place from 0 in the order: ranges are numbered in parallel and shifted by the sizes of those before."""
    ranged = df.repartitionByRange(*order_by).withColumn("__part", F.spark_partition_id())
    sizes = ranged.groupBy("__part").agg(rows().alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    own = F.row_number().over(Window.partitionBy("__part").orderBy(*order_by))
    return ranged.withColumn("__own", own).join(F.broadcast(starts), "__part").withColumn(out, F.col("__start") + F.col("__own") - 1).drop("__part", "__own", "__start")


def intervals(df: DataFrame, timestamp_column: str) -> DataFrame:
    """``t`` (seconds) of each row with a timestamp, and ``gap`` to the one before; null on the first row."""
    times = df.select(_seconds(F.col(timestamp_column)).alias("t")).where("t is not null")
    return ordered_lag(times, "t", ["t"], "__before").select("t", (F.col("t") - F.col("__before")).alias("gap"))


def _expected(gaps: DataFrame, frequency_seconds: float | None) -> DataFrame:
    """One row with the ``step`` between points: given, or the median of the gaps above 0."""
    return exact_quantiles(gaps.where("gap > 0"), {"step": ("gap", [0.5])}).select(F.col("step")[0].alias("step")) if frequency_seconds is None else gaps.sparkSession.range(1).select(F.lit(float(frequency_seconds)).alias("step"))


def timeseries_completeness(timestamp_column: str, frequency_seconds: float | None = None, min_coverage: float = 0.95) -> Check:
    """Points over those that fit between the first and the last at the expected step."""

    def plan(df: DataFrame) -> DataFrame:
        gaps = intervals(df, timestamp_column)
        one = gaps.agg(rows().alias("n"), F.min("t").alias("a"), F.max("t").alias("b")).crossJoin(_expected(gaps, frequency_seconds))
        share = F.least(F.try_divide(F.col("n").cast("double"), F.floor((F.col("b") - F.col("a")) / F.col("step")) + 1), F.lit(1.0))
        return graded(one, "timeseries_completeness", timestamp_column, "incomplete_series", outside(share, min_coverage, None), F.lit(1), share, grade="medium")

    return Check("timeseries_completeness", plan)


def timeseries_value_completeness(timestamp_column: str, value_column: str, max_null_ratio: float = 0.05, max_consecutive_nulls: int | None = None) -> Check:
    """Share of null values, and the longest run of them in time."""

    def plan(df: DataFrame) -> DataFrame:
        x = F.col(value_column)
        share = F.try_divide(count_if(x.isNull()), rows())
        out = graded(df.agg(count_if(x.isNull()).alias("bad"), rows().alias("total"), share.alias("s")), "timeseries_value_completeness", value_column, "null_values", F.col("bad"), F.col("total"), F.col("s"), limit=max_null_ratio)
        if max_consecutive_nulls is None:
            return out
        placed = numbered(df.select(timestamp_column, value_column), [timestamp_column, value_column])
        nulls = numbered(placed.where(x.isNull()).select("i"), ["i"], "j")
        longest = nulls.groupBy(F.col("i") - F.col("j")).agg(rows().alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).alias("n"))
        return out.unionByName(graded(longest, "timeseries_value_completeness", value_column, "consecutive_nulls", outside(F.col("n"), None, max_consecutive_nulls), F.lit(1), F.col("n"), grade="medium"))

    return Check("timeseries_value_completeness", plan)


def timeseries_date_range(timestamp_column: str, required_start: datetime | None = None, required_end: datetime | None = None, max_start_delay: float = 0.0, max_end_gap: float = 0.0) -> Check:
    """Seconds by which the series begins late or ends early."""

    def plan(df: DataFrame) -> list[Measure]:
        t, made = _seconds(F.col(timestamp_column)), []
        if required_start is not None:
            late = F.min(t) - _seconds(F.lit(required_start))
            made.append(Measure("timeseries_date_range", timestamp_column, "late_start", outside(late, None, max_start_delay), F.lit(1), late, grade="high"))
        if required_end is not None:
            early = _seconds(F.lit(required_end)) - F.max(t)
            made.append(Measure("timeseries_date_range", timestamp_column, "early_end", outside(early, None, max_end_gap), F.lit(1), early, grade="high"))
        return made

    return Check("timeseries_date_range", plan)


def timeseries_gap(timestamp_column: str, frequency_seconds: float | None = None, max_gap_multiplier: float = 2.0, max_gap_ratio: float = 0.05) -> Check:
    """Intervals above ``max_gap_multiplier`` times the expected step, if over ``max_gap_ratio`` of all."""

    def plan(df: DataFrame) -> DataFrame:
        gaps = intervals(df, timestamp_column).where("gap is not null")
        one = gaps.crossJoin(F.broadcast(_expected(gaps, frequency_seconds))).agg(count_if(F.col("gap") > F.col("step") * max_gap_multiplier).alias("bad"), rows().alias("total"))
        return graded(one, "timeseries_gap", timestamp_column, "time_gap", F.col("bad"), F.col("total"), limit=max_gap_ratio)

    return Check("timeseries_gap", plan)


def timeseries_interval(timestamp_column: str, min_interval: float | None = None, max_interval: float | None = None, max_interval_std: float | None = None) -> Check:
    def plan(df: DataFrame) -> DataFrame:
        one = intervals(df, timestamp_column).where("gap is not null").agg(count_if(outside(F.col("gap"), min_interval, None) == 1).alias("lo"), count_if(outside(F.col("gap"), None, max_interval) == 1).alias("hi"), rows().alias("total"), F.stddev_pop("gap").alias("s"))
        out = graded(one, "timeseries_interval", timestamp_column, "interval_too_short", F.col("lo"), F.col("total"))
        out = out.unionByName(graded(one, "timeseries_interval", timestamp_column, "interval_too_long", F.col("hi"), F.col("total")))
        return out.unionByName(graded(one, "timeseries_interval", timestamp_column, "irregular_intervals", outside(F.col("s"), None, max_interval_std), F.lit(1), F.col("s"), grade="medium"))

    return Check("timeseries_interval", plan)


def timeseries_duplicate(timestamp_column: str, max_duplicate_ratio: float = 0.0) -> Check:
    def plan(df: DataFrame) -> DataFrame:
        one = df.dropna(subset=[timestamp_column]).groupBy(timestamp_column).count().agg(F.sum(F.col("count") - 1).alias("bad"), F.sum("count").alias("total"))
        return graded(one, "timeseries_duplicate", timestamp_column, "duplicate_timestamp", F.col("bad"), F.col("total"), limit=max_duplicate_ratio)

    return Check("timeseries_duplicate", plan)


_WRONG = {"non_decreasing": lambda d: d < 0, "non_increasing": lambda d: d > 0, "strictly_increasing": lambda d: d <= 0, "strictly_decreasing": lambda d: d >= 0}


def timeseries_monotonic(timestamp_column: str, value_column: str, monotonicity: str = "non_decreasing", max_violation_ratio: float = 0.0) -> Check:
    """Steps of the value, in time order (equal times by value), in the wrong direction."""

    def plan(df: DataFrame) -> DataFrame:
        clean = df.select(timestamp_column, value_column).where(F.col(value_column).isNotNull() & F.col(timestamp_column).isNotNull())
        steps = ordered_lag(clean, value_column, [timestamp_column, value_column]).where("before is not null")
        one = steps.agg(count_if(_WRONG[monotonicity](F.col(value_column) - F.col("before"))).alias("bad"), rows().alias("total"))
        return graded(one, "timeseries_monotonic", value_column, "not_monotonic", F.col("bad"), F.col("total"), limit=max_violation_ratio)

    return Check("timeseries_monotonic", plan)


def timeseries_order(timestamp_column: str, sequence_column: str, allow_equal: bool = True) -> Check:
    """Timestamps that go back in the order of a sequence column."""

    def plan(df: DataFrame) -> DataFrame:
        steps = ordered_lag(df.select(sequence_column, timestamp_column), timestamp_column, [sequence_column])
        bad = F.col(timestamp_column) < F.col("before") if allow_equal else F.col(timestamp_column) <= F.col("before")
        return graded(steps.agg(count_if(bad).alias("bad"), rows().alias("total")), "timeseries_order", timestamp_column, "out_of_order", F.col("bad"), F.col("total"))

    return Check("timeseries_order", plan)


def _series(df: DataFrame, timestamp_column: str, value_column: str) -> DataFrame:
    """``i, x``: places and values of the rows with both, equal times by value."""
    clean = df.select(F.col(timestamp_column).alias("t"), F.col(value_column).cast("double").alias("x")).where("t is not null and x is not null")
    return numbered(clean, ["t", "x"]).select("i", "x")


def _line(series: DataFrame) -> DataFrame:
    """One row: ``slope``, ``base`` and ``r2`` of the least-squares line of x on i."""
    return series.agg(F.regr_slope("x", "i").alias("slope"), F.regr_intercept("x", "i").alias("base"), F.regr_r2("x", "i").alias("r2"))


#: Places of a series that a task works on together, at least.
BLOCK = 4096


def blocked(series: DataFrame, before: int, after: int) -> tuple[DataFrame, WindowSpec]:
    """The rows of a series (``i`` and others) dealt in blocks of consecutive places, with ``mine``, and the order within a block. A block also holds copies of the ``before``
    rows that precede it and the ``after`` rows that follow, which aren't ``mine``: so windows of so many rows need no order over the whole series, and few rows are doubled."""
    size = max(BLOCK, 4 * (before + after))
    own, place = F.floor(F.col("i") / size), F.pmod(F.col("i"), F.lit(size))
    blocks = F.array(own, F.when(place < after, own - 1), F.when(place >= size - before, own + 1))
    dealt = series.withColumn("__block", F.explode(F.array_compact(blocks))).withColumn("mine", F.col("__block") == own)
    return dealt, Window.partitionBy("__block").orderBy("i")


def autocorrelation(series: DataFrame, lags: list[int]) -> DataFrame:
    """``lag, acf`` of the detrended series, all lags by one aggregation; each row meets those so many places later in its block."""
    flat = series.crossJoin(F.broadcast(_line(series))).select("i", (F.col("x") - F.col("base") - F.col("slope") * F.col("i")).alias("x"))
    centred = flat.crossJoin(F.broadcast(flat.agg(F.avg("x").alias("m")))).select("i", (F.col("x") - F.col("m")).alias("x"))
    dealt, order = blocked(centred, 0, max(lags))
    pairs = dealt.select("x", "mine", *[(F.col("x") * F.lead("x", k).over(order)).alias(f"p{k}") for k in lags]).where("mine")
    one = pairs.agg(F.sum(F.col("x") * F.col("x")).alias("v"), *[F.sum(f"p{k}").alias(f"p{k}") for k in lags])
    return one.select(F.inline(F.array(*[F.struct(F.lit(k).alias("lag"), F.try_divide(f"p{k}", "v").alias("acf")) for k in lags]))).where("acf is not null")


def seasonality(timestamp_column: str, value_column: str, expected_period: int | None = None, min_strength: float = 0.3, max_period_search: int = 100) -> Check:
    """Autocorrelation at the expected period, or the highest of all periods from 2."""

    def plan(df: DataFrame) -> DataFrame:
        lags = [expected_period] if expected_period else list(range(2, max_period_search + 1))
        one = autocorrelation(_series(df, timestamp_column, value_column), lags).agg(F.max("acf").alias("s"))
        return graded(one, "seasonality", value_column, "weak_seasonality", outside(F.col("s"), min_strength, None), F.lit(1), F.col("s"), grade="low")

    return Check("seasonality", plan)


def moving_average(series: DataFrame, width: int, out: str = "trend") -> DataFrame:
    """Centred means of ``width`` places (one more if even), of the places that have so many around them."""
    half = width // 2
    dealt, order = blocked(series, half, half)
    near = order.rowsBetween(-half, half)
    wide = dealt.withColumn(out, F.avg("x").over(near)).withColumn("__n", F.count("x").over(near))
    return wide.where(F.col("mine") & (F.col("__n") == 2 * half + 1)).drop("__n", "__block", "mine")


def seasonal_decomposition(timestamp_column: str, value_column: str, period: int, max_residual_ratio: float = 0.3) -> Check:
    """Variance of what moving average and seasonal means leave, over that of the series."""

    def plan(df: DataFrame) -> DataFrame:
        trend = moving_average(_series(df, timestamp_column, value_column), period).withColumn("d", F.col("x") - F.col("trend")).withColumn("s", F.col("i") % period)
        means = trend.groupBy("s").agg(F.avg("d").alias("season"))
        one = trend.join(F.broadcast(means), "s").agg(F.var_pop(F.col("d") - F.col("season")).alias("r"), F.var_pop("x").alias("v"))
        share = F.try_divide("r", "v")
        return graded(one, "seasonal_decomposition", value_column, "large_residual", outside(share, None, max_residual_ratio), F.lit(1), share, grade="medium")

    return Check("seasonal_decomposition", plan)


def trend(timestamp_column: str, value_column: str, expected_direction: str = "any", min_strength: float | None = None, max_strength: float | None = None, min_r_squared: float | None = None) -> Check:
    """Slope of the least-squares line over the places; within 0.001 of 0 it has no direction."""

    def plan(df: DataFrame) -> DataFrame:
        one = _line(_series(df, timestamp_column, value_column))
        direction = F.when(F.col("slope") > 0.001, "increasing").when(F.col("slope") < -0.001, "decreasing").otherwise("none")
        off = F.lit(0) if expected_direction == "any" else F.when(direction != expected_direction, 1).otherwise(0)
        out = graded(one, "trend", value_column, "trend_direction", off, F.lit(1), F.col("slope"), grade="medium")
        out = out.unionByName(graded(one, "trend", value_column, "trend_strength", outside(F.abs("slope"), min_strength, max_strength), F.lit(1), F.abs("slope"), grade="medium"))
        return out.unionByName(graded(one, "trend", value_column, "trend_fit", outside(F.col("r2"), min_r_squared, None), F.lit(1), F.col("r2"), grade="medium"))

    return Check("trend", plan)


def trend_break(timestamp_column: str, value_column: str, min_break_magnitude: float = 0.05, window_size: int = 10, max_breaks: int = 0) -> Check:
    """Places where the mean of the ``window_size`` values from there on differs from that of those before by ``min_break_magnitude`` of it or more, and by most among the three
    places on each side."""

    def plan(df: DataFrame) -> DataFrame:
        series = _series(df, timestamp_column, value_column)
        dealt, order = blocked(series, window_size, window_size - 1)
        means = {"before": order.rowsBetween(-window_size, -1), "after": order.rowsBetween(0, window_size - 1)}
        wide = dealt.select("i", "mine", *[F.avg("x").over(w).alias(k) for k, w in means.items()], *[F.count("x").over(w).alias(f"n_{k}") for k, w in means.items()])
        whole = wide.where(F.col("mine") & (F.col("n_before") == window_size) & (F.col("n_after") == window_size))
        change = whole.select("i", F.abs(F.try_divide(F.col("after") - F.col("before"), F.abs("before"))).alias("c"))
        again, order = blocked(change, 3, 3)
        top = again.withColumn("top", F.max("c").over(order.rangeBetween(-3, 3))).where("mine")
        one = top.agg(count_if((F.col("c") >= min_break_magnitude) & (F.col("c") >= F.col("top"))).alias("n"))
        return graded(one, "trend_break", value_column, "trend_break", F.when(F.col("n") > max_breaks, F.col("n")).otherwise(0), F.col("n"), F.col("n"), grade="medium")

    return Check("trend_break", plan)
