"""Quantiles of whole columns, exact or by mergeable sketches, without a task that holds a column's values."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Brackets come from sketches whose ranks are off by a share of 1 / `ACCURACY` at most; a bracket spans `MARGIN` times that on either side.
ACCURACY, MARGIN = 10_000, 3

Asked = Mapping[str, tuple[str | Column, Sequence[float]]]


def exact_quantiles(df: DataFrame, asked: Asked, also: Mapping[str, Column] | None = None) -> DataFrame:
    """One row: for each name, an array of the quantiles of a column (null without values), interpolated linearly; and the aggregates ``also`` of ``df``.

    A first scan sketches each column, which gives every quantile a bracket of values that surely holds it. A second one counts the values below each bracket and, by
    partial sums, those inside: some `2 * MARGIN / ACCURACY` of the column, or fewer if values repeat. Only these are sorted. Raises if a bracket should miss.
    """
    pairs = [(name, i, q) for name, (_, qs) in asked.items() for i, q in enumerate(qs)]
    column = {name: f"__x{k}" for k, name in enumerate(asked)}
    xs = df.select(*[(F.col(c) if isinstance(c, str) else c).cast("double").alias(column[name]) for name, (c, _) in asked.items()])
    step = MARGIN / ACCURACY
    asks = [F.count(x).alias(f"n_{x}") for x in column.values()]
    for p, (name, _, q) in enumerate(pairs):
        x = column[name]
        asks.append((F.percentile_approx(x, q - step, ACCURACY) if q - step > 0 else F.min(x)).alias(f"lo{p}"))
        asks.append((F.percentile_approx(x, q + step, ACCURACY) if q + step < 1 else F.max(x)).alias(f"hi{p}"))
    known = xs.agg(*asks)
    wide = xs.crossJoin(F.broadcast(known))  # one row
    sides = []
    for p, (name, *_) in enumerate(pairs):
        x, lo, hi = F.col(column[name]), F.col(f"lo{p}"), F.col(f"hi{p}")
        sides += [F.count_if(x < lo).alias(f"below{p}"), F.max(F.when(x < lo, x)).alias(f"prev{p}"), F.min(F.when(x > hi, x)).alias(f"next{p}")]
    beside = wide.agg(*sides)
    inside = [
        F.when(F.col(column[name]).between(F.col(f"lo{p}"), F.col(f"hi{p}")), F.struct(F.lit(p).alias("p"), F.col(column[name]).alias("x"))) for p, (name, *_) in enumerate(pairs)
    ]
    counts = wide.select(F.explode(F.array_compact(F.array(*inside))).alias("v")).groupBy("v.p", "v.x").agg(F.count("*").alias("n"))
    own = Window.partitionBy("p").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    sums = counts.withColumn("upto", F.sum("n").over(own)).crossJoin(F.broadcast(known.crossJoin(beside)))

    def of_pair(columns: Sequence[Column]) -> Column:
        return F.element_at(F.array(*columns), F.col("p") + 1)

    place = of_pair([F.lit(q) * (F.col(f"n_{column[name]}") - 1) for name, _, q in pairs])
    placed = sums.select(
        "p", "x", "n", place.alias("place"), (F.col("upto") + of_pair([F.col(f"below{p}") for p in range(len(pairs))])).alias("upto"),
        of_pair([F.col(f"prev{p}") for p in range(len(pairs))]).alias("prev"), of_pair([F.col(f"next{p}") for p in range(len(pairs))]).alias("next"),
    )
    first, last = F.floor("place"), F.ceil("place")
    found = placed.groupBy("p", "place", "prev", "next").agg(
        F.min(F.when(F.col("upto") > first, F.col("x"))).alias("low"),
        F.min(F.when(F.col("upto") > last, F.col("x"))).alias("high"),
        F.min(F.col("upto") - F.col("n")).alias("before"),
        F.max("upto").alias("upto"),
    )

    def at(rank: Column, inside_: str) -> Column:
        """The value of a rank: inside the bracket or right beside it, as ranks of few rows are rounded."""
        return F.when(rank == F.col("before") - 1, F.col("prev")).when(rank == F.col("upto"), F.col("next")).when((rank >= F.col("before")) & (rank < F.col("upto")), F.col(inside_))

    found = found.select("p", "place", at(first, "low").alias("low"), at(last, "high").alias("high"))
    between = (last - F.col("place")) * F.col("low") + (F.col("place") - first) * F.col("high")
    missed = F.col("low").isNull() | F.col("high").isNull()
    value = F.when(missed, F.raise_error(F.lit("a quantile lies outside its bracket")).cast("double")).when(F.col("low") == F.col("high"), F.col("low")).otherwise(between)
    one = found.withColumn("value", value).agg(*[F.max(F.when(F.col("p") == p, F.col("value"))).alias(f"v{p}") for p in range(len(pairs))])
    made = []
    for name, (_, qs) in asked.items():
        at = [F.col(f"v{p}") for p, (n, *_) in enumerate(pairs) if n == name]
        made.append(F.when(at[0].isNotNull(), F.array(*at)).alias(name) if qs else F.array().cast("array<double>").alias(name))
    out = one.select(*made)
    return out.crossJoin(df.agg(*[v.alias(k) for k, v in also.items()])) if also else out


def beside_quantiles(df: DataFrame, asked: Asked, also: Mapping[str, Column] | None = None) -> DataFrame:
    """``df`` beside the one row of `exact_quantiles`."""
    return df.crossJoin(F.broadcast(exact_quantiles(df, asked, also)))  # one row


def sketch(df: DataFrame, column: str, k: int = 800, group_by: Sequence[str] = ()) -> DataFrame:
    """``sketch``: a KLL sketch of a column, which other sketches can be merged with; ranks are off by some 1.3 / ``k`` ** 0.9 with a chance of 1 %."""
    x = F.col(column).cast("double")
    return df.where(x.isNotNull()).groupBy(*group_by).agg(F.kll_sketch_agg_double(x, F.lit(k)).alias("sketch"))


def merged_sketches(sketches: DataFrame) -> DataFrame:
    """One sketch of all. Sketches are small and merged by partial aggregation."""
    return sketches.agg(F.kll_merge_agg_double("sketch").alias("sketch"))


def sketch_quantiles(sketches: DataFrame, qs: Sequence[float]) -> DataFrame:
    """``q, value`` of each sketch."""
    each = [F.struct(F.lit(float(q)).alias("q"), F.kll_sketch_get_quantile_double("sketch", F.lit(float(q))).alias("value")) for q in qs]
    return sketches.select(F.inline(F.array(*each)))


def rank_error(k: int) -> float:
    """The share by which ranks of a sketch of size ``k`` may be off."""
    return 2.446 / math.pow(k, 0.9433)
