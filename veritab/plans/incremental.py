"""Profiles that grow: a small state for each column, merged with the states of further rows, batches of a stream among them; and covariances brought up to date."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from .checks import NUMERIC, count_if, rows

#: Size of the sketches: distinct counts within some 1.6 %, ranks within some 0.5 %.
HLL, KLL = 12, 800


def state(df: DataFrame) -> DataFrame:
    """``column_name, n, n_null, low, high, total, squares, distinct, ranks`` of each numeric or text column, by one aggregation: sums and sketches, which can be merged."""
    fields = [f for f in df.schema.fields if isinstance(f.dataType, (*NUMERIC, T.StringType))]
    asked, made = [rows().alias("n")], []
    for i, f in enumerate(fields):
        x, number = F.col(f"`{f.name}`"), isinstance(f.dataType, NUMERIC)
        v = x.cast("double") if number else F.char_length(x).cast("double")
        asked += [
            count_if(x.isNull()).alias(f"null{i}"), F.min(v).alias(f"low{i}"), F.max(v).alias(f"high{i}"), F.coalesce(F.sum(v), F.lit(0.0)).alias(f"total{i}"),
            F.coalesce(F.sum(v * v), F.lit(0.0)).alias(f"squares{i}"), F.hll_sketch_agg(x.cast("string"), HLL).alias(f"distinct{i}"), F.kll_sketch_agg_double(v, F.lit(KLL)).alias(f"ranks{i}"),
        ]
        names = {"n_null": "null", "low": "low", "high": "high", "total": "total", "squares": "squares", "distinct": "distinct", "ranks": "ranks"}
        made.append(F.struct(F.lit(f.name).alias("column_name"), F.col("n"), *[F.col(f"{k}{i}").alias(a) for a, k in names.items()]))
    return df.agg(*asked).select(F.inline(F.array(*made)))


def merged(*states: DataFrame) -> DataFrame:
    """The state of all rows; a row for each column meets, whatever the tables' sizes."""
    return reduce(DataFrame.unionByName, states).groupBy("column_name").agg(
        F.sum("n").alias("n"), F.sum("n_null").alias("n_null"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("total").alias("total"), F.sum("squares").alias("squares"),
        F.hll_union_agg("distinct").alias("distinct"), F.kll_merge_agg_double("ranks").alias("ranks"),
    )


def finished(states: DataFrame) -> DataFrame:
    """``column_name, n_rows, n_null, low, high, mean, std, n_distinct, median``: the last two are estimates. Numbers of a text column are those of its lengths."""
    k = F.col("n") - F.col("n_null")
    variance = F.try_divide(F.col("squares") - F.col("total") * F.col("total") / F.nullif(k, F.lit(0)), F.nullif(k - 1, F.lit(0)))
    median = F.when(k > 0, F.kll_sketch_get_quantile_double("ranks", F.lit(0.5)))
    return states.select(
        "column_name", F.col("n").alias("n_rows"), "n_null", "low", "high", F.try_divide("total", k).alias("mean"), F.sqrt(F.greatest(variance, F.lit(0.0))).alias("std"),
        F.hll_sketch_estimate("distinct").alias("n_distinct"), median.alias("median"),
    )


def profile_stream(df: DataFrame, path: str, checkpoint: str, sink: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Keeps the state of a stream's rows below ``path``, one folder for each batch, and hands the finished profile so far to ``sink``. A batch that is run again overwrites its own
    folder, so each row counts once."""
    spark = df.sparkSession

    def each(batch: DataFrame, number: int) -> None:
        state(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")
        if sink:
            sink(finished(merged(spark.read.parquet(path).drop("batch"))), number)

    return df.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Covariance:
    """Mean, covariance and its inverse, brought up to date with the moments of further rows; the inverse by Woodbury's identity, without inverting anew."""

    def __init__(self, n: int, mean: np.ndarray, covariance: np.ndarray, ridge: float = 1e-9):
        self.n, self.mean = n, np.asarray(mean, float)
        self.scatter = np.asarray(covariance, float) * max(n - 1, 0) + ridge * np.eye(len(mean))
        self.inverse_scatter = np.linalg.inv(self.scatter)

    def update(self, rows_: np.ndarray) -> Covariance:
        """Adds a bounded number of rows: a change of the scatter matrix of low rank."""
        k = len(rows_)
        if not k:
            return self
        mean = rows_.mean(axis=0)
        far = np.sqrt(self.n * k / (self.n + k)) * (mean - self.mean)
        u = np.vstack([rows_ - mean, far]).T
        self.scatter += u @ u.T
        inner = np.linalg.inv(np.eye(u.shape[1]) + u.T @ self.inverse_scatter @ u)
        self.inverse_scatter -= self.inverse_scatter @ u @ inner @ u.T @ self.inverse_scatter
        self.mean = (self.n * self.mean + k * mean) / (self.n + k)
        self.n += k
        return self

    def merge(self, n: int, mean: np.ndarray, covariance: np.ndarray) -> Covariance:
        """Adds the moments of any number of rows, as `moments` gives them."""
        if n:
            gap = np.asarray(mean) - self.mean
            self.scatter += np.asarray(covariance) * (n - 1) + np.outer(gap, gap) * self.n * n / (self.n + n)
            self.inverse_scatter = np.linalg.inv(self.scatter)
            self.mean = self.mean + gap * n / (self.n + n)
            self.n += n
        return self

    @property
    def covariance(self) -> np.ndarray:
        return self.scatter / max(self.n - 1, 1)

    @property
    def inverse(self) -> np.ndarray:
        return self.inverse_scatter * max(self.n - 1, 1)
