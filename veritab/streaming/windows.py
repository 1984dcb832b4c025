"""Event-time windows, deduplication and incremental checks; every function takes batch and streaming DataFrames alike unless it says otherwise."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, GroupedData, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.checks import Check, Measure, count_if, pick, rows, run

AGGREGATES: dict[str, Callable[[str], Column]] = {
    "count": lambda c: rows(),
    "sum": lambda c: F.coalesce(F.sum(c), F.lit(0)),
    "avg": lambda c: F.coalesce(F.avg(c), F.lit(0.0)),
    "min": lambda c: F.min(c),
    "max": lambda c: F.max(c),
}


def _timed(df: DataFrame, ts: str, delay: str | None) -> DataFrame:
    return df.withWatermark(ts, delay) if df.isStreaming and delay else df


def _finished(grouped: GroupedData, spec: Mapping[str, tuple[str, str]]) -> DataFrame:
    out = grouped.agg(*[AGGREGATES[f](c).alias(a) for a, (f, c) in spec.items()])
    rest = [c for c in out.columns if c not in ("window", "session_window")]
    name = "window" if "window" in out.columns else "session_window"
    return out.select(F.col(f"{name}.start").alias("window_start"), F.col(f"{name}.end").alias("window_end"), *rest)


def tumbling(df: DataFrame, ts: str, size: str, spec: Mapping[str, tuple[str, str]], keys: Sequence[str] = (), delay: str | None = "0 seconds") -> DataFrame:
    """Aggregates of windows of one size, aligned to the epoch. On a stream, rows later than ``delay`` behind the latest are dropped and a window comes out once it is closed."""
    return _finished(_timed(df, ts, delay).groupBy(F.window(ts, size), *keys), spec)


def sliding(df: DataFrame, ts: str, size: str, slide: str, spec: Mapping[str, tuple[str, str]], keys: Sequence[str] = (), delay: str | None = "0 seconds") -> DataFrame:
    return _finished(_timed(df, ts, delay).groupBy(F.window(ts, size, slide), *keys), spec)


def session(df: DataFrame, ts: str, gap: str, spec: Mapping[str, tuple[str, str]], keys: Sequence[str], delay: str | None = "0 seconds") -> DataFrame:
    """Windows that last while rows of a key follow each other within ``gap``, in whatever order they come."""
    return _finished(_timed(df, ts, delay).groupBy(F.session_window(ts, gap), *keys), spec)


def deduplicated(df: DataFrame, ts: str, keys: Sequence[str], within: str = "1 hour") -> DataFrame:
    """Without rows that repeat the keys within a time; state is dropped as the watermark passes. On a batch, the first of all equal keys stays."""
    return df.withWatermark(ts, within).dropDuplicatesWithinWatermark(list(keys)) if df.isStreaming else df.dropDuplicates(list(keys))


def by_content(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    """A name for a row's content, for deduplication."""
    return F.sha2(F.to_json(F.struct(*(columns or df.columns))), 256)


def joined_within(left: DataFrame, right: DataFrame, on: str, left_ts: str, right_ts: str, within: str, delay: str = "0 seconds") -> DataFrame:
    """Pairs of rows of equal keys whose times differ by ``within`` at most; on streams both sides' state is bounded by the watermark."""
    a, b = _timed(left, left_ts, delay).alias("a"), _timed(right, right_ts, delay).alias("b")
    span = F.expr(f"INTERVAL {within}")
    near = (F.col(f"b.{right_ts}") >= F.col(f"a.{left_ts}") - span) & (F.col(f"b.{right_ts}") <= F.col(f"a.{left_ts}") + span)
    return a.join(b, (F.col(f"a.{on}") == F.col(f"b.{on}")) & near)


def check_batches(df: DataFrame, checks: Sequence[Check], sink: Callable[[DataFrame, int], None], checkpoint: str, trigger: Mapping[str, str | bool] | None = None) -> StreamingQuery:
    """Runs a suite on each micro-batch and hands its results to ``sink`` with the batch's number; the checkpoint makes batches exactly-once for sinks that overwrite by number."""

    def each(batch: DataFrame, number: int) -> None:
        sink(run(batch.persist(), checks).withColumn("batch", F.lit(number)), number)
        batch.unpersist()

    return df.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


#: State stores: in the executors' memory with snapshots, or in RocksDB on their disks with changelogs in the checkpoint folder, for state that outgrows memory or must outlive a server.
STATE_STORES = {
    "memory": "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider",
    "rocksdb": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def state_store(spark: SparkSession, kind: str) -> None:
    """The state store of the streams started from now on: ``memory`` or ``rocksdb``. Both recover a batch's state from the checkpoint folder."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORES[kind])


def aggregated_with(df: DataFrame, keys: Sequence[str], spec: Mapping[str, tuple[str, str]], static: DataFrame, how: str = "inner") -> DataFrame:
    """Aggregates of a stream (or a table) by key, joined with a static table of those keys. Rows are aggregated first, so a row for each key meets the table."""
    own = df.groupBy(*keys).agg(*[AGGREGATES[f](c).alias(a) for a, (f, c) in spec.items()])
    return own.join(static, list(keys), how)


def merged(results: DataFrame) -> DataFrame:
    """Results of many batches as one: counts add up, the worst severity holds."""
    rank = F.array_position(F.array(*map(F.lit, ("low", "medium", "high", "critical"))), F.col("severity"))
    out = results.groupBy("check_name", "column_name", "issue").agg(F.sum("n_bad").alias("n_bad"), F.sum("n_rows").alias("n_rows"), F.max_by("severity", rank).alias("severity"))
    return out.select("check_name", "column_name", "issue", "n_bad", "n_rows", "severity")


def _accumulated(name: str, columns, kind: str, issue: str, bad: Callable[[Column], Column], total: Callable[[Column], Column] = lambda x: rows(), limit: float = 0.0) -> Check:
    return Check(name, lambda df: [Measure(name, c, issue, count_if(bad(F.col(c))), total(F.col(c)), limit=limit) for c in pick(df, columns, kind)])


def streaming_null(columns: str | Sequence[str] | None = None) -> Check:
    return _accumulated("streaming_null", columns, "any", "null", lambda x: x.isNull())


def streaming_completeness(columns: str | Sequence[str] | None = None, min_ratio: float = 0.95) -> Check:
    return _accumulated("streaming_completeness", columns, "any", "low_completeness", lambda x: x.isNull(), limit=1 - min_ratio)


def streaming_nan(columns: str | Sequence[str] | None = None) -> Check:
    return _accumulated("streaming_nan", columns, "float", "nan", F.isnan, F.count)


def streaming_range(columns: str | Sequence[str] | None = None, min_value: float | None = None, max_value: float | None = None, inclusive: bool = True) -> Check:
    def bad(x: Column) -> Column:
        out = F.lit(False)
        out = out | (x < min_value if inclusive else x <= min_value) if min_value is not None else out
        return out | (x > max_value if inclusive else x >= max_value) if max_value is not None else out

    return _accumulated("streaming_range", columns, "numeric", "out_of_range", bad, F.count)


def streaming_outlier(columns: str | Sequence[str] | None = None, iqr_multiplier: float = 1.5) -> Check:
    """Fences from the whole table, counts that can be summed."""
    from ..operators.distribution import outlier

    inner = outlier(columns, iqr_multiplier)
    return Check("streaming_outlier", lambda df: inner.plan(df).withColumn("check_name", F.lit("streaming_outlier")))


def streaming_positive(columns: str | Sequence[str] | None = None) -> Check:
    return _accumulated("streaming_positive", columns, "numeric", "not_positive", lambda x: x <= 0, F.count)
