"""Sketches as small tables: built by partial aggregation, merged by adding up, asked by joins; and samples that are the same on every run."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _place(value: Column, seed: int, width: int) -> Column:
    """A place from 0 below ``width`` by the first 32 bits of an MD5: the same in any system."""
    digest = F.md5(F.concat(F.lit(f"{seed}/"), value.cast("string")).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % width


def _places(value: Column, depth: int, width: int) -> Column:
    return F.explode(F.array(*[F.struct(F.lit(i).alias("row"), _place(value, i, width).alias("cell")) for i in range(depth)]))


def count_min_size(error: float, confidence: float) -> tuple[int, int]:
    """Rows and cells of a row such that a count is over by at most ``error`` of all rows with the given confidence."""
    return math.ceil(math.log(1 / (1 - confidence))), math.ceil(math.e / error)


def count_min(df: DataFrame, column: str, error: float = 0.001, confidence: float = 0.99) -> DataFrame:
    """``row, cell, n``: a count-min sketch of a column's values other than null. It has a fixed number of cells, so partial sums are small."""
    depth, width = count_min_size(error, confidence)
    placed = df.where(F.col(column).isNotNull()).select(_places(F.col(column), depth, width).alias("p"))
    return placed.groupBy("p.row", "p.cell").agg(F.count("*").alias("n"))


def count_min_merged(*sketches: DataFrame) -> DataFrame:
    """One sketch of all rows."""
    return reduce(DataFrame.unionByName, sketches).groupBy("row", "cell").agg(F.sum("n").alias("n"))


def count_min_estimates(sketch: DataFrame, values: DataFrame, column: str, error: float = 0.001, confidence: float = 0.99) -> DataFrame:
    """``column, n``: how often each of the values occurs at most: never less than in truth."""
    depth, width = count_min_size(error, confidence)
    asked = values.select(column).distinct().select(column, _places(F.col(column), depth, width).alias("p")).select(column, "p.row", "p.cell")
    return asked.join(sketch, ["row", "cell"], "left").groupBy(column).agg(F.min(F.coalesce("n", F.lit(0))).alias("n"))


def heavy_hitters(df: DataFrame, column: str, share: float, error: float = 0.001, confidence: float = 0.99) -> DataFrame:
    """``column, n`` of values that ``share`` of the rows have at least. The sketch names the candidates, of which there are few; only they are counted."""
    sketch = count_min(df, column, error, confidence)
    depth, width = count_min_size(error, confidence)
    total = df.where(F.col(column).isNotNull()).agg(F.count("*").alias("total"))
    heavy = sketch.crossJoin(F.broadcast(total)).where(F.col("n") >= share * F.col("total")).select("row", "cell")
    by_row = heavy.groupBy("row").agg(F.collect_set("cell").alias("cells"))  # 1 / share cells of a row at most
    one = by_row.agg(F.map_from_entries(F.collect_list(F.struct("row", "cells"))).alias("heavy"))
    wide = df.where(F.col(column).isNotNull()).select(column).crossJoin(F.broadcast(one))
    inside = reduce(lambda a, b: a & b, [F.coalesce(F.array_contains(F.col("heavy")[F.lit(i)], _place(F.col(column), i, width)), F.lit(False)) for i in range(depth)])
    counts = wide.where(inside).groupBy(column).agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(total)).where(F.col("n") >= share * F.col("total")).select(column, "n")


def bloom_size(expected: int, error: float) -> tuple[int, int]:
    """Hash functions and bits of a Bloom filter."""
    bits = max(8, math.ceil(-expected * math.log(error) / math.log(2) ** 2))
    return max(1, round(bits / max(expected, 1) * math.log(2))), bits


def bloom(df: DataFrame, column: str, expected: int, error: float = 0.01) -> DataFrame:
    """``bucket, bitmap``: a Bloom filter of a column's values other than null, as bitmaps of 32768 bits each; filters of equal size merge by ``bitmap_or_agg``."""
    depth, bits = bloom_size(expected, error)
    placed = df.where(F.col(column).isNotNull()).select(F.explode(F.array(*[_place(F.col(column), i, bits) for i in range(depth)])).alias("bit"))
    return placed.groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bitmap"))


def bloom_merged(*filters: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, filters).groupBy("bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))


def might_contain(filter_: DataFrame, values: DataFrame, column: str, expected: int, error: float = 0.01) -> DataFrame:
    """The distinct values that the filter may hold: all that it does, and ``error`` of the others or so."""
    depth, bits = bloom_size(expected, error)
    asked = values.select(column).distinct().select(column, F.explode(F.array(*[_place(F.col(column), i, bits) for i in range(depth)])).alias("bit"))
    at = F.bitmap_bit_position("bit")
    byte = F.conv(F.hex(F.substring("bitmap", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.floor(byte / F.pow(F.lit(2), at % 8)) % 2 == 1, F.lit(False))
    met = asked.withColumn("bucket", F.bitmap_bucket_number("bit")).join(filter_, "bucket", "left").select(column, hit.alias("hit"))
    return met.groupBy(column).agg(F.min("hit").alias("all_set")).where("all_set").select(column)


def draw(*columns: str, seed: int = 42) -> Column:
    """A number from 0 below 1 by a hash of the columns: the same for a row on every run, however the table is partitioned."""
    digest = F.md5(F.concat_ws("/", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns]).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / float(16**8)


def sample_share(df: DataFrame, share: float, keys: Sequence[str], seed: int = 42) -> DataFrame:
    """About ``share`` of the rows, by a hash of the key columns: one pass, no shuffle. Rows of equal keys are taken or left together."""
    return df.where(draw(*keys, seed=seed) < share)


def sample_rows(df: DataFrame, n: int, keys: Sequence[str], seed: int = 42) -> DataFrame:
    """The ``n`` rows of the least draws: each partition sends ``n`` rows at most."""
    return df.withColumn("__draw", draw(*keys, seed=seed)).orderBy("__draw", *keys).limit(n).drop("__draw")


def sample_blocks(df: DataFrame, share: float, order: str, block: int, seed: int = 42) -> DataFrame:
    """Whole blocks of ``block`` consecutive whole numbers of ``order``, about ``share`` of them; neighbours stay together, and the filter needs no shuffle."""
    blocks = df.withColumn("__block", F.floor(F.col(order) / block).cast("long"))
    return blocks.where(draw("__block", seed=seed) < share).drop("__block")


def sample_strata(df: DataFrame, by: str, n: int, keys: Sequence[str], seed: int = 42) -> DataFrame:
    """``n`` rows of each stratum, those of the least draws; strata of any size, since a window group limit keeps ``n`` rows of each before the shuffle."""
    place = F.row_number().over(Window.partitionBy(by).orderBy("__draw", *keys))
    return df.withColumn("__draw", draw(*keys, seed=seed)).withColumn("__place", place).where(F.col("__place") <= n).drop("__draw", "__place")


def reservoir(state: DataFrame | None, batch: DataFrame, n: int, keys: Sequence[str], seed: int = 42) -> DataFrame:
    """A running sample of ``n`` rows: that of the rows seen so far and a new batch, the same as if all had come at once."""
    return sample_rows(batch if state is None else state.unionByName(batch), n, keys, seed)


_BYTES: Mapping[str, int] = {"boolean": 1, "tinyint": 1, "smallint": 2, "int": 4, "bigint": 8, "float": 4, "double": 8, "date": 4, "timestamp": 8, "timestamp_ntz": 8}


def memory_estimate(df: DataFrame) -> DataFrame:
    """``column_name, bytes``: what a column's values take in memory: fixed sizes, the bytes of texts, 16 for anything else; one aggregation."""
    sizes = []
    for c, kind in df.dtypes:
        x = F.col(f"`{c}`")
        size = F.sum(F.octet_length(x).cast("long")) if kind in ("string", "binary") else F.count(x) * F.lit(_BYTES.get(kind, 16))
        sizes.append(F.struct(F.lit(c).alias("column_name"), F.coalesce(size.cast("long"), F.lit(0).cast("long")).alias("bytes")))
    return df.agg(F.array(*sizes).alias("s")).select(F.inline("s"))
