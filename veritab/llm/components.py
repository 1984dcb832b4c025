"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored


def components(links: DataFrame, max_steps: int = 60) -> DataFrame:
    """``v, component`` for each end of the links ``a, b``: the smallest id that it reaches. Ends without a link are not in it.

    Every step is a grouped minimum and a join with one row on its other side; the number of steps grows with the logarithm of the longest path. Nothing but a row count
    and a checksum comes to the driver. Raises if ``max_steps`` pairs of steps don't suffice.
    """
    edges = stored(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("w")).distinct(), "edges")
    before = None
    for _ in range(max_steps):
        both = edges.union(edges.select(F.col("w").alias("u"), F.col("u").alias("w")))
        least = both.groupBy("u").agg(F.least("u", F.min("w")).alias("m"))
        large = both.where("w > u").join(least, "u").select(F.col("w").alias("u"), F.col("m").alias("w")).where("u <> w").distinct()
        down = large.groupBy("u").agg(F.min("w").alias("m"))
        small = large.join(down, "u").where("w <> m").select(F.col("w").alias("u"), F.col("m").alias("w")).union(down.select("u", F.col("m").alias("w")))
        old, edges = edges, stored(small.distinct(), "edges")
        discard(old)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "w").cast("decimal(38,0)"))).first()
        if now == before:
            tops = edges.select(F.col("w").alias("v"), F.col("w").alias("component")).distinct()
            return edges.select(F.col("u").alias("v"), F.col("w").alias("component")).union(tops)
        before = now
    raise RuntimeError("components: no end after max_steps")
