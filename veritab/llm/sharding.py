"""Rendezvous hashing of stable record keys over weighted shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ranked

#: 13 hexadecimal digits of an MD5: a whole number below 2**52, exact as a double.
_DIGITS = 13


def _draw(key: Column, shard: int) -> Column:
    digest = F.md5(F.concat(key, F.lit(f"/{shard}")).cast("binary"))
    return F.conv(F.substring(digest, 1, _DIGITS), 16, 10).cast("double")


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard whose weighted draw for this key is best. A shard of weight 0 gets nothing; a shard added later takes keys only into itself.

    Each shard j draws u_j in (0, 1] from the key and j alone and bids -ln(u_j) / weight_j; the least bid wins, the lower shard on a tie.
    """
    bids = [
        F.struct((-F.log((_draw(key, j) + 1) / float(16**_DIGITS)) / float(w)).alias("bid"), F.lit(j).alias("shard"))
        for j, w in enumerate(weights)
        if w > 0
    ]
    if not bids:
        raise ValueError("no shard has a weight above 0")
    return F.array_min(F.array(*bids))["shard"] if len(bids) > 1 else bids[0]["shard"]


def shard_rows(df: DataFrame, id_col: str, text_col: str, weights: Sequence[float], grown: Sequence[float] | None = None) -> DataFrame:
    """``id_col``, ``size`` (UTF-8 bytes of the text, null none, plus 1), ``text_crc32``, ``shard``, ``slot`` and ``grown_shard`` of each row.

    ``slot`` counts the rows of a shard from 0 without gaps, in the order of a hash of id and text: ranges of the hash are ranked by tasks of their own (see `ranked`), so
    neither a large shard nor an id that many rows share is one task's work.

    A null id is a key of its own and goes to one shard; rows with equal ids share a shard and have slots of their own; a null text has size 1
    and the CRC of no bytes. An empty table gives no rows. Other columns are ignored, whatever their names. A text is read once, by one task.
    """
    key = F.coalesce(F.col("__id").cast("string"), F.lit(""))
    rows = df.select(F.col(id_col).alias("__id"), F.coalesce(F.encode(F.col(text_col), "UTF-8"), F.lit(b"")).alias("__bytes")).select(
        "__id", (F.octet_length("__bytes").cast("long") + 1).alias("__size"), F.crc32("__bytes").alias("__crc")
    )
    digest = F.md5(F.concat(key, F.lit("/"), F.col("__crc").cast("string"), F.lit("/slot")).cast("binary"))
    rows = rows.withColumn("__draw", F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")).withColumn("__shard", rendezvous(key, weights))
    grown_shard = rendezvous(key, grown) if grown else F.lit(None)
    return ranked(rows, "__shard", "__draw").select(
        F.col("__id").alias(id_col),
        F.col("__size").alias("size"),
        F.col("__crc").alias("text_crc32"),
        F.lit("key").alias("law"),
        F.col("__shard").cast("int").alias("shard"),
        F.col("__rank").cast("long").alias("slot"),
        grown_shard.cast("int").alias("grown_shard"),
    )
