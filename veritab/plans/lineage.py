"""Shared storage: cutting the lineage of tables that are built up in rounds, and folders for what is written on the way."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def in_one_process(spark: SparkSession) -> bool:
    """Whether tasks run in the driver's process, as in local mode."""
    return bool(re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master))


def folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where that is unset, a temporary one in local mode; on a cluster, whose machines don't share one, an error."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if known:
        return known
    if not in_one_process(spark):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
    made = f"file://{tempfile.mkdtemp(prefix='veritab-')}"
    spark.sparkContext.setCheckpointDir(made)
    return made


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` as a reliable checkpoint, so that a round's plan doesn't hold all rounds before."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder(df.sparkSession))
    return df.checkpoint()
