"""The corpus pipeline: each stage's documents are written as Parquet and read again as the next one's."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritab.llm import decontaminate, neardup, packing, substrings, toxicity
from veritab.llm.common import discard, scratch, stored
from veritab.llm.queries import tokenizer_path

#: The first stage learns from labels and the last one tokenizes, which SQL can't express.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.7."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(docs, labels, "doc_id", "text", "toxic")
    return toxicity.score(docs, model, "text").where("score < 0.7").select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: that with the smallest id, null ids last. Rows without words are no one's duplicates and stay.

    Rows are numbered first, so those that repeat an id, or have none, are documents of their own: no text goes because another one has its id.
    """
    row = F.struct(*[docs[c] for c in docs.columns]).alias("row")
    numbered = stored(docs.select(row, F.monotonically_increasing_id().alias("n")), "numbered")
    with scratch() as keep:
        found = neardup.near_duplicates(numbered.select("n", F.col("row.text").alias("text")), "n", "text").withColumnRenamed("component_id", "node")
        named = keep(stored(found.join(numbered.select("n", F.col("row.doc_id").alias("doc_id")), "n").select("n", "node", "doc_id"), "found"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "n"))
    groups = named.groupBy("node").agg(F.count("*").alias("size"), first["n"].alias("stays")).where("size > 1")
    gone = neardup.told(named, groups).where("n <> stays").select("n")
    return numbered.join(gone, "n", "left_anti").select("row.*")


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 35 words and more that occur elsewhere; those that hold nothing else go. Texts without such passages stay as they are."""
    out = substrings.remove_repeats(docs, "doc_id", "text").where("n_words = 0 or n_removed < n_words")
    changed = F.col("n_removed") > 0
    own = {"text": F.when(changed, F.col("kept_text")).otherwise(F.col("row.text")), "n_chars": F.when(changed, F.length("kept_text").cast("long")).otherwise(F.col("row.n_chars"))}
    return out.select(*[own.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no ten words of a benchmark item follow each other."""
    return decontaminate.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "doc_id", "text", "item_id", "text")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all documents' tokens in sequences of 1024."""
    return packing.pack(docs, "doc_id", "text", tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("substring_dedup", drop_repeated_passages),
    ("decontamination", drop_contaminated),
    ("best_fit_packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    last = None
    for name, stage in STAGES[:-1]:
        with scratch() as keep:
            docs = keep(stored(stage(spark, docs, sf_dir), name))
        if last is not None:
            discard(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
