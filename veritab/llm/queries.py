"""The operators over the whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, neardup, packing, quality, sharding, substrings, toxicity, transcripts, warc, wordpiece
from .oracles import ORACLES

SHARDS = 16


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), "doc_id", "text", "item_id", "text")


def op2_super_kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.remove_repeats(_table(spark, sf_dir, "documents"), "doc_id", "text")
    return out.select("row.doc_id", "n_words", "n_removed", "kept_sha256")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.clean_lines(_table(spark, sf_dir, "documents"), "doc_id", "text").drop("clean_text")


def op4_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"), "doc_id", "text")


def op5_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(_table(spark, sf_dir, "documents"), "doc_id", "text", [1.0] * SHARDS, [1.0] * (SHARDS + 1))


def op6_counterfactual_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.predictions(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), "doc_id", "text", "toxic")


def op7_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.round_trip(_table(spark, sf_dir, "pages"), "page_id", "url", "html")
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "fault")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), "doc_id", "text", tokenizer_path())


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordpiece.token_counts(_table(spark, sf_dir, "documents"), "doc_id", "text", wordpiece.byte_bpe_vocabulary(tokenizer_path()))


def op10_transcript_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations")
    pieces = turns.select("conv_id", "turn", transcripts.with_markers(F.col("text"), F.col("role"), F.col("turn")).alias("piece"))
    return transcripts.parse_transcripts(pieces, "conv_id", "turn", "piece")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_positional_index": op1_positional_index,
        "op2_super_kmers": op2_super_kmers,
        "op3_quality_rules": op3_quality_rules,
        "op4_chosen_path": op4_chosen_path,
        "op5_rendezvous_shards": op5_rendezvous_shards,
        "op6_counterfactual_toxicity": op6_counterfactual_toxicity,
        "op7_warc_round_trip": op7_warc_round_trip,
        "op8_best_fit_packing": op8_best_fit_packing,
        "op9_token_counts": op9_token_counts,
        "op10_transcript_roles": op10_transcript_roles,
    }


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
