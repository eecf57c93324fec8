"""Registered queries of this package: ``name -> (spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from . import (bpe, bwt_dedup, chat_pairs, collocations, decontam, hard_negatives, pii, quality_rules, secret_scan,
               simhash_vptree, template, token_counts, warc)

VOCABULARY = "byte_bpe_50k.tiktoken"
TOKENIZER = "byte_bpe_50k.json"

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def preference_turns(conversations: DataFrame) -> DataFrame:
    """Stand-in preference pairs: each conversation as chosen; as rejected its first
    turns, none to four, and from there on the turns of the next conversation."""
    row = conversations.select(F.col("conv_id").alias("pair_id"), "turn", "role", "text")
    own = row.where(F.col("turn") < F.col("pair_id") % 5)
    pairs = row.select("pair_id").distinct()
    other = (row.withColumn("pair_id", F.col("pair_id") - 1).join(pairs, "pair_id", "left_semi")
             .where(F.col("turn") >= F.col("pair_id") % 5))
    return row.withColumn("side", F.lit("chosen")).unionByName(own.unionByName(other).withColumn("side", F.lit("rejected")))


def op2_chat_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = chat_pairs.preference_pairs(preference_turns(_table(spark, sf_dir, "conversations")))
    return pairs.withColumns({c: chat_pairs.mask_text(F.col(c)) for c in ("chosen_mask", "rejected_mask")})


def op3_simhash_vptree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_vptree.near_duplicates(_table(spark, sf_dir, "documents"))


def op4_html_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return template.extracted(_table(spark, sf_dir, "pages"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_bwt_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bwt_dedup.without_repeats(_table(spark, sf_dir, "documents")).drop("removed")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(_table(spark, sf_dir, "documents"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secrets(_table(spark, sf_dir, "documents"))


def op10_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    wrong = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(_table(spark, sf_dir, "embeddings").withColumn("label", wrong), F.col("vec_id") % 50 == 0)


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {
        "op1_quality_rules": op1_quality_rules,
        "op2_chat_pairs": op2_chat_pairs,
        "op3_simhash_vptree": op3_simhash_vptree,
        "op4_html_template": op4_html_template,
        "op5_byte_bpe": op5_byte_bpe,
        "op6_decontamination": op6_decontamination,
        "op7_bwt_dedup": op7_bwt_dedup,
        "op8_pii": op8_pii,
        "op9_secret_scan": op9_secret_scan,
        "op10_warc_bundles": op10_warc_bundles,
        "op11_token_counts": op11_token_counts,
        "op12_hard_negatives": op12_hard_negatives,
        "op13_collocations": op13_collocations,
        "pipeline": corpus_pipeline.run,
    }
