"""Registered queries of this folder and their SQL counterparts."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitequarry.llm import (
    exact_dedup, line_dedup, mixing, near_dedup, negatives, neighbours, packing, pieces, quality, suffix_dedup, token_records, warc, whitening,
)
from sitequarry.llm.common import table


def op1_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality_scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op2_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.line_dedup(table(spark, folder, "documents")).drop("kept_text")


def op3_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.archived(table(spark, folder, "pages")).drop("url", "payload")


def op4_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_dedup.near_components(table(spark, folder, "documents"))


def op5_pieces(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("piece_bpe_32k.model")
    return pieces.decoded(pieces.encoded(table(spark, folder, "documents"), path), path).drop("ids", "text")


def op6_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, folder, "documents"))


def op7_token_records(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    return token_records.token_records(table(spark, folder, "documents"), path).drop("ids")


def op8_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_plan(table(spark, folder, "documents")).drop("shards")


def op9_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.neighbours(table(spark, folder, "embeddings"))


def op10_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(table(spark, folder, "documents"))


def op11_packing(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return packing.packed(table(spark, folder, "documents"), path)[1].drop("row")


def op12_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.components_of(table(spark, folder, "embeddings"))


def op13_negatives(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(vectors.select("vec_id", "embedding", label.alias("label")))


QUERIES = {
    "op1_quality": op1_quality,
    "op2_line_dedup": op2_line_dedup,
    "op3_warc": op3_warc,
    "op4_near_dedup": op4_near_dedup,
    "op5_pieces": op5_pieces,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_token_records": op7_token_records,
    "op8_mixing": op8_mixing,
    "op9_neighbours": op9_neighbours,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_packing": op11_packing,
    "op12_whitening": op12_whitening,
    "op13_negatives": op13_negatives,
}

ORACLES = {
    "op2_line_dedup": line_dedup.SQL,
    "op3_warc": warc.SQL,
    "op6_exact_dedup": exact_dedup.SQL,
    "op8_mixing": mixing.SQL,
    "op13_negatives": negatives.SQL,
}
