"""A training corpus from documents: good ones, without copies and near copies, mixed by source, as piece ids."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sitequarry.llm import exact_dedup, mixing, near_dedup, pieces, quality
from sitequarry.llm.common import saved, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows whose text is predicted good. A null text is scored as an empty one; labels of no row, or of one class only, leave a
    score that is the same for all. Rows that repeat a doc_id stay if any of them does. No rows in, no rows out, here and in all stages."""
    return quality.good_documents(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (null: empty) the row with the largest doc_id; rows that repeat the doc_id of one that stays do too, and rows without a
    doc_id stay where their text occurs with none."""
    return exact_dedup.without_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that near copies link, that with the smallest doc_id. Texts without words, null ones among them, are near to nothing
    and stay; rows that repeat a doc_id are one document."""
    # 0.85 is the contract of op4 alone
    return near_dedup.without_near_copies(docs, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time that the mix takes a row, up to twice. A null source is a source; rows that repeat a doc_id are taken each by
    themselves; rows without words are taken with those around them."""
    return mixing.mixed(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per row of the mix: its ids, and the digest of what they decode to. Null and empty texts have no ids."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    return pieces.decoded(pieces.encoded(docs, path), path).drop("text")


#: All but the last return the columns of documents; the mix holds a row for each time that it takes a document.
STAGES = [
    ("quality classifier", keep_good),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("source mixing", mix_sources),
    ("pieces", encode_pieces),
]

#: SQL has no form for the classifier. The tests hold what each stage keeps on the smallest given tables against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
