"""A training corpus from raw documents, in stages.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept and
returns a DataFrame, which is written as Parquet and read again by the next. All but
the last return the columns of `documents`.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from smeltry.llm import decontaminate, jaccard_join, quality_rules, sentence_pieces, substring_dedup
from smeltry.llm.common import small_batches, table, written


def keep_by_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go, by the base rule or by rules learned from the labels."""
    small_batches(spark)
    return quality_rules.kept_documents(docs, table(spark, sf_dir, "labels"))


def keep_one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents the one of the smallest doc_id stays."""
    return jaccard_join.one_of_each(docs)


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has too are cut out; documents left empty go."""
    small_batches(spark)
    return substring_dedup.kept_documents(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit, with begin and end) and checksums of ids and decoded text."""
    small_batches(spark)
    rows = sentence_pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"), decoded=True)
    return rows.select("doc_id", *sentence_pieces.digest_columns(), "ids")


STAGES = [
    ("quality rules", keep_by_quality),
    ("n-gram Jaccard join", keep_one_of_similar),
    ("substring dedup", remove_repeats),
    ("benchmark decontamination", remove_benchmark),
    ("SentencePiece encoding and decoding", encode_pieces),
]

#: Learned rules and piece encoding can't be expressed in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs)
    return docs
