"""From raw documents to a filtered, deduplicated, mixed and tokenised corpus."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderlens.llm import bpe, exact_dedup, fertility, mixing, ngram_join
from orderlens.llm.common import documents
from orderlens.llm.queries import PIECES, RANKS, SEED
from orderlens.sources.catalog import stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules accept."""
    return fertility.accepted(docs, public_tokenizers.path(PIECES))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the smallest doc_id."""
    return exact_dedup.keep_first(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that similarity links connect, the row with the smallest doc_id."""
    return ngram_join.one_row_of_each_class(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed to target weights: some documents left out, some repeated."""
    return mixing.mixed(docs, SEED)


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document of the mix, and whether they decode to its text."""
    return bpe.encoded(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN).select(
        "doc_id",
        "lang",
        "source",
        F.size("ids").cast("long").alias("n_tokens"),
        "ids",
        (F.col("bytes") == F.coalesce("text", F.lit("")).cast("binary")).alias("round_trip"),
    )


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality_stage),
    ("exact dedup", exact_dedup_stage),
    ("n-gram Jaccard join", near_dedup_stage),
    ("mixing sources to target weights", mix_stage),
    ("byte-level BPE encoding and decoding", encode_stage),
]

# SQL can't express the tokenizer rules, the similarity join and the encoder.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each result is written and read by the next."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
