"""The text operators over the sample tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderlens.llm import (
    bpe,
    exact_dedup,
    fertility,
    lexical_search,
    license_scan,
    main_text,
    mixing,
    ngram_join,
    sharding,
    site_bayes,
    spelling,
    token_lengths,
    toxicity,
)
from orderlens.llm.common import documents
from orderlens.sources.catalog import stored

PIECES = "piece_bpe_32k.model"
RANKS = "byte_bpe_multi_50k.tiktoken"
SEED = 7
SHARDS = 16


def op1_ngram_join(spark: SparkSession, directory: str) -> DataFrame:
    return ngram_join.similar_classes(documents(spark, directory))


def op2_exact_dedup(spark: SparkSession, directory: str) -> DataFrame:
    return exact_dedup.exact_duplicates(documents(spark, directory))


def op3_license_scan(spark: SparkSession, directory: str) -> DataFrame:
    return license_scan.licenses(license_scan.license_spans(documents(spark, directory)))


def op4_fertility(spark: SparkSession, directory: str) -> DataFrame:
    return fertility.quality(documents(spark, directory), public_tokenizers.path(PIECES))


def op5_site_bayes(spark: SparkSession, directory: str) -> DataFrame:
    labels = spark.read.parquet(f"{directory}/labels.parquet")
    # A source stands for a host, its languages for the paths below it.
    path = F.concat_ws("/", "source", "lang")
    return site_bayes.site_quality(documents(spark, directory), labels, F.col("source"), path)


def op6_byte_bpe(spark: SparkSession, directory: str) -> DataFrame:
    ranks = public_tokenizers.path(RANKS), public_tokenizers.PATTERN
    return bpe.encoded(documents(spark, directory).select("doc_id", "text"), *ranks).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )


def op7_token_lengths(spark: SparkSession, directory: str) -> DataFrame:
    histogram = token_lengths.length_histogram(
        documents(spark, directory), public_tokenizers.path(RANKS), public_tokenizers.PATTERN
    )
    return token_lengths.context_limits(stored(histogram, "token-lengths"))


def op8_mixing(spark: SparkSession, directory: str) -> DataFrame:
    return mixing.systematic_copies(documents(spark, directory), SEED).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken")
    )


def op9_toxicity(spark: SparkSession, directory: str) -> DataFrame:
    labels = spark.read.parquet(f"{directory}/labels.parquet")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    scored = toxicity.toxicity(documents(spark, directory), labels, ~held_out)
    return scored.select(
        # A row without an identifier is neither learnt from nor held out.
        "doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op10_sharding(spark: SparkSession, directory: str) -> DataFrame:
    tree, grown = sharding.default_tree(SHARDS), sharding.default_tree(SHARDS + 1)
    return sharding.shards_by_key(documents(spark, directory), tree, grown)


def op11_spelling(spark: SparkSession, directory: str) -> DataFrame:
    return spelling.variants(documents(spark, directory))


def op12_main_text(spark: SparkSession, directory: str) -> DataFrame:
    pages = spark.read.parquet(f"{directory}/pages.parquet")
    return main_text.extracted(pages).select("page_id", "url", "text", "n_chars")


def op13_lexical_search(spark: SparkSession, directory: str) -> DataFrame:
    items = spark.read.parquet(f"{directory}/benchmark.parquet")
    return lexical_search.ranked(documents(spark, directory), items)


def llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ngram_join": op1_ngram_join,
        "op2_exact_dedup": op2_exact_dedup,
        "op3_license_scan": op3_license_scan,
        "op4_fertility": op4_fertility,
        "op5_site_bayes": op5_site_bayes,
        "op6_byte_bpe": op6_byte_bpe,
        "op7_token_lengths": op7_token_lengths,
        "op8_mixing": op8_mixing,
        "op9_toxicity": op9_toxicity,
        "op10_sharding": op10_sharding,
        "op11_spelling": op11_spelling,
        "op12_main_text": op12_main_text,
        "op13_lexical_search": op13_lexical_search,
    }
