"""Token counts: an exact histogram of encoded lengths.

Documents are counted by their number of tokens. Running sums over the histogram,
from the longest length down, then answer for every context limit how many
documents and tokens there are, how many exceed the limit, how many tokens are left
when each document is cut at the limit, and at what length any quantile lies.

Every document counts, with all of its text. A null or empty text has no tokens and
counts as length 0. Repeated rows count each. An empty table gives an empty
histogram.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderlens.llm.bpe import token_counts

# Lengths that one task sums at a time.
_BLOCK_LENGTHS = 4096


def length_histogram(
    docs: DataFrame, path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """``n_tokens`` and ``n_docs``, a row per length that occurs."""
    return token_counts(docs, path, pattern, id_column, text_column).groupBy("n_tokens").agg(
        F.count(F.lit(1)).alias("n_docs")
    )


def length_totals(histogram: DataFrame) -> DataFrame:
    """Per length: documents and tokens of greater length (``docs_over``, ``tokens_over``) and in total.

    Sums run within blocks of lengths; the sums of later blocks, a row per block, are
    added. ``histogram`` is read twice.
    """
    lengths = histogram.withColumns(
        {"tokens": F.col("n_tokens") * F.col("n_docs"), "block": F.floor(F.col("n_tokens") / _BLOCK_LENGTHS)}
    )
    later = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.col("block").desc()).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    sums = {"docs": F.sum("n_docs"), "tokens": F.sum("tokens")}
    blocks = (
        lengths.groupBy("block")
        .agg(*[total.alias(f"block_{name}") for name, total in sums.items()])
        .select(
            "block",
            *[F.coalesce(F.sum(f"block_{n}").over(later), F.lit(0)).alias(f"later_{n}") for n in sums],
            *[F.sum(f"block_{n}").over(everything).alias(f"total_{n}") for n in sums],
        )
    )
    longer = (
        Window.partitionBy("block").orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, -1)
    )
    over = {n: F.col(f"later_{n}") + F.coalesce(total.over(longer), F.lit(0)) for n, total in sums.items()}
    return lengths.join(blocks, "block").select(
        "n_tokens",
        "n_docs",
        over["docs"].alias("docs_over"),
        over["tokens"].alias("tokens_over"),
        "total_docs",
        "total_tokens",
    )


def context_limits(histogram: DataFrame) -> DataFrame:
    """For each length that occurs, as a context limit: what fits, what is cut, and its quantile.

    ``tokens_within`` counts each document's tokens up to the limit; between two
    lengths it grows by ``docs_over`` per token, so these rows answer every limit.
    """
    cut = F.col("tokens_over") - F.col("n_tokens") * F.col("docs_over")
    return length_totals(histogram).select(
        F.col("n_tokens").alias("context_limit"),
        "n_docs",
        "docs_over",
        (F.col("total_docs") - F.col("docs_over")).alias("docs_within"),
        (F.col("total_tokens") - cut).alias("tokens_within"),
        cut.alias("tokens_cut"),
        "total_tokens",
        ((F.col("total_docs") - F.col("docs_over")) / F.col("total_docs")).alias("quantile"),
    )


def at_limit(limits: DataFrame, limit: int) -> DataFrame:
    """Documents and tokens within any one limit, from ``context_limits``: one row, or none if empty."""
    nearest = limits.where(F.col("context_limit") <= limit).agg(
        F.max(F.struct("context_limit", "docs_within", "docs_over", "tokens_within")).alias("at")
    )
    total = limits.agg(F.max("docs_within").alias("all_docs"))
    within: Column = F.col("at.tokens_within") + (F.lit(limit) - F.col("at.context_limit")) * F.col("at.docs_over")
    # Below the shortest length every document is cut.
    return (
        total.join(nearest, F.lit(True))
        .where(F.col("all_docs").isNotNull())
        .select(
            F.lit(limit).cast("long").alias("context_limit"),
            F.coalesce("at.docs_within", F.lit(0)).cast("long").alias("docs_within"),
            F.coalesce(within, F.lit(limit) * F.col("all_docs")).cast("long").alias("tokens_within"),
        )
    )


def length_quantiles(limits: DataFrame, shares: Sequence[float]) -> DataFrame:
    """The smallest length that at least each share of the documents do not exceed."""
    one = [
        F.min(F.when(F.col("quantile") >= share, F.col("context_limit"))).alias(f"p{share * 100:g}") for share in shares
    ]
    return limits.agg(*one)
