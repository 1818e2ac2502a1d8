"""Exact duplicates by sorting contents.

Sampled splitters deal the normalised texts to ranges, an external sort puts equal
texts next to each other, and a pass over neighbours, comparing whole texts, keeps
the row with the smallest identifier.

Texts are equal when they are identical after each run of space, tab, line feed,
vertical tab, form feed and carriage return became one space. Null is an empty
text. A null identifier comes after all others. Rows equal in identifier and text
are copies too: one of them stays. Any other columns may have any name; an empty
table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlens.llm.common import SPACES, id_text, whole_text
from orderlens.sources.catalog import stored

# A text with more copies than a slice is sorted in slices of this many rows, or of
# this share of all rows if that is more. So at most 100,000 texts are ever listed.
SLICE_ROWS = 1000
MOST_LISTED = 100_000

# Splitters are sampled from this many characters and a hash, never from whole texts.
_HEAD_CHARACTERS = 32


def normalised(text: str | Column) -> Column:
    return F.regexp_replace(whole_text(text), f"[{SPACES}]+", " ")


def _fingerprints(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    return docs.select(F.col(id_column).alias("id"), normalised(text_column).alias("norm")).select(
        "id", F.unhex(F.sha2("norm", 256)).alias("sha"), F.xxhash64("norm").alias("hash")
    )


def row_hash(id_column: str) -> Column:
    """A number that spreads rows, also those with one identifier, over slices. Any slice is right for a row."""
    return F.xxhash64(id_text(id_column), F.monotonically_increasing_id())


def _sorted_groups(docs: DataFrame, id_column: str, text_column: str, hashes: DataFrame, kept: Column) -> DataFrame:
    """One row per text: ``kept`` of its smallest identifier as ``kept``, and its number of rows as ``size``.

    ``hashes`` has the hash of every row. A text with very many copies is dealt to
    several ranges by row, as identifiers may be null or repeat; what is left of it, a row per slice, is compared
    in a second, small step.
    """
    rows = hashes.count()
    slice_rows = max(SLICE_ROWS, math.ceil(rows / MOST_LISTED))
    # At most MOST_LISTED rows, as each stands for more than slice_rows of all rows.
    listed = (
        hashes.groupBy("hash")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > slice_rows)
        .select("hash", F.ceil(F.col("n") / slice_rows).alias("slices"))
    )
    first = F.struct(F.col(id_column).isNull().alias("no_id"), F.col(id_column).alias("id"))
    contents = (
        docs.select(
            first.alias("first"),
            row_hash(id_column).alias("row_hash"),
            F.xxhash64(whole_text(text_column)).alias("text_hash"),
            kept.alias("kept"),
            normalised(text_column).alias("norm"),
        )
        .withColumns({"head": F.substring("norm", 1, _HEAD_CHARACTERS), "hash": F.xxhash64("norm")})
        .join(F.broadcast(listed), "hash", "left")
        .withColumn("slice", F.when(F.col("slices").isNotNull(), F.pmod("row_hash", "slices")))
        .drop("slices", "row_hash")
    )
    content = ["head", "hash", "slice", "norm"]
    ordered = contents.repartitionByRange("head", "hash", "slice").sortWithinPartitions(*content, "first")
    order = F.struct("first", "text_hash")
    slices = stored(
        ordered.groupBy(*content)
        .agg(F.min_by(F.struct("kept", order.alias("order")), order).alias("best"), F.count(F.lit(1)).alias("size"))
        # The text is needed again only where its slices meet.
        .select("best", "size", F.when(F.col("slice").isNotNull(), F.col("norm")).alias("norm")),
        "content-groups",
    )
    met = (
        slices.where(F.col("norm").isNotNull())
        .groupBy("norm")
        .agg(F.min_by("best", F.col("best.order")).alias("best"), F.sum("size").alias("size"))
    )
    whole = slices.where(F.col("norm").isNull()).select("best", "size")
    return whole.unionByName(met.select("best", "size")).select("best.kept", "size")


def exact_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """For each row: ``keep_id``, ``group_size``, ``kept`` and ``text_sha256`` of its normalised text."""
    prints = stored(_fingerprints(docs, id_column, text_column), "content-prints")
    kept = F.struct(F.col(id_column).alias("id"), F.unhex(F.sha2(normalised(text_column), 256)).alias("sha"))
    groups = (
        _sorted_groups(docs, id_column, text_column, prints.select("hash"), kept)
        .where(F.col("size") > 1)
        .select(F.col("kept.sha").alias("sha"), F.col("kept.id").alias("keep_id"), "size")
    )
    # Repeated rows are counted, joined once and told apart again.
    distinct = prints.groupBy("id", "sha").agg(F.count(F.lit(1)).alias("times"))
    in_group = F.col("size").isNotNull()
    return (
        distinct.join(groups, "sha", "left")
        .withColumn("repeat", F.explode(F.sequence(F.lit(1).cast("long"), "times")))
        .select(
            F.col("id").alias(id_column),
            F.when(in_group, F.col("keep_id")).otherwise(F.col("id")).alias("keep_id"),
            F.when(in_group, F.col("size")).otherwise(F.lit(1).cast("long")).alias("group_size"),
            (
                ~in_group | (F.col("keep_id").eqNullSafe(F.col("id")) & (F.col("repeat") == 1))
            ).alias("kept"),
            F.lower(F.hex("sha")).alias("text_sha256"),
        )
    )


def keep_first(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows that stay, with all their columns."""
    hashes = stored(docs.select(F.xxhash64(normalised(text_column)).alias("hash")), "content-hashes")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return _sorted_groups(docs, id_column, text_column, hashes, row).select("kept.*")
