"""Exact, interpolated percentiles that start from value counts.

Both functions take a frame of (groups..., value, rows) with one row per
distinct value. Building it is a hash aggregate with a map-side combine, so a
group that holds most of the rows has shrunk to its distinct values before
anything is shuffled.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def value_counts(df: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """Rows per distinct value in each group, as column ``rows``."""
    return df.groupBy(*groups, value).agg(F.count("*").alias("rows"))


def weighted_percentile(value: str, p: float, rows: Column | None = None) -> Column:
    """Aggregate for a value whose set of distinct values is small.

    The buffer is a map of distinct values. That suits whole days (bounded by
    the calendar) and orders per seller: k distinct volumes need at least
    k(k+1)/2 orders, so 10^12 orders give at most 1.5 million of them.
    """
    return F.percentile(value, p, F.col("rows") if rows is None else rows)


def selected_percentiles(
    counts: DataFrame,
    groups: Sequence[str],
    value: str,
    probabilities: Mapping[str, float],
    bits: int = 16,
) -> DataFrame:
    """Percentiles of a whole-number value with any number of distinct values.

    No task has to hold all distinct values of a group. Ranks are first located
    among ranges of 2^bits neighbouring values, then only the ranges that hold a
    wanted rank are ordered value by value. A task therefore sees the ranges of
    one group, or the at most 2^bits values of one range.
    """
    number = F.col(value).cast("long")
    # A NULL value has no weight. A filter would do the same, but Spark would move
    # it below the counts, whose shuffle could then not be shared with a report.
    present = counts.select(
        *groups,
        number.alias("_value"),
        (F.col("rows") * number.isNotNull().cast("long")).alias("_rows"),
        F.coalesce(F.shiftright(number, bits), F.lit(0)).alias("_range"),
    )
    in_group = Window.partitionBy(*groups)
    up_to_range = in_group.orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranges = (
        present.groupBy(*groups, "_range")
        .agg(F.sum("_rows").alias("_rows"))
        .select(
            *groups,
            "_range",
            (F.sum("_rows").over(up_to_range) - F.col("_rows")).alias("_before"),
            F.sum("_rows").over(up_to_range).alias("_through"),
            F.sum("_rows").over(in_group).alias("_total"),
        )
    )

    def position(p: float) -> Column:
        return F.lit(float(p)) * (F.col("_total") - 1)

    ranks = F.array_distinct(
        F.array(*[edge(position(p)).cast("long") for p in probabilities.values() for edge in (F.floor, F.ceil)])
    )

    def ranks_between(wanted: Column, first: Column, end: Column) -> Column:
        return F.filter(wanted, lambda rank: (rank >= first) & (rank < end))

    wanted = ranges.select(
        *[F.col(g).alias(f"_wanted_{g}") for g in groups],
        F.col("_range").alias("_wanted_range"),
        "_before",
        "_total",
        ranks_between(ranks, F.col("_before"), F.col("_through")).alias("_ranks"),
    ).where(F.size("_ranks") > 0)

    # Groups may be NULL (orders without a score), hence the null-safe equality.
    same_range = F.col("_range") == F.col("_wanted_range")
    for g in groups:
        same_range = same_range & F.col(g).eqNullSafe(F.col(f"_wanted_{g}"))
    up_to_value = (
        Window.partitionBy(*groups, "_range")
        .orderBy("_value")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    located = (
        present.join(wanted, same_range)
        .withColumn("_end", F.col("_before") + F.sum("_rows").over(up_to_value))
        .select(
            *groups,
            "_value",
            "_total",
            F.explode(ranks_between(F.col("_ranks"), F.col("_end") - F.col("_rows"), F.col("_end"))).alias("_rank"),
        )
    )

    def at(rank: Column) -> Column:
        return F.max(F.when(F.col("_rank") == rank.cast("long"), F.col("_value"))).cast("double")

    def interpolated(p: float) -> Column:
        low, high = at(F.floor(position(p))), at(F.ceil(position(p)))
        total = F.max("_total")
        offset = F.lit(float(p)) * (total - 1)
        return low + (high - low) * (offset - F.floor(offset))

    return located.groupBy(*groups).agg(*[interpolated(p).alias(name) for name, p in probabilities.items()])
