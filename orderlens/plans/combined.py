"""Several reports from one aggregate of the order facts.

Score, whole days and seller group take few values each, so the facts of all orders
shrink to a count per combination. Buckets, rates, means and percentiles of the reports
that use nothing else come from these counts: one scan of the facts serves them all.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlens.constants import BAD_MAX, BUCKET_BOUNDS
from orderlens.functions.measures import ascending, delivery_bucket, percent, ratio
from orderlens.operators.percentiles import weighted_percentile

CELL = ["is_reviewed", "review_score", "seller_group", "delivery_days", "delivery_delay_days"]

REPORTS = (
    "headline_kpis",
    "delivery_bucket_bad_reviews",
    "multi_seller_by_bucket",
    "score_vs_delivery_days",
    "score_vs_delay",
    "late_vs_on_time",
    "seller_group_median_days",
)


def satisfaction_counts(facts: DataFrame) -> DataFrame:
    """Clean orders per score, seller group (NULL without items), delivery days and delay; ``rows`` counts them.

    ``facts`` has one row per clean order.
    """
    return facts.groupBy(*CELL).agg(F.count("*").alias("rows"))


def _rates(bad_max: int) -> list[Column]:
    rows = F.sum("rows")
    bad = F.sum(F.when(F.col("review_score") <= bad_max, F.col("rows")).otherwise(0))
    return [rows.alias("order_count"), bad.alias("bad_reviews"), percent(bad, rows).alias("bad_review_pct")]


def _mean(value: str, scale: int) -> Column:
    total = F.sum(F.col(value).cast("long") * F.col("rows"))
    return ratio(total, F.sum(F.when(F.col(value).isNotNull(), F.col("rows"))), scale)


def _by_bucket(counts: DataFrame, bounds: Sequence[int], bad_max: int, *extra: str) -> DataFrame:
    bucket = delivery_bucket(F.col("delivery_days"), bounds).alias("delivery_bucket")
    return counts.groupBy(bucket, *extra).agg(*_rates(bad_max)).orderBy(*ascending("delivery_bucket", *extra))


def _by_score(counts: DataFrame, column: str, suffix: str) -> DataFrame:
    return (
        counts.groupBy("review_score", column)
        .agg(F.sum("rows").alias("rows"))
        .groupBy("review_score")
        .agg(
            F.sum("rows").alias("order_count"),
            _mean(column, 1).alias(f"avg_{suffix}"),
            weighted_percentile(column, 0.5).alias(f"median_{suffix}"),
        )
        .orderBy(*ascending("review_score"))
    )


def _late_vs_on_time(counts: DataFrame) -> DataFrame:
    status = F.when(F.col("delivery_delay_days") > 0, "Late").otherwise("On Time or Early")
    return (
        counts.groupBy(status.alias("delivery_status"))
        .agg(F.sum("rows").alias("order_count"), _mean("review_score", 2).alias("avg_review_score"))
        .orderBy(*ascending("delivery_status"))
    )


def _headline_kpis(counts: DataFrame, bad_max: int) -> DataFrame:
    reviewed = F.when(F.col("is_reviewed"), F.col("rows")).otherwise(0)
    bad = F.when(F.col("review_score") <= bad_max, F.col("rows")).otherwise(0)
    by_days = counts.groupBy("delivery_days").agg(
        F.sum("rows").alias("rows"), F.sum(reviewed).alias("reviewed"), F.sum(bad).alias("bad")
    )
    return by_days.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("orders_analyzed"),
        F.coalesce(F.sum("reviewed"), F.lit(0)).alias("reviewed_orders"),
        weighted_percentile("delivery_days", 0.5, F.col("reviewed")).alias("median_delivery_days"),
        percent(F.sum("bad"), F.sum("reviewed")).alias("bad_review_pct"),
    )


def _seller_group_median_days(counts: DataFrame) -> DataFrame:
    return (
        counts.groupBy("seller_group", "delivery_days")
        .agg(F.sum("rows").alias("rows"))
        .groupBy("seller_group")
        .agg(F.sum("rows").alias("order_count"), weighted_percentile("delivery_days", 0.5).alias("median_delivery_days"))
        .orderBy(*ascending("seller_group"))
    )


def reports_from_counts(
    counts: DataFrame, bounds: Sequence[int] = BUCKET_BOUNDS, bad_max: int = BAD_MAX
) -> dict[str, Callable[[], DataFrame]]:
    """The reports that need nothing but the counts, equal to the jobs of the same names."""
    reviewed = counts.where("is_reviewed")
    with_items = reviewed.where("seller_group IS NOT NULL")
    return {
        "headline_kpis": lambda: _headline_kpis(counts, bad_max),
        "delivery_bucket_bad_reviews": lambda: _by_bucket(reviewed, bounds, bad_max),
        "multi_seller_by_bucket": lambda: _by_bucket(with_items, bounds, bad_max, "seller_group"),
        "score_vs_delivery_days": lambda: _by_score(reviewed, "delivery_days", "delivery_days"),
        "score_vs_delay": lambda: _by_score(reviewed, "delivery_delay_days", "delay_days"),
        "late_vs_on_time": lambda: _late_vs_on_time(reviewed),
        "seller_group_median_days": lambda: _seller_group_median_days(with_items),
    }
