"""Reports on scores, delivery time and delay.

Whole days have few distinct values. So each report first counts rows per
distinct value in a hash aggregate, and takes percentiles of those counts.
``reviewed`` is the output of ``operators.clean.reviewed_orders``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlens.constants import BAD_MAX, BUCKET_BOUNDS
from orderlens.functions.measures import ascending, delivery_bucket, percent, ratio
from orderlens.operators.percentiles import value_counts, weighted_percentile
from orderlens.operators.quality import share_of_total

QUARTILES_AND_P90 = {"p25": 0.25, "median": 0.50, "p75": 0.75, "p90": 0.90}


def is_bad(bad_max: int = BAD_MAX) -> Column:
    return F.col("review_score") <= bad_max


def _mean_of_counts(value: str, scale: int) -> Column:
    """Mean of a whole-number value that comes with a ``rows`` count."""
    total = F.sum(F.col(value).cast("long") * F.col("rows"))
    return ratio(total, F.sum(F.when(F.col(value).isNotNull(), F.col("rows"))), scale)


def review_score_distribution(scores: DataFrame) -> DataFrame:
    """Orders per score, and their percentage of all."""
    return share_of_total(scores, "review_score", "review_count", ascending("review_score"))


def distribution(
    clean: DataFrame, column: str, suffix: str, probabilities: Mapping[str, float] = QUARTILES_AND_P90
) -> DataFrame:
    """Minimum, maximum, mean and percentiles of a whole-day column."""
    return value_counts(clean, [], column).agg(*_distribution(column, suffix, probabilities))


def _distribution(column: str, suffix: str, probabilities: Mapping[str, float]) -> list[Column]:
    return [
        F.min(column).alias(f"min_{suffix}"),
        F.max(column).alias(f"max_{suffix}"),
        _mean_of_counts(column, 1).alias(f"avg_{suffix}"),
        *[weighted_percentile(column, p).alias(name) for name, p in probabilities.items()],
    ]


def delivery_days_distribution(clean: DataFrame) -> DataFrame:
    return distribution(clean, "delivery_days", "days")


def delivery_delay_distribution(clean: DataFrame) -> DataFrame:
    """As the delivery days, with the number of late and of on-time or early orders."""
    delay, rows = F.col("delivery_delay_days"), F.col("rows")
    return value_counts(clean, [], "delivery_delay_days").agg(
        *_distribution("delivery_delay_days", "delay", QUARTILES_AND_P90),
        F.sum(F.when(delay > 0, rows).otherwise(0)).alias("late_orders"),
        F.sum(F.when(delay <= 0, rows).otherwise(0)).alias("on_time_or_early_orders"),
    )


def late_vs_on_time(reviewed: DataFrame) -> DataFrame:
    """Orders and mean score of late orders against the rest; late means a whole day or more."""
    status = F.when(F.col("delivery_delay_days") > 0, "Late").otherwise("On Time or Early")
    return (
        reviewed.groupBy(status.alias("delivery_status"))
        .agg(
            F.count("*").alias("order_count"),
            ratio(F.sum("review_score"), F.count("review_score"), 2).alias("avg_review_score"),
        )
        .orderBy(*ascending("delivery_status"))
    )


def by_score(reviewed: DataFrame, column: str, suffix: str) -> DataFrame:
    """Per score: orders, mean and median of a whole-day column."""
    return (
        value_counts(reviewed, ["review_score"], column)
        .groupBy("review_score")
        .agg(
            F.sum("rows").alias("order_count"),
            _mean_of_counts(column, 1).alias(f"avg_{suffix}"),
            weighted_percentile(column, 0.5).alias(f"median_{suffix}"),
        )
        .orderBy(*ascending("review_score"))
    )


def score_vs_delivery_days(reviewed: DataFrame) -> DataFrame:
    return by_score(reviewed, "delivery_days", "delivery_days")


def score_vs_delay(reviewed: DataFrame) -> DataFrame:
    return by_score(reviewed, "delivery_delay_days", "delay_days")


def bad_review_columns(bad_max: int) -> list[Column]:
    """Orders, bad reviews and bad-review percentage of a group of orders."""
    bad = F.sum(F.when(is_bad(bad_max), 1).otherwise(0))
    return [
        F.count("*").alias("order_count"),
        bad.alias("bad_reviews"),
        percent(bad, F.count("*")).alias("bad_review_pct"),
    ]


def bad_reviews_by_bucket(
    reviewed: DataFrame,
    bounds: Sequence[int] = BUCKET_BOUNDS,
    bad_max: int = BAD_MAX,
    extra_group: Sequence[str] = (),
) -> DataFrame:
    """Bad-review rate per delivery-time bucket, and per further column if given."""
    bucket = delivery_bucket(F.col("delivery_days"), bounds).alias("delivery_bucket")
    return (
        reviewed.groupBy(bucket, *extra_group)
        .agg(*bad_review_columns(bad_max))
        .orderBy(*ascending("delivery_bucket", *extra_group))
    )


def headline_kpis(scored: DataFrame, bad_max: int = BAD_MAX) -> DataFrame:
    """One row: clean orders, reviewed orders, their median delivery days and bad-review rate.

    ``scored`` holds all clean orders, so one pass counts both populations.
    """
    counts = scored.groupBy("is_reviewed", "delivery_days").agg(
        F.count("*").alias("rows"), F.count_if(is_bad(bad_max)).alias("bad")
    )
    reviewed_rows = F.when(F.col("is_reviewed"), F.col("rows")).otherwise(0)
    return counts.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("orders_analyzed"),
        F.coalesce(F.sum(reviewed_rows), F.lit(0)).alias("reviewed_orders"),
        weighted_percentile("delivery_days", 0.5, reviewed_rows).alias("median_delivery_days"),
        percent(F.sum("bad"), F.sum(reviewed_rows)).alias("bad_review_pct"),
    )
