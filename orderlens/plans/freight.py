"""Reports on freight cost. ``orders`` are reviewed orders joined to ``order_item_facts``.

Order totals can take very many distinct values, so their percentiles come from
``selected_percentiles``. It and the counts read the same value counts, so the
joins below them run once.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlens.constants import BAD_MAX, BUCKET_BOUNDS
from orderlens.functions.measures import ascending, delivery_bucket, percent, ratio
from orderlens.operators.percentiles import selected_percentiles, value_counts
from orderlens.plans.delivery import is_bad

FREIGHT_PERCENTILES = {"p25_freight": 0.25, "median_freight": 0.50, "p75_freight": 0.75, "p99_freight": 0.99}


def _with_percentiles(per_score: DataFrame, counts: DataFrame, probabilities: Mapping[str, float]) -> DataFrame:
    cents = selected_percentiles(counts, ["review_score"], "freight_cents", probabilities)
    money = cents.select(
        F.col("review_score").alias("_score"), *[(F.col(name) / 100).alias(name) for name in probabilities]
    )
    return (
        per_score.join(money, F.col("review_score").eqNullSafe(F.col("_score")), "left")
        .drop("_score")
        .orderBy(*ascending("review_score"))
    )


def score_vs_freight(orders: DataFrame) -> DataFrame:
    """Per score: orders, mean and median freight per order."""
    counts = value_counts(orders, ["review_score"], "freight_cents")
    cents, rows = F.col("freight_cents"), F.col("rows")
    total = F.sum(cents.cast("decimal(19,0)") * rows.cast("decimal(18,0)"))
    per_score = counts.groupBy("review_score").agg(
        F.sum("rows").alias("order_count"),
        ratio(total, F.sum(F.when(cents.isNotNull(), rows)) * 100, 2).alias("avg_freight"),
    )
    return _with_percentiles(per_score, counts, {"median_freight": 0.50})


def freight_percentiles_by_score(
    orders: DataFrame, probabilities: Mapping[str, float] = FREIGHT_PERCENTILES
) -> DataFrame:
    """Per score: orders and freight percentiles, to two places."""
    counts = value_counts(orders, ["review_score"], "freight_cents")
    per_score = counts.groupBy("review_score").agg(F.sum("rows").alias("order_count"))
    table = _with_percentiles(per_score, counts, probabilities)
    return table.select(
        "review_score",
        "order_count",
        *[F.round(F.col(p).cast("decimal(38,10)"), 2).cast("double").alias(p) for p in probabilities],
    )


def freight_by_delivery_bucket(
    orders: DataFrame, bounds: Sequence[int] = BUCKET_BOUNDS, bad_max: int = BAD_MAX
) -> DataFrame:
    """Each delivery bucket split at the median freight of all reviewed clean orders.

    Does freight still matter at equal delivery time? A half without orders has
    a NULL percentage.
    """
    bucketed = orders.select(
        delivery_bucket(F.col("delivery_days"), bounds).alias("delivery_bucket"),
        F.coalesce(is_bad(bad_max), F.lit(False)).alias("_bad"),
        "freight_cents",
    )
    counts = value_counts(bucketed, ["delivery_bucket", "_bad"], "freight_cents")
    median = selected_percentiles(counts, [], "freight_cents", {"median": 0.50}).scalar()

    def half(condition: Column) -> tuple[Column, Column]:
        count = F.sum(F.when(condition, F.col("rows")).otherwise(0))
        bad = F.sum(F.when(condition & F.col("_bad"), F.col("rows")).otherwise(0))
        return count, percent(bad, count)

    low_orders, low_pct = half(F.col("freight_cents") <= F.col("_median"))
    high_orders, high_pct = half(F.col("freight_cents") > F.col("_median"))
    return (
        counts.withColumn("_median", median)
        .groupBy("delivery_bucket")
        .agg(
            low_orders.alias("low_freight_orders"),
            low_pct.alias("low_freight_bad_pct"),
            high_orders.alias("high_freight_orders"),
            high_pct.alias("high_freight_bad_pct"),
        )
        .orderBy(*ascending("delivery_bucket"))
    )
