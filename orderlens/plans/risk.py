"""Reports on sellers, product categories and orders split across sellers.

``pairs`` holds distinct (entity, order_id) rows, so that an order with several
items counts once for each seller or category. ``orders`` are reviewed orders
joined to ``order_item_facts``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orderlens.constants import (
    BAD_MAX,
    BUCKET_BOUNDS,
    HIGH_RISK_PCT,
    MIN_CATEGORY_ORDERS,
    MIN_SELLER_ORDERS,
    SELLER_VOLUME_CUTS,
    TOP_SELLERS,
)
from orderlens.functions.measures import ascending, descending, percent, ratio
from orderlens.operators.percentiles import value_counts, weighted_percentile
from orderlens.plans.delivery import bad_review_columns, bad_reviews_by_bucket, is_bad

SELLER_VOLUME_PERCENTILES = {"p1": 0.01, "p5": 0.05, "p10": 0.10, "p25": 0.25, "p50": 0.50}
CATEGORY_VOLUME_PERCENTILES = {"p10": 0.10, "p25": 0.25, "p50": 0.50}


def order_volumes(pairs: DataFrame, entity: str) -> DataFrame:
    """Distinct orders per entity; an entity with only NULL orders has none."""
    return pairs.groupBy(entity).agg(F.count("order_id").alias("order_count"))


def volume_distribution(
    volumes: DataFrame, probabilities: Mapping[str, float], total_name: str | None = None
) -> DataFrame:
    """Percentiles, minimum and maximum of orders per entity; the number of entities if named."""
    total = [F.coalesce(F.sum("rows"), F.lit(0)).alias(total_name)] if total_name else []
    return value_counts(volumes, [], "order_count").agg(
        *[weighted_percentile("order_count", p).alias(name) for name, p in probabilities.items()],
        F.min("order_count").alias("min_orders"),
        F.max("order_count").alias("max_orders"),
        *total,
    )


def seller_volume_percentiles(pairs: DataFrame) -> DataFrame:
    return volume_distribution(order_volumes(pairs, "seller_id"), SELLER_VOLUME_PERCENTILES)


def category_volume_distribution(pairs: DataFrame) -> DataFrame:
    volumes = order_volumes(pairs, "category_english")
    return volume_distribution(volumes, CATEGORY_VOLUME_PERCENTILES, "total_categories")


def seller_volume_thresholds(pairs: DataFrame, cuts: Sequence[int] = SELLER_VOLUME_CUTS) -> DataFrame:
    """Sellers that reach each number of orders, and all sellers."""
    volumes = order_volumes(pairs, "seller_id")
    return volumes.agg(
        *[
            F.sum(F.when(F.col("order_count") >= cut, 1).otherwise(0)).alias(f"sellers_{cut}_plus")
            for cut in cuts
        ],
        F.count("*").alias("total_sellers"),
    )


def entity_rates(pairs: DataFrame, reviewed: DataFrame, entity: str, bad_max: int = BAD_MAX) -> DataFrame:
    """Orders, bad reviews and mean score per entity. Reports on sellers can share one stored copy."""
    return (
        pairs.join(reviewed.select("order_id", "review_score"), "order_id")
        .groupBy(entity)
        .agg(
            *bad_review_columns(bad_max),
            ratio(F.sum("review_score"), F.count("review_score"), 2).alias("avg_review_score"),
        )
    )


def entity_risk(
    pairs: DataFrame,
    reviewed: DataFrame,
    entity: str,
    min_orders: int,
    limit: int | None = None,
    bad_max: int = BAD_MAX,
    rates: DataFrame | None = None,
) -> DataFrame:
    """Bad-review rate and mean score per entity with enough orders, worst rounded rate first."""
    if rates is None:
        rates = entity_rates(pairs, reviewed, entity, bad_max)
    ranked = rates.where(F.col("order_count") >= min_orders).orderBy(*descending("bad_review_pct"), *ascending(entity))
    return ranked if limit is None else ranked.limit(limit)


def worst_sellers(
    pairs: DataFrame,
    reviewed: DataFrame,
    min_orders: int = MIN_SELLER_ORDERS,
    limit: int = TOP_SELLERS,
    bad_max: int = BAD_MAX,
    rates: DataFrame | None = None,
) -> DataFrame:
    return entity_risk(pairs, reviewed, "seller_id", min_orders, limit, bad_max, rates)


def seller_risk_all(
    pairs: DataFrame,
    reviewed: DataFrame,
    min_orders: int = MIN_SELLER_ORDERS,
    bad_max: int = BAD_MAX,
    rates: DataFrame | None = None,
) -> DataFrame:
    return entity_risk(pairs, reviewed, "seller_id", min_orders, None, bad_max, rates)


def category_risk(
    pairs: DataFrame, reviewed: DataFrame, min_orders: int = MIN_CATEGORY_ORDERS, bad_max: int = BAD_MAX
) -> DataFrame:
    return entity_risk(pairs, reviewed, "category_english", min_orders, None, bad_max)


def multi_seller_by_bucket(
    orders: DataFrame, bounds: Sequence[int] = BUCKET_BOUNDS, bad_max: int = BAD_MAX
) -> DataFrame:
    """Bad-review rate per delivery bucket, for orders of one seller and of several."""
    return bad_reviews_by_bucket(orders, bounds, bad_max, extra_group=["seller_group"])


def seller_group_median_days(orders: DataFrame) -> DataFrame:
    """Median delivery days of orders of one seller and of several."""
    return (
        value_counts(orders, ["seller_group"], "delivery_days")
        .groupBy("seller_group")
        .agg(
            F.sum("rows").alias("order_count"),
            weighted_percentile("delivery_days", 0.5).alias("median_delivery_days"),
        )
        .orderBy(*ascending("seller_group"))
    )


def split_order_share(orders: DataFrame) -> DataFrame:
    """Orders split across sellers, as a count and as a percentage of all."""
    split = F.count_if(F.col("seller_group") != "1 seller")
    return orders.agg(
        split.alias("split_orders"),
        F.count("*").alias("order_count"),
        percent(split, F.count("*")).alias("split_order_pct"),
    )


def seller_risk_segments(
    pairs: DataFrame,
    reviewed: DataFrame,
    high: float = HIGH_RISK_PCT,
    bad_max: int = BAD_MAX,
    rates: DataFrame | None = None,
) -> DataFrame:
    """Sellers in three segments by their rounded bad-review rate, and each segment's share of bad reviews.

    The segments are below the platform's rounded rate, up to ``high``
    inclusive, and above it. An order counts once for each of its sellers.
    """
    sellers = entity_rates(pairs, reviewed, "seller_id", bad_max) if rates is None else rates
    bad = F.count_if(is_bad(bad_max))
    platform = reviewed.agg(percent(bad, F.count("*")).alias("_platform")).scalar()

    rate, average = F.col("bad_review_pct"), F.col("_platform")
    average_text = average.cast("decimal(9,1)").cast("string")
    segment = (
        F.when(rate < average, "1. Below Platform Average")
        .when(
            rate.between(average, high),
            F.concat(F.lit("2. Moderate Risk ("), average_text, F.lit(f"% - {high:g}%)")),
        )
        .otherwise(f"3. High Risk ({high:g}%+)")
    )
    per_segment = (
        sellers.withColumn("_platform", platform)
        .groupBy(segment.alias("seller_segment"))
        .agg(
            F.count("*").alias("seller_count"),
            F.sum("order_count").alias("total_orders"),
            F.sum("bad_reviews").alias("total_bad_reviews"),
        )
    )
    # A window without a key is one task: here it holds three rows.
    all_bad = F.sum("total_bad_reviews").over(Window.partitionBy())
    return per_segment.withColumn(
        "pct_of_all_bad_reviews", percent(F.col("total_bad_reviews"), all_bad)
    ).orderBy(*ascending("seller_segment"))
