"""How much the choice of one review per order matters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orderlens.constants import BAD_MAX
from orderlens.functions.measures import percent


def dedup_policy_sensitivity(clean: DataFrame, reviews: DataFrame, bad_max: int = BAD_MAX) -> DataFrame:
    """Platform bad-review rate, to two places, if an order's score were its lowest, highest or mean.

    All three come from one aggregate per order and one join. The mean is bad
    when the sum is at most ``bad_max`` times the number of scores.
    """
    per_order = reviews.groupBy("order_id").agg(
        F.min("review_score").alias("_lowest"),
        F.max("review_score").alias("_highest"),
        F.sum("review_score").alias("_sum"),
        F.count("review_score").alias("_scores"),
    )
    totals = (
        clean.select("order_id")
        .join(per_order, "order_id")
        .agg(
            F.count("*").alias("reviewed_orders"),
            F.count_if(F.col("_lowest") <= bad_max).alias("_lowest_bad"),
            F.count_if(F.col("_highest") <= bad_max).alias("_highest_bad"),
            F.count_if(F.col("_sum") <= F.col("_scores") * bad_max).alias("_average_bad"),
        )
    )
    policies = F.explode(
        F.array(
            *[
                F.struct(F.lit(policy).alias("policy"), F.col(f"_{policy}_bad").alias("bad_reviews"))
                for policy in ("lowest", "highest", "average")
            ]
        )
    )
    return totals.select("reviewed_orders", policies.alias("_policy")).select(
        "_policy.policy",
        "reviewed_orders",
        "_policy.bad_reviews",
        percent(F.col("_policy.bad_reviews"), F.col("reviewed_orders"), 2).alias("bad_review_pct"),
    )


def tied_lowest_reviews(reviews: DataFrame) -> DataFrame:
    """Orders whose lowest score is shared by more than one review.

    Reviews are counted per order and score first, so the window holds one row
    per distinct score of an order.
    """
    lowest_first = Window.partitionBy("order_id").orderBy(F.asc_nulls_last("review_score"))
    return (
        reviews.groupBy("order_id", "review_score")
        .agg(F.count("*").alias("_reviews"))
        .withColumn("_rank", F.row_number().over(lowest_first))
        .where((F.col("_rank") == 1) & (F.col("_reviews") > 1))
        .agg(F.count("*").alias("tied_orders"))
    )
