"""Profiling and quality checks. Each returns a DataFrame with its findings.

Rows are pre-aggregated by key before any join, so a key that holds a large
share of the rows is one row per task by the time it is shuffled.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderlens.constants import DELIVERED, NEAR_SIMULTANEOUS_SECONDS
from orderlens.functions.measures import ascending, descending, percent, whole_hours, whole_seconds


def _union(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


# A join side cut to this many key values is small whatever the tables hold.
_BROADCAST_KEYS = 100_000


def _first_keys(keys: DataFrame, order: Sequence[Column], limit: int) -> DataFrame:
    """The first ``limit`` rows, to join with: broadcast when the limit itself keeps them few."""
    first = keys.orderBy(*order).limit(limit)
    return F.broadcast(first) if limit <= _BROADCAST_KEYS else first


def table_row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row per table: its name and row count. Parquet answers from its footers."""
    return _union(
        [df.agg(F.count("*").alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
         for name, df in tables.items()]
    )


def join_key_match(
    left: DataFrame, right: DataFrame, left_key: str, right_key: str, candidates: Sequence[str]
) -> DataFrame:
    """How often each candidate column of the right side equals the left key.

    The two sides are paired on ``right_key`` by a full join, so a candidate is
    only compared within those pairs. Both sides are counted per key first.
    """
    columns = list(dict.fromkeys([right_key, *candidates]))
    lefts = left.groupBy(F.col(left_key).alias("_left")).agg(F.count("*").alias("_left_rows"))
    rights = right.groupBy(*columns).agg(F.count("*").alias("_right_rows"))
    pairs = lefts.join(rights, F.col("_left") == F.col(right_key), "full")
    matched = F.col("_left_rows") * F.col("_right_rows")
    return pairs.agg(
        *[
            F.coalesce(F.sum(F.when(F.col("_left") == F.col(c), matched)), F.lit(0)).alias(f"{c}_match")
            for c in candidates
        ]
    )


def blank_profile(df: DataFrame, column: str, count_name: str = "row_count") -> DataFrame:
    """Rows whose column is NULL or empty text, counted per value."""
    value = F.col(column)
    return df.where(value.isNull() | (value == "")).groupBy(column).agg(F.count("*").alias(count_name))


def unmatched_keys(df: DataFrame, dimension: DataFrame, key: str, count_name: str = "row_count") -> DataFrame:
    """Key values with no row in the dimension, with how many rows have them."""
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias(count_name))
    return counts.join(dimension.select(key), key, "left_anti")


def category_labels(translation: DataFrame) -> DataFrame:
    """Key and English label in label order, for review by a person."""
    return translation.select("product_category_name", "product_category_name_english").orderBy(
        *ascending("product_category_name_english", "product_category_name")
    )


def category_dimensions(
    products: DataFrame, translation: DataFrame, labels: Sequence[str], by_weight: bool = False
) -> DataFrame:
    """Number of products and rounded mean weight, length and height of some categories."""

    def mean(column: str) -> Column:
        return F.round(F.avg(column).cast("decimal(38,10)")).cast("double")

    chosen = translation.where(F.col("product_category_name_english").isin(*labels))
    profile = (
        products.join(chosen, "product_category_name")
        .groupBy(F.col("product_category_name_english").alias("category"))
        .agg(
            F.count("*").alias("products"),
            mean("product_weight_g").alias("avg_weight_g"),
            mean("product_length_cm").alias("avg_length_cm"),
            mean("product_height_cm").alias("avg_height_cm"),
        )
    )
    return profile.orderBy(*ascending("avg_weight_g", "category")) if by_weight else profile


def duplicate_values(df: DataFrame, column: str, count_name: str = "row_count") -> DataFrame:
    """Values of a column that occur more than once."""
    return df.groupBy(column).agg(F.count("*").alias(count_name)).where(F.col(count_name) > 1)


def key_uniqueness(df: DataFrame, key: str, total_name: str, unique_name: str) -> DataFrame:
    """Number of rows against number of distinct key values, exact."""
    return df.agg(F.count("*").alias(total_name), F.count_distinct(key).alias(unique_name))


def duplicate_rows_ranked(
    df: DataFrame,
    key: str,
    order_by: str,
    limit: int,
    keep: Column | None = None,
    ties: Sequence[str] = (),
) -> DataFrame:
    """The first ``limit`` rows, in key order, of keys that occur more than once.

    ``keep`` drops rows after the repeated keys are found. ``rnk`` ranks the kept
    rows of a key by ``order_by``.

    Only the first ``limit`` keys that have a kept row can matter, so the rows are
    read once more with those few keys broadcast, and never shuffled by key. The
    rank of a row depends on rows before it only, and all of those are in the
    first ``limit`` rows too, so it is computed after the cut.
    """
    kept = F.lit(True) if keep is None else keep
    repeated = (
        df.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.count("*").alias("_rows"), F.count_if(kept).alias("_kept"))
        .where((F.col("_rows") > 1) & (F.col("_kept") > 0))
        .select(key)
    )
    first_keys = _first_keys(repeated, ascending(key), limit)
    order = ascending(key, order_by, *ties)
    first_rows = df.where(kept).join(first_keys, key, "left_semi").orderBy(*order).limit(limit)
    rank = F.rank().over(Window.partitionBy(key).orderBy(*ascending(order_by)))
    return first_rows.withColumn("rnk", rank).orderBy(*order)


def reviews_vs_products(orders: DataFrame, reviews: DataFrame, items: DataFrame, limit: int) -> DataFrame:
    """Distinct reviews and products of orders with more than one review, most reviews first.

    Joining reviews to items would pair every review of an order with every item.
    The two counts do not depend on each other, so each is taken on its own side;
    products are counted only for the orders that make the cut.
    """
    many_reviews = (
        reviews.groupBy("order_id")
        .agg(F.count_distinct("review_id").alias("review_count"))
        .where(F.col("review_count") > 1)
    )
    order = [*descending("review_count"), *ascending("order_id")]
    complete = many_reviews.join(orders.select("order_id"), "order_id", "left_semi").join(
        items.select("order_id").distinct(), "order_id", "left_semi"
    )
    first = _first_keys(complete, order, limit)
    return (
        items.select("order_id", "product_id")
        .join(first, "order_id")
        .groupBy("order_id", "review_count")
        .agg(F.count_distinct("product_id").alias("product_count"))
        .orderBy(*order)
    )


def shared_review_gap(reviews: DataFrame, orders: DataFrame, limit: int, as_interval: bool = False) -> DataFrame:
    """The first ``limit`` orders that share a review_id, with the time to the next one in seconds.

    With ``as_interval`` it also comes as an interval of days to seconds, ``time_to_next_order``.

    The row number looks back and the gap one row ahead, so both are computed
    after the cut, on ``limit + 1`` rows.
    """
    repeated = reviews.groupBy("review_id").agg(F.count("*").alias("_rows")).where(F.col("_rows") > 1)
    with_order = (
        reviews.select("review_id", "order_id")
        .distinct()
        .join(orders.select("order_id"), "order_id", "left_semi")
        .select("review_id")
        .distinct()
    )
    shared = repeated.join(with_order, "review_id", "left_semi").select("review_id")
    first_keys = _first_keys(shared, ascending("review_id"), limit + 1)
    order = ascending("review_id", "order_purchase_timestamp", "order_id", "review_comment_message")
    first_rows = (
        reviews.join(first_keys, "review_id", "left_semi")
        .select("review_id", "order_id", "review_comment_message")
        .join(
            orders.select("order_id", "order_purchase_timestamp", "order_delivered_customer_date"), "order_id"
        )
        .orderBy(*order)
        .limit(limit + 1)
    )
    in_review = Window.partitionBy("review_id").orderBy(*order[1:])
    purchased = F.col("order_purchase_timestamp")
    gap = [(F.lead(purchased).over(in_review) - purchased).alias("time_to_next_order")] if as_interval else []
    return (
        first_rows.select(
            "review_id",
            "order_id",
            "order_purchase_timestamp",
            F.row_number().over(in_review).alias("row_number"),
            whole_seconds(F.lead(purchased).over(in_review), purchased).alias("seconds_to_next_order"),
            *gap,
            "review_comment_message",
            "order_delivered_customer_date",
        )
        .orderBy(*order, "row_number")
        .limit(limit)
    )


def shared_review_gap_within(
    reviews: DataFrame, orders: DataFrame, seconds: int = NEAR_SIMULTANEOUS_SECONDS
) -> DataFrame:
    """Of consecutive orders that share a review_id, how many were bought within some seconds.

    A window over all orders of a review would put a hot review into one task.
    Orders of a review bought at the same moment are counted into one row first:
    n of them are n - 1 pairs with no gap. The gap to the next moment is looked
    up within the hour, and for the last moment of an hour among the first
    moments of the review's hours, so no task holds more than one hour of a
    review's moments or one row for each of its hours. A review_id that occurs
    once adds no pair, so it needs no filter.
    """
    purchases = orders.select("order_id", F.col("order_purchase_timestamp").alias("_moment"))
    moments = (
        reviews.where(F.col("review_id").isNotNull())
        .groupBy("review_id", "order_id")
        .agg(F.count("*").alias("_rows"))
        .join(purchases.where(F.col("_moment").isNotNull()), "order_id")
        .groupBy("review_id", "_moment")
        .agg(F.sum("_rows").alias("_rows"))
        .withColumn("_hour", whole_hours(F.col("_moment"), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")))
    )
    in_hour = Window.partitionBy("review_id", "_hour").orderBy("_moment")
    across_hours = Window.partitionBy("review_id").orderBy("_hour")
    limit = F.make_dt_interval(secs=F.lit(seconds))

    same_moment = F.sum(F.col("_rows") - 1)
    inside = moments.withColumn("_next", F.lead("_moment").over(in_hour)).agg(
        (same_moment + F.count("_next")).alias("_pairs"),
        (same_moment + F.count_if(F.col("_next") - F.col("_moment") <= limit)).alias("_near"),
    )
    between = (
        moments.groupBy("review_id", "_hour")
        .agg(F.min("_moment").alias("_first"), F.max("_moment").alias("_last"))
        .withColumn("_next", F.lead("_first").over(across_hours))
        .agg(
            F.count("_next").alias("_pairs"),
            F.count_if(F.col("_next") - F.col("_last") <= limit).alias("_near"),
        )
    )
    return inside.unionByName(between).agg(
        F.coalesce(F.sum("_pairs"), F.lit(0)).alias("consecutive_pairs"),
        F.coalesce(F.sum("_near"), F.lit(0)).alias("pairs_within"),
    )


def null_counts(df: DataFrame, table_name: str, columns: Mapping[str, str]) -> DataFrame:
    """Total rows and NULLs per column, in one pass. ``columns`` maps column to output name."""
    return df.agg(
        F.count("*").alias("total_rows"),
        *[F.sum(F.when(F.col(c).isNull(), 1).otherwise(0)).alias(name) for c, name in columns.items()],
    ).select(F.lit(table_name).alias("table_name"), "total_rows", *columns.values())


def share_of_total(df: DataFrame, column: str, count_name: str, order: Sequence[Column]) -> DataFrame:
    """Rows per value and their percentage of all rows, to two places.

    The total is a scalar subquery on the same counts, so the shuffle is shared.
    """
    counts = df.groupBy(column).agg(F.count("*").alias(count_name))
    total = counts.agg(F.sum(count_name).alias("_total")).scalar()
    return counts.withColumn("pct_of_total", percent(F.col(count_name), total, 2)).orderBy(*order)


def delivered_without_date(orders: DataFrame, delivered: str = DELIVERED) -> DataFrame:
    """Orders marked as delivered that have no delivery date."""
    return orders.where((F.col("order_status") == delivered) & F.col("order_delivered_customer_date").isNull())


def count_where(df: DataFrame, condition: Column, name: str) -> DataFrame:
    return df.where(condition).agg(F.count("*").alias(name))


def reconcile_count(df: DataFrame, expected: int | DataFrame, name: str = "difference") -> DataFrame:
    """Expected minus actual number of rows; the expectation is a number or another frame's count."""
    count = F.lit(expected) if isinstance(expected, int) else expected.agg(F.count("*").alias("_rows")).scalar()
    return df.agg(F.count("*").alias("_rows")).select((count - F.col("_rows")).alias(name))


def primary_key_check(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key values that break a primary key: repeated, or NULL in some column."""
    is_null = reduce(Column.__or__, [F.col(k).isNull() for k in keys])
    return (
        df.groupBy(*keys).agg(F.count("*").alias("row_count")).where((F.col("row_count") > 1) | is_null)
    )


def primary_key_summary(tables: Mapping[str, tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """Per table: how many key values repeat, in how many rows, and how many rows have a NULL key."""
    legs = []
    for name, (df, keys) in tables.items():
        is_null = reduce(Column.__or__, [F.col(k).isNull() for k in keys])
        rows = F.col("row_count")
        legs.append(
            primary_key_check(df, keys)
            .agg(
                F.count_if(~is_null).alias("duplicate_keys"),
                F.coalesce(F.sum(F.when(~is_null, rows)), F.lit(0)).alias("duplicate_rows"),
                F.coalesce(F.sum(F.when(is_null, rows)), F.lit(0)).alias("null_key_rows"),
            )
            .select(
                F.lit(name).alias("table_name"),
                F.lit(", ".join(keys)).alias("key_columns"),
                "duplicate_keys",
                "duplicate_rows",
                "null_key_rows",
            )
        )
    return _union(legs)


def foreign_key_check(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Child rows, and their distinct key values, whose non-null key has no parent."""
    return unmatched_keys(child, parent, key, "_rows").agg(
        F.count("*").alias("orphan_keys"), F.coalesce(F.sum("_rows"), F.lit(0)).alias("orphan_rows")
    )


def foreign_key_summary(tables: Mapping[str, DataFrame], edges: Sequence[tuple[str, str, str]]) -> DataFrame:
    """``foreign_key_check`` for each (child, parent, key)."""
    return _union(
        [
            foreign_key_check(tables[child], tables[parent], key).select(
                F.lit(child).alias("child_table"),
                F.lit(parent).alias("parent_table"),
                F.lit(key).alias("key_column"),
                "orphan_keys",
                "orphan_rows",
            )
            for child, parent, key in edges
        ]
    )


PRIMARY_KEYS = {
    "sellers": ("seller_id",),
    "orders": ("order_id",),
    "customers": ("customer_id",),
    "products": ("product_id",),
    "category_translation": ("product_category_name",),
    "order_items": ("order_id", "order_item_id"),
}

CATEGORY_KEY = ("products", "category_translation", "product_category_name")

FOREIGN_KEYS = [
    ("order_items", "orders", "order_id"),
    ("order_items", "products", "product_id"),
    ("order_items", "sellers", "seller_id"),
    ("orders", "customers", "customer_id"),
    ("reviews", "orders", "order_id"),
    ("payments", "orders", "order_id"),
    CATEGORY_KEY,
]
