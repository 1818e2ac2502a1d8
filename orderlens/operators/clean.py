"""Fixes and derived tables. Each takes and returns DataFrames; inputs stay as they are."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderlens.constants import DELIVERED
from orderlens.functions.measures import ascending, whole_days

# Places that amounts in floating point are rounded to before they are summed.
FLOAT_PLACES = 4

REVIEW_COLUMNS = (
    "review_id",
    "order_id",
    "review_score",
    "review_comment_title",
    "review_comment_message",
    "review_creation_date",
    "review_answer_timestamp",
)


def blank_to_null(df: DataFrame, column: str) -> DataFrame:
    """Empty text becomes NULL, so that it no longer counts as a key value."""
    return df.withColumn(column, F.nullif(F.col(column), F.lit("")))


def append_rows(df: DataFrame, rows: Sequence[tuple]) -> DataFrame:
    """The frame plus a few literal rows, given in the frame's column order.

    The rows are part of the plan, so its size estimate stays that of the frame, and
    joins may still broadcast the result.
    """
    if not rows:
        return df
    names, types = df.columns, [field.dataType for field in df.schema.fields]
    literals = [
        F.struct(*[F.lit(v).cast(t).alias(n) for v, t, n in zip(row, types, names, strict=True)]) for row in rows
    ]
    one_row = df.sparkSession.sql("SELECT 1")
    return df.unionByName(one_row.select(F.inline(F.array(*literals))))


def correct_labels(df: DataFrame, corrections: Mapping[str, str], column: str) -> DataFrame:
    """Whole-value replacement on one column. Other columns, so also the key, stay."""
    return df.replace(dict(corrections), subset=[column])


def dedupe_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row per key in ascending order, NULL last.

    Spark plans ``row_number() = 1`` as a group limit on both sides of the
    shuffle, so each map task sends one row per key, however hot the key is.
    """
    in_key = Window.partitionBy(*keys).orderBy(*ascending(*order))
    return df.withColumn("_rank", F.row_number().over(in_key)).where(F.col("_rank") == 1).drop("_rank")


def reviews_deduped(reviews: DataFrame) -> DataFrame:
    """One review per order: lowest score, then lowest review_id.

    Rows equal in both are told apart by the remaining columns, so that a rerun
    keeps the same row.
    """
    ties = [c for c in REVIEW_COLUMNS if c not in ("order_id", "review_score", "review_id")]
    return dedupe_first(
        reviews.select(*REVIEW_COLUMNS), ["order_id"], ["review_score", "review_id", *reversed(ties)]
    )


def order_scores(reviews: DataFrame) -> DataFrame:
    """The (order_id, review_score) columns of ``reviews_deduped``, by a hash aggregate.

    The kept review has the lowest score of its order, and ``min`` skips NULL as
    the order does. The reports need nothing else, so they avoid the sort and
    never read the comments.
    """
    return reviews.groupBy("order_id").agg(F.min("review_score").alias("review_score"))


def orders_clean(orders: DataFrame, min_days: int | None = None, delivered: str = DELIVERED) -> DataFrame:
    """Delivered orders with whole-day delivery time and delay.

    ``min_days`` keeps only orders that took more days than that; None keeps all.
    """
    arrived = F.col("order_delivered_customer_date")
    clean = orders.where((F.col("order_status") == delivered) & arrived.isNotNull()).select(
        "order_id",
        "customer_id",
        "order_purchase_timestamp",
        "order_delivered_customer_date",
        "order_estimated_delivery_date",
        whole_days(arrived, F.col("order_purchase_timestamp")).cast("double").alias("delivery_days"),
        whole_days(arrived, F.col("order_estimated_delivery_date")).cast("double").alias("delivery_delay_days"),
    )
    return clean if min_days is None else clean.where(F.col("delivery_days") > min_days)


def reviewed_orders(clean: DataFrame, scores: DataFrame) -> DataFrame:
    """Clean orders that have a review: the base of nearly every report.

    ``scores`` has one row per order: ``order_scores`` or ``reviews_deduped``.
    """
    return clean.select("order_id", "delivery_days", "delivery_delay_days").join(
        scores.select("order_id", "review_score"), "order_id"
    )


def scored_orders(clean: DataFrame, scores: DataFrame) -> DataFrame:
    """All clean orders, with their score if ``is_reviewed``."""
    joined = clean.select("order_id", "delivery_days", "delivery_delay_days").join(
        scores.select("order_id", "review_score", F.lit(True).alias("is_reviewed")), "order_id", "left"
    )
    return joined.withColumn("is_reviewed", F.coalesce("is_reviewed", F.lit(False)))


def sum_in_cents(df: DataFrame, column: str) -> Column:
    """Sum of an amount of money in whole cents, rounded half away from zero once, after summing.

    Amounts are summed as whole numbers of their smallest unit, in long arithmetic.
    Floating-point amounts are first rounded to ``FLOAT_PLACES`` places each.
    """
    kind = df.schema[column].dataType
    if isinstance(kind, T.FractionalType) and not isinstance(kind, T.DecimalType):
        places, amount = FLOAT_PLACES, F.col(column).cast(f"decimal(18,{FLOAT_PLACES})")
    else:
        places, amount = getattr(kind, "scale", 0), F.col(column)
    units = F.sum((amount * F.lit(10**places).cast(f"decimal({places + 1},0)")).cast("long"))
    if places <= 2:
        return units * 10 ** (2 - places)
    return F.round(units.cast("decimal(19,0)") / F.lit(10 ** (places - 2)).cast(f"decimal({places - 1},0)"), 0).cast("long")


def order_item_facts(items: DataFrame) -> DataFrame:
    """Per order: freight in whole cents, and whether one seller or several sold its items.

    Lowest and highest seller are equal exactly when there is one seller, so one
    shuffle of one row per order and task is enough, where a distinct count would
    take two.
    """
    one_seller = F.min("seller_id") == F.max("seller_id")
    return items.groupBy("order_id").agg(
        sum_in_cents(items, "freight_value").alias("freight_cents"),
        F.when(one_seller, "1 seller").otherwise("2+ sellers").alias("seller_group"),
    )


def order_freight(items: DataFrame) -> DataFrame:
    """Freight per order."""
    return order_item_facts(items).select(
        "order_id",
        (F.col("freight_cents").cast("decimal(18,0)") / 100).cast("decimal(18,2)").alias("total_freight"),
    )


def product_labels(products: DataFrame, translation: DataFrame) -> DataFrame:
    """English category label per product; products without one are left out."""
    return products.join(translation, "product_category_name").select(
        "product_id", F.col("product_category_name_english").alias("category_english")
    )


def seller_pairs(items: DataFrame) -> DataFrame:
    """Distinct (seller_id, order_id), so that several items count as one order."""
    return items.select("seller_id", "order_id").distinct()


def category_pairs(items: DataFrame, products: DataFrame, translation: DataFrame) -> DataFrame:
    """Distinct (order_id, category_english); an order counts once in each of its categories.

    A product in a third of all items is no trouble: the product side is
    broadcast when its measured size allows it, and else the adaptive join
    splits that product's partition.
    """
    labels = product_labels(products, translation)
    return items.select("order_id", "product_id").join(labels, "product_id").select(
        "order_id", "category_english"
    ).distinct()


def among_clean(pairs: DataFrame, clean: DataFrame) -> DataFrame:
    """The pairs whose order is a clean order."""
    return pairs.join(clean.select("order_id"), "order_id", "left_semi")
