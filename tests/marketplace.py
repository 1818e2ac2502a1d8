"""Small hand-made tables with the real column names and text ids."""

from datetime import datetime, timedelta
from decimal import Decimal

START = datetime(2020, 1, 1, 12)
REVIEW_SCHEMA = """review_id string, order_id string, review_score int, review_comment_title string,
    review_comment_message string, review_creation_date timestamp_ntz, review_answer_timestamp timestamp_ntz"""
ORDER_SCHEMA = """order_id string, customer_id string, order_status string,
    order_purchase_timestamp timestamp_ntz, order_delivered_customer_date timestamp_ntz,
    order_estimated_delivery_date timestamp_ntz"""
ITEM_SCHEMA = """order_id string, order_item_id int, product_id string, seller_id string,
    price decimal(10,2), freight_value decimal(10,2)"""


def reviews(spark, rows):
    """Rows of (review_id, order_id, score[, message])."""
    full = [(r[0], r[1], r[2], None, r[3] if len(r) > 3 else None, START, START) for r in rows]
    return spark.createDataFrame(full, REVIEW_SCHEMA)


def orders(spark, rows):
    """Rows of (order_id, status, hours to delivery or None, hours from purchase to estimate)."""
    full = [
        (
            order_id,
            f"c-{order_id}",
            status,
            START,
            None if hours is None else START + timedelta(hours=hours),
            START + timedelta(hours=estimate),
        )
        for order_id, status, hours, estimate in rows
    ]
    return spark.createDataFrame(full, ORDER_SCHEMA)


def delivered(spark, days):
    """Delivered orders o0, o1, ... that took the given whole days and a bit."""
    return orders(spark, [(f"o{i}", "delivered", 24 * d + 1, 240) for i, d in enumerate(days)])


def items(spark, rows):
    """Rows of (order_id, product_id, seller_id, freight)."""
    full = [
        (o, i, p, s, Decimal("1.00"), None if f is None else Decimal(f)) for i, (o, p, s, f) in enumerate(rows)
    ]
    return spark.createDataFrame(full, ITEM_SCHEMA)
