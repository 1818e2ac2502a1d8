"""Views as SQL text in the catalog, in versions, so that a definition can be replaced and both be compared."""

from __future__ import annotations

from pyspark.sql import SparkSession

from orderlens.constants import DELIVERED

_ORDERS_CLEAN = """
    SELECT order_id, customer_id, order_purchase_timestamp, order_delivered_customer_date, order_estimated_delivery_date,
        CAST(extract(DAY FROM order_delivered_customer_date - order_purchase_timestamp) AS DOUBLE) AS delivery_days,
        CAST(extract(DAY FROM order_delivered_customer_date - order_estimated_delivery_date) AS DOUBLE) AS delivery_delay_days
    FROM {prefix}orders
    WHERE order_status = '{delivered}' AND order_delivered_customer_date IS NOT NULL"""

# Text of each version of a view, oldest first.
DEFINITIONS = {
    "orders_clean": (
        _ORDERS_CLEAN,
        _ORDERS_CLEAN + " AND extract(DAY FROM order_delivered_customer_date - order_purchase_timestamp) > 0",
    ),
    "reviews_deduped": (
        """
    SELECT review_id, order_id, review_score, review_comment_title, review_comment_message, review_creation_date,
        review_answer_timestamp
    FROM (
        SELECT *, row_number() OVER (
            PARTITION BY order_id
            ORDER BY review_score NULLS LAST, review_id NULLS LAST, review_answer_timestamp NULLS LAST,
                review_creation_date NULLS LAST, review_comment_message NULLS LAST, review_comment_title NULLS LAST) AS _place
        FROM {prefix}reviews)
    WHERE _place = 1""",
    ),
}


def view_text(name: str, version: int | None = None, prefix: str = "", delivered: str = DELIVERED) -> str:
    """The SELECT of a version, counted from 1; the newest if none is given."""
    versions = DEFINITIONS[name]
    number = len(versions) if version is None else version
    if not 1 <= number <= len(versions):
        raise ValueError(f"{name} has no version {number}")
    return versions[number - 1].format(prefix=prefix, delivered=delivered)


def create_view(
    spark: SparkSession,
    name: str,
    version: int | None = None,
    prefix: str = "",
    delivered: str = DELIVERED,
    temporary: bool = True,
) -> None:
    """Define a view over the registered tables; an error if the name is taken, as in ``CREATE VIEW``.

    Views that are not ``temporary`` outlive the session and need tables that do too.
    """
    if spark.catalog.tableExists(prefix + name):
        raise ValueError(f"view {prefix + name} exists; drop it first")
    kind = "TEMPORARY VIEW" if temporary else "VIEW"
    spark.sql(f"CREATE {kind} {prefix}{name} AS {view_text(name, version, prefix, delivered)}")


def drop_view(spark: SparkSession, name: str, prefix: str = "") -> None:
    """Remove a view. Frames read from it before keep the definition they were read with."""
    spark.sql(f"DROP VIEW IF EXISTS {prefix}{name}")
