"""The nine tables, built from a star schema of orders, line items, parts and events.

Stand-ins for the real extract, by fixed rules: order status ``F`` plays
"delivered", the last ship date of an order is its delivery, an event is a
review whose type gives the score, and a brand is a product category. Some keys
are repeated, missing or without a counterpart, some scores and prices missing,
and some orders have four reviews, so that every check has something to find.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderlens.sources.catalog import Tables

DELIVERED = "F"
ESTIMATE_DAYS = 1000

# Label of each brand before correction. Other brands get a label
# made from their name; the last two have no translation at all.
RAW_LABELS = {
    "Brand#1": "fashio_female_clothing",
    "Brand#2": "home_confort",
    "Brand#3": "costruction_tools_garden",
    "Brand#4": "costruction_tools_tools",
    "Brand#5": "arts_and_craftmanship",
    "Brand#6": "security_and_services",
    "Brand#7": "cds_dvds_musicals",
    "Brand#8": "cine_photo",
    "Brand#9": "fixed_telephony",
    "Brand#10": "telephony",
    "Brand#11": "electronics",
    "Brand#12": "la_cuisine",
    "Brand#13": "food",
    "Brand#14": "food_drink",
    "Brand#15": "drinks",
    "Brand#16": "housewares",
    "Brand#17": "small_appliances",
    "Brand#18": "home_appliances",
    "Brand#19": "home_appliances",
}
UNTRANSLATED = [("Brand#24", "pc_gamer"), ("Brand#25", "portable_kitchen_and_food_preparers")]

_COLUMNS = {
    "customer": "c_custkey bigint, c_nationkey int",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, props string",
    "lineitem": """l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int,
        l_extendedprice double, l_shipdate timestamp_ntz""",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_orderdate timestamp_ntz",
    "part": "p_partkey bigint, p_brand string, p_size int, p_retailprice double",
    "supplier": "s_suppkey bigint",
}


def sample_tables(spark: SparkSession, directory: str) -> Tables:
    def table(name: str) -> DataFrame:
        return spark.read.schema(_COLUMNS[name]).parquet(f"{directory}/{name}.parquet")

    return Tables(
        {
            "customers": lambda: table("customer").selectExpr(
                """CASE WHEN c_custkey % 83 = 5 THEN c_custkey - 1 WHEN c_custkey % 89 <> 7 THEN c_custkey END
                   AS customer_id""",
                "c_custkey + c_nationkey AS customer_unique_id",
            ),
            "geolocation": lambda: table("customer").selectExpr("c_nationkey AS geolocation_zip_code_prefix"),
            "order_items": lambda: _order_items(table("lineitem")),
            "payments": lambda: table("orders").selectExpr(
                """CASE WHEN o_orderkey % 211 = 0 THEN o_orderkey + 100000000
                   WHEN o_orderkey % 223 <> 0 THEN o_orderkey END AS order_id"""
            ),
            "reviews": lambda: _reviews(table("events")),
            "orders": lambda: _orders(table("orders"), table("lineitem")),
            "products": lambda: _products(table("part")),
            "sellers": lambda: table("supplier").selectExpr(
                """CASE WHEN s_suppkey % 9 = 7 THEN s_suppkey - 1 WHEN s_suppkey % 8 <> 3 THEN s_suppkey END
                   AS seller_id"""
            ),
            "category_translation": lambda: _translation(table("part")),
        }
    )


def _orders(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    shipped = lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("shipped"))
    return orders.join(shipped, "o_orderkey", "left").selectExpr(
        "o_orderkey AS order_id",
        """CASE WHEN o_orderkey % 157 = 0 THEN o_custkey + 100000000
           WHEN o_orderkey % 151 <> 0 THEN o_custkey END AS customer_id""",
        "o_orderstatus AS order_status",
        "o_orderdate AS order_purchase_timestamp",
        "shipped AS order_delivered_customer_date",
        f"o_orderdate + INTERVAL '{ESTIMATE_DAYS}' DAY AS order_estimated_delivery_date",
    )


def _order_items(lineitem: DataFrame) -> DataFrame:
    return lineitem.selectExpr(
        "CASE WHEN l_orderkey % 307 = 0 AND l_linenumber = 1 THEN l_orderkey + 100000000 ELSE l_orderkey END AS order_id",
        "CASE WHEN l_orderkey % 401 <> 0 OR l_linenumber <> 2 THEN l_linenumber END AS order_item_id",
        "CASE WHEN l_partkey % 97 = 0 THEN l_partkey + 100000000 ELSE l_partkey END AS product_id",
        "CASE WHEN l_orderkey % 101 = 0 THEN l_suppkey + 100000000 ELSE l_suppkey END AS seller_id",
        "CASE WHEN l_orderkey % 13 <> 0 OR l_linenumber <> 5 THEN CAST(l_extendedprice AS DECIMAL(12,2)) END AS price",
        """CASE WHEN l_orderkey % 17 <> 0 OR l_linenumber <> 6 THEN CAST(l_extendedprice AS DECIMAL(12,2)) END
           AS freight_value""",
    )


def _reviews(events: DataFrame) -> DataFrame:
    return events.selectExpr(
        "user_id AS review_id",
        """CASE WHEN event_id % 333 = 0 THEN event_id + 100000000 WHEN event_id % 777 = 5 THEN NULL
           WHEN event_id % 10 < 4 THEN event_id DIV 10 * 5 ELSE event_id DIV 2 END AS order_id""",
        """CASE WHEN event_id % 29 <> 0 THEN
           CASE event_type WHEN 'error' THEN 1 WHEN 'view' THEN 2 WHEN 'click' THEN 3
           WHEN 'signup' THEN 4 WHEN 'purchase' THEN 5 END END AS review_score""",
        "event_type AS review_comment_title",
        "CASE WHEN event_type <> 'signup' THEN props END AS review_comment_message",
        "ts AS review_creation_date",
        "ts AS review_answer_timestamp",
    )


def _products(part: DataFrame) -> DataFrame:
    return part.selectExpr(
        """CASE WHEN p_partkey % 23 = 11 THEN p_partkey - 1 WHEN p_partkey % 31 <> 3 THEN p_partkey END
           AS product_id""",
        "CASE p_size WHEN 1 THEN '' WHEN 2 THEN NULL ELSE p_brand END AS product_category_name",
        "p_retailprice AS product_weight_g",
        "CAST(p_size AS DOUBLE) AS product_length_cm",
        "p_size / 4 AS product_height_cm",
    )


def _translation(part: DataFrame) -> DataFrame:
    labels = " ".join(f"WHEN '{brand}' THEN '{label}'" for brand, label in RAW_LABELS.items())
    untranslated = [brand for brand, _ in UNTRANSLATED]
    return (
        part.select("p_brand")
        .distinct()
        .where(~F.col("p_brand").isin(*untranslated))
        .selectExpr(
            "p_brand AS product_category_name",
            f"""CASE p_brand {labels} ELSE lower(replace(p_brand, '#', '_')) END
                AS product_category_name_english""",
        )
    )
