"""Every job over the sample tables, with parameters that suit their values."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderlens.operators import quarantine
from orderlens.operators.quality import shared_review_gap
from orderlens.plans import delivery, risk
from orderlens.plans.combined import REPORTS
from orderlens.plans.workflow import EXPORTED, Analysis, Parameters, register_views
from orderlens.sample.tables import DELIVERED, UNTRANSLATED, sample_tables
from orderlens.sources.catalog import new_folder, register_tables, stored
from orderlens.sources.csv import read_csv_table, write_csv, write_report
from orderlens.sources.publish import profile, publish_tables, read_published
from orderlens.sources.views import create_view, drop_view

PARAMETERS = Parameters(
    delivered=DELIVERED,
    bad_max=1,
    bounds=(180, 365, 730, 1095),
    high_risk_pct=45,
    min_seller_orders=50,
    min_category_orders=200,
    seller_volume_cuts=(500, 550, 575, 600, 625, 650),
    long_delivery_days=1095,
    near_seconds=30 * 86400,
    missing_translations=tuple(UNTRANSLATED),
)

# Results to four places, so that both engines print the same digits.
_ROUNDED = {
    "order_freight": ["total_freight"],
    "quarantined_order_items": ["price", "freight_value"],
    "delivery_days_distribution": list(delivery.QUARTILES_AND_P90),
    "delivery_delay_distribution": list(delivery.QUARTILES_AND_P90),
    "score_vs_freight": ["median_freight"],
    "seller_volume_percentiles": list(risk.SELLER_VOLUME_PERCENTILES),
    "category_volume_distribution": list(risk.CATEGORY_VOLUME_PERCENTILES),
}


def sample_analysis(spark: SparkSession, directory: str) -> Analysis:
    return Analysis(sample_tables(spark, directory), PARAMETERS)


def _job(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, directory: str) -> DataFrame:
        return _rounded(name, sample_analysis(spark, directory).jobs()[name]())

    return query


def _rounded(name: str, result: DataFrame) -> DataFrame:
    columns = _ROUNDED.get(name, [])
    return result.withColumns({c: F.round(F.col(c).cast("decimal(38,10)"), 4).cast("double") for c in columns})


def _load_reviews_csv(spark: SparkSession, directory: str, line_end: str = "\n") -> DataFrame:
    """Reviews written as CSV with newlines, quotes, blanks and NULLs in cells, and read back."""
    score, title, message = F.col("review_score"), F.col("review_comment_title"), F.col("review_comment_message")
    reviews = sample_tables(spark, directory)["reviews"].withColumns(
        {
            "review_comment_message": F.concat(message, F.lit('\nsaid "'), title, F.lit('"')),
            "review_comment_title": F.when(score == 1, "").when(score == 2, None).otherwise(title),
        }
    )
    path = new_folder(spark, "reviews-csv")
    write_csv(reviews, path, line_end)
    return read_csv_table(spark, path, reviews.schema, multiline=True)


def _register_tables(spark: SparkSession, directory: str) -> DataFrame:
    register_tables(sample_tables(spark, directory), prefix="sample_")
    return spark.sql(
        """
        SELECT o.order_status, count(*) AS item_count, count(DISTINCT i.seller_id) AS seller_count
        FROM sample_orders o JOIN sample_order_items i USING (order_id)
        GROUP BY o.order_status
        """
    )


def _register_views(spark: SparkSession, directory: str) -> DataFrame:
    register_views(sample_analysis(spark, directory), prefix="sample_")
    return spark.sql(
        """
        SELECT r.review_score, count(*) AS order_count, count(DISTINCT i.seller_id) AS seller_count
        FROM sample_orders_clean o
        JOIN sample_reviews_deduped r USING (order_id)
        JOIN sample_order_items i USING (order_id)
        GROUP BY r.review_score
        """
    )


def _register_all_views(spark: SparkSession, directory: str) -> DataFrame:
    """Rows and non-null keys of every registered name."""
    register_views(sample_analysis(spark, directory), prefix="sample_")
    keys = {
        "customers": "customer_id",
        "geolocation": "geolocation_zip_code_prefix",
        "order_items": "order_item_id",
        "payments": "order_id",
        "reviews": "order_id",
        "orders": "order_id",
        "products": "product_category_name",
        "sellers": "seller_id",
        "category_translation": "product_category_name_english",
        "orders_clean": "order_id",
        "reviews_deduped": "order_id",
    }
    return spark.sql(
        " UNION ALL ".join(
            f"SELECT '{name}' AS view_name, count(*) AS row_count, count({key}) AS key_count FROM sample_{name}"
            for name, key in keys.items()
        )
    )


def _export_report_csv(spark: SparkSession, directory: str) -> DataFrame:
    """A report written as CSV and read back."""
    report = sample_analysis(spark, directory).jobs()["delivery_bucket_bad_reviews"]()
    path = new_folder(spark, "report-csv")
    write_report(report, path)
    return read_csv_table(spark, path, report.schema)


def _exported(name: str) -> Callable[[SparkSession, str], DataFrame]:
    """One of the ten main reports as the command line makes it: on stored facts, written as CSV, read back."""

    def query(spark: SparkSession, directory: str) -> DataFrame:
        facts = sample_analysis(spark, directory).stored()
        report = {**facts.jobs(), **facts.counted_reports()}[name]()
        path = new_folder(spark, "exported-csv")
        write_report(report, path)
        facts.close()
        return _rounded(name, read_csv_table(spark, path, report.schema))

    return query


def _counted(name: str) -> Callable[[SparkSession, str], DataFrame]:
    """A report from the counts that several reports share."""

    def query(spark: SparkSession, directory: str) -> DataFrame:
        return sample_analysis(spark, directory).counted_reports()[name]()

    return query


def _quarantined_csv(spark: SparkSession, directory: str) -> DataFrame:
    """Reviews in a CSV file with unreadable rows, and missing, repeated and orphan keys: rows per reason."""
    lines = spark.read.schema("event_id long, user_id long, event_type string").parquet(f"{directory}/events.parquet")
    written = lines.selectExpr(
        """CASE WHEN event_id % 43 = 0 THEN NULL WHEN event_id % 47 = 0 THEN event_id - 1 ELSE event_id END AS review_id""",
        "event_id DIV 2 AS order_id",
        "CASE WHEN event_id % 41 = 0 THEN 'none' ELSE '5' END AS review_score",
        "concat(event_type, '\n', 'again') AS review_comment_message",
    )
    path = new_folder(spark, "reviews-csv")
    write_csv(written, path)
    schema = "review_comment_message string, review_id long, review_score int, order_id long"
    reviews = read_csv_table(spark, path, schema, multiline=True, corrupt_column="_corrupt_record")
    orders = sample_tables(spark, directory)["orders"]
    rows = quarantine.with_reasons(reviews, ["review_id"], {"order_id": orders}, "_corrupt_record")
    return quarantine.rejection_summary({"reviews": rows})


def _published(spark: SparkSession, directory: str) -> DataFrame:
    """The fixed translation as others read it, after it was published together with the fixed products."""
    tables = sample_analysis(spark, directory).tables
    path = new_folder(spark, "published")
    publish_tables(spark, {name: tables[name] for name in ("products", "category_translation")}, path)
    published = read_published(spark, path)
    products = published["products"].groupBy("product_category_name").agg(F.count("*").alias("product_count"))
    return published["category_translation"].join(products, "product_category_name", "left").select(
        "product_category_name", "product_category_name_english", F.coalesce("product_count", F.lit(0)).alias("product_count")
    )


def _published_profile(spark: SparkSession, directory: str) -> DataFrame:
    """Rows and NULLs of every column, counted by the one scan that published the tables."""
    tables = sample_tables(spark, directory)
    names = ("orders", "order_items", "reviews", "products")
    return profile(spark, publish_tables(spark, {name: tables[name] for name in names}, new_folder(spark, "published")))


def _orders_clean_versions(spark: SparkSession, directory: str) -> DataFrame:
    """Both versions of the view, the first one read before it is dropped and defined anew."""
    register_tables(sample_tables(spark, directory), prefix="versioned_")
    versions = []
    for version in (1, 2):
        drop_view(spark, "orders_clean", "versioned_")
        create_view(spark, "orders_clean", version, "versioned_", DELIVERED)
        versions.append(
            spark.sql(
                f"""SELECT {version} AS version, count(*) AS order_count, min(delivery_days) AS min_days,
                        max(delivery_days) AS max_days
                    FROM versioned_orders_clean"""
            )
        )
    return versions[0].unionByName(versions[1])


def _shared_review_gap_interval(spark: SparkSession, directory: str) -> DataFrame:
    """The gap to the next order as an interval, after it was written and read back; its parts as numbers."""
    tables = sample_tables(spark, directory)
    rows = shared_review_gap(tables["reviews"], tables["orders"], PARAMETERS.gaps_shown, as_interval=True)
    gaps = stored(rows.select("review_id", "order_id", "row_number", "time_to_next_order"), "gaps")
    gap = F.col("time_to_next_order")
    return gaps.select(
        "review_id",
        "order_id",
        "row_number",
        F.extract(F.lit("DAY"), gap).cast("long").alias("gap_days"),
        F.extract(F.lit("HOUR"), gap).cast("long").alias("gap_hours"),
        F.extract(F.lit("MINUTE"), gap).cast("long").alias("gap_minutes"),
        (gap > F.expr("INTERVAL '30' DAY")).alias("over_30_days"),
    )


def sample_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "load_reviews_csv": _load_reviews_csv,
        "load_reviews_csv_by_lines": partial(_load_reviews_csv, line_end="\r\n"),
        "register_tables": _register_tables,
        "register_views": _register_views,
        "register_all_views": _register_all_views,
        "export_report_csv": _export_report_csv,
        **{f"exported_{name}": _exported(name) for name in EXPORTED},
        **{f"counted_{name}": _counted(name) for name in REPORTS},
        "quarantined_csv": _quarantined_csv,
        "published_translation": _published,
        "published_profile": _published_profile,
        "orders_clean_versions": _orders_clean_versions,
        "shared_review_gap_interval": _shared_review_gap_interval,
        **{name: _job(name) for name in Analysis({}, PARAMETERS).jobs()},
    }
