"""All jobs on one set of tables, and the export of the ten main reports."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import cached_property, partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlens import constants as C
from orderlens.functions.measures import ascending, descending
from orderlens.operators import clean as ops
from orderlens.operators import quality as q
from orderlens.operators import quarantine
from orderlens.plans import combined, delivery, freight, policy, risk
from orderlens.sources.catalog import Tables, new_folder, register_tables, remove_folder, stored
from orderlens.sources.csv import write_report

EXPORTED = (
    "headline_kpis",
    "score_vs_delivery_days",
    "score_vs_delay",
    "score_vs_freight",
    "delivery_bucket_bad_reviews",
    "freight_by_delivery_bucket",
    "multi_seller_by_bucket",
    "seller_risk_segments",
    "worst_sellers",
    "category_risk",
)


# Tells reviews apart that agree in both ids, so that a cut list is always the same.
REVIEW_TIES = ("review_creation_date", "review_answer_timestamp", "review_score", "review_comment_message")


@dataclass(frozen=True)
class Parameters:
    """Thresholds and fixes, with their usual values."""

    delivered: str = C.DELIVERED
    bad_max: int = C.BAD_MAX
    bounds: Sequence[int] = C.BUCKET_BOUNDS
    high_risk_pct: float = C.HIGH_RISK_PCT
    min_seller_orders: int = C.MIN_SELLER_ORDERS
    min_category_orders: int = C.MIN_CATEGORY_ORDERS
    top_sellers: int = C.TOP_SELLERS
    seller_volume_cuts: Sequence[int] = C.SELLER_VOLUME_CUTS
    long_delivery_days: int = C.LONG_DELIVERY_DAYS
    near_seconds: int = C.NEAR_SIMULTANEOUS_SECONDS
    duplicates_shown: int = C.DUPLICATES_SHOWN
    gaps_shown: int = C.GAPS_SHOWN
    missing_translations: Sequence[tuple[str, str]] = tuple(C.MISSING_TRANSLATIONS)
    label_corrections: Mapping[str, str] = field(default_factory=lambda: dict(C.LABEL_CORRECTIONS))


def fixed_tables(tables: Mapping[str, DataFrame], parameters: Parameters | None = None) -> Tables:
    """The tables with blank categories nulled and translations completed and corrected."""
    p = parameters or Parameters()

    def translation() -> DataFrame:
        complete = ops.append_rows(tables["category_translation"], p.missing_translations)
        return ops.correct_labels(complete, p.label_corrections, "product_category_name_english")

    return Tables(
        {
            **{name: partial(tables.__getitem__, name) for name in tables},
            "products": lambda: ops.blank_to_null(tables["products"], "product_category_name"),
            "category_translation": translation,
        }
    )


class Analysis:
    """The derived tables and jobs of one set of tables. Nothing runs until a result is used."""

    def __init__(self, tables: Mapping[str, DataFrame], parameters: Parameters | None = None):
        self.raw = tables
        self.parameters = parameters or Parameters()
        self.tables = fixed_tables(tables, self.parameters)
        self.folders: list[str] = []

    @cached_property
    def all_delivered(self) -> DataFrame:
        return ops.orders_clean(self.tables["orders"], delivered=self.parameters.delivered)

    @cached_property
    def clean(self) -> DataFrame:
        return ops.orders_clean(self.tables["orders"], min_days=0, delivered=self.parameters.delivered)

    @cached_property
    def measures(self) -> DataFrame:
        return self.clean.select("order_id", "delivery_days", "delivery_delay_days")

    @cached_property
    def scores(self) -> DataFrame:
        return ops.order_scores(self.tables["reviews"])

    @cached_property
    def scored(self) -> DataFrame:
        return ops.scored_orders(self.measures, self.scores)

    @cached_property
    def reviewed(self) -> DataFrame:
        return ops.reviewed_orders(self.measures, self.scores)

    @cached_property
    def reviewed_with_items(self) -> DataFrame:
        return self.reviewed.join(ops.order_item_facts(self.tables["order_items"]), "order_id")

    @cached_property
    def review_keys(self) -> DataFrame:
        """Reviews without dates and comments: enough to count the deduplicated ones.

        Reviews equal in these columns have equal counts, so no other tie-break is needed.
        """
        return self.tables["reviews"].select("order_id", "review_score", "review_id")

    @cached_property
    def seller_pairs(self) -> DataFrame:
        return ops.seller_pairs(self.tables["order_items"])

    @cached_property
    def category_pairs(self) -> DataFrame:
        t = self.tables
        return ops.category_pairs(t["order_items"], t["products"], t["category_translation"])

    @cached_property
    def seller_rates(self) -> DataFrame:
        return risk.entity_rates(self.seller_pairs, self.reviewed, "seller_id", self.parameters.bad_max)

    @cached_property
    def facts(self) -> DataFrame:
        """A row per clean order: score, delivery, freight and seller group, if it has them."""
        item_facts = ops.order_item_facts(self.tables["order_items"])
        return self.scored.join(item_facts.withColumn("has_items", F.lit(True)), "order_id", "left")

    @cached_property
    def counts(self) -> DataFrame:
        """Clean orders per score, seller group, days and delay; written once if the facts are."""
        counts = combined.satisfaction_counts(self.facts)
        return self._written(counts, "satisfaction-counts") if self.folders else counts

    def counted_reports(self) -> dict[str, Callable[[], DataFrame]]:
        """The reports that come from ``counts`` alone, so that one scan of the facts serves them all."""
        names = combined.REPORTS
        return {
            name: lambda name=name: combined.reports_from_counts(self.counts, self.parameters.bounds, self.parameters.bad_max)[name]()
            for name in names
        }

    @cached_property
    def with_reasons(self) -> dict[str, DataFrame]:
        """The fixed tables with a reason for each row that breaks a key."""
        return quarantine.tables_with_reasons(self.tables, q.PRIMARY_KEYS, q.FOREIGN_KEYS)

    def stored(self) -> Analysis:
        """The same analysis, with a row of facts per clean order and a row of rates per seller written out once.

        Score, delivery, freight and seller group are joined in the first job, so
        seven of the ten exports then read a narrow table and join nothing; the two
        on sellers read the rates. ``close`` removes both folders.
        """
        copy = Analysis(self.raw, self.parameters)
        facts = copy._written(self.facts, "order-facts")
        copy.facts = facts
        copy.measures = facts
        copy.scored = facts
        copy.reviewed = facts.where("is_reviewed")
        copy.reviewed_with_items = copy.reviewed.where("has_items")
        copy.seller_rates = copy._written(copy.seller_rates, "seller-rates")
        return copy

    def _written(self, df: DataFrame, name: str) -> DataFrame:
        self.folders.append(new_folder(df.sparkSession, name))
        return stored(df, name, self.folders[-1])

    def close(self) -> None:
        """Remove what ``stored`` has written. Results that read it can't be computed after."""
        while self.folders:
            remove_folder(next(iter(self.raw.values())).sparkSession, self.folders.pop())

    def jobs(self) -> dict[str, Callable[[], DataFrame]]:
        """Every check, fix, derived table and report by name."""
        return {**self._checks(), **self._fixes(), **self._reports()}

    def _checks(self) -> dict[str, Callable[[], DataFrame]]:
        p, raw, fixed = self.parameters, self.raw, self.tables
        category, label = "product_category_name", "product_category_name_english"
        return {
            "table_row_counts": lambda: q.table_row_counts(raw),
            "join_key_match": lambda: q.join_key_match(
                raw["orders"],
                raw["customers"],
                "customer_id",
                "customer_id",
                ["customer_id", "customer_unique_id"],
            ),
            "blank_category_profile": lambda: q.blank_profile(raw["products"], category, "product_count"),
            "unmatched_categories": lambda: q.unmatched_keys(
                fixed["products"], raw["category_translation"], category, "product_count"
            ),
            "category_labels_sorted": lambda: q.category_labels(raw["category_translation"]),
            "category_dimensions_telephony": lambda: q.category_dimensions(
                raw["products"], raw["category_translation"], C.TELEPHONY_LABELS
            ),
            "category_dimensions_kitchen": lambda: q.category_dimensions(
                fixed["products"], fixed["category_translation"], C.KITCHEN_LABELS, by_weight=True
            ),
            "duplicate_labels": lambda: q.duplicate_values(fixed["category_translation"], label, "label_count"),
            "review_id_uniqueness": lambda: q.key_uniqueness(
                raw["reviews"], "review_id", "total_rows", "unique_review_ids"
            ),
            "review_order_id_uniqueness": lambda: q.key_uniqueness(
                raw["reviews"], "order_id", "total_rows", "unique_order_ids"
            ),
            "deduped_order_uniqueness": lambda: q.key_uniqueness(
                ops.dedupe_first(self.review_keys, ["order_id"], ["review_score", "review_id"]),
                "order_id",
                "total",
                "unique_orders",
            ),
            "duplicate_review_ids": lambda: q.duplicate_rows_ranked(
                raw["reviews"],
                "review_id",
                "order_id",
                p.duplicates_shown,
                F.col("review_comment_message").isNotNull(),
                REVIEW_TIES,
            ),
            "duplicate_order_ids": lambda: q.duplicate_rows_ranked(
                raw["reviews"], "order_id", "review_id", p.duplicates_shown, ties=REVIEW_TIES
            ),
            "multi_review_vs_products": lambda: q.reviews_vs_products(
                raw["orders"], raw["reviews"], raw["order_items"], p.duplicates_shown
            ),
            "shared_review_gap": lambda: q.shared_review_gap(raw["reviews"], raw["orders"], p.gaps_shown),
            "shared_review_gap_within": lambda: q.shared_review_gap_within(
                raw["reviews"], raw["orders"], p.near_seconds
            ),
            "null_counts_reviews": lambda: q.null_counts(
                ops.dedupe_first(self.review_keys, ["order_id"], ["review_score", "review_id"]),
                "reviews_deduped",
                {"review_score": "null_review_score"},
            ),
            "null_counts_orders": lambda: q.null_counts(
                raw["orders"],
                "orders",
                {
                    "order_status": "null_status",
                    "order_purchase_timestamp": "null_purchase_date",
                    "order_delivered_customer_date": "null_delivery_date",
                    "order_estimated_delivery_date": "null_estimated_date",
                },
            ),
            "null_counts_order_items": lambda: q.null_counts(
                raw["order_items"], "order_items", {"price": "null_price", "freight_value": "null_freight"}
            ),
            "order_status_distribution": lambda: q.share_of_total(
                raw["orders"],
                "order_status",
                "order_count",
                [*descending("order_count"), *ascending("order_status")],
            ),
            "delivered_without_date": lambda: q.delivered_without_date(raw["orders"], p.delivered),
            "zero_day_deliveries": lambda: q.count_where(
                self.all_delivered, F.col("delivery_days") == 0, "zero_day_deliveries"
            ),
            "very_long_deliveries": lambda: q.count_where(
                self.all_delivered, F.col("delivery_days") > p.long_delivery_days, "very_long_deliveries"
            ),
            "reconcile_row_count": lambda: q.reconcile_count(self.clean, self.all_delivered),
            "primary_key_check": lambda: q.primary_key_summary(
                {name: (fixed[name], keys) for name, keys in q.PRIMARY_KEYS.items()}
            ),
            "primary_key_violations": lambda: q.primary_key_check(
                fixed["order_items"], q.PRIMARY_KEYS["order_items"]
            ),
            "foreign_key_check": lambda: q.foreign_key_summary(fixed, q.FOREIGN_KEYS),
            "quarantine_summary": lambda: quarantine.rejection_summary(self.with_reasons),
            "quarantined_order_items": lambda: quarantine.rejected(self.with_reasons["order_items"]),
            "foreign_key_check_before_fixes": lambda: q.foreign_key_summary(raw, [q.CATEGORY_KEY]),
        }

    def _fixes(self) -> dict[str, Callable[[], DataFrame]]:
        p, raw = self.parameters, self.raw
        category, label = "product_category_name", "product_category_name_english"
        return {
            "blank_to_null": lambda: self.tables["products"].select("product_id", category),
            "append_missing_translations": lambda: ops.append_rows(
                raw["category_translation"], p.missing_translations
            ),
            "correct_labels": lambda: ops.correct_labels(
                raw["category_translation"], p.label_corrections, label
            ),
            "reviews_deduped": lambda: ops.reviews_deduped(raw["reviews"]),
            "order_scores": lambda: self.scores,
            "orders_clean_all_days": lambda: self.all_delivered,
            "orders_clean": lambda: self.clean,
            "order_freight": lambda: ops.order_freight(raw["order_items"]),
            "order_seller_groups": lambda: ops.order_item_facts(raw["order_items"]).select(
                "order_id", "seller_group"
            ),
            "seller_orders": lambda: ops.among_clean(self.seller_pairs, self.clean),
            "category_orders": lambda: ops.among_clean(self.category_pairs, self.clean),
        }

    def _reports(self) -> dict[str, Callable[[], DataFrame]]:
        p = self.parameters
        return {
            "review_score_distribution": lambda: delivery.review_score_distribution(self.scores),
            "delivery_days_distribution": lambda: delivery.delivery_days_distribution(self.all_delivered),
            "delivery_delay_distribution": lambda: delivery.delivery_delay_distribution(self.measures),
            "late_vs_on_time": lambda: delivery.late_vs_on_time(self.reviewed),
            "score_vs_delivery_days": lambda: delivery.score_vs_delivery_days(self.reviewed),
            "delivery_bucket_bad_reviews": lambda: delivery.bad_reviews_by_bucket(
                self.reviewed, p.bounds, p.bad_max
            ),
            "score_vs_delay": lambda: delivery.score_vs_delay(self.reviewed),
            "headline_kpis": lambda: delivery.headline_kpis(self.scored, p.bad_max),
            "score_vs_freight": lambda: freight.score_vs_freight(self.reviewed_with_items),
            "freight_by_delivery_bucket": lambda: freight.freight_by_delivery_bucket(
                self.reviewed_with_items, p.bounds, p.bad_max
            ),
            "freight_percentiles_by_score": lambda: freight.freight_percentiles_by_score(
                self.reviewed_with_items
            ),
            "seller_volume_percentiles": lambda: risk.seller_volume_percentiles(self.seller_pairs),
            "seller_volume_thresholds": lambda: risk.seller_volume_thresholds(
                self.seller_pairs, p.seller_volume_cuts
            ),
            "worst_sellers": lambda: risk.worst_sellers(
                self.seller_pairs,
                self.reviewed,
                p.min_seller_orders,
                p.top_sellers,
                p.bad_max,
                self.seller_rates,
            ),
            "seller_risk_all": lambda: risk.seller_risk_all(
                self.seller_pairs, self.reviewed, p.min_seller_orders, p.bad_max, self.seller_rates
            ),
            "multi_seller_by_bucket": lambda: risk.multi_seller_by_bucket(
                self.reviewed_with_items, p.bounds, p.bad_max
            ),
            "seller_risk_segments": lambda: risk.seller_risk_segments(
                self.seller_pairs, self.reviewed, p.high_risk_pct, p.bad_max, self.seller_rates
            ),
            "category_volume_distribution": lambda: risk.category_volume_distribution(
                ops.among_clean(self.category_pairs, self.measures)
            ),
            "category_risk": lambda: risk.category_risk(
                self.category_pairs, self.reviewed, p.min_category_orders, p.bad_max
            ),
            "dedup_policy_sensitivity": lambda: policy.dedup_policy_sensitivity(
                self.measures, self.tables["reviews"], p.bad_max
            ),
            "tied_lowest_reviews": lambda: policy.tied_lowest_reviews(self.tables["reviews"]),
            "seller_group_median_days": lambda: risk.seller_group_median_days(self.reviewed_with_items),
            "split_order_share": lambda: risk.split_order_share(self.reviewed_with_items),
        }


def register_views(analysis: Analysis, prefix: str = "") -> None:
    """The fixed tables and the two derived views under their names, for use from SQL."""
    derived = {
        "orders_clean": analysis.clean,
        "reviews_deduped": ops.reviews_deduped(analysis.tables["reviews"]),
    }
    register_tables({**analysis.tables, **derived}, prefix)


def export_reports(analysis: Analysis, directory: str) -> list[str]:
    """Write the ten main reports as CSV, each in its own new folder; returns the folders."""
    facts = analysis.stored()
    jobs = {**facts.jobs(), **facts.counted_reports()}
    paths = []
    try:
        for name in EXPORTED:
            path = f"{directory.rstrip('/')}/{name}"
            write_report(jobs[name](), path)
            paths.append(path)
    finally:
        facts.close()
    return paths
