"""Reports that look at the same orders must agree with each other."""

import pytest

from __spark_entry__ import queries


@pytest.fixture(scope="module", params=["sf0.001", "sf0.01"])
def report(spark, request):
    results = {}

    def rows(name):
        if name not in results:
            results[name] = queries()[name](spark, f"/root/testdata/{request.param}").collect()
        return results[name]

    return rows


def total(rows, column, **where):
    return sum(r[column] for r in rows if all(r[k] == v for k, v in where.items()))


def test_reviewed_orders_agree(report):
    (kpis,) = report("headline_kpis")
    for name in ("delivery_bucket_bad_reviews", "score_vs_delivery_days", "score_vs_delay", "score_vs_freight", "late_vs_on_time"):
        assert total(report(name), "order_count") == kpis["reviewed_orders"], name


def test_bad_reviews_agree(report):
    bad = total(report("delivery_bucket_bad_reviews"), "bad_reviews")
    assert bad == total(report("score_vs_delay"), "order_count", review_score=1)
    assert bad == total(report("multi_seller_by_bucket"), "bad_reviews")


def test_halves_and_groups_add_up_per_bucket(report):
    for bucket in report("delivery_bucket_bad_reviews"):
        same = {"delivery_bucket": bucket["delivery_bucket"]}
        halves = report("freight_by_delivery_bucket")
        low, high = total(halves, "low_freight_orders", **same), total(halves, "high_freight_orders", **same)
        assert low + high == bucket["order_count"]
        assert total(report("multi_seller_by_bucket"), "order_count", **same) == bucket["order_count"]


def test_split_orders_agree(report):
    (share,) = report("split_order_share")
    assert share["split_orders"] == total(report("multi_seller_by_bucket"), "order_count", seller_group="2+ sellers")


def test_segments_count_an_order_once_per_seller(report):
    segments = report("seller_risk_segments")
    assert total(segments, "total_orders") >= total(report("delivery_bucket_bad_reviews"), "order_count")
    assert total(segments, "pct_of_all_bad_reviews") == pytest.approx(100, abs=0.2)


def test_row_counts_reconcile(report):
    before, after = len(report("orders_clean_all_days")), len(report("orders_clean"))
    assert report("reconcile_row_count")[0]["difference"] == before - after
    assert report("headline_kpis")[0]["orders_analyzed"] == after
