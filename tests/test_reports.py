import marketplace as m
import pytest

from orderlens.operators import clean as ops
from orderlens.plans import delivery, freight, policy, risk


def reviewed(spark, days_and_scores):
    orders = m.delivered(spark, [d for d, _ in days_and_scores])
    reviews = m.reviews(spark, [(f"r{i}", f"o{i}", s) for i, (_, s) in enumerate(days_and_scores)])
    return ops.reviewed_orders(ops.orders_clean(orders, 0), ops.order_scores(reviews))


def test_bucket_edges(spark):
    days = [1, 7, 8, 14, 15, 21, 22, 30, 31, 209]
    report = delivery.bad_reviews_by_bucket(reviewed(spark, [(d, 3 if d < 20 else 4) for d in days]))
    assert [tuple(r) for r in report.collect()] == [
        ("1. 0-7 days", 2, 2, 100.0),
        ("2. 8-14 days", 2, 2, 100.0),
        ("3. 15-21 days", 2, 1, 50.0),
        ("4. 22-30 days", 2, 0, 0.0),
        ("5. 31+ days", 2, 0, 0.0),
    ]


def test_order_without_score_counts_but_is_not_bad(spark):
    report = delivery.bad_reviews_by_bucket(reviewed(spark, [(1, None), (1, 1), (1, 5)]))
    assert [tuple(r) for r in report.collect()] == [("1. 0-7 days", 3, 1, 33.3)]


def test_late_means_a_whole_day(spark):
    orders = m.orders(spark, [("o0", "delivered", 71, 48), ("o1", "delivered", 72, 48), ("o2", "delivered", 48, 96)])
    reviews = m.reviews(spark, [("a", "o0", 5), ("b", "o1", 1), ("c", "o2", 4)])
    base = ops.reviewed_orders(ops.orders_clean(orders, 0), ops.order_scores(reviews))
    assert [tuple(r) for r in delivery.late_vs_on_time(base).collect()] == [
        ("Late", 1, 1.0),
        ("On Time or Early", 2, 4.5),
    ]


def test_by_score_has_mean_and_median(spark):
    base = reviewed(spark, [(1, 1), (2, 1), (4, 1), (10, 5), (11, 5)])
    assert [tuple(r) for r in delivery.score_vs_delivery_days(base).collect()] == [
        (1, 3, 2.3, 2.0),
        (5, 2, 10.5, 10.5),
    ]


def test_distribution_of_delay(spark):
    orders = m.orders(spark, [(f"o{i}", "delivered", 24 * 10 + 24 * i, 24 * 10) for i in (-3, -2, 0, 1)])
    row = delivery.delivery_delay_distribution(ops.orders_clean(orders, 0)).first().asDict()
    assert row == {
        "min_delay": -3.0,
        "max_delay": 1.0,
        "avg_delay": -1.0,
        "p25": -2.25,
        "median": -1.0,
        "p75": 0.25,
        "p90": pytest.approx(0.7),
        "late_orders": 1,
        "on_time_or_early_orders": 3,
    }


def test_headline_counts_orders_without_review(spark):
    clean = ops.orders_clean(m.delivered(spark, [1, 3, 9, 50]), 0)
    scores = ops.order_scores(m.reviews(spark, [("a", "o0", 1), ("b", "o1", 5), ("b", "o1", 4), ("c", "o2", 3), ("d", "zz", 1)]))
    assert tuple(delivery.headline_kpis(ops.scored_orders(clean, scores)).first()) == (4, 3, 3.0, 66.7)
    empty = ops.scored_orders(clean.limit(0), scores)
    assert tuple(delivery.headline_kpis(empty).first()) == (0, 0, None, None)


def with_freight(spark, reviewed_orders, amounts):
    items = m.items(spark, [(f"o{i}", "p", "s", a) for i, a in enumerate(amounts)])
    return reviewed_orders.join(ops.order_item_facts(items), "order_id")


def test_empty_freight_half_is_null_and_no_error(spark):
    base = reviewed(spark, [(1, 1), (1, 5), (10, 1), (10, 5), (10, 5), (40, 5)])
    report = freight.freight_by_delivery_bucket(with_freight(spark, base, ["1", "2", "9", "9", "9", None]))
    assert [tuple(r) for r in report.collect()] == [
        ("1. 0-7 days", 2, 50.0, 0, None),
        ("2. 8-14 days", 3, 33.3, 0, None),
        ("5. 31+ days", 0, None, 0, None),
    ]


def test_freight_split_at_a_median_between_two_orders(spark):
    base = reviewed(spark, [(1, 1), (1, 5), (1, 2), (1, 5)])
    report = freight.freight_by_delivery_bucket(with_freight(spark, base, ["1.00", "1.01", "1.02", "5"]))
    assert [tuple(r) for r in report.collect()] == [("1. 0-7 days", 2, 50.0, 2, 50.0)]


def test_score_vs_freight(spark):
    base = reviewed(spark, [(1, 1), (1, 1), (1, 1), (1, 5), (1, None)])
    orders = with_freight(spark, base, ["1.00", "2.01", None, "3.50", "7"])
    assert [tuple(r) for r in freight.score_vs_freight(orders).collect()] == [
        (1, 3, 1.51, 1.505),
        (5, 1, 3.5, 3.5),
        (None, 1, 7.0, 7.0),
    ]
    table = freight.freight_percentiles_by_score(orders).collect()
    assert [tuple(r) for r in table] == [
        (1, 3, 1.25, 1.51, 1.76, 2.0),
        (5, 1, 3.5, 3.5, 3.5, 3.5),
        (None, 1, 7.0, 7.0, 7.0, 7.0),
    ]


def seller_case(spark):
    """s-low 0 of 20 bad, s-edge 7 of 20 (35.0), s-high 8 of 20, s-few 1 of 1."""
    bad = {"s-low": (20, 0), "s-edge": (20, 7), "s-high": (20, 8), "s-few": (1, 1)}
    scores, pairs = [], []
    for seller, (count, bad_count) in bad.items():
        for i in range(count):
            pairs.append((f"o{len(scores)}", "p", seller, "1"))
            scores.append((2, 3 if i < bad_count else 5))
    items = m.items(spark, pairs * 2)
    return ops.seller_pairs(items), reviewed(spark, scores)


def test_segments_with_a_seller_exactly_at_the_boundary(spark):
    pairs, base = seller_case(spark)
    assert [tuple(r) for r in risk.seller_risk_segments(pairs, base).collect()] == [
        ("1. Below Platform Average", 1, 20, 0, 0.0),
        ("2. Moderate Risk (26.2% - 35%)", 1, 20, 7, 43.8),
        ("3. High Risk (35%+)", 2, 21, 9, 56.3),
    ]


def test_whole_number_average_keeps_its_decimal_in_the_label(spark):
    base = reviewed(spark, [(2, 1), (2, 5), (2, 5), (2, 5)])
    items = m.items(spark, [(f"o{i}", "p", "s", "1") for i in range(4)])
    report = risk.seller_risk_segments(ops.seller_pairs(items), base).collect()
    assert [r["seller_segment"] for r in report] == ["2. Moderate Risk (25.0% - 35%)"]


def test_worst_sellers_need_enough_orders(spark):
    pairs, base = seller_case(spark)
    everyone = risk.seller_risk_all(pairs, base).collect()
    assert [tuple(r) for r in everyone] == [
        ("s-high", 20, 8, 40.0, 4.2),
        ("s-edge", 20, 7, 35.0, 4.3),
        ("s-low", 20, 0, 0.0, 5.0),
    ]
    assert risk.worst_sellers(pairs, base, limit=2).collect() == everyone[:2]
    assert risk.worst_sellers(pairs, base, min_orders=1, limit=1).first()["seller_id"] == "s-few"


def test_ties_on_the_rounded_rate_are_ordered_by_id(spark):
    # 10 of 999 and 5 of 500 differ, but both round to 1.0.
    scores = [(1, 1 if i < 10 else 5) for i in range(999)] + [(1, 1 if i < 5 else 5) for i in range(500)]
    items = m.items(spark, [(f"o{i}", "p", "b" if i < 999 else "a", "1") for i in range(1499)])
    found = risk.seller_risk_all(ops.seller_pairs(items), reviewed(spark, scores)).collect()
    assert [(r["seller_id"], r["bad_review_pct"]) for r in found] == [("a", 1.0), ("b", 1.0)]


def test_volumes(spark):
    pairs = ops.seller_pairs(m.items(spark, [(f"o{i}", "p", f"s{i % 7 % 3}", "1") for i in range(70)]))
    assert tuple(risk.seller_volume_thresholds(pairs, [20, 30]).first()) == (3, 1, 3)
    row = risk.seller_volume_percentiles(pairs).first().asDict()
    assert (row["min_orders"], row["p50"], row["max_orders"]) == (20, 20.0, 30)


def test_split_orders(spark):
    base = reviewed(spark, [(7, 1), (10, 5), (12, 5), (40, 2)])
    items = m.items(spark, [("o0", "p", "a", "1"), ("o0", "p", "b", "1"), ("o1", "p", "a", "1"), ("o1", "q", "a", "1"), ("o2", "p", "a", "1"), ("o3", "p", "a", "1")])
    orders = base.join(ops.order_item_facts(items), "order_id")
    assert [tuple(r) for r in risk.multi_seller_by_bucket(orders).collect()] == [
        ("1. 0-7 days", "2+ sellers", 1, 1, 100.0),
        ("2. 8-14 days", "1 seller", 2, 0, 0.0),
        ("5. 31+ days", "1 seller", 1, 1, 100.0),
    ]
    assert tuple(risk.split_order_share(orders).first()) == (1, 4, 25.0)
    assert [tuple(r) for r in risk.seller_group_median_days(orders).collect()] == [
        ("1 seller", 3, 12.0),
        ("2+ sellers", 1, 7.0),
    ]


def test_policies_and_ties(spark):
    reviews = m.reviews(
        spark,
        [("a", "o0", 1), ("b", "o0", 5), ("c", "o1", 3), ("d", "o1", 4), ("e", "o2", 2), ("f", "o2", 2), ("g", "o3", 5),
         ("h", "o3", 5), ("i", "o3", None), ("j", "o4", None), ("k", "o4", None)],
    )
    clean = ops.orders_clean(m.delivered(spark, [1, 1, 1, 1]), 0)
    assert {r["policy"]: (r["reviewed_orders"], r["bad_reviews"], r["bad_review_pct"]) for r in policy.dedup_policy_sensitivity(clean, reviews).collect()} == {
        "lowest": (4, 3, 75.0),
        "highest": (4, 1, 25.0),
        "average": (4, 2, 50.0),
    }
    assert policy.tied_lowest_reviews(reviews).first()["tied_orders"] == 3
