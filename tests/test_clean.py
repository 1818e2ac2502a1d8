import marketplace as m
import pytest

from orderlens.constants import LABEL_CORRECTIONS, MISSING_TRANSLATIONS
from orderlens.operators import clean as ops


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_lowest_score_then_lowest_review_id_is_kept(spark):
    reviews = m.reviews(spark, [("r2", "o1", 1), ("r1", "o1", 1), ("r0", "o1", 4)])
    assert rows(ops.reviews_deduped(reviews), "review_id", "review_score") == [("r1", 1)]


def test_null_score_never_wins_over_a_score(spark):
    reviews = m.reviews(spark, [("r1", "o1", None), ("r2", "o1", 3), ("r3", "o2", None)])
    deduped = ops.reviews_deduped(reviews)
    assert {r["order_id"]: r["review_id"] for r in deduped.collect()} == {"o1": "r2", "o2": "r3"}
    assert {tuple(r) for r in ops.order_scores(reviews).collect()} == {("o1", 3), ("o2", None)}


def test_scores_equal_those_of_the_deduped_reviews(spark):
    data = [(f"r{i * 7 % 11}", f"o{i % 9}", (i * 5 % 6) or None) for i in range(60)]
    reviews = m.reviews(spark, data)
    key = ("order_id", "review_score")
    left = {tuple(r) for r in ops.reviews_deduped(reviews).select(*key).collect()}
    assert left == {tuple(r) for r in ops.order_scores(reviews).collect()}


def test_whole_days_truncate_toward_zero(spark):
    orders = m.orders(
        spark,
        [
            ("late-12h", "delivered", 60, 48),
            ("early-12h", "delivered", 60, 72),
            ("early-36h", "delivered", 60, 96),
            ("late-24h", "delivered", 72, 48),
        ],
    )
    delay = {r["order_id"]: r["delivery_delay_days"] for r in ops.orders_clean(orders).collect()}
    assert delay == {"late-12h": 0.0, "early-12h": 0.0, "early-36h": -1.0, "late-24h": 1.0}


def test_orders_clean_keeps_delivered_orders_of_a_day_or_more(spark):
    orders = m.orders(
        spark,
        [
            ("same-day", "delivered", 23, 240),
            ("one-day", "delivered", 25, 240),
            ("no-date", "delivered", None, 240),
            ("canceled", "canceled", 50, 240),
            ("before-purchase", "delivered", -30, 240),
        ],
    )
    assert rows(ops.orders_clean(orders), "order_id", "delivery_days") == [
        ("before-purchase", -1.0),
        ("one-day", 1.0),
        ("same-day", 0.0),
    ]
    assert rows(ops.orders_clean(orders, min_days=0), "order_id") == [("one-day",)]


def test_blank_becomes_null_and_text_stays(spark):
    df = spark.createDataFrame([("a", ""), ("b", None), ("c", "x")], "k string, category string")
    assert {tuple(r) for r in ops.blank_to_null(df, "category").collect()} == {("a", None), ("b", None), ("c", "x")}


def test_labels_are_added_and_corrected_and_keys_stay(spark):
    raw = spark.createDataFrame(
        [("fixed_telephony", "fixed_telephony"), ("k", "home_confort"), ("t", "telephony")],
        "product_category_name string, product_category_name_english string",
    )
    fixed = ops.correct_labels(
        ops.append_rows(raw, MISSING_TRANSLATIONS), LABEL_CORRECTIONS, "product_category_name_english"
    )
    assert dict(fixed.collect()) == {
        "fixed_telephony": "landline_telephony",
        "k": "home_comfort",
        "t": "telephony",
        **dict(MISSING_TRANSLATIONS),
    }


def test_freight_is_summed_in_exact_cents(spark):
    items = m.items(spark, [("o1", "p", "s", "0.10")] * 3 + [("o2", "p", "s", None)])
    result = {r["order_id"]: r["total_freight"] for r in ops.order_freight(items).collect()}
    assert str(result["o1"]) == "0.30" and result["o2"] is None


def test_several_items_of_a_seller_are_one_pair(spark):
    items = m.items(spark, [("o1", "p1", "s1", "1")] * 3 + [("o2", "p1", "s1", "1"), ("o2", "p2", "s2", "1")])
    assert rows(ops.seller_pairs(items), "seller_id", "order_id") == [("s1", "o1"), ("s1", "o2"), ("s2", "o2")]
    groups = {r["order_id"]: r["seller_group"] for r in ops.order_item_facts(items).collect()}
    assert groups == {"o1": "1 seller", "o2": "2+ sellers"}


def test_order_over_two_categories_counts_in_each(spark):
    items = m.items(spark, [("o1", "p1", "s", "1"), ("o1", "p2", "s", "1"), ("o1", "p3", "s", "1")])
    products = spark.createDataFrame(
        [("p1", "a"), ("p2", "b"), ("p3", None)], "product_id string, product_category_name string"
    )
    translation = spark.createDataFrame(
        [("a", "A"), ("b", "B")], "product_category_name string, product_category_name_english string"
    )
    pairs = ops.category_pairs(items, products, translation)
    assert rows(pairs, "order_id", "category_english") == [("o1", "A"), ("o1", "B")]


@pytest.mark.parametrize(
    ("kind", "values", "total"),
    [
        ("decimal(10,3)", ["0.005", "0.005"], "0.01"),
        ("decimal(10,3)", ["-0.005", "-0.010"], "-0.02"),
        ("decimal(12,2)", ["17.29", "0.29"], "17.58"),
        ("decimal(12,2)", ["-17.29", "0.29"], "-17.00"),
        ("decimal(12,1)", ["0.1", "0.2"], "0.30"),
        ("int", ["1", "2"], "3.00"),
        ("double", ["17.29", "0.29"], "17.58"),
        ("double", ["-17.29", "-0.29"], "-17.58"),
        ("float", ["0.1", "0.2"], "0.30"),
    ],
)
def test_no_part_of_an_amount_is_cut_off(spark, kind, values, total):
    items = spark.createDataFrame([("o", "s", v) for v in values], "order_id string, seller_id string, v string")
    items = items.selectExpr("order_id", "seller_id", f"CAST(v AS {kind}) AS freight_value")
    assert str(ops.order_freight(items).first()["total_freight"]) == total


def test_appended_rows_are_part_of_the_plan(spark):
    df = spark.createDataFrame([("a", 1)], "k string, n int")
    out = ops.append_rows(df, [("b", 2), (None, None)])
    assert [tuple(r) for r in out.collect()] == [("a", 1), ("b", 2), (None, None)]
    assert ops.append_rows(df, []).collect() == df.collect()
