"""Rows set aside: each row once, the first reason that applies."""

import pytest

from orderlens.operators import quarantine as qa
from orderlens.operators.quality import FOREIGN_KEYS, PRIMARY_KEYS
from orderlens.sample.queries import sample_analysis
from orderlens.sources.csv import read_csv_table

ROWS = [(1, 1, 10), (1, 2, 10), (2, 1, 99), (3, 1, None), (None, 1, 99), (4, 7, 10), (4, 7, 99), (4, 8, 11)]


def test_first_reason_of_each_row(spark):
    items = spark.createDataFrame(ROWS, "k long, n int, parent long")
    parents = spark.createDataFrame([(10,), (10,), (11,), (None,)], "parent long")
    rows = qa.with_reasons(items, ["k", "n"], {"parent": parents})
    reasons = ["accepted" if r.reject_reason is None else r.reject_reason for r in sorted(rows.collect(), key=lambda r: (r.k or 9, r.n, r.parent or 0))]
    assert reasons == ["accepted", "accepted", "orphan parent", "accepted", "repeated key", "repeated key", "accepted", "null key"]
    assert rows.columns == [*items.columns, "reject_reason"]


def test_accepted_and_rejected_add_up(spark):
    analysis = sample_analysis(spark, "/root/testdata/sf0.001")
    set_aside = 0
    for name, rows in qa.tables_with_reasons(analysis.tables, PRIMARY_KEYS, FOREIGN_KEYS).items():
        total = analysis.tables[name].count()
        good, bad = qa.accepted(rows), qa.rejected(rows)
        assert good.count() + bad.count() == total, name
        set_aside += bad.count()
        assert good.columns == analysis.tables[name].columns
        keys = PRIMARY_KEYS.get(name)
        if keys:
            assert good.dropna(subset=list(keys)).select(*keys).distinct().count() == good.count(), name
    assert set_aside > 0


def test_accepted_rows_break_no_constraint_but_rows_of_rejected_parents(spark):
    orders = spark.createDataFrame([(1, 5), (1, 6), (2, 5)], "order_id long, customer_id long")
    customers = spark.createDataFrame([(5,), (6,)], "customer_id long")
    items = spark.createDataFrame([(1, 1), (2, 1), (3, 1)], "order_id long, order_item_id int")
    rows = qa.tables_with_reasons(
        {"orders": orders, "customers": customers, "order_items": items},
        {"orders": ["order_id"], "order_items": ["order_id", "order_item_id"]},
        [("orders", "customers", "customer_id"), ("order_items", "orders", "order_id")],
    )
    assert {r.order_id: r.reject_reason for r in rows["order_items"].collect()} == {1: None, 2: None, 3: "orphan order_id"}
    assert sorted(r.reject_reason or "" for r in rows["orders"].collect()) == ["", "repeated key", "repeated key"]


@pytest.mark.parametrize("multiline", [False, True])
def test_unreadable_rows_come_first(spark, tmp_path, multiline):
    (tmp_path / "t.csv").write_text("k,n\n1,1\n2,x\n2,2\n3,3\n3,4\n,5\n")
    df = read_csv_table(spark, str(tmp_path), "k long, n int", multiline, corrupt_column="bad")
    rows = qa.with_reasons(df, ["k"], corrupt_column="bad").collect()
    assert sorted((r.k or 0, r.reject_reason or "") for r in rows) == [
        (0, "null key"), (1, ""), (2, ""), (2, "unreadable"), (3, "repeated key"), (3, "repeated key"),
    ]


def test_a_hot_key_and_empty_tables(spark):
    hot = spark.range(30_000).selectExpr("CASE WHEN id % 3 = 0 THEN 0 ELSE id END AS k")
    counts = {r.reject_reason: r.row_count for r in qa.rejection_summary({"t": qa.with_reasons(hot, ["k"])}).collect()}
    assert counts == {"accepted": 20_000, "repeated key": 10_000}
    assert qa.with_reasons(hot.limit(0), ["k"], {"k": hot.limit(0)}).collect() == []
