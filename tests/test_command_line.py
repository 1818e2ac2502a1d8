"""From nine CSV files to reports, with the usual parameters."""

import csv
from pathlib import Path

import pytest

from orderlens.__main__ import main
from orderlens.plans.workflow import EXPORTED

TABLES = {
    "customers": "customer_id,customer_unique_id,customer_zip_code_prefix,customer_city,customer_state\nc1,u1,1,x,SP\nc2,u2,1,x,SP\nc3,u2,1,x,SP\n",
    "orders": """order_id,customer_id,order_status,order_purchase_timestamp,order_approved_at,order_delivered_carrier_date,order_delivered_customer_date,order_estimated_delivery_date
o1,c1,delivered,2018-01-01 10:00:00,,,2018-01-04 12:00:00,2018-01-20 00:00:00
o2,c2,delivered,2018-01-01 10:00:00,,,2018-02-20 12:00:00,2018-01-20 00:00:00
o3,c3,delivered,2018-01-01 10:00:00,,,,2018-01-20 00:00:00
""",
    "order_items": """order_id,order_item_id,product_id,seller_id,shipping_limit_date,price,freight_value
o1,1,p1,s1,2018-01-03 00:00:00,10.00,1.50
o1,2,p1,s1,2018-01-03 00:00:00,10.00,1.50
o2,1,p2,s2,2018-01-03 00:00:00,20.00,9.90
o2,2,p1,s1,2018-01-03 00:00:00,20.00,0.10
""",
    "reviews": '''review_id,order_id,review_score,review_comment_title,review_comment_message,review_creation_date,review_answer_timestamp
r1,o1,5,,"very
good ""indeed""",2018-01-05 00:00:00,2018-01-05 00:00:00
r2,o2,1,,late,2018-02-21 00:00:00,2018-02-21 00:00:00
r3,o2,4,"",,2018-02-21 00:00:00,2018-02-21 00:00:00
''',
    "products": """product_id,product_category_name,product_name_lenght,product_description_lenght,product_photos_qty,product_weight_g,product_length_cm,product_height_cm,product_width_cm
p1,telefonia_fixa,1,1,1,660.5,20,10,10
p2,pc_gamer,1,1,1,5000,40,30,20
p3,"",1,1,1,1,1,1,1
""",
    "sellers": "seller_id,seller_zip_code_prefix,seller_city,seller_state\ns1,1,x,SP\ns2,1,x,SP\n",
    "payments": "order_id,payment_sequential,payment_type,payment_installments,payment_value\no1,1,card,1,23.00\n",
    "geolocation": "geolocation_zip_code_prefix,geolocation_lat,geolocation_lng,geolocation_city,geolocation_state\n1,-23.5,-46.6,x,SP\n",
    "category_translation": "product_category_name,product_category_name_english\ntelefonia_fixa,fixed_telephony\n",
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("csv-tables")
    for name, text in TABLES.items():
        (path / f"{name}.csv").write_text(text)
    return path


def read(folder, name):
    rows = []
    for file in sorted((Path(folder) / name).glob("*.csv")):
        with file.open() as lines:
            rows += list(csv.DictReader(lines))
    return rows


def test_ten_reports_from_csv(spark, folder, tmp_path):
    main(["--tables", str(folder), "--out", str(tmp_path / "out")])
    reports = {name: read(tmp_path / "out", name) for name in EXPORTED}
    assert reports["headline_kpis"] == [
        {"orders_analyzed": "2", "reviewed_orders": "2", "median_delivery_days": "26.5", "bad_review_pct": "50.0"}
    ]
    assert [r["delivery_bucket"] for r in reports["delivery_bucket_bad_reviews"]] == ["1. 0-7 days", "5. 31+ days"]
    assert [r["seller_group"] for r in reports["multi_seller_by_bucket"]] == ["1 seller", "2+ sellers"]
    assert [r["median_freight"] for r in reports["score_vs_freight"]] == ["10.0", "3.0"]


def test_chosen_jobs(spark, folder, tmp_path):
    jobs = ["blank_category_profile", "category_orders", "delivered_without_date", "foreign_key_check"]
    main(["--tables", str(folder), "--out", str(tmp_path / "out"), "--jobs", *jobs])
    assert read(tmp_path / "out", "blank_category_profile") == [{"product_category_name": "", "product_count": "1"}]
    pairs = {(r["order_id"], r["category_english"]) for r in read(tmp_path / "out", "category_orders")}
    assert pairs == {("o1", "landline_telephony"), ("o2", "landline_telephony"), ("o2", "pc_gamer")}
    assert [r["order_id"] for r in read(tmp_path / "out", "delivered_without_date")] == ["o3"]
    assert {r["orphan_rows"] for r in read(tmp_path / "out", "foreign_key_check")} == {"0"}


def test_unknown_job_is_refused(spark, folder, tmp_path):
    with pytest.raises(SystemExit):
        main(["--tables", str(folder), "--out", str(tmp_path / "out"), "--jobs", "no_such_job"])
