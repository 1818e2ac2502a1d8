"""What each sample query must return, as SQL on the star-schema tables.

The statements follow the definitions as directly as SQL allows (window over all
rows, join first and count distinct after), and share no logic with the jobs.
Thresholds and made-up labels are those of the sample tables.
"""

from __future__ import annotations

from orderlens.plans.combined import REPORTS
from orderlens.plans.workflow import EXPORTED
from orderlens.sample.queries import PARAMETERS
from orderlens.sample.tables import ESTIMATE_DAYS, RAW_LABELS, UNTRANSLATED

_UNTRANSLATED_NAMES = ", ".join(f"'{name}'" for name, _ in UNTRANSLATED)
_RAW_LABEL = " ".join(f"WHEN '{brand}' THEN '{label}'" for brand, label in RAW_LABELS.items())
_KITCHEN = ("la_cuisine", "food", "food_drink", "drinks", "housewares", "small_appliances")
# Written out, so that a slip in the corrections under test is noticed.
_CORRECTION = """
    WHEN 'fashio_female_clothing' THEN 'fashion_female_clothing'
    WHEN 'home_confort' THEN 'home_comfort'
    WHEN 'costruction_tools_garden' THEN 'construction_tools_garden'
    WHEN 'costruction_tools_tools' THEN 'construction_tools_tools'
    WHEN 'arts_and_craftmanship' THEN 'arts_and_craftsmanship'
    WHEN 'security_and_services' THEN 'insurance_and_services'
    WHEN 'cds_dvds_musicals' THEN 'cds_dvds_music'
    WHEN 'cine_photo' THEN 'photography_and_video_equipment'
    WHEN 'fixed_telephony' THEN 'landline_telephony'
"""
_ADDED = ", ".join(f"('{name}', '{label}')" for name, label in UNTRANSLATED)

# Name, needed names, and body of each common table.
_TABLES: dict[str, tuple[tuple[str, ...], str]] = {
    "t_sellers": (
        (),
        """SELECT CASE WHEN s_suppkey % 9 = 7 THEN s_suppkey - 1 WHEN s_suppkey % 8 <> 3 THEN s_suppkey END
               AS seller_id FROM supplier""",
    ),
    "t_payments": (
        (),
        """SELECT CASE WHEN o_orderkey % 211 = 0 THEN o_orderkey + 100000000
                    WHEN o_orderkey % 223 <> 0 THEN o_orderkey END AS order_id FROM orders""",
    ),
    "t_customers": (
        (),
        """SELECT CASE WHEN c_custkey % 83 = 5 THEN c_custkey - 1 WHEN c_custkey % 89 <> 7 THEN c_custkey END
               AS customer_id, c_custkey + c_nationkey AS customer_unique_id FROM customer""",
    ),
    "t_orders": (
        (),
        f"""SELECT o_orderkey AS order_id,
               CASE WHEN o_orderkey % 157 = 0 THEN o_custkey + 100000000
                    WHEN o_orderkey % 151 <> 0 THEN o_custkey END AS customer_id,
               o_orderstatus AS order_status,
               o_orderdate AS order_purchase_timestamp,
               (SELECT max(l_shipdate) FROM lineitem WHERE l_orderkey = o_orderkey)
                   AS order_delivered_customer_date,
               o_orderdate + INTERVAL {ESTIMATE_DAYS} DAY AS order_estimated_delivery_date
            FROM orders""",
    ),
    "t_items": (
        (),
        """SELECT
               CASE WHEN l_orderkey % 307 = 0 AND l_linenumber = 1 THEN l_orderkey + 100000000 ELSE l_orderkey END
                   AS order_id,
               CASE WHEN l_orderkey % 401 = 0 AND l_linenumber = 2 THEN NULL ELSE l_linenumber END AS order_item_id,
               CASE WHEN l_partkey % 97 = 0 THEN l_partkey + 100000000 ELSE l_partkey END AS product_id,
               CASE WHEN l_orderkey % 101 = 0 THEN l_suppkey + 100000000 ELSE l_suppkey END AS seller_id,
               CASE WHEN l_orderkey % 13 = 0 AND l_linenumber = 5 THEN NULL
                   ELSE CAST(l_extendedprice AS DECIMAL(12,2)) END AS price,
               CASE WHEN l_orderkey % 17 = 0 AND l_linenumber = 6 THEN NULL
                   ELSE CAST(l_extendedprice AS DECIMAL(12,2)) END AS freight_value
           FROM lineitem""",
    ),
    "t_reviews": (
        (),
        """SELECT user_id AS review_id,
               CASE WHEN event_id % 333 = 0 THEN event_id + 100000000
                    WHEN event_id % 777 = 5 THEN NULL
                    WHEN event_id % 10 < 4 THEN event_id // 10 * 5 ELSE event_id // 2 END AS order_id,
               CASE WHEN event_id % 29 = 0 THEN NULL WHEN event_type = 'error' THEN 1 WHEN event_type = 'view' THEN 2
                    WHEN event_type = 'click' THEN 3 WHEN event_type = 'signup' THEN 4
                    WHEN event_type = 'purchase' THEN 5 END AS review_score,
               event_type AS review_comment_title,
               CASE WHEN event_type <> 'signup' THEN props END AS review_comment_message,
               ts AS review_creation_date, ts AS review_answer_timestamp
           FROM events""",
    ),
    "t_products": (
        (),
        """SELECT CASE WHEN p_partkey % 23 = 11 THEN p_partkey - 1 WHEN p_partkey % 31 <> 3 THEN p_partkey END
                   AS product_id,
               CASE p_size WHEN 1 THEN '' WHEN 2 THEN NULL ELSE p_brand END AS product_category_name,
               p_retailprice AS product_weight_g, CAST(p_size AS DOUBLE) AS product_length_cm,
               p_size / 4 AS product_height_cm
           FROM part""",
    ),
    "t_translation": (
        (),
        f"""SELECT DISTINCT p_brand AS product_category_name,
               CASE p_brand {_RAW_LABEL} ELSE lower(replace(p_brand, '#', '_')) END
                   AS product_category_name_english
            FROM part WHERE p_brand NOT IN ({_UNTRANSLATED_NAMES})""",
    ),
    "products_fixed": (
        ("t_products",),
        """SELECT * REPLACE (CASE WHEN product_category_name <> '' THEN product_category_name END
               AS product_category_name) FROM t_products""",
    ),
    "translation_added": (
        ("t_translation",),
        f"""SELECT * FROM t_translation
            UNION ALL SELECT * FROM (VALUES {_ADDED}) AS added(product_category_name, product_category_name_english)""",
    ),
    "translation_fixed": (
        ("translation_added",),
        f"""SELECT product_category_name,
               CASE product_category_name_english {_CORRECTION} ELSE product_category_name_english END
                   AS product_category_name_english
            FROM translation_added""",
    ),
    "deduped": (
        ("t_reviews",),
        """SELECT * FROM t_reviews
           QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY review_score ASC NULLS LAST,
               review_id ASC NULLS LAST, review_creation_date ASC NULLS LAST) = 1""",
    ),
    "all_delivered": (
        ("t_orders",),
        """SELECT order_id, customer_id, order_purchase_timestamp, order_delivered_customer_date,
               order_estimated_delivery_date,
               CAST(date_part('day', order_delivered_customer_date - order_purchase_timestamp) AS DOUBLE)
                   AS delivery_days,
               CAST(date_part('day', order_delivered_customer_date - order_estimated_delivery_date) AS DOUBLE)
                   AS delivery_delay_days
           FROM t_orders
           WHERE order_status = 'F' AND order_delivered_customer_date IS NOT NULL""",
    ),
    "clean": (("all_delivered",), "SELECT * FROM all_delivered WHERE delivery_days > 0"),
    "reviewed": (
        ("clean", "deduped"),
        """SELECT clean.*, review_score, CAST(review_score <= 1 AS INTEGER) AS bad
           FROM clean JOIN deduped USING (order_id)""",
    ),
    "freight": (
        ("t_items",),
        """SELECT order_id, CAST(sum(freight_value) AS DOUBLE) AS total_freight
           FROM t_items GROUP BY order_id""",
    ),
    "seller_groups": (
        ("t_items",),
        """SELECT order_id, CASE count(DISTINCT seller_id) WHEN 1 THEN '1 seller' ELSE '2+ sellers' END
               AS seller_group
           FROM t_items GROUP BY order_id""",
    ),
    "item_labels": (
        ("t_items", "products_fixed", "translation_fixed"),
        """SELECT order_id, product_category_name_english AS category_english
           FROM t_items JOIN products_fixed USING (product_id)
               JOIN translation_fixed USING (product_category_name)""",
    ),
    "seller_volumes": (
        ("t_items",),
        "SELECT seller_id, count(DISTINCT order_id) AS order_count FROM t_items GROUP BY seller_id",
    ),
}


def _r(expression: str, digits: int) -> str:
    """Rounding half away from zero, through an exact decimal."""
    return f"CAST(round(CAST({expression} AS DECIMAL(28,10)), {digits}) AS DOUBLE)"


def _count(expression: str) -> str:
    return f"CAST(coalesce(sum({expression}), 0) AS BIGINT)"


def _quantile(column: str, p: float, digits: int = 4) -> str:
    return _r(f"quantile_cont({column}, {p})", digits)


_BAD_PCT = _r("100 * avg(coalesce(bad, 0))", 1)


def _entity_rates(entity: str, source: str) -> str:
    return f"""SELECT {entity}, count(*) AS order_count, {_count('bad')} AS bad_reviews,
            {_BAD_PCT} AS bad_review_pct, {_r('avg(review_score)', 2)} AS avg_review_score
        FROM (SELECT DISTINCT {entity}, order_id FROM {source}) JOIN reviewed USING (order_id)
        GROUP BY {entity}"""


_TABLES["seller_rates"] = (("t_items", "reviewed"), _entity_rates("seller_id", "t_items"))
_TABLES["category_rates"] = (("item_labels", "reviewed"), _entity_rates("category_english", "item_labels"))


def _bucket(days: str) -> str:
    lows = [0, *[b + 1 for b in PARAMETERS.bounds]]
    whens = " ".join(
        f"WHEN {days} <= {high} THEN '{i + 1}. {lows[i]}-{high} days'" for i, high in enumerate(PARAMETERS.bounds)
    )
    return f"CASE {whens} ELSE '{len(lows)}. {lows[-1]}+ days' END"


def _with(body: str, *names: str) -> str:
    """The body after the common tables it names and those they need, each once."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for needed in _TABLES[name][0]:
            add(needed)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        add(name)
    ctes = ",\n".join(f"{name} AS ({_TABLES[name][1]})" for name in ordered)
    return f"WITH {ctes}\n{body}"


def _distribution(column: str, suffix: str) -> str:
    percentiles = {"p25": 0.25, "median": 0.5, "p75": 0.75, "p90": 0.9}
    return f"""min({column}) AS min_{suffix}, max({column}) AS max_{suffix}, {_r(f'avg({column})', 1)} AS avg_{suffix},
        {', '.join(f'{_quantile(column, p)} AS {name}' for name, p in percentiles.items())}"""


def _by_score(column: str, suffix: str, join: str = "", digits: int = 1) -> str:
    return f"""SELECT review_score, count(*) AS order_count, {_r(f'avg({column})', digits)} AS avg_{suffix},
            {_quantile(column, 0.5)} AS median_{suffix}
        FROM reviewed {join} GROUP BY review_score ORDER BY review_score"""


def _share(source: str, column: str, count_name: str) -> str:
    return f"""SELECT {column}, count(*) AS {count_name},
            {_r(f'100.0 * count(*) / (SELECT count(*) FROM {source})', 2)} AS pct_of_total
        FROM {source} GROUP BY {column}"""


def _null_counts(source: str, table_name: str, columns: dict[str, str]) -> str:
    nulls = ", ".join(f"count(*) - count({c}) AS {name}" for c, name in columns.items())
    return f"SELECT '{table_name}' AS table_name, count(*) AS total_rows, {nulls} FROM {source}"


def _dimensions(translation: str, products: str, labels: tuple[str, ...]) -> str:
    names = ", ".join(f"'{label}'" for label in labels)
    return f"""SELECT product_category_name_english AS category, count(*) AS products,
            {_r('avg(product_weight_g)', 0)} AS avg_weight_g, {_r('avg(product_length_cm)', 0)} AS avg_length_cm,
            {_r('avg(product_height_cm)', 0)} AS avg_height_cm
        FROM {products} JOIN {translation} USING (product_category_name)
        WHERE product_category_name_english IN ({names}) GROUP BY category"""


def _primary_key(name: str, source: str, keys: tuple[str, ...]) -> str:
    columns = ", ".join(keys)
    missing = " OR ".join(f"{k} IS NULL" for k in keys)
    return f"""SELECT '{name}' AS table_name, '{columns}' AS key_columns,
            count(*) FILTER (WHERE n > 1 AND NOT missing) AS duplicate_keys,
            CAST(coalesce(sum(n) FILTER (WHERE n > 1 AND NOT missing), 0) AS BIGINT) AS duplicate_rows,
            CAST(coalesce(sum(n) FILTER (WHERE missing), 0) AS BIGINT) AS null_key_rows
        FROM (SELECT {columns}, count(*) AS n, {missing} AS missing FROM {source} GROUP BY {columns})"""


def _foreign_key(child: str, parent: str, key: str, child_source: str, parent_source: str) -> str:
    return f"""SELECT '{child}' AS child_table, '{parent}' AS parent_table, '{key}' AS key_column,
            count(DISTINCT {key}) AS orphan_keys, count(*) AS orphan_rows
        FROM {child_source} AS child
        WHERE {key} IS NOT NULL
          AND NOT EXISTS (SELECT 1 FROM {parent_source} AS parent WHERE parent.{key} = child.{key})"""


def _uniqueness(source: str, key: str, total_name: str, unique_name: str) -> str:
    return f"""SELECT {_count('n')} AS {total_name}, count({key}) AS {unique_name}
        FROM (SELECT {key}, count(*) AS n FROM {source} GROUP BY {key})"""


def _policy(name: str, score: str) -> str:
    return f"""SELECT '{name}' AS policy, count(*) AS reviewed_orders,
            count(*) FILTER (WHERE score <= {PARAMETERS.bad_max}) AS bad_reviews,
            {_r(f'100.0 * count(*) FILTER (WHERE score <= {PARAMETERS.bad_max}) / count(*)', 2)} AS bad_review_pct
        FROM clean JOIN (SELECT order_id, {score} AS score FROM t_reviews GROUP BY order_id) USING (order_id)"""


def _half(name: str, condition: str) -> str:
    return f"""count(*) FILTER (WHERE {condition}) AS {name}_freight_orders,
        {_r(f'100 * avg(coalesce(bad, 0)) FILTER (WHERE {condition})', 1)} AS {name}_freight_bad_pct"""


def sample_oracle() -> dict[str, str]:
    t = PARAMETERS
    bucket = _bucket("delivery_days")
    bucket_rates = f"count(*) AS order_count, {_count('bad')} AS bad_reviews, {_BAD_PCT} AS bad_review_pct"
    bucket_report = _with(
        f"SELECT {bucket} AS delivery_bucket, {bucket_rates} FROM reviewed GROUP BY 1 ORDER BY 1", "reviewed"
    )
    median = "(SELECT quantile_cont(total_freight, 0.5) FROM freight JOIN reviewed USING (order_id))"
    platform = f"(SELECT {_BAD_PCT} FROM reviewed)"
    high = f"{t.high_risk_pct:g}"
    reviews_csv = _with(
        """SELECT * REPLACE (
               review_comment_message || chr(10) || 'said "' || review_comment_title || '"'
                   AS review_comment_message,
               CASE review_score WHEN 1 THEN '' WHEN 2 THEN NULL ELSE review_comment_title END
                   AS review_comment_title)
           FROM t_reviews""",
        "t_reviews",
    )
    row_counts = {
        "customers": "customer",
        "geolocation": "customer",
        "order_items": "lineitem",
        "payments": "orders",
        "reviews": "events",
        "orders": "orders",
        "products": "part",
        "sellers": "supplier",
        "category_translation": "t_translation",
    }
    sources = {
        "sellers": "t_sellers",
        "orders": "t_orders",
        "customers": "t_customers",
        "products": "products_fixed",
        "category_translation": "translation_fixed",
        "order_items": "t_items",
        "reviews": "t_reviews",
        "payments": "t_payments",
    }
    primary_keys = {
        "sellers": ("seller_id",),
        "orders": ("order_id",),
        "customers": ("customer_id",),
        "products": ("product_id",),
        "category_translation": ("product_category_name",),
        "order_items": ("order_id", "order_item_id"),
    }
    foreign_keys = [
        ("order_items", "orders", "order_id"),
        ("order_items", "products", "product_id"),
        ("order_items", "sellers", "seller_id"),
        ("orders", "customers", "customer_id"),
        ("reviews", "orders", "order_id"),
        ("payments", "orders", "order_id"),
        ("products", "category_translation", "product_category_name"),
    ]
    key_tables = (
        "t_orders",
        "t_customers",
        "products_fixed",
        "translation_fixed",
        "t_items",
        "t_reviews",
        "t_sellers",
        "t_payments",
    )
    segments = f"""
        SELECT CASE WHEN bad_review_pct < {platform} THEN '1. Below Platform Average'
                    WHEN bad_review_pct <= {high}
                        THEN '2. Moderate Risk (' || CAST(CAST({platform} AS DECIMAL(9,1)) AS VARCHAR) || '% - {high}%)'
                    ELSE '3. High Risk ({high}%+)' END AS seller_segment,
            count(*) AS seller_count, {_count('order_count')} AS total_orders,
            {_count('bad_reviews')} AS total_bad_reviews,
            {_r('100.0 * sum(bad_reviews) / (SELECT sum(bad_reviews) FROM seller_rates)', 1)}
                AS pct_of_all_bad_reviews
        FROM seller_rates GROUP BY 1 ORDER BY 1"""
    queries = {
        "load_reviews_csv": reviews_csv,
        "load_reviews_csv_by_lines": reviews_csv,
        "table_row_counts": _with(
            "\nUNION ALL ".join(
                f"SELECT '{name}' AS table_name, count(*) AS row_count FROM {source}"
                for name, source in row_counts.items()
            ),
            "t_translation",
        ),
        "register_tables": _with(
            """SELECT order_status, count(*) AS item_count, count(DISTINCT seller_id) AS seller_count
            FROM t_orders JOIN t_items USING (order_id) GROUP BY order_status""",
            "t_orders",
            "t_items",
        ),
        "register_all_views": _with(
            """SELECT 'customers' AS view_name, count(*) AS row_count, count(customer_id) AS key_count FROM t_customers
               UNION ALL SELECT 'geolocation', count(*), count(c_nationkey) FROM customer
               UNION ALL SELECT 'order_items', count(*), count(order_item_id) FROM t_items
               UNION ALL SELECT 'payments', count(*), count(order_id) FROM t_payments
               UNION ALL SELECT 'reviews', count(*), count(order_id) FROM t_reviews
               UNION ALL SELECT 'orders', count(*), count(order_id) FROM t_orders
               UNION ALL SELECT 'products', count(*), count(product_category_name) FROM products_fixed
               UNION ALL SELECT 'sellers', count(*), count(seller_id) FROM t_sellers
               UNION ALL SELECT 'category_translation', count(*), count(product_category_name_english)
                   FROM translation_fixed
               UNION ALL SELECT 'orders_clean', count(*), count(order_id) FROM clean
               UNION ALL SELECT 'reviews_deduped', count(*), count(order_id) FROM deduped""",
            "t_customers",
            "t_items",
            "t_payments",
            "t_sellers",
            "products_fixed",
            "translation_fixed",
            "clean",
            "deduped",
        ),
        "register_views": _with(
            """SELECT review_score, count(*) AS order_count, count(DISTINCT seller_id) AS seller_count
               FROM reviewed JOIN t_items USING (order_id) GROUP BY review_score""",
            "reviewed",
            "t_items",
        ),
        "export_report_csv": bucket_report,
        "join_key_match": _with(
            """SELECT (SELECT count(*) FROM t_orders JOIN t_customers USING (customer_id)) AS customer_id_match,
                   (SELECT count(*) FROM t_orders JOIN t_customers USING (customer_id)
                    WHERE customer_unique_id = customer_id) AS customer_unique_id_match""",
            "t_orders",
            "t_customers",
        ),
        "blank_category_profile": _with(
            """SELECT product_category_name, count(*) AS product_count FROM t_products
               WHERE coalesce(product_category_name, '') = '' GROUP BY product_category_name""",
            "t_products",
        ),
        "unmatched_categories": _with(
            """SELECT product_category_name, count(*) AS product_count FROM products_fixed
               WHERE product_category_name IS NOT NULL
                 AND product_category_name NOT IN (SELECT product_category_name FROM t_translation)
               GROUP BY product_category_name""",
            "products_fixed",
            "t_translation",
        ),
        "category_labels_sorted": _with("SELECT * FROM t_translation ORDER BY 2, 1", "t_translation"),
        "category_dimensions_telephony": _with(
            _dimensions("t_translation", "t_products", ("telephony", "fixed_telephony", "electronics")), "t_translation", "t_products"
        ),
        "category_dimensions_kitchen": _with(
            _dimensions("translation_fixed", "products_fixed", _KITCHEN) + " ORDER BY avg_weight_g, category",
            "translation_fixed",
            "products_fixed",
        ),
        "duplicate_labels": _with(
            """SELECT product_category_name_english, count(*) AS label_count FROM translation_fixed
               GROUP BY product_category_name_english HAVING label_count > 1""",
            "translation_fixed",
        ),
        "review_id_uniqueness": _with(
            _uniqueness("t_reviews", "review_id", "total_rows", "unique_review_ids"),
            "t_reviews",
        ),
        "review_order_id_uniqueness": _with(
            _uniqueness("t_reviews", "order_id", "total_rows", "unique_order_ids"),
            "t_reviews",
        ),
        "deduped_order_uniqueness": _with(
            _uniqueness("deduped", "order_id", "total", "unique_orders"), "deduped"
        ),
        "duplicate_review_ids": _with(
            """SELECT *, CAST(rank() OVER (PARTITION BY review_id ORDER BY order_id) AS INTEGER) AS rnk
               FROM t_reviews
               WHERE review_comment_message IS NOT NULL
                 AND review_id IN (SELECT review_id FROM t_reviews GROUP BY review_id HAVING count(*) > 1)
               ORDER BY review_id, order_id, review_creation_date LIMIT 300""",
            "t_reviews",
        ),
        "duplicate_order_ids": _with(
            """SELECT *, CAST(rank() OVER (PARTITION BY order_id ORDER BY review_id) AS INTEGER) AS rnk
               FROM t_reviews
               WHERE order_id IN (SELECT order_id FROM t_reviews GROUP BY order_id HAVING count(*) > 1)
               ORDER BY order_id, review_id, review_creation_date LIMIT 300""",
            "t_reviews",
        ),
        "multi_review_vs_products": _with(
            """SELECT * FROM (
                   SELECT o.order_id,
                       (SELECT count(DISTINCT r.review_id) FROM t_reviews r WHERE r.order_id = o.order_id)
                           AS review_count,
                       (SELECT count(DISTINCT i.product_id) FROM t_items i WHERE i.order_id = o.order_id)
                           AS product_count
                   FROM t_orders o)
               WHERE review_count > 1 AND product_count > 0
               ORDER BY review_count DESC, order_id LIMIT 300""",
            "t_orders",
            "t_reviews",
            "t_items",
        ),
        "shared_review_gap": _with(
            """SELECT review_id, order_id, order_purchase_timestamp,
                   CAST(row_number() OVER in_review AS INTEGER) AS row_number,
                   date_sub('second', order_purchase_timestamp, lead(order_purchase_timestamp) OVER in_review)
                       AS seconds_to_next_order,
                   review_comment_message, order_delivered_customer_date
               FROM t_reviews JOIN t_orders USING (order_id)
               WHERE review_id IN (SELECT review_id FROM t_reviews GROUP BY review_id HAVING count(*) > 1)
               WINDOW in_review AS (PARTITION BY review_id
                   ORDER BY order_purchase_timestamp, order_id, review_comment_message)
               ORDER BY review_id, order_purchase_timestamp, order_id, review_comment_message, row_number LIMIT 2000""",
            "t_reviews",
            "t_orders",
        ),
        "null_counts_reviews": _with(
            _null_counts("deduped", "reviews_deduped", {"review_score": "null_review_score"}), "deduped"
        ),
        "null_counts_orders": _with(
            _null_counts(
                "t_orders",
                "orders",
                {
                    "order_status": "null_status",
                    "order_purchase_timestamp": "null_purchase_date",
                    "order_delivered_customer_date": "null_delivery_date",
                    "order_estimated_delivery_date": "null_estimated_date",
                },
            ),
            "t_orders",
        ),
        "null_counts_order_items": _with(
            _null_counts("t_items", "order_items", {"price": "null_price", "freight_value": "null_freight"}),
            "t_items",
        ),
        "order_status_distribution": _with(
            _share("t_orders", "order_status", "order_count") + " ORDER BY order_count DESC, order_status",
            "t_orders",
        ),
        "delivered_without_date": _with(
            "SELECT * FROM t_orders WHERE order_status = 'F' AND order_delivered_customer_date IS NULL", "t_orders"
        ),
        "zero_day_deliveries": _with(
            "SELECT count(*) AS zero_day_deliveries FROM all_delivered WHERE delivery_days = 0", "all_delivered"
        ),
        "very_long_deliveries": _with(
            f"SELECT count(*) AS very_long_deliveries FROM all_delivered WHERE delivery_days > {t.long_delivery_days}",
            "all_delivered",
        ),
        "reconcile_row_count": _with(
            "SELECT (SELECT count(*) FROM all_delivered) - (SELECT count(*) FROM clean) AS difference", "clean"
        ),
        "primary_key_check": _with(
            "\nUNION ALL ".join(_primary_key(name, sources[name], keys) for name, keys in primary_keys.items()),
            *key_tables,
        ),
        "primary_key_violations": _with(
            """SELECT order_id, order_item_id, count(*) AS row_count FROM t_items
               GROUP BY order_id, order_item_id
               HAVING row_count > 1 OR order_id IS NULL OR order_item_id IS NULL""",
            "t_items",
        ),
        "foreign_key_check": _with(
            "\nUNION ALL ".join(_foreign_key(c, p, k, sources[c], sources[p]) for c, p, k in foreign_keys),
            *key_tables,
        ),
        "foreign_key_check_before_fixes": _with(
            _foreign_key(
                "products", "category_translation", "product_category_name", "t_products", "t_translation"
            ),
            "t_products",
            "t_translation",
        ),
        "blank_to_null": _with("SELECT product_id, product_category_name FROM products_fixed", "products_fixed"),
        "append_missing_translations": _with("SELECT * FROM translation_added", "translation_added"),
        "correct_labels": _with(
            f"""SELECT product_category_name,
                   CASE product_category_name_english {_CORRECTION} ELSE product_category_name_english END
                       AS product_category_name_english
               FROM t_translation""",
            "t_translation",
        ),
        "reviews_deduped": _with("SELECT * FROM deduped", "deduped"),
        "order_scores": _with("SELECT order_id, review_score FROM deduped", "deduped"),
        "orders_clean_all_days": _with("SELECT * FROM all_delivered", "all_delivered"),
        "orders_clean": _with("SELECT * FROM clean", "clean"),
        "order_freight": _with("SELECT * FROM freight", "freight"),
        "order_seller_groups": _with("SELECT * FROM seller_groups", "seller_groups"),
        "seller_orders": _with(
            "SELECT DISTINCT seller_id, order_id FROM t_items JOIN clean USING (order_id)", "t_items", "clean"
        ),
        "category_orders": _with(
            "SELECT DISTINCT order_id, category_english FROM item_labels JOIN clean USING (order_id)",
            "item_labels",
            "clean",
        ),
        "review_score_distribution": _with(
            _share("deduped", "review_score", "review_count") + " ORDER BY review_score", "deduped"
        ),
        "delivery_days_distribution": _with(
            f"SELECT {_distribution('delivery_days', 'days')} FROM all_delivered", "all_delivered"
        ),
        "delivery_delay_distribution": _with(
            f"""SELECT {_distribution('delivery_delay_days', 'delay')},
                    count(*) FILTER (WHERE delivery_delay_days > 0) AS late_orders,
                    count(*) FILTER (WHERE delivery_delay_days <= 0) AS on_time_or_early_orders
                FROM clean""",
            "clean",
        ),
        "late_vs_on_time": _with(
            f"""SELECT CASE WHEN delivery_delay_days > 0 THEN 'Late' ELSE 'On Time or Early' END AS delivery_status,
                    count(*) AS order_count, {_r('avg(review_score)', 2)} AS avg_review_score
                FROM reviewed GROUP BY 1 ORDER BY 1""",
            "reviewed",
        ),
        "score_vs_delivery_days": _with(_by_score("delivery_days", "delivery_days"), "reviewed"),
        "delivery_bucket_bad_reviews": bucket_report,
        "score_vs_delay": _with(_by_score("delivery_delay_days", "delay_days"), "reviewed"),
        "headline_kpis": _with(
            f"""SELECT (SELECT count(*) FROM clean) AS orders_analyzed, count(*) AS reviewed_orders,
                    {_quantile('delivery_days', 0.5)} AS median_delivery_days, {_BAD_PCT} AS bad_review_pct
                FROM reviewed""",
            "clean",
            "reviewed",
        ),
        "score_vs_freight": _with(
            _by_score("total_freight", "freight", "JOIN freight USING (order_id)", 2), "reviewed", "freight"
        ),
        "freight_by_delivery_bucket": _with(
            f"""SELECT {bucket} AS delivery_bucket, {_half('low', f'total_freight <= {median}')},
                    {_half('high', f'total_freight > {median}')}
                FROM reviewed JOIN freight USING (order_id) GROUP BY 1 ORDER BY 1""",
            "reviewed",
            "freight",
        ),
        "freight_percentiles_by_score": _with(
            f"""SELECT review_score, count(*) AS order_count,
                    {_quantile('total_freight', 0.25, 2)} AS p25_freight,
                    {_quantile('total_freight', 0.50, 2)} AS median_freight,
                    {_quantile('total_freight', 0.75, 2)} AS p75_freight,
                    {_quantile('total_freight', 0.99, 2)} AS p99_freight
                FROM reviewed JOIN freight USING (order_id) GROUP BY review_score ORDER BY review_score""",
            "reviewed",
            "freight",
        ),
        "seller_volume_percentiles": _with(
            f"""SELECT {_quantile('order_count', 0.01)} AS p1, {_quantile('order_count', 0.05)} AS p5,
                    {_quantile('order_count', 0.10)} AS p10, {_quantile('order_count', 0.25)} AS p25,
                    {_quantile('order_count', 0.50)} AS p50,
                    min(order_count) AS min_orders, max(order_count) AS max_orders
                FROM seller_volumes""",
            "seller_volumes",
        ),
        "seller_volume_thresholds": _with(
            f"""SELECT {', '.join(f'count(*) FILTER (WHERE order_count >= {c}) AS sellers_{c}_plus' for c in t.seller_volume_cuts)},
                    count(*) AS total_sellers
                FROM seller_volumes""",
            "seller_volumes",
        ),
        "worst_sellers": _with(
            f"""SELECT * FROM seller_rates WHERE order_count >= {t.min_seller_orders}
                ORDER BY bad_review_pct DESC, seller_id LIMIT {t.top_sellers}""",
            "seller_rates",
        ),
        "seller_risk_all": _with(
            f"""SELECT * FROM seller_rates WHERE order_count >= {t.min_seller_orders}
                ORDER BY bad_review_pct DESC, seller_id""",
            "seller_rates",
        ),
        "multi_seller_by_bucket": _with(
            f"""SELECT {bucket} AS delivery_bucket, seller_group, {bucket_rates}
                FROM reviewed JOIN seller_groups USING (order_id) GROUP BY 1, 2 ORDER BY 1, 2""",
            "reviewed",
            "seller_groups",
        ),
        "seller_risk_segments": _with(segments, "seller_rates"),
        "category_volume_distribution": _with(
            f"""SELECT {_quantile('n', 0.10)} AS p10, {_quantile('n', 0.25)} AS p25, {_quantile('n', 0.50)} AS p50,
                    min(n) AS min_orders, max(n) AS max_orders, count(*) AS total_categories
                FROM (SELECT category_english, count(DISTINCT order_id) AS n
                      FROM item_labels JOIN clean USING (order_id) GROUP BY category_english)""",
            "item_labels",
            "clean",
        ),
        "category_risk": _with(
            f"""SELECT * FROM category_rates WHERE order_count >= {t.min_category_orders}
                ORDER BY bad_review_pct DESC, category_english""",
            "category_rates",
        ),
        "dedup_policy_sensitivity": _with(
            "\nUNION ALL ".join(
                _policy(name, score)
                for name, score in {
                    "lowest": "min(review_score)",
                    "highest": "max(review_score)",
                    "average": "avg(review_score)",
                }.items()
            ),
            "clean",
            "t_reviews",
        ),
        "tied_lowest_reviews": _with(
            """SELECT count(*) AS tied_orders
               FROM (SELECT order_id
                     FROM (SELECT order_id, rank() OVER (PARTITION BY order_id ORDER BY review_score) AS place
                           FROM t_reviews)
                     WHERE place = 1 GROUP BY order_id HAVING count(*) > 1)""",
            "t_reviews",
        ),
        "shared_review_gap_within": _with(
            f"""SELECT count(gap) AS consecutive_pairs, count(*) FILTER (WHERE gap <= {t.near_seconds}) AS pairs_within
                FROM (SELECT date_sub('second', order_purchase_timestamp,
                          lead(order_purchase_timestamp) OVER (PARTITION BY review_id ORDER BY order_purchase_timestamp))
                          AS gap
                      FROM t_reviews JOIN t_orders USING (order_id)
                      WHERE review_id IN (SELECT review_id FROM t_reviews GROUP BY review_id HAVING count(*) > 1))""",
            "t_reviews",
            "t_orders",
        ),
        "seller_group_median_days": _with(
            f"""SELECT seller_group, count(*) AS order_count, {_quantile('delivery_days', 0.5)} AS median_delivery_days
                FROM reviewed JOIN seller_groups USING (order_id) GROUP BY seller_group ORDER BY seller_group""",
            "reviewed",
            "seller_groups",
        ),
        "split_order_share": _with(
            f"""SELECT count(*) FILTER (WHERE seller_group = '2+ sellers') AS split_orders, count(*) AS order_count,
                    {_r("100.0 * count(*) FILTER (WHERE seller_group = '2+ sellers') / count(*)", 1)}
                        AS split_order_pct
                FROM reviewed JOIN seller_groups USING (order_id)""",
            "reviewed",
            "seller_groups",
        ),
    }
    queries |= _quarantine(primary_keys, foreign_keys, sources, key_tables)
    queries |= {
        "published_translation": _with(
            """SELECT product_category_name, product_category_name_english, count(p.product_category_name) AS product_count
               FROM translation_fixed t LEFT JOIN products_fixed p USING (product_category_name) GROUP BY ALL""",
            "translation_fixed",
            "products_fixed",
        ),
        "published_profile": _with(
            "\nUNION ALL ".join(
                f"""SELECT '{table}' AS table_name, '{column}' AS column_name, count(*) AS total_rows,
                    count(*) - count({column}) AS null_rows FROM {source}"""
                for table, (source, columns) in _PROFILED.items()
                for column in columns.split()
            ),
            *[source for source, _ in _PROFILED.values()],
        ),
        "orders_clean_versions": _with(
            """SELECT 1 AS version, count(*) AS order_count, min(delivery_days) AS min_days, max(delivery_days) AS max_days
               FROM all_delivered
               UNION ALL SELECT 2, count(*), min(delivery_days), max(delivery_days) FROM clean""",
            "clean",
        ),
        "shared_review_gap_interval": "WITH gaps AS ("
        + queries["shared_review_gap"]
        + """)
            SELECT review_id, order_id, row_number, seconds_to_next_order // 86400 AS gap_days,
                seconds_to_next_order % 86400 // 3600 AS gap_hours, seconds_to_next_order % 3600 // 60 AS gap_minutes,
                seconds_to_next_order > 30 * 86400 AS over_30_days
            FROM gaps""",
    }
    counted = {f"counted_{name}": queries[name] for name in REPORTS}
    return {**queries, **counted, **{f"exported_{name}": queries[name] for name in EXPORTED}}


# Columns of the tables that are profiled while they are published.
_PROFILED = {
    "orders": (
        "t_orders",
        """order_id customer_id order_status order_purchase_timestamp order_delivered_customer_date
           order_estimated_delivery_date""",
    ),
    "order_items": ("t_items", "order_id order_item_id product_id seller_id price freight_value"),
    "reviews": (
        "t_reviews",
        """review_id order_id review_score review_comment_title review_comment_message review_creation_date
           review_answer_timestamp""",
    ),
    "products": (
        "t_products",
        "product_id product_category_name product_weight_g product_length_cm product_height_cm",
    ),
}


def _quarantine(
    primary_keys: dict[str, tuple[str, ...]],
    foreign_keys: list[tuple[str, str, str]],
    sources: dict[str, str],
    key_tables: tuple[str, ...],
) -> dict[str, str]:
    """Rows of each table with the first reason to reject them."""

    def reasons(name: str) -> str:
        keys = primary_keys.get(name, ())
        whens = []
        if keys:
            whens.append(f"WHEN {' OR '.join(f'{k} IS NULL' for k in keys)} THEN 'null key'")
            whens.append(f"WHEN count(*) OVER (PARTITION BY {', '.join(keys)}) > 1 THEN 'repeated key'")
        for child, parent, key in foreign_keys:
            if child == name:
                known = f"SELECT {key} FROM {sources[parent]} WHERE {key} IS NOT NULL"
                whens.append(f"WHEN {key} NOT IN ({known}) THEN 'orphan {key}'")
        return f"SELECT *, CASE {' '.join(whens)} END AS reject_reason FROM {sources[name]}"

    names = list(dict.fromkeys([*primary_keys, *[child for child, _, _ in foreign_keys]]))
    summary = "\nUNION ALL ".join(
        f"""SELECT '{name}' AS table_name, coalesce(reject_reason, 'accepted') AS reject_reason, count(*) AS row_count
            FROM ({reasons(name)}) GROUP BY ALL"""
        for name in names
    )
    csv = """WITH written AS (
            SELECT CASE WHEN event_id % 43 = 0 THEN NULL WHEN event_id % 47 = 0 THEN event_id - 1 ELSE event_id END AS review_id,
                event_id // 2 AS order_id, event_id % 41 = 0 AS broken FROM events
        ),
        repeated AS (
            SELECT review_id FROM written WHERE NOT broken AND review_id IS NOT NULL GROUP BY review_id HAVING count(*) > 1
        )
        SELECT 'reviews' AS table_name,
            CASE WHEN broken THEN 'unreadable' WHEN review_id IS NULL THEN 'null key'
                WHEN review_id IN (FROM repeated) THEN 'repeated key'
                WHEN order_id NOT IN (SELECT o_orderkey FROM orders) THEN 'orphan order_id'
                ELSE 'accepted' END AS reject_reason,
            count(*) AS row_count
        FROM written GROUP BY ALL"""
    return {
        "quarantine_summary": _with(summary, *key_tables),
        "quarantined_order_items": _with(
            f"""SELECT * REPLACE (CAST(price AS DOUBLE) AS price, CAST(freight_value AS DOUBLE) AS freight_value)
                FROM ({reasons('order_items')}) WHERE reject_reason IS NOT NULL""",
            *key_tables,
        ),
        "quarantined_csv": csv,
    }
