"""DuckDB SQL for every analysis, used as an independent correctness oracle.

The SQL reads the raw test tables (views ``orders``, ``lineitem``, ...),
re-derives the logical tables with the same binding rules as
:mod:`churnlens.sources.testdata` in a shared ``WITH`` prefix, and then
computes each analysis the plain-SQL way (global NTILE, ``quantile_cont``,
self-joins), so it shares no code path with the Spark operators.
``ORACLE_SQL`` uses the registered thresholds; :func:`build` gives the SQL
for others.
"""

from __future__ import annotations

from churnlens.plans.params import REGISTERED

PERSON = "customer_unique_id"
TS = "order_purchase_timestamp"


# -- exact rounding, mirrored from churnlens.functions.rounding ---------------
def ratio(num: str, den: str, scale: int = 1, digits: int = 2, mode: str = "half_even") -> str:
    factor = scale * 10 ** digits
    n = f"(CAST({num} AS HUGEINT) * {factor})"
    d = f"NULLIF(CAST({den} AS HUGEINT), 0)"
    if mode == "half_up":
        q = f"(({n} * 2 + {d}) // ({d} * 2))"
    else:
        q = (f"(CASE WHEN ({n} % {d}) * 2 > {d} OR (({n} % {d}) * 2 = {d} AND ({n} // {d}) % 2 = 1)"
             f" THEN {n} // {d} + 1 ELSE {n} // {d} END)")
    return f"(CAST({q} AS DOUBLE) / CAST({10 ** digits} AS DOUBLE))"


def cents(x: str) -> str:
    return f"CAST(({x}) * 100 AS HUGEINT)"


def money_avg(total: str, count: str, mode: str = "half_even") -> str:
    return f"({ratio(cents(total), count, 1, 0, mode)} / CAST(100 AS DOUBLE))"


def money_share(part: str, whole: str) -> str:
    return ratio(cents(part), cents(whole), 100, 2)


def pct(num: str, den: str, mode: str = "half_even") -> str:
    return ratio(num, den, 100, 2, mode)


# -- the binding ----------------------------------------------------------------
TABLE_COLUMNS = {
    "customers": ["customer_id", PERSON, "customer_zip_code_prefix", "customer_city",
                  "customer_state"],
    "geolocation": ["geolocation_zip_code_prefix", "geolocation_lat", "geolocation_lng",
                    "geolocation_city", "geolocation_state"],
    "order_items": ["order_id", "order_item_id", "product_id", "seller_id",
                    "shipping_limit_date", "price", "freight_value"],
    "order_payments": ["order_id", "payment_sequential", "payment_type",
                       "payment_installments", "payment_value"],
    "order_reviews": ["review_id", "order_id", "review_score", "review_comment_title",
                      "review_comment_message", "review_creation_date", "review_answer_timestamp"],
    "orders": ["order_id", "customer_id", "order_status", TS, "order_approved_at",
               "order_delivered_carrier_date", "order_delivered_customer_date",
               "order_estimated_delivery_date"],
    "products": ["product_id", "product_category_name", "product_name_lenght",
                 "product_description_lenght", "product_photos_qty", "product_weight_g",
                 "product_length_cm", "product_height_cm", "product_width_cm"],
    "sellers": ["seller_id", "seller_zip_code_prefix", "seller_city", "seller_state"],
    "category_translation": ["product_category_name", "product_category_name_english"],
}
MASTER_COLS = (TABLE_COLUMNS["orders"]
               + [PERSON, "customer_zip_code_prefix", "customer_city", "customer_state"]
               + ["order_item_id", "product_id", "seller_id", "shipping_limit_date", "price",
                  "freight_value", "product_category_name", "product_category_name_english",
                  "review_score", "has_review"])
FIRST_ORDER = ("order_purchase_timestamp, order_id, order_item_id, product_id, seller_id, "
               "price")


def _master_select(src: str) -> str:
    cols = ", ".join("CAST(price AS DOUBLE) AS price" if c == "price" else
                     "CAST(freight_value AS DOUBLE) AS freight_value" if c == "freight_value"
                     else c for c in MASTER_COLS)
    return f"SELECT {cols} FROM {src}"


def _person_months(src: str, person: str, ts: str, order: str) -> str:
    return f"""(SELECT {person}, order_month, n_orders, cohort_month,
        CAST((year(order_month) - year(cohort_month)) * 12
             + month(order_month) - month(cohort_month) AS INTEGER) AS month_index
      FROM (SELECT *, min(order_month) OVER (PARTITION BY {person}) AS cohort_month
            FROM (SELECT {person}, CAST(date_trunc('month', {ts}) AS DATE) AS order_month,
                         count(DISTINCT {order}) AS n_orders
                  FROM {src} WHERE {person} IS NOT NULL AND {ts} IS NOT NULL
                  GROUP BY 1, 2)))"""


def _qbin(x: str, edges: str, k: int = 4) -> str:
    return "(1 + " + " + ".join(f"CAST({x} > {edges}[{i}] AS INTEGER)"
                               for i in range(1, k + 1)) + ")"


# Frequency score limits and segment rules (texts, limits and
# order as in churnlens.functions.rules).
def _f_score(f: str) -> str:
    return (f"CAST(CASE WHEN {f} = 1 THEN 1 WHEN {f} = 2 THEN 3 "
            f"WHEN {f} BETWEEN 3 AND 4 THEN 4 ELSE 5 END AS INTEGER)")


def _segment(r: str, f: str, m: str) -> str:
    return f"""CASE
        WHEN {r} >= 4 AND {f} >= 4 THEN 'Champions'
        WHEN {f} >= 3 AND {r} >= 3 THEN 'Loyal Customers'
        WHEN {r} >= 4 AND {f} = 3 THEN 'Potential Loyalists'
        WHEN {f} >= 3 AND {r} <= 2 THEN 'At Risk'
        WHEN {r} = 5 AND {f} = 1 AND {m} >= 4 THEN 'New High-Value'
        WHEN {r} >= 4 AND {f} = 1 THEN 'Recent One-Timers'
        WHEN {r} <= 2 AND {f} = 1 AND {m} >= 4 THEN 'Lost High-Value'
        WHEN {r} <= 2 AND {f} = 1 THEN 'Lost / Hibernating'
        ELSE 'Middle One-Timers' END"""


PREFIX = f"""WITH
b_ship AS (SELECT l_orderkey, min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship
           FROM lineitem GROUP BY l_orderkey),
b_orders AS (
  SELECT o.o_orderkey AS order_id, CAST(o.o_orderkey AS VARCHAR) AS customer_id,
         CASE WHEN o.o_orderstatus = 'F' THEN 'delivered' WHEN o.o_orderstatus = 'O' THEN 'shipped'
              ELSE 'processing' END AS order_status,
         o.o_orderdate AS order_purchase_timestamp, o.o_orderdate AS order_approved_at,
         CASE WHEN s.first_ship >= o.o_orderdate THEN s.first_ship END AS order_delivered_carrier_date,
         CASE WHEN s.last_ship >= o.o_orderdate THEN s.last_ship END AS order_delivered_customer_date,
         o.o_orderdate + to_days(5 * CAST(substr(o.o_orderpriority, 1, 1) AS INTEGER))
           AS order_estimated_delivery_date
  FROM orders o LEFT JOIN b_ship s ON s.l_orderkey = o.o_orderkey),
b_customers AS (
  SELECT CAST(o.o_orderkey AS VARCHAR) AS customer_id, o.o_custkey AS customer_unique_id,
         c.c_nationkey AS customer_zip_code_prefix, n.n_name AS customer_city,
         r.r_name AS customer_state
  FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey
  LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
  LEFT JOIN region r ON n.n_regionkey = r.r_regionkey),
b_items AS (
  SELECT l_orderkey AS order_id, l_linenumber AS order_item_id, l_partkey AS product_id,
         l_suppkey AS seller_id, l_shipdate AS shipping_limit_date,
         CAST(l_extendedprice AS DECIMAL(12,2)) AS price,
         CAST(ROUND(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_tax AS DECIMAL(4,2)), 2)
              AS DECIMAL(12,2)) AS freight_value
  FROM lineitem),
b_reviews AS (
  SELECT CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS review_id,
         l_orderkey AS order_id, CAST(floor((l_quantity - 1) / 10) + 1 AS INTEGER) AS review_score,
         CASE WHEN l_returnflag = 'R' THEN l_linestatus END AS review_comment_title,
         CASE WHEN l_linestatus = 'F' THEN l_returnflag || '-' || l_linestatus END AS review_comment_message,
         l_shipdate AS review_creation_date, l_shipdate + to_days(1) AS review_answer_timestamp
  FROM lineitem),
b_products AS (
  SELECT p_partkey AS product_id, CASE WHEN p_size <> 1 THEN p_type END AS product_category_name,
         CAST(length(p_name) AS DOUBLE) AS product_name_lenght,
         CAST(length(p_type) AS DOUBLE) AS product_description_lenght,
         CAST(p_size % 6 AS DOUBLE) AS product_photos_qty, p_retailprice AS product_weight_g,
         CAST(p_size AS DOUBLE) AS product_length_cm, p_size / 2 AS product_height_cm,
         CASE WHEN p_size % 7 <> 0 THEN CAST(p_size AS DOUBLE) END AS product_width_cm
  FROM part),
b_translation AS (
  SELECT * FROM (VALUES ('ECONOMY', 'economy'), ('LARGE', 'large'), ('MEDIUM', 'medium'),
                        ('SMALL', 'small'), ('STANDARD', 'standard'))
           AS t(product_category_name, product_category_name_english)),
b_sellers AS (
  SELECT s.s_suppkey AS seller_id, s.s_nationkey AS seller_zip_code_prefix,
         n.n_name AS seller_city, r.r_name AS seller_state
  FROM supplier s LEFT JOIN nation n ON s.s_nationkey = n.n_nationkey
  LEFT JOIN region r ON n.n_regionkey = r.r_regionkey),
b_payments AS (
  SELECT o_orderkey AS order_id, 1 AS payment_sequential,
         CASE WHEN CAST(substr(o_orderpriority, 1, 1) AS INTEGER) <= 2 THEN 'credit_card'
              ELSE 'boleto' END AS payment_type,
         CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS payment_installments,
         CAST(o_totalprice AS DECIMAL(12,2)) AS payment_value
  FROM orders),
b_geolocation AS (
  SELECT c.c_nationkey AS geolocation_zip_code_prefix,
         CAST(n.n_nationkey AS DOUBLE) AS geolocation_lat,
         CAST(n.n_regionkey AS DOUBLE) AS geolocation_lng,
         n.n_name AS geolocation_city, r.r_name AS geolocation_state
  FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
  LEFT JOIN region r ON n.n_regionkey = r.r_regionkey),
b_review_summary AS (
  SELECT order_id, avg(review_score) AS review_score, count(review_id) AS has_review
  FROM b_reviews WHERE order_id IS NOT NULL GROUP BY order_id),
b_master AS (
  SELECT o.order_id, o.customer_id, o.order_status, o.order_purchase_timestamp,
         o.order_approved_at, o.order_delivered_carrier_date, o.order_delivered_customer_date,
         o.order_estimated_delivery_date, c.customer_unique_id, c.customer_zip_code_prefix,
         c.customer_city, c.customer_state, i.order_item_id, i.product_id, i.seller_id,
         i.shipping_limit_date, i.price, i.freight_value, p.product_category_name,
         t.product_category_name_english, rv.review_score, rv.has_review
  FROM b_orders o
  LEFT JOIN b_customers c ON o.customer_id = c.customer_id
  LEFT JOIN b_review_summary rv ON rv.order_id = o.order_id
  LEFT JOIN b_items i ON i.order_id = o.order_id
  LEFT JOIN b_products p ON p.product_id = i.product_id
  LEFT JOIN b_translation t ON t.product_category_name = p.product_category_name),
b_delivered AS (SELECT * FROM b_master WHERE order_status = 'delivered' AND price IS NOT NULL),
b_opc AS (
  SELECT order_id, customer_unique_id, order_purchase_timestamp, sum(price) AS order_value
  FROM b_delivered
  WHERE order_id IS NOT NULL AND customer_unique_id IS NOT NULL
    AND order_purchase_timestamp IS NOT NULL
  GROUP BY 1, 2, 3),
b_pm AS {_person_months("b_opc", PERSON, TS, "order_id")},
b_activity AS (SELECT cohort_month, month_index, count(*) AS active_customers
               FROM b_pm GROUP BY 1, 2),
b_retention AS (
  SELECT *, CAST(active_customers AS DOUBLE) / cohort_size * CAST(100 AS DOUBLE) AS retention_pct
  FROM (SELECT *, max(CASE WHEN month_index = 0 THEN active_customers END)
                    OVER (PARTITION BY cohort_month) AS cohort_size FROM b_activity)),
b_rfm AS (
  SELECT customer_unique_id,
         date_sub('day', max(order_purchase_timestamp),
                  (SELECT max(order_purchase_timestamp) + INTERVAL 1 DAY FROM b_opc)) AS recency,
         count(DISTINCT order_id) AS frequency, sum(order_value) AS monetary
  FROM b_opc GROUP BY 1),
b_rfm_edges AS (
  SELECT quantile_cont(CAST(recency AS DOUBLE), [0.2, 0.4, 0.6, 0.8]) AS re,
         quantile_cont(CAST(monetary AS DOUBLE), [0.2, 0.4, 0.6, 0.8]) AS me FROM b_rfm),
b_rfm_qcut AS (
  SELECT *, {_segment("R_score", "F_score", "M_score")} AS segment
  FROM (SELECT r.*, CAST(6 - {_qbin("CAST(r.recency AS DOUBLE)", "e.re")} AS INTEGER) AS R_score,
               {_f_score("r.frequency")} AS F_score,
               CAST({_qbin("CAST(r.monetary AS DOUBLE)", "e.me")} AS INTEGER) AS M_score
        FROM b_rfm r CROSS JOIN b_rfm_edges e)),
b_sql_universe AS (
  SELECT c.customer_unique_id, o.*
  FROM b_customers c JOIN b_orders o ON c.customer_id = o.customer_id
  WHERE o.order_status = 'delivered'),
b_rfm_sql_orders AS (
  SELECT u.customer_unique_id, u.order_id, u.order_purchase_timestamp, sum(i.price) AS order_value
  FROM b_sql_universe u JOIN b_items i ON u.order_id = i.order_id
  GROUP BY 1, 2, 3),
b_rfm_sql AS (
  SELECT customer_unique_id,
         CAST(date_diff('day', CAST(max(order_purchase_timestamp) AS DATE),
              (SELECT CAST(max(order_purchase_timestamp) AS DATE) + 1 FROM b_orders)) AS BIGINT)
           AS recency_days,
         count(DISTINCT order_id) AS frequency, sum(order_value) AS monetary
  FROM b_rfm_sql_orders GROUP BY 1),
b_rfm_ntile AS (
  SELECT *, {_segment("r_score", "f_score", "m_score")} AS segment
  FROM (SELECT customer_unique_id, recency_days, frequency, monetary,
               CAST(6 - NTILE(5) OVER (ORDER BY recency_days, customer_unique_id) AS INTEGER)
                 AS r_score,
               {_f_score("frequency")} AS f_score,
               CAST(NTILE(5) OVER (ORDER BY monetary, customer_unique_id) AS INTEGER) AS m_score
        FROM b_rfm_sql)),
b_first AS (
  SELECT * FROM (
    SELECT d.*, row_number() OVER (PARTITION BY customer_unique_id
                                   ORDER BY {FIRST_ORDER.replace(",", " NULLS LAST,")} NULLS LAST) AS rn
    FROM b_delivered d WHERE customer_unique_id IS NOT NULL) WHERE rn = 1),
b_fo AS (
  SELECT * FROM (
    SELECT f.customer_unique_id, f.order_purchase_timestamp, f.order_delivered_customer_date,
           f.order_estimated_delivery_date, f.review_score, f.price,
           f.product_category_name_english,
           CAST(date_sub('microsecond', f.order_purchase_timestamp,
                         f.order_delivered_customer_date) AS DOUBLE) / 86400000000.0 AS delivery_days,
           CAST(date_sub('microsecond', f.order_estimated_delivery_date,
                         f.order_delivered_customer_date) AS DOUBLE) / 86400000000.0
             AS days_vs_estimate,
           r.frequency >= 2 AS is_repeat, r.frequency, r.monetary
    FROM b_first f LEFT JOIN b_rfm r ON f.customer_unique_id = r.customer_unique_id)
  WHERE delivery_days IS NOT NULL),
b_spend_edges AS (SELECT quantile_cont(CAST(price AS DOUBLE), [0.2, 0.4, 0.6, 0.8]) AS e FROM b_fo),
b_spend AS (
  SELECT bucket, spend_bucket, count(customer_unique_id) AS total_customers,
         CAST(coalesce(sum(CAST(is_repeat AS INTEGER)), 0) AS BIGINT) AS repeat_customers,
         {money_avg("sum(price)", "count(price)")} AS avg_first_order_value,
         CAST(min(price) AS DOUBLE) AS min_value, CAST(max(price) AS DOUBLE) AS max_value,
         {pct("coalesce(sum(CAST(is_repeat AS INTEGER)), 0)", "count(customer_unique_id)")}
           AS repeat_rate_pct
  FROM (SELECT f.*, CAST({_qbin("CAST(f.price AS DOUBLE)", "s.e")} AS INTEGER) AS bucket,
               ['Very Low (bottom 20%)', 'Low', 'Medium', 'High', 'Very High (top 20%)']
                 [{_qbin("CAST(f.price AS DOUBLE)", "s.e")}] AS spend_bucket
        FROM b_fo f CROSS JOIN b_spend_edges s)
  GROUP BY 1, 2),
b_purchases AS (SELECT * FROM events WHERE event_type = 'purchase')
"""  # queries may continue this CTE list with ", name AS (...)"


def _rate_by(src: str, dim: str, min_n: int = 0, mode: str = "half_even",
             where: str = "") -> str:
    having = f"HAVING count(customer_unique_id) >= {min_n}" if min_n else ""
    cond = f"WHERE {dim} IS NOT NULL" + (f" AND {where}" if where else "")
    return f"""SELECT {dim}, count(customer_unique_id) AS total_customers,
         CAST(coalesce(sum(CAST(is_repeat AS INTEGER)), 0) AS BIGINT) AS repeat_customers,
         {pct("coalesce(sum(CAST(is_repeat AS INTEGER)), 0)", "count(customer_unique_id)", mode)}
           AS repeat_rate_pct
  FROM {src} {cond} GROUP BY {dim} {having}"""


def _describe(src: str, variables: dict[str, str]) -> str:
    parts = []
    for name, expr in variables.items():
        x = f"CAST({expr} AS DOUBLE)"
        parts.append(f"""SELECT '{name}' AS variable, count({x}) AS count,
           round_even(avg({x}), 2) AS mean, round_even(stddev_samp({x}), 2) AS std,
           round_even(min({x}), 2) AS min,
           round_even(quantile_cont({x}, 0.25), 2) AS p25,
           round_even(quantile_cont({x}, 0.5), 2) AS p50,
           round_even(quantile_cont({x}, 0.75), 2) AS p75,
           round_even(max({x}), 2) AS max
    FROM {src} WHERE {expr} IS NOT NULL""")
    return "\nUNION ALL\n".join(parts)


def _per_person_all() -> str:
    return "(SELECT customer_unique_id, count(*) AS order_count FROM b_customers " \
           "WHERE customer_unique_id IS NOT NULL GROUP BY 1)"


def _value_counts(src: str, col: str, where: str = "") -> str:
    cond = f"WHERE {col} IS NOT NULL" + (f" AND {where}" if where else "")
    return f"""SELECT {col}, n_rows, {pct("n_rows", "sum(n_rows) OVER ()")} AS pct
  FROM (SELECT {col}, count(*) AS n_rows FROM {src} {cond} GROUP BY 1)"""


def _logical(name: str) -> str:
    return {"customers": "b_customers", "geolocation": "b_geolocation",
            "order_items": "b_items", "order_payments": "b_payments",
            "order_reviews": "b_reviews", "orders": "b_orders", "products": "b_products",
            "sellers": "b_sellers", "category_translation": "b_translation"}[name]


def _null_profile() -> str:
    parts = []
    for t, cols in TABLE_COLUMNS.items():
        for c in cols:
            parts.append(f"SELECT '{t}' AS table_name, '{c}' AS column_name, "
                         f"CAST(count(*) - count({c}) AS BIGINT) AS n_null, "
                         f"count(*) AS n_rows FROM {_logical(t)}")
    inner = "\nUNION ALL\n".join(parts)
    missing = f"SELECT * FROM ({inner}) WHERE n_null > 0"
    key_cols = [PERSON, TS, "price", "review_score", "product_category_name_english"]
    master = "\nUNION ALL\n".join(
        f"SELECT 'master' AS table_name, '{c}' AS column_name, "
        f"CAST(count(*) - count({c}) AS BIGINT) AS n_null, count(*) AS n_rows FROM b_master"
        for c in key_cols)
    return f"""SELECT table_name, column_name, n_null, n_rows, {pct("n_null", "n_rows")} AS pct_null
  FROM ({missing} UNION ALL {master})"""


def _cohort_cells(value: str, src: str) -> str:
    return f""", cells AS (SELECT cohort_month, month_index AS i, {value} AS v FROM {src}),
      spans AS (SELECT cohort_month, CAST(max(i) + 1 AS INTEGER) AS n_months FROM cells GROUP BY 1),
      places AS (SELECT cohort_month, n_months, unnest(range(n_months)) AS i FROM spans)
    SELECT p.cohort_month, p.n_months, string_agg(coalesce(CAST(v AS VARCHAR), '-'), ',' ORDER BY p.i) AS cells
    FROM places p LEFT JOIN cells c ON c.cohort_month = p.cohort_month AND c.i = p.i GROUP BY 1, 2"""


# (table, column, referenced table, its key); no reference: a primary key
DECLARED = [
    ("customers", "customer_id", None, None), ("orders", "order_id", None, None),
    ("products", "product_id", None, None), ("sellers", "seller_id", None, None),
    ("category_translation", "product_category_name", None, None),
    ("orders", "customer_id", "customers", "customer_id"), ("order_items", "order_id", "orders", "order_id"),
    ("order_items", "product_id", "products", "product_id"), ("order_items", "seller_id", "sellers", "seller_id"),
    ("order_payments", "order_id", "orders", "order_id"), ("order_reviews", "order_id", "orders", "order_id"),
    ("products", "product_category_name", "category_translation", "product_category_name"),
]


def _key_row(table: str, key: str, parent: str | None, parent_key: str | None) -> str:
    src = _logical(table)
    orphans = (f"(SELECT count(*) FROM {src} c WHERE {key} IS NOT NULL AND NOT EXISTS "
               f"(SELECT 1 FROM {_logical(parent)} p WHERE p.{parent_key} = c.{key}))" if parent else "CAST(NULL AS BIGINT)")
    return f"""SELECT '{table}' AS table_name, '{key}' AS key_column,
           {f"'{parent}'" if parent else "CAST(NULL AS VARCHAR)"} AS refers_to, count(*) AS n_rows,
           count(*) - count({key}) AS n_null, count(DISTINCT {key}) AS n_distinct,
           (SELECT count(*) FROM (SELECT {key} FROM {src} WHERE {key} IS NOT NULL GROUP BY 1 HAVING count(*) > 1))
             AS n_duplicate_keys, {orphans} AS n_orphans FROM {src}"""


def build(P=REGISTERED) -> dict[str, str]:
    """All oracle queries for one set of thresholds."""
    Q: dict[str, str] = {}

    Q["table_profile"] = "\nUNION ALL\n".join(
        f"SELECT '{t}' AS table_name, count(*) AS n_rows, CAST({len(cols)} AS INTEGER) AS n_cols "
        f"FROM {_logical(t)}" for t, cols in TABLE_COLUMNS.items())
    Q["null_profile"] = _null_profile()
    Q["duplicate_rows"] = "\nUNION ALL\n".join(
        f"SELECT '{t}' AS table_name, count(*) AS n_rows, "
        f"CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {_logical(t)})) AS BIGINT) "
        f"AS n_duplicates FROM {_logical(t)}" for t in TABLE_COLUMNS)
    Q["key_uniqueness"] = """SELECT count(*) AS n_rows, count(DISTINCT customer_id) AS n_ids,
           count(DISTINCT customer_unique_id) AS n_persons,
           count(*) - count(DISTINCT customer_unique_id) AS rows_minus_persons FROM b_customers"""
    Q["key_report"] = "\nUNION ALL\n".join(_key_row(*k) for k in DECLARED)
    Q["second_purchase_survival"] = """, placed AS (
        SELECT customer_unique_id, order_purchase_timestamp AS ts,
               row_number() OVER (PARTITION BY customer_unique_id ORDER BY order_purchase_timestamp, order_id) AS r
        FROM b_opc),
      ends AS (SELECT max(ts) + INTERVAL 1 DAY AS snap FROM placed),
      per AS (SELECT min(ts) AS t1, max(ts) FILTER (WHERE r = 2) AS t2 FROM placed WHERE r <= 2
              GROUP BY customer_unique_id),
      days AS (SELECT CAST(floor(date_diff('microsecond', t1, coalesce(t2, snap)) / 86400000000.0) AS BIGINT) AS day,
                      count(t2) AS events, count(*) - count(t2) AS censored FROM per, ends GROUP BY 1),
      risk AS (SELECT *, CAST(sum(events + censored) OVER (ORDER BY day DESC) AS BIGINT) AS at_risk FROM days)
    SELECT day, at_risk, events, censored,
           round(product(1.0 - events / at_risk) OVER (ORDER BY day), 6) AS survival FROM risk"""
    Q["monthly_shared_customers"] = """, m AS (
        SELECT DISTINCT CAST(date_trunc('month', order_purchase_timestamp) AS DATE) AS order_month, customer_unique_id
        FROM b_orders JOIN b_customers USING (customer_id))
    SELECT a.order_month, count(*) AS persons, count(b.customer_unique_id) AS shared_with_next
    FROM m a LEFT JOIN m b ON b.customer_unique_id = a.customer_unique_id
                          AND b.order_month = CAST(a.order_month + INTERVAL 1 MONTH AS DATE) GROUP BY 1"""
    Q["estimate_rank_sum"] = """, v AS (
        SELECT days_vs_estimate AS v, is_repeat AS f,
               rank() OVER (ORDER BY days_vs_estimate) + (count(*) OVER (PARTITION BY days_vs_estimate) - 1) / 2.0 AS r
        FROM b_fo WHERE days_vs_estimate IS NOT NULL AND is_repeat IS NOT NULL),
      s AS (SELECT count(*) FILTER (WHERE f) AS a, count(*) FILTER (WHERE NOT f) AS b, sum(r) FILTER (WHERE f) AS ra,
                   count(*) FILTER (WHERE f AND v > 0) AS la, count(*) FILTER (WHERE NOT f AND v > 0) AS lb FROM v),
      t AS (SELECT sum(CAST(n AS DOUBLE) * n * n - n) AS ties FROM (SELECT count(*) AS n FROM v GROUP BY v.v))
    SELECT a AS n_repeat, b AS n_one_time, CAST(ra - a * (a + 1) / 2.0 AS DOUBLE) AS u,
           round((ra - a * (a + 1) / 2.0 - a * b / 2.0)
                 / sqrt(CAST(a AS DOUBLE) * b / 12 * (a + b + 1 - ties / (CAST(a + b AS DOUBLE) * (a + b - 1)))), 6) AS z,
           round(la * 100.0 / a, 6) AS late_repeat_pct, round(lb * 100.0 / b, 6) AS late_one_time_pct FROM s, t"""
    Q["status_breakdown"] = _value_counts("b_master", "order_status")
    Q["missing_price_status"] = _value_counts("b_master", "order_status", "price IS NULL")
    Q["purchase_distribution"] = f"""SELECT order_count, n_customers,
           {pct("n_customers", "sum(n_customers) OVER ()")} AS pct_customers
      FROM (SELECT order_count, count(*) AS n_customers FROM {_per_person_all()} GROUP BY 1)"""
    Q["repeat_rate_all"] = f"""SELECT total_customers, repeat_customers,
           {pct("repeat_customers", "total_customers")} AS repeat_rate_pct
      FROM (SELECT count(*) AS total_customers, count(*) FILTER (WHERE order_count >= 2)
                   AS repeat_customers FROM {_per_person_all()})"""
    Q["top_repeat_customers"] = f"""SELECT customer_unique_id, order_count FROM {_per_person_all()}
      ORDER BY order_count DESC, customer_unique_id ASC LIMIT {P.top_k}"""
    Q["top_customer_profile"] = f""", top1 AS (
        SELECT customer_unique_id FROM {_per_person_all()}
        ORDER BY order_count DESC, customer_unique_id LIMIT 1),
      ids AS (SELECT * FROM b_customers WHERE customer_unique_id IN (SELECT * FROM top1)),
      ords AS (SELECT * FROM b_orders WHERE customer_id IN (SELECT customer_id FROM ids)),
      its AS (SELECT * FROM b_items WHERE order_id IN (SELECT order_id FROM ords)),
      s AS (SELECT coalesce(sum(price), 0) AS p, coalesce(sum(freight_value), 0) AS f FROM its)
    SELECT (SELECT customer_unique_id FROM top1) AS customer_unique_id,
           (SELECT count(*) FROM ids) AS customer_ids,
           (SELECT count(DISTINCT (customer_city, customer_state)) FROM ids
             WHERE customer_city IS NOT NULL AND customer_state IS NOT NULL) AS locations,
           (SELECT count(*) FROM ords) AS orders_placed,
           CAST(s.p AS DOUBLE) AS product_spend, CAST(s.f AS DOUBLE) AS freight,
           CAST(s.p + s.f AS DOUBLE) AS grand_total,
           {money_avg("s.p + s.f", "(SELECT count(*) FROM ords)")} AS avg_order_value
    FROM s"""
    Q["top_customer_locations"] = f""", top1 AS (
        SELECT customer_unique_id FROM {_per_person_all()}
        ORDER BY order_count DESC, customer_unique_id LIMIT 1),
      locs AS (SELECT customer_city, customer_state, count(*) AS n_ids FROM b_customers
               WHERE customer_unique_id IN (SELECT * FROM top1)
                 AND customer_city IS NOT NULL AND customer_state IS NOT NULL
               GROUP BY 1, 2)
    SELECT customer_city, customer_state, n_ids,
           {pct("n_ids", "sum(n_ids) OVER ()")} AS pct FROM locs"""
    Q["order_date_range"] = f"""SELECT min({TS}) AS min_ts, max({TS}) AS max_ts FROM b_orders"""
    Q["avg_order_value"] = f"""SELECT CAST(p AS DOUBLE) AS total_price, CAST(f AS DOUBLE) AS total_freight,
           n_orders, {money_avg("p + f", "n_orders")} AS avg_order_value
      FROM (SELECT sum(price) AS p, sum(freight_value) AS f FROM b_items),
           (SELECT count(*) AS n_orders FROM b_orders)"""
    Q["master_table"] = _master_select("b_master")
    Q["master_delivered"] = _master_select("b_delivered")
    Q["master_drop_report"] = """SELECT count(*) AS rows_before,
           count(*) FILTER (WHERE order_status = 'delivered' AND price IS NOT NULL) AS rows_after,
           count(*) - count(*) FILTER (WHERE order_status = 'delivered' AND price IS NOT NULL)
             AS rows_dropped FROM b_master"""
    Q["master_checks"] = """SELECT count(DISTINCT order_id) AS unique_orders,
           count(DISTINCT customer_unique_id) AS unique_customers,
           count(DISTINCT product_id) AS unique_products,
           count(DISTINCT product_category_name_english) AS unique_categories,
           CAST(coalesce(sum(price), 0) AS DOUBLE) AS total_price,
           CAST(coalesce(sum(freight_value), 0) AS DOUBLE) AS total_freight,
           CAST(coalesce(sum(price), 0) + coalesce(sum(freight_value), 0) AS DOUBLE) AS grand_total
      FROM b_master"""
    Q["orders_per_customer"] = """SELECT order_id, customer_unique_id, order_purchase_timestamp,
           CAST(order_value AS DOUBLE) AS order_value FROM b_opc"""
    Q["cohort_sizes"] = """SELECT cohort_month, count(*) AS cohort_size FROM b_pm
      WHERE month_index = 0 GROUP BY 1"""
    Q["cohort_activity"] = "SELECT * FROM b_activity"
    Q["cohort_activity_sql"] = f"""SELECT cohort_month, month_index, count(*) AS active_customers
      FROM {_person_months("b_sql_universe", PERSON, TS, "order_id")} GROUP BY 1, 2"""
    Q["month_index_distribution"] = """SELECT month_index, CAST(sum(n_orders) AS BIGINT) AS n_orders
      FROM b_pm GROUP BY 1"""
    Q["cohort_matrix"] = _cohort_cells("active_customers", "b_activity")
    Q["retention_matrix"] = _cohort_cells("round_even(retention_pct, 2)", "b_retention")
    Q["retention_long"] = """SELECT cohort_month, month_index, active_customers, cohort_size,
           round_even(retention_pct, 6) AS retention_pct FROM b_retention"""
    Q["retention_heatmap_data"] = f"""SELECT strftime(cohort_month, '%Y-%m') AS cohort, month_index,
           round_even(retention_pct, 2) AS retention_pct FROM b_retention
      WHERE cohort_size >= {P.heatmap_min_cohort} AND month_index <= {P.shown_month_index}"""
    Q["retention_curve"] = f"""SELECT month_index, count(*) AS n_cohorts,
           round_even(avg(retention_pct), 2) AS avg_retention_pct FROM b_retention
      WHERE cohort_size >= {P.curve_min_cohort} AND month_index <= {P.shown_month_index}
      GROUP BY 1"""
    Q["month1_cliff"] = f"""SELECT round_even(m1, 2) AS month1_retention_pct,
           round_even(100.0 - m1, 2) AS drop_pct
      FROM (SELECT avg(retention_pct) AS m1 FROM b_retention
            WHERE cohort_size >= {P.curve_min_cohort} AND month_index = 1)"""
    Q["repeat_rate"] = f"""SELECT total_customers, repeat_customers,
           {pct("repeat_customers", "total_customers", "half_up")} AS repeat_rate_pct
      FROM (SELECT count(*) AS total_customers,
                   count(*) FILTER (WHERE order_count >= 2) AS repeat_customers
            FROM (SELECT customer_unique_id, count(DISTINCT order_id) AS order_count
                  FROM b_sql_universe GROUP BY 1))"""
    Q["rfm_base"] = """SELECT customer_unique_id, recency, frequency,
           CAST(monetary AS DOUBLE) AS monetary FROM b_rfm"""
    Q["rfm_describe"] = _describe("b_rfm", {"recency": "recency", "frequency": "frequency",
                                            "monetary": "monetary"})
    Q["rfm_scores_qcut"] = """SELECT customer_unique_id, recency, frequency,
           CAST(monetary AS DOUBLE) AS monetary, R_score, F_score, M_score,
           CAST(R_score AS VARCHAR) || CAST(F_score AS VARCHAR) || CAST(M_score AS VARCHAR)
             AS RFM_score, segment FROM b_rfm_qcut"""
    Q["rfm_score_distribution"] = "\nUNION ALL\n".join(
        f"SELECT '{s}' AS score_name, {s} AS score, count(*) AS n_customers FROM b_rfm_qcut "
        f"GROUP BY {s}" for s in ("R_score", "F_score", "M_score"))
    Q["rfm_scores_ntile"] = """SELECT customer_unique_id, recency_days, frequency,
           CAST(monetary AS DOUBLE) AS monetary, r_score, f_score, m_score FROM b_rfm_ntile"""
    Q["rfm_segments_sql"] = f"""SELECT segment, count(*) AS customer_count,
           {money_avg("sum(monetary)", "count(*)", "half_up")} AS avg_monetary,
           CAST(sum(monetary) AS DOUBLE) AS total_revenue
      FROM b_rfm_ntile GROUP BY 1 ORDER BY total_revenue DESC"""
    Q["rfm_segments_qcut"] = f"""SELECT segment, count(customer_unique_id) AS customer_count,
           {money_avg("sum(monetary)", "count(customer_unique_id)")} AS avg_monetary,
           CAST(sum(monetary) AS DOUBLE) AS total_monetary,
           {ratio("sum(frequency)", "count(customer_unique_id)")} AS avg_frequency,
           {ratio("sum(recency)", "count(customer_unique_id)")} AS avg_recency_days
      FROM b_rfm_qcut GROUP BY 1"""
    Q["segment_shares"] = f"""SELECT segment, customer_count,
           {pct("customer_count", "sum(customer_count) OVER ()")} AS pct_customers,
           CAST(m AS DOUBLE) AS total_revenue,
           {money_share("m", "sum(m) OVER ()")} AS pct_revenue
      FROM (SELECT segment, count(customer_unique_id) AS customer_count, sum(monetary) AS m
            FROM b_rfm_qcut GROUP BY 1)"""
    Q["one_time_revenue_share"] = f"""SELECT CAST(coalesce(one, 0) AS DOUBLE) AS one_time_revenue,
           CAST(total AS DOUBLE) AS total_revenue,
           {money_share("coalesce(one, 0)", "total")} AS one_time_revenue_pct
      FROM (SELECT sum(monetary) FILTER (WHERE frequency = 1) AS one, sum(monetary) AS total
            FROM b_rfm)"""
    Q["repeat_flag_summary"] = f"""SELECT total_customers, repeat_customers,
           {pct("repeat_customers", "total_customers")} AS repeat_pct,
           total_customers - repeat_customers AS one_time_customers,
           {pct("total_customers - repeat_customers", "total_customers")} AS one_time_pct
      FROM (SELECT count(*) AS total_customers,
                   count(*) FILTER (WHERE frequency >= 2) AS repeat_customers FROM b_rfm)"""
    Q["first_orders"] = """SELECT customer_unique_id, order_purchase_timestamp,
           order_delivered_customer_date, order_estimated_delivery_date, review_score,
           CAST(price AS DOUBLE) AS price, product_category_name_english, delivery_days,
           days_vs_estimate, is_repeat, frequency, CAST(monetary AS DOUBLE) AS monetary FROM b_fo"""
    Q["delivery_days_describe"] = _describe("b_fo", {"delivery_days": "delivery_days"})
    _FLAG = ("CASE WHEN is_repeat THEN 'Repeat customers' ELSE 'One-time customers' END "
             "AS customer_type")
    Q["delivery_comparison"] = f"""SELECT {_FLAG}, is_repeat,
           round_even(avg(delivery_days), 2) AS mean,
           round_even(quantile_cont(delivery_days, 0.5), 2) AS median,
           round_even(stddev_samp(delivery_days), 2) AS std, count(delivery_days) AS count
      FROM b_fo WHERE is_repeat IS NOT NULL GROUP BY is_repeat"""
    Q["delivery_median_gap"] = """SELECT round_even(o, 2) AS one_time_median,
           round_even(r, 2) AS repeat_median, round_even(o - r, 2) AS difference
      FROM (SELECT quantile_cont(delivery_days, 0.5) FILTER (WHERE NOT is_repeat) AS o,
                   quantile_cont(delivery_days, 0.5) FILTER (WHERE is_repeat) AS r FROM b_fo)"""
    Q["delivery_boxplot_data"] = f""", q AS (
        SELECT is_repeat, quantile_cont(delivery_days, 0.25) AS q1,
               quantile_cont(delivery_days, 0.5) AS median,
               quantile_cont(delivery_days, 0.75) AS q3
        FROM b_fo WHERE is_repeat IS NOT NULL GROUP BY is_repeat)
    SELECT {_FLAG.replace("is_repeat", "q.is_repeat")}, q.is_repeat, round_even(q1, 2) AS q1, round_even(median, 2) AS median,
           round_even(q3, 2) AS q3, round_even(q3 - q1, 2) AS iqr,
           round_even(min(f.delivery_days) FILTER (WHERE f.delivery_days >= q1 - 1.5 * (q3 - q1)), 2)
             AS lower_whisker,
           round_even(max(f.delivery_days) FILTER (WHERE f.delivery_days <= q3 + 1.5 * (q3 - q1)), 2)
             AS upper_whisker
      FROM q JOIN b_fo f ON f.is_repeat = q.is_repeat
      GROUP BY q.is_repeat, q1, median, q3"""
    Q["review_retention_raw"] = _rate_by("b_fo", "review_score")
    Q["review_retention"] = _rate_by(
        "(SELECT *, CAST(round_even(review_score, 0) AS INTEGER) AS review_score_int FROM b_fo "
        "WHERE review_score IS NOT NULL)", "review_score_int")
    Q["review_extremes"] = f"""SELECT one_star_pct, five_star_pct,
           round_even(five_star_pct / NULLIF(one_star_pct, 0), 2) AS five_over_one
      FROM (SELECT max(CASE WHEN review_score = 1.0 THEN repeat_rate_pct END) AS one_star_pct,
                   max(CASE WHEN review_score = 5.0 THEN repeat_rate_pct END) AS five_star_pct
            FROM ({_rate_by("b_fo", "review_score")}))"""
    _CAT = "product_category_name_english"
    Q["category_retention_nb"] = _rate_by("b_fo", _CAT, P.category_min_customers)
    Q["category_against_overall"] = f"""SELECT {_CAT}, total_customers, repeat_customers, repeat_rate_pct,
           overall_rate_pct, round_even(repeat_rate_pct - overall_rate_pct, 2) AS points_above,
           round_even(repeat_rate_pct / NULLIF(overall_rate_pct, 0), 4) AS ratio_to_overall
      FROM ({_rate_by("b_fo", _CAT, P.category_min_customers)})
      CROSS JOIN (SELECT {pct("count(*) FILTER (WHERE is_repeat)", "count(customer_unique_id)")} AS overall_rate_pct
                  FROM b_fo)"""
    Q["category_top_bottom"] = f"""SELECT {_CAT}, total_customers, repeat_customers, repeat_rate_pct,
           rank_desc, rank_desc <= 10 AS in_top, rank_desc > n - 10 AS in_bottom,
           rank_desc <= 15 AS in_chart,
           round_even(repeat_rate_pct / NULLIF(best, 0), 4) AS ratio_to_best
      FROM (SELECT *, CAST(row_number() OVER (ORDER BY repeat_rate_pct DESC, {_CAT} ASC) AS INTEGER)
                 AS rank_desc,
                   count(*) OVER () AS n, max(repeat_rate_pct) OVER () AS best
            FROM ({_rate_by("b_fo", _CAT, P.category_min_customers)}))"""
    Q["category_retention_sql"] = f""", base AS (
        SELECT u.customer_unique_id, u.order_id, u.order_purchase_timestamp, i.order_item_id,
               i.product_id, i.seller_id, i.price, t.product_category_name_english AS category
        FROM b_sql_universe u
        JOIN b_items i ON u.order_id = i.order_id
        JOIN b_products p ON i.product_id = p.product_id
        JOIN b_translation t ON p.product_category_name = t.product_category_name),
      firsts AS (
        SELECT customer_unique_id, category FROM (
          SELECT customer_unique_id, category,
                 row_number() OVER (PARTITION BY customer_unique_id
                                    ORDER BY {FIRST_ORDER.replace(",", " NULLS LAST,")} NULLS LAST) AS rn
          FROM base) WHERE rn = 1),
      counts AS (SELECT customer_unique_id, count(DISTINCT order_id) AS total_orders
                 FROM base GROUP BY 1),
      flagged AS (SELECT f.customer_unique_id, f.category, c.total_orders >= 2 AS is_repeat
                  FROM firsts f JOIN counts c ON f.customer_unique_id = c.customer_unique_id)
    SELECT category, count(customer_unique_id) AS total_customers,
           CAST(coalesce(sum(CAST(is_repeat AS INTEGER)), 0) AS BIGINT) AS repeat_customers,
           {pct("coalesce(sum(CAST(is_repeat AS INTEGER)), 0)", "count(customer_unique_id)",
                "half_up")} AS repeat_rate_pct
      FROM flagged GROUP BY category HAVING count(customer_unique_id) >= {P.category_min_customers}"""
    Q["spend_bucket_retention"] = "SELECT * FROM b_spend"
    measures = {"master_delivered": ("master_delivered", "price", "parquet csv"),
                "rfm_segmentation": ("rfm_scores_qcut", "monetary", "parquet csv"),
                "segment_summary": ("rfm_segments_qcut", "total_monetary", "csv"),
                "first_orders_analysis": ("first_orders", "price", "parquet"),
                "review_retention": ("review_retention", "total_customers", "csv"),
                "category_retention": ("category_retention_nb", "total_customers", "csv"),
                "spend_retention": ("spend_bucket_retention", "total_customers", "csv")}
    Q["published_outputs"] = "\nUNION ALL\n".join(
        f"SELECT '{name}' AS output, '{fmt}' AS format, count(*) AS n_rows, "
        f"CAST(sum(CAST({col} AS DECIMAL(18, 2))) AS DOUBLE) AS total FROM ({Q[key]})"
        for name, (key, col, formats) in measures.items() for fmt in formats.split())
    Q["csv_monthly_revenue"] = """SELECT CAST(date_trunc('month', order_purchase_timestamp) AS DATE) AS order_month,
           count(*) AS n_items, count(DISTINCT order_id) AS n_orders,
           count(DISTINCT customer_unique_id) AS n_customers,
           count(product_category_name_english) AS categorised_items,
           count(*) FILTER (WHERE has_review > 0) AS reviewed_items,
           CAST(sum(price) AS DOUBLE) AS revenue, CAST(sum(freight_value) AS DOUBLE) AS freight
      FROM b_delivered GROUP BY 1"""
    Q["spend_extremes"] = """SELECT lowest_bucket_pct, highest_bucket_pct,
           round_even(highest_bucket_pct / NULLIF(lowest_bucket_pct, 0), 2) AS high_over_low
      FROM (SELECT max(CASE WHEN bucket = 1 THEN repeat_rate_pct END) AS lowest_bucket_pct,
                   max(CASE WHEN bucket = 5 THEN repeat_rate_pct END) AS highest_bucket_pct
            FROM b_spend)"""
    Q["events_repeat_rate"] = f"""SELECT total_customers, repeat_customers,
           {pct("repeat_customers", "total_customers", "half_up")} AS repeat_rate_pct
      FROM (SELECT count(*) AS total_customers,
                   count(*) FILTER (WHERE n >= 2) AS repeat_customers
            FROM (SELECT user_id, count(DISTINCT event_id) AS n FROM b_purchases
                  WHERE user_id IS NOT NULL AND event_id IS NOT NULL GROUP BY 1))"""
    Q["events_cohort_activity"] = """SELECT cohort_week, CAST((week - cohort_week) / 7 AS INTEGER) AS week_index,
           count(*) AS active_customers
      FROM (SELECT *, min(week) OVER (PARTITION BY user_id) AS cohort_week
            FROM (SELECT DISTINCT user_id, CAST(date_trunc('week', ts) AS DATE) AS week FROM b_purchases
                  WHERE user_id IS NOT NULL AND ts IS NOT NULL))
      GROUP BY 1, 2"""
    Q["events_cohort_activity_stream"] = Q["events_cohort_activity"]


    # bodies starting with "," extend the shared CTE list before their SELECT
    return {k: PREFIX + v for k, v in Q.items()}


ORACLE_SQL: dict[str, str] = build(REGISTERED)
