"""Master table, cohorts, RFM and drivers on hand-written fixtures."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from churnlens.operators import cohort, drivers, master, rates, rfm

T = dt.datetime


@pytest.fixture(scope="module")
def tables(spark):
    orders = spark.createDataFrame([
        ("o1", "c1", "delivered", T(2017, 12, 5), T(2017, 12, 15), T(2017, 12, 20)),
        ("o2", "c2", "delivered", T(2018, 1, 10), T(2018, 1, 12), T(2018, 1, 20)),
        ("o3", "c3", "delivered", T(2018, 1, 11), None, T(2018, 1, 30)),
        ("o4", "c4", "canceled", T(2018, 2, 1), None, T(2018, 2, 9)),
        ("o5", "c5", "delivered", T(2018, 3, 1), T(2018, 3, 4), T(2018, 3, 9)),
    ], "order_id string, customer_id string, order_status string, "
       "order_purchase_timestamp timestamp_ntz, order_delivered_customer_date timestamp_ntz, "
       "order_estimated_delivery_date timestamp_ntz")
    for c in ("order_approved_at", "order_delivered_carrier_date"):
        orders = orders.withColumn(c, F.lit(None).cast("timestamp_ntz"))
    customers = spark.createDataFrame([
        ("c1", "alice", 1, "x", "SP"), ("c2", "alice", 1, "x", "SP"), ("c3", "bob", 2, "y", "RJ"),
        ("c4", "carol", 3, "z", "MG"), ("c5", "dan", 4, "w", "SP"),
    ], "customer_id string, customer_unique_id string, customer_zip_code_prefix int, "
       "customer_city string, customer_state string")
    items = spark.createDataFrame([
        ("o1", 1, "p1", "s1", Decimal("10.00"), Decimal("1.00")),
        ("o1", 2, "p2", "s1", Decimal("30.00"), Decimal("2.00")),
        ("o2", 1, "p1", "s2", Decimal("20.00"), Decimal("1.50")),
        ("o4", 1, "p3", "s2", Decimal("99.00"), Decimal("5.00")),
        ("o5", 1, "p9", "s3", Decimal("50.00"), Decimal("3.00")),
    ], "order_id string, order_item_id int, product_id string, seller_id string, "
       "price decimal(10,2), freight_value decimal(10,2)").withColumn(
        "shipping_limit_date", F.lit(None).cast("timestamp_ntz"))
    products = spark.createDataFrame([("p1", "casa"), ("p2", None), ("p3", "moveis")],
                                     "product_id string, product_category_name string")
    translation = spark.createDataFrame([("casa", "home"), ("moveis", "furniture")],
                                        "product_category_name string, "
                                        "product_category_name_english string")
    reviews = spark.createDataFrame([("r1", "o1", 4), ("r2", "o1", 5), ("r3", "o2", 3)],
                                    "review_id string, order_id string, review_score int")
    return dict(orders=orders, customers=customers, items=items, products=products,
                translation=translation, reviews=reviews)


@pytest.fixture(scope="module")
def m(tables):
    t = tables
    return master.master_table(t["orders"], t["customers"], t["items"], t["products"],
                               t["translation"], t["reviews"]).cache()


def test_master_fanout_and_left_semantics(m):
    assert m.count() == 6  # o1 has two items, o3 none (kept)
    o3 = m.filter(F.col("order_id") == "o3").first()
    assert o3.price is None and o3.review_score is None and o3.has_review is None
    o1 = m.filter(F.col("order_id") == "o1").collect()
    assert {r.review_score for r in o1} == {4.5} and {r.has_review for r in o1} == {2}
    unknown = m.filter(F.col("product_id") == "p9").first()
    assert unknown.product_category_name is None and unknown.product_category_name_english is None


def test_delivered_universe(m):
    d = master.delivered(m)
    assert sorted(r.order_id for r in d.select("order_id").collect()) == ["o1", "o1", "o2", "o5"]
    rep = master.row_drop_report(m, (F.col("order_status") == "delivered")
                                 & F.col("price").isNotNull()).first()
    assert (rep.rows_before, rep.rows_after, rep.rows_dropped) == (6, 4, 2)


def test_person_not_order_level_id(m, tables):
    d = master.delivered(m)
    per = rates.orders_per_person(d, "customer_unique_id", "order_id")
    got = {r.customer_unique_id: r.order_count for r in per.collect()}
    assert got == {"alice": 2, "dan": 1}
    wrong = rates.orders_per_person(d, "customer_id", "order_id")
    assert rates.repeat_rate(wrong).first().repeat_customers == 0  # the two-id trap
    rr = rates.repeat_rate(per).first()
    assert (rr.total_customers, rr.repeat_customers, rr.repeat_rate_pct) == (2, 1, 50.0)


def test_cohorts(m):
    opc = master.collapse_orders(master.delivered(m))
    pm = cohort.person_months(opc, "customer_unique_id", "order_purchase_timestamp", "order_id")
    act = {(r.cohort_month, r.month_index): r.active_customers
           for r in cohort.cohort_activity(pm).collect()}
    assert act == {(dt.date(2017, 12, 1), 0): 1, (dt.date(2017, 12, 1), 1): 1,
                   (dt.date(2018, 3, 1), 0): 1}
    ret = cohort.retention(cohort.cohort_activity(pm)).collect()
    assert all(r.retention_pct == 100.0 for r in ret if r.month_index == 0)
    curve = {r.month_index: r.avg_retention_pct
             for r in cohort.retention_curve(cohort.retention(cohort.cohort_activity(pm)),
                                             1).collect()}
    # month 1 is absent for the March cohort: skipped, not counted as 0
    assert curve == {0: 100.0, 1: 100.0}


def test_cohort_window_equals_self_join(spark, m):
    opc = master.collapse_orders(master.delivered(m))
    opc.createOrReplaceTempView("opc_fixture")
    sql = spark.sql("""
        WITH co AS (SELECT customer_unique_id, trunc(order_purchase_timestamp, 'MM') AS order_month
                    FROM opc_fixture),
             cc AS (SELECT customer_unique_id, min(order_month) AS cohort_month FROM co GROUP BY 1)
        SELECT cohort_month, (year(order_month) - year(cohort_month)) * 12
                 + month(order_month) - month(cohort_month) AS month_index,
               count(DISTINCT co.customer_unique_id) AS active_customers
        FROM co JOIN cc USING (customer_unique_id) GROUP BY 1, 2""")
    pm = cohort.person_months(opc, "customer_unique_id", "order_purchase_timestamp", "order_id")
    assert sorted(map(tuple, cohort.cohort_activity(pm).collect())) == \
        sorted(map(tuple, sql.collect()))


def test_rfm_modes(spark):
    opc = spark.createDataFrame([
        ("a", "o1", T(2018, 1, 1, 1, 0), Decimal("10.00")),
        ("b", "o2", T(2018, 1, 2, 0, 0), Decimal("5.00")),
    ], "customer_unique_id string, order_id string, order_purchase_timestamp timestamp_ntz, "
       "order_value decimal(12,2)")
    snap = spark.createDataFrame([(T(2018, 1, 3, 0, 0),)], "snapshot timestamp_ntz")
    el = {r.customer_unique_id: r.recency for r in
          rfm.rfm_base(opc, snapshot=snap, mode="elapsed").collect()}
    cal = {r.customer_unique_id: r.recency for r in
           rfm.rfm_base(opc, snapshot=snap, mode="calendar").collect()}
    assert el == {"a": 1, "b": 1} and cal == {"a": 2, "b": 1}
    auto = {r.customer_unique_id: r.recency for r in rfm.rfm_base(opc).collect()}
    assert auto == {"a": 1, "b": 1}  # snapshot = last purchase + 1 day


def test_segment_invariants(spark):
    import numpy as np
    rng = np.random.default_rng(2)
    n = 400
    rows = [(f"p{i}", int(rng.integers(0, 700)), int(rng.choice([1, 1, 1, 2, 3, 5])),
             Decimal(str(round(float(rng.random() * 500), 2)))) for i in range(n)]
    base = spark.createDataFrame(rows, "customer_unique_id string, recency long, "
                                       "frequency long, monetary decimal(12,2)")
    seg = rfm.with_segment(rfm.scores_qcut(base), "R_score", "F_score", "M_score")
    summ = rfm.segment_summary(seg, "customer_unique_id").collect()
    assert sum(r.customer_count for r in summ) == n
    total = sum(float(r[3]) for r in rows)
    assert abs(sum(r.total_monetary for r in summ) - total) < 1e-6
    shares = rfm.segment_shares(seg, "customer_unique_id").collect()
    assert abs(sum(r.pct_customers for r in shares) - 100) < 0.05 * len(shares)
    ntile = rfm.scores_ntile(base, "customer_unique_id")
    sizes = [r[1] for r in ntile.groupBy("m_score").count().collect()]
    assert max(sizes) - min(sizes) <= 1


def test_first_orders_picks_first_item(spark, m):
    d = master.delivered(m)
    fo = {r.customer_unique_id: r for r in drivers.first_orders(d).collect()}
    assert fo["alice"].price == Decimal("10.00")  # item 1 of the first order, not the total
    assert fo["alice"].is_repeat and not fo["dan"].is_repeat
    assert fo["alice"].delivery_days == 10.0 and fo["alice"].days_vs_estimate == -5.0


def test_skew_safe_left_join_equals_left_join(spark):
    import random
    rnd = random.Random(4)
    left = spark.createDataFrame([(i if i % 7 else None, f"l{i}") for i in range(300)],
                                 "k int, lv string")
    # key 1 holds a third of the right rows; some keys have no match
    right_rows = [(1, f"r{j}") for j in range(200)] + \
        [(rnd.randint(0, 400), f"s{j}") for j in range(400)] + [(None, "n")]
    right = spark.createDataFrame(right_rows, "k int, rv string")
    got = sorted(map(tuple, master.left_join_skew_safe(left, right, "k")
                     .select("k", "lv", "rv").collect()), key=repr)
    exp = sorted(map(tuple, left.join(right, "k", "left").select("k", "lv", "rv").collect()),
                 key=repr)
    assert got == exp


def test_first_of_total_order_with_ties_and_nulls(spark):
    from churnlens.operators.ranking import first_row_per_key
    rows = [("p", "2018-01-01 10:00:00", "o2", 1, 9.0), ("p", "2018-01-01 10:00:00", "o1", 2, 5.0),
            ("p", "2018-01-01 10:00:00", "o1", 1, 7.0), ("q", None, "o3", 1, 1.0),
            ("q", "2019-01-01 00:00:00", "o4", 1, 2.0), ("r", None, "o5", 1, 3.0)]
    df = spark.createDataFrame(rows, "k string, ts string, o string, i int, v double")
    got = {r.k: (r.o, r.i) for r in first_row_per_key(df, "k", ["ts", "o", "i"]).collect()}
    # ties on time broken by order id then item; a null time sorts last
    assert got == {"p": ("o1", 1), "q": ("o4", 1), "r": ("o5", 1)}


def test_review_score_rounding_half_even(spark):
    fo = spark.createDataFrame(
        [("a", 4.5, True), ("b", 2.5, False), ("c", 3.5, True), ("d", 4.0, False), ("e", None, True)],
        "customer_unique_id string, review_score double, is_repeat boolean")
    got = {r.review_score_int: (r.total_customers, r.repeat_customers)
           for r in drivers.review_retention(fo, "customer_unique_id", rounded=True).collect()}
    assert got == {2: (1, 0), 4: (3, 2)}  # 4.5 -> 4, 2.5 -> 2, 3.5 -> 4; no review: dropped


def test_category_flags_with_many_categories(spark):
    df = spark.createDataFrame([(f"c{i:02d}", 100, i, float(i)) for i in range(30)],
                               "product_category_name_english string, total_customers long, "
                               "repeat_customers long, repeat_rate_pct double")
    got = {r.product_category_name_english: r for r in drivers.category_rankings(df).collect()}
    assert sorted(c for c, r in got.items() if r.in_top) == [f"c{i}" for i in range(20, 30)]
    assert sorted(c for c, r in got.items() if r.in_bottom) == [f"c{i:02d}" for i in range(10)]
    assert sorted(c for c, r in got.items() if r.in_chart) == [f"c{i}" for i in range(15, 30)]


def test_matrix_holds_every_observed_month(spark):
    pm = spark.createDataFrame([("a", 0), ("a", 40), ("b", 0), ("b", 7)], "person string, k int") \
        .selectExpr("date'2015-01-01' AS cohort_month", "k AS month_index", "person")
    m = cohort.matrix(cohort.cohort_activity(pm), "active_customers")
    assert m.columns == ["cohort_month", "m0", "m7", "m40"]
    assert [tuple(r)[1:] for r in m.collect()] == [(2, 1, 1)]


def test_rate_by_drops_null_groups(spark):
    df = spark.createDataFrame([("a", "x", True), ("b", None, True), ("c", "x", False)],
                               "customer_unique_id string, cat string, is_repeat boolean")
    got = [tuple(r) for r in rates.rate_by(df, "cat", "is_repeat", "customer_unique_id").collect()]
    assert got == [("x", 2, 1, 50.0)]
