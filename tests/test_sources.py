"""CSV reader with declared schema and the Parquet / CSV sinks."""

import datetime as dt
import os
import tempfile

from pyspark.sql import functions as F

from churnlens.sources import read_csv_table, read_parquet_table, write_csv, write_parquet
from churnlens.sources.testdata import TestTables


def test_csv_orders_with_bad_timestamp(spark):
    d = tempfile.mkdtemp(prefix="csv-")
    path = os.path.join(d, "orders.csv")
    with open(path, "w") as f:
        f.write("order_id,customer_id,order_status,order_purchase_timestamp,order_approved_at,"
                "order_delivered_carrier_date,order_delivered_customer_date,"
                "order_estimated_delivery_date\n")
        f.write("o1,c1,delivered,2017-10-02 10:56:33,2017-10-02 11:07:15,,"
                "2017-10-10 21:25:13,2017-10-18 00:00:00\n")
        f.write("o2,c2,canceled,not-a-date,,,,\n")
    df = read_csv_table(spark, path, "orders")
    rows = {r.order_id: r for r in df.collect()}
    assert dict(df.dtypes)["order_purchase_timestamp"] == "timestamp_ntz"
    assert rows["o1"].order_purchase_timestamp == dt.datetime(2017, 10, 2, 10, 56, 33)
    assert rows["o1"].order_delivered_carrier_date is None
    assert rows["o2"].order_purchase_timestamp is None  # unparsable → null, no failure


def test_sinks_round_trip(spark):
    d = tempfile.mkdtemp(prefix="sink-")
    df = spark.createDataFrame([(1, "a", 2.5), (2, "b", None)], "k int, s string, v double")
    write_parquet(df, os.path.join(d, "p"), partition_by=["s"])
    back = read_parquet_table(spark, os.path.join(d, "p")).select("k", "s", "v")
    assert sorted(map(tuple, back.collect())) == [(1, "a", 2.5), (2, "b", None)]
    write_csv(df, os.path.join(d, "c"))
    write_csv(df, os.path.join(d, "c"))  # overwrite, not append
    csv = spark.read.option("header", True).csv(os.path.join(d, "c"))
    assert csv.count() == 2 and csv.columns == ["k", "s", "v"]


def test_csv_with_quoted_text(spark):
    import pandas as pd
    d = tempfile.mkdtemp(prefix="csv-quoted-")
    rows = ['r1,o1,5,"two\nlines","he said ""yes"", twice",2018-01-01 00:00:00,2018-01-02 00:00:00',
            'r2,o2,4,,"comma, in text",2018-01-03 00:00:00,2018-01-04 00:00:00',
            'r3,o3,1,plain,"",2018-01-05 00:00:00,']
    path = os.path.join(d, "reviews.csv")
    with open(path, "w", encoding="utf-8") as f:
        f.write("review_id,order_id,review_score,review_comment_title,review_comment_message,"
                "review_creation_date,review_answer_timestamp\n" + "\n".join(rows) + "\n")
    df = read_csv_table(spark, path, "order_reviews")
    got = sorted(df.collect(), key=lambda r: r.review_id)
    assert len(got) == len(pd.read_csv(path)) == 3
    assert got[0].review_comment_title == "two\nlines"
    assert got[0].review_comment_message == 'he said "yes", twice'
    assert got[1].review_comment_title is None and got[1].review_comment_message == "comma, in text"
    out = os.path.join(d, "out")
    strings = df.select("review_id", "order_id", "review_score", "review_comment_title",
                        "review_comment_message",
                        *[F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in
                          ("review_creation_date", "review_answer_timestamp")])
    write_csv(strings, out)
    assert sorted(map(tuple, read_csv_table(spark, out, "order_reviews").collect())) == sorted(map(tuple, got))


def test_csv_with_too_few_columns_fails(spark):
    import pytest
    d = tempfile.mkdtemp(prefix="csv-bad-")
    with open(os.path.join(d, "s.csv"), "w", encoding="utf-8") as f:
        f.write("seller_id,seller_zip_code_prefix,seller_city,seller_state\ns1,123\n")
    with pytest.raises(Exception):
        read_csv_table(spark, d, "sellers").collect()


def test_changed_files_and_folder_names_change_nothing_else(spark):
    import shutil
    src = "/root/testdata/sf0.001"
    from churnlens.plans.catalog import QUERIES
    d = os.path.join(tempfile.mkdtemp(prefix="folder-"), "any_name")
    shutil.copytree(src, d)
    os.chmod(d, 0o755)
    for name in ("retention_heatmap_data", "category_retention_sql"):
        assert sorted(map(tuple, QUERIES[name](spark, d).collect())) == \
            sorted(map(tuple, QUERIES[name](spark, src).collect()))
    before = QUERIES["master_table"](spark, d).count()
    half = spark.read.parquet(f"{src}/orders.parquet").filter("o_orderkey % 2 = 0")
    half.write.parquet(f"{d}/half")
    part = next(f for f in os.listdir(f"{d}/half") if f.endswith(".parquet"))
    os.chmod(f"{d}/orders.parquet", 0o644)
    shutil.copyfile(f"{d}/half/{part}", f"{d}/orders.parquet")
    spark.catalog.refreshByPath(f"{d}/orders.parquet")
    assert 0 < QUERIES["master_table"](spark, d).count() < before


def test_binding_shapes(spark):
    t = TestTables(spark, "/root/testdata/sf0.001")
    assert TestTables(None, "/x/y/").sf_dir == "/x/y"
    n_orders = t.raw("orders").count()
    assert t.customers().count() == n_orders == t.orders().count()
    assert t.customers().select("customer_id").distinct().count() == n_orders
    cats = {r[0] for r in t.category_translation().collect()}
    assert "PROMO" not in cats and len(cats) == 5


def test_csv_tables_end_to_end(spark):
    """The analysis from source-layout CSVs (declared schemas, text dates)
    equals the analysis from the Parquet binding."""
    from pyspark.sql import functions as F

    from churnlens.operators import master, rates
    from churnlens.sources.schemas import SCHEMAS

    t = TestTables(spark, "/root/testdata/sf0.001")
    d = tempfile.mkdtemp(prefix="csv-e2e-")
    names = ["customers", "orders", "order_items", "order_reviews", "products",
             "category_translation"]
    for name in names:
        src = t.table(name)
        cols = []
        for f in SCHEMAS[name].fields:
            c = F.col(f.name) if f.name in src.columns else F.lit(None)
            if f.name in src.columns and dict(src.dtypes)[f.name] == "timestamp_ntz":
                c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
            cols.append(c.cast("string").alias(f.name))
        write_csv(src.select(*cols), os.path.join(d, name))
    csv = {n: read_csv_table(spark, os.path.join(d, n), n) for n in names}
    m_csv = master.master_table(csv["orders"], csv["customers"], csv["order_items"],
                                csv["products"], csv["category_translation"],
                                csv["order_reviews"])
    m_pq = master.master_table(t.orders(), t.customers(), t.order_items(), t.products(),
                               t.category_translation(), t.order_reviews())
    key = ["order_id", "order_item_id", "product_id", "seller_id"]
    norm = [F.col(c).cast("string").alias(c) for c in key] + [
        F.col("price").cast("double"), "order_purchase_timestamp",
        "product_category_name_english", "review_score"]
    assert sorted(map(tuple, m_csv.select(*norm).collect()), key=repr) == \
        sorted(map(tuple, m_pq.select(*norm).collect()), key=repr)

    def rate(m):
        per = rates.orders_per_person(master.delivered(m), "customer_unique_id", "order_id")
        return tuple(rates.repeat_rate(per).first())
    assert rate(m_csv) == rate(m_pq)


def test_schema_and_preview_helpers(spark):
    from churnlens.operators.profile import column_types, preview
    df = spark.createDataFrame([(3, "c"), (1, "a"), (2, "b")], "k int, s string")
    types = [tuple(r) for r in column_types(df, "t").collect()]
    assert types == [("t", 0, "k", "int"), ("t", 1, "s", "string")]
    assert [r.k for r in preview(df, 2, ["k"]).collect()] == [1, 2]
