"""Plan shape checks: no single-partition step over person- or row-level
data, no cartesian product, pruning of unused lookups (SURVEY §7.5)."""

import re
from collections import Counter

import pytest

SF = "/root/testdata/sf0.001"

# what the one row a task, day or category that reaches a single partition is made of
SMALL = (r"HashAggregate\(keys=\[\].*partial_", r"HashAggregate\(keys=\[\], functions=\[\], output=\[\]\)",
         r"HashAggregate\(keys=\[_pid#\d+\]",
         r"repeat_rate_pct",  # a ranking of aggregated categories
         r"day#\d+L, events#\d+L, censored#\d+L")  # running products over distinct days


def _names():
    from churnlens.plans.catalog import QUERIES
    return list(QUERIES)


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _single_partition_children(plan: str) -> list[str]:
    lines = plan.split("\n")
    return [lines[i + 1] for i, line in enumerate(lines)
            if "Exchange SinglePartition" in line and i + 1 < len(lines)]


@pytest.mark.parametrize("name", _names())
def test_no_single_partition_over_rows(spark, name):
    from churnlens.plans.catalog import QUERIES
    plan = _plan(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in plan
    for child in _single_partition_children(plan):
        assert any(re.search(p, child) for p in SMALL), child


def test_unused_lookups_are_pruned(spark):
    from churnlens.operators import cohort
    from churnlens.plans.catalog import Analysis
    a = Analysis(spark, SF)  # planned from the raw tables
    plan = _plan(cohort.cohort_activity(a.person_months))
    assert "p_partkey" not in plan and "l_shipdate" not in plan  # no product / ship-date work
    assert re.search(r"ReadSchema: struct<l_orderkey:bigint,l_extendedprice:double>", plan)


def test_shared_stage_is_read_not_recomputed(spark):
    from churnlens.plans.catalog import QUERIES, suite
    with suite(spark, SF):
        QUERIES["master_delivered"](spark, SF)  # builds the shared master once
        plan = _plan(QUERIES["orders_per_customer"](spark, SF))
        cohorts = _plan(QUERIES["cohort_activity"](spark, SF))
    for p in (plan, cohorts):
        assert "lineitem" not in p and "orders.parquet" not in p
    # cohorts read two columns of the table bucketed by person
    assert re.search(r"ReadSchema: struct<customer_unique_id:\w+,order_month:date>", cohorts)
    # only the columns the orders need are read from the stage table
    # (plan text truncates long schemas, so match the prefix)
    assert re.search(r"ReadSchema: struct<order_id:bigint,order_status:string,"
                     r"order_purchase_timestamp:timestamp_ntz,customer_unique", plan)
    assert "customer_city" not in plan.split("ReadSchema")[1]


# every analysis of a suite that reads cohorts or RFM
BY_PERSON = ["cohort_sizes", "cohort_activity", "month_index_distribution", "cohort_matrix", "retention_matrix",
             "retention_long", "retention_heatmap_data", "retention_curve", "month1_cliff", "rfm_base",
             "rfm_describe", "rfm_scores_qcut", "rfm_segments_qcut", "segment_shares", "one_time_revenue_share",
             "repeat_flag_summary"]


def test_a_suite_exchanges_nothing_by_person(spark):
    """Cohorts and RFM read a table bucketed by person: no exchange by person,
    and the same rows as from the files."""
    from churnlens.operators import rfm
    from churnlens.plans.catalog import PERSON, QUERIES, suite
    alone = {name: sorted(map(str, QUERIES[name](spark, SF).collect())) for name in BY_PERSON}
    with suite(spark, SF) as a:
        a.master  # noqa: B018 - written before
        plans = {"person_totals": _plan(rfm.person_totals(a.person_periods, PERSON))}
        for name in BY_PERSON:
            df = QUERIES[name](spark, SF)
            plans[name] = _plan(df)
            assert sorted(map(str, df.collect())) == alone[name], name
        table = a.stage_tables[0]
        assert spark.catalog.tableExists(table)
    assert not spark.catalog.tableExists(table)
    for name, plan in plans.items():
        assert not re.search(r"hashpartitioning\([^)]*customer_unique_id", plan), name
    assert "Bucketed: true" in plans["cohort_activity"] and "Bucketed: true" in plans["person_totals"]


def test_a_hot_person_makes_no_large_bucket(spark):
    from pyspark.sql import functions as F
    from churnlens.operators import cohort, rfm
    from churnlens.session import delete_path, write_bucketed
    n = 30000
    rows = spark.range(0, n, 1, 8).select(
        F.when(F.col("id") % 3 == 0, F.lit("guest")).otherwise(F.concat(F.lit("p"), F.col("id") % 9000)).alias("who"),
        F.expr("timestamp_ntz'2020-01-01' + make_dt_interval(id % 400)").alias("ts"), F.col("id").alias("order_id"),
        (F.col("id") % 50).cast("decimal(10,2)").alias("price"))
    periods = cohort.person_periods(rows, "who", "ts", "order_id", "price")
    kept = write_bucketed(periods, "who", 4)
    try:
        assert kept.filter("who = 'guest'").count() == 14  # months, not orders
        got = rfm.person_totals(kept, "who")
        want = rows.groupBy("who").agg(F.max("ts"), F.count_distinct("order_id"), F.sum("price"))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
        assert kept.rdd.getNumPartitions() <= 4
    finally:
        spark.sql(f"DROP TABLE {kept._churnlens_stage_table}")
        delete_path(spark, kept._churnlens_stage_path)


def test_first_rows_are_not_sort_aggregated(spark):
    from churnlens.plans.catalog import QUERIES
    for name in ("first_orders", "category_retention_sql"):
        plan = _plan(QUERIES[name](spark, SF))
        # (lookups take the max of a label: sorted by their key, not by person)
        sorted_aggregates = [line for line in plan.split("\n") if "SortAggregate" in line]
        assert not any("customer_unique_id" in line for line in sorted_aggregates), name
        assert "WindowGroupLimit" in plan


def test_matrix_cells_sum_to_the_activity(spark):
    from churnlens.plans.catalog import QUERIES
    total = QUERIES["cohort_activity"](spark, SF).groupBy().sum("active_customers").first()[0]
    rows = QUERIES["cohort_matrix"](spark, SF).collect()
    cells = [r["cells"].split(",") for r in rows]
    assert sum(int(v) for row in cells for v in row if v != "-") == total
    assert [len(row) for row in cells] == [r["n_months"] for r in rows]


def test_a_hot_order_is_split(spark):
    from pyspark.sql import functions as F
    from churnlens.operators import master
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k"}
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        n = 60000
        ids = spark.range(0, 4000, 1, 4)
        orders = ids.select(F.col("id").alias("order_id"), F.col("id").cast("string").alias("customer_id"),
                            F.lit("delivered").alias("order_status"),
                            *[F.lit(None).cast("timestamp_ntz").alias(c) for c in master.ORDER_COLS[3:]])
        customers = orders.select("customer_id", *[F.col("customer_id").alias(c) for c in master.CUSTOMER_COLS])
        items = spark.range(0, n, 1, 8).select(
            F.when(F.col("id") % 2 == 0, F.lit(7)).otherwise(F.col("id") % 4000).alias("order_id"),
            F.col("id").alias("order_item_id"), (F.col("id") % 50).alias("product_id"),
            F.sha2(F.col("id").cast("string"), 256).alias("seller_id"),
            F.lit(None).cast("timestamp_ntz").alias("shipping_limit_date"),
            F.lit(1).alias("price"), F.lit(1).alias("freight_value"))
        products = spark.range(50).select(F.col("id").alias("product_id"), F.concat(F.lit("c"), "id").alias("product_category_name"))
        labels = spark.createDataFrame([("c1", "A")], "product_category_name string, product_category_name_english string")
        reviews = ids.select(F.col("id").alias("order_id"), F.lit(5).alias("review_score"), F.col("id").alias("review_id"))
        m = master.master_table(orders, customers, items, products, labels, reviews)
        out = m.withColumn("_p", F.spark_partition_id())
        largest = max(Counter(r["_p"] for r in out.collect()).values())
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "skew=true" in plan.split("Initial Plan")[0] and largest < 0.4 * n
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_release_deletes_stage_tables(spark):
    import os

    from churnlens.plans.catalog import Analysis
    a = Analysis(spark, SF, share=True)
    n = a.master.count()
    path = a.stage_paths[0]
    assert n > 0 and os.path.isdir(path.replace("file:", ""))
    a.release()
    assert not os.path.exists(path.replace("file:", "")) and a.stage_paths == []
