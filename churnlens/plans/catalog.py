"""The named analyses, each ``(spark, sf_dir) -> DataFrame``.

``Analysis`` wires the logical tables of one test-data folder through the
operators.  Its properties are DataFrames built on first use, so a query
only plans what it uses and Catalyst prunes the rest.  Every registered
query plans from the given files on each call; only inside an explicit
``suite(spark, sf_dir)`` are the master and first-orders tables written once
and read by the later analyses, and they are deleted when the suite ends.
Queries that need exact ranks run their ranking passes while the DataFrame
is being built.  Output column names match the SQL
oracle in :mod:`churnlens.plans.oracle`; money leaves as double, counts as
bigint.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlens.functions.rounding import money_avg
from churnlens.functions.dates import month_start
from churnlens.operators import cohort, drivers, keys, master, profile, ranksum, rates, rfm, sketches, survival
from churnlens.operators.ranking import first_row_per_key
from churnlens.plans.params import REGISTERED
from churnlens.session import delete_path, ensure_checkpoint_dir, materialize, write_bucketed, write_stage
from churnlens.sources import files
from churnlens.sources.testdata import TestTables

PERSON = "customer_unique_id"
TS = "order_purchase_timestamp"


# "parquet": a columnar table (readers prune columns, push filters, get size
# statistics); "checkpoint": Spark's serialized-row checkpoint files
STAGE_FORMAT = os.environ.get("CHURNLENS_STAGE_FORMAT", "parquet")
_SUITES: list["Analysis"] = []


@contextmanager
def suite(spark: SparkSession, sf_dir: str, stage_master: bool = True) -> Iterator["Analysis"]:
    """Share the stage tables of one folder between the analyses run inside,
    the way the analysed notebooks hand over persisted files.  The files must
    not change meanwhile; the tables are deleted at the end.
    ``stage_master=False``, where few analyses read more than the delivered
    rows: these are a table of their own, planned from the files, and the
    master is written only if it is asked for."""
    a = Analysis(spark, sf_dir, share=True, stage_master=stage_master)
    _SUITES.append(a)
    try:
        yield a
    finally:
        _SUITES.remove(a)
        a.release()


def analysis(spark: SparkSession, sf_dir: str) -> "Analysis":
    """The running suite's analysis of ``sf_dir``, else a new one that plans
    everything from the files."""
    for a in reversed(_SUITES):
        if a.spark is spark and a.t.sf_dir == sf_dir.rstrip("/"):
            return a
    return Analysis(spark, sf_dir)


class Analysis:
    """The analysis pipeline of one folder: master → delivered → orders,
    cohorts, RFM → first orders.  ``share=True`` writes the master and
    first-orders stages once, and the order months of every person as a table
    bucketed by person, which cohorts and RFM read in place (see :func:`suite`)."""

    def __init__(self, spark: SparkSession, sf_dir: str, share: bool = False, stage_master: bool = True):
        self.spark = spark
        self.t = TestTables(spark, sf_dir)
        self.p = REGISTERED
        self.share = share
        self.stage_master = stage_master
        self.stage_paths: list[str] = []
        self.stage_tables: list[str] = []

    def _stage(self, df: DataFrame) -> DataFrame:
        if not self.share:
            return df
        if STAGE_FORMAT == "checkpoint":
            return materialize(df)
        out = write_stage(df)
        self.stage_paths.append(out._churnlens_stage_path)
        return out

    def release(self) -> None:
        """Delete the stage tables this analysis wrote."""
        for name in self.stage_tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.stage_tables.clear()
        for path in self.stage_paths:
            delete_path(self.spark, path)
        self.stage_paths.clear()

    # -- stage 1: master table ---------------------------------------------
    def _master_rows(self) -> DataFrame:
        t = self.t
        return master.master_table(t.orders(), t.customers(), t.order_items(), t.products(),
                                   t.category_translation(), t.order_reviews())

    @cached_property
    def master(self) -> DataFrame:
        # a flat Parquet table: readers prune columns and push the status
        # test down (partitioning by status cost more to write than it saves
        # when nearly every order is delivered)
        return self._stage(self._master_rows())

    @cached_property
    def delivered(self) -> DataFrame:
        if self.stage_master:
            return master.delivered(self.master)
        # from the files the status test reaches the order scan, and no row
        # of another order is joined or written
        return self._stage(master.delivered(self._master_rows()))

    # -- stage 2: orders, cohorts, RFM ---------------------------------------
    @cached_property
    def orders_per_customer(self) -> DataFrame:
        return master.collapse_orders(self.delivered)

    @cached_property
    def person_periods(self) -> DataFrame:
        """Person and month with orders, last purchase and value, bucketed by
        person.  Rows of a person are bounded by the months, so one who holds
        a third of all orders makes no large bucket (order-level rows would)."""
        dated = self.delivered.filter(F.col("order_id").isNotNull())
        out = write_bucketed(cohort.person_periods(dated, PERSON, TS, "order_id", "price"), PERSON)
        self.stage_paths.append(out._churnlens_stage_path)
        self.stage_tables.append(out._churnlens_stage_table)
        return out

    @cached_property
    def person_months(self) -> DataFrame:
        if self.share:
            return cohort.with_cohorts(self.person_periods, PERSON)
        return cohort.person_months(self.orders_per_customer, PERSON, TS, "order_id")

    @cached_property
    def retention(self) -> DataFrame:
        return cohort.retention(cohort.cohort_activity(self.person_months))

    @cached_property
    def rfm(self) -> DataFrame:
        if self.share:
            return rfm.rfm_from_periods(self.person_periods, PERSON)
        # straight from the item rows: distinct orders, spend and last
        # purchase per person equal those of the order-level collapse, one
        # shuffle fewer
        dated = self.delivered.filter(F.col(TS).isNotNull() & F.col("order_id").isNotNull())
        return rfm.rfm_base(dated, PERSON, TS, "order_id", "price", mode="elapsed")

    @cached_property
    def rfm_qcut(self) -> DataFrame:
        # rfm_base computed its own snapshot, so its per-person rows are
        # checkpointed already
        return rfm.with_segment(rfm.scores_qcut(self.rfm, materialized=True),
                                "R_score", "F_score", "M_score")

    @cached_property
    def rfm_ntile(self) -> DataFrame:
        """SQL-formulation RFM (inner joins, calendar recency) with exact
        distributed NTILE scores; both rankings are checkpointed."""
        return rfm.scores_ntile(_rfm_sql_base(self.t), PERSON)

    # -- stage 3: first orders ------------------------------------------------
    @cached_property
    def first_orders(self) -> DataFrame:
        return self._stage(drivers.first_orders(self.delivered, PERSON))

    @cached_property
    def delivery_stats(self) -> DataFrame:
        return drivers.delivery_stats(self.first_orders)


# ---------------------------------------------------------------------------
# notebook 1: profiling and the master table


def q_table_profile(spark, sf_dir):
    return profile.table_shape(TestTables(spark, sf_dir).all())


def q_null_profile(spark, sf_dir):
    a = analysis(spark, sf_dir)
    frames = [profile.null_profile(df, name) for name, df in a.t.all().items()]
    key_cols = [PERSON, TS, "price", "review_score", "product_category_name_english"]
    if a.share:  # the master is a table already
        frames.append(profile.null_profile(a.master, "master", key_cols, only_missing=False))
    else:
        t = a.t
        counts = master.master_nulls(t.orders(), t.customers(), t.order_items(), t.products(),
                                     t.category_translation(), t.order_reviews(), key_cols)
        frames.append(profile.null_rows(counts, "master", key_cols, only_missing=False))
    return profile.union_all(frames)


def q_duplicate_rows(spark, sf_dir):
    t = TestTables(spark, sf_dir)
    return profile.union_all([keys.duplicate_rows_by_hash(df, name) for name, df in t.all().items()])


def q_key_report(spark, sf_dir):
    """Every declared key and reference: rows, nulls, distinct values,
    repeated keys, orphans."""
    return keys.key_report(TestTables(spark, sf_dir).all())


def q_key_uniqueness(spark, sf_dir):
    return profile.key_uniqueness(TestTables(spark, sf_dir).customers(), "customer_id", PERSON)


def q_status_breakdown(spark, sf_dir):
    return profile.value_counts(analysis(spark, sf_dir).master, "order_status", out="n_rows")


def q_missing_price_status(spark, sf_dir):
    return profile.value_counts(analysis(spark, sf_dir).master, "order_status",
                                where=F.col("price").isNull(), out="n_rows")


def _orders_per_person_all(spark, sf_dir):
    # value_counts of the person id over the customers table: one row per
    # order-level id, all statuses
    return rates.orders_per_person(TestTables(spark, sf_dir).customers(), PERSON, None)


def q_purchase_distribution(spark, sf_dir):
    return rates.purchase_distribution(_orders_per_person_all(spark, sf_dir))


def q_repeat_rate_all(spark, sf_dir):
    return rates.repeat_rate(_orders_per_person_all(spark, sf_dir), mode="half_even")


def q_top_repeat_customers(spark, sf_dir):
    return rates.top_k(_orders_per_person_all(spark, sf_dir), REGISTERED.top_k,
                       [F.col("order_count").desc(), F.col(PERSON).asc()])


def q_top_customer_profile(spark, sf_dir):
    """Profile of the single most frequent person, found without a collect:
    the top-1 row stays a DataFrame and drives semi joins."""
    t = TestTables(spark, sf_dir)
    cust = t.customers()
    top1 = rates.top_k(rates.orders_per_person(cust, PERSON, None), 1,
                       [F.col("order_count").desc(), F.col(PERSON).asc()]).select(PERSON)
    their_ids = cust.join(top1, PERSON, "left_semi")
    ids = their_ids.agg(F.count(F.lit(1)).alias("customer_ids"),
                        F.count_distinct("customer_city", "customer_state").alias("locations"))
    their_orders = t.orders().join(their_ids.select("customer_id"), "customer_id", "left_semi")
    n_orders = their_orders.agg(F.count(F.lit(1)).alias("orders_placed"))
    items = t.order_items().join(their_orders.select("order_id"), "order_id", "left_semi")
    spend = items.agg(F.coalesce(F.sum("price"), F.lit(0).cast("decimal(12,2)")).alias("_p"),
                      F.coalesce(F.sum("freight_value"), F.lit(0).cast("decimal(12,2)")).alias("_f"))
    # every frame here is a single row
    one = top1.crossJoin(ids).crossJoin(n_orders).crossJoin(spend)
    return one.select(PERSON, "customer_ids", "locations", "orders_placed",
                      F.col("_p").cast("double").alias("product_spend"),
                      F.col("_f").cast("double").alias("freight"),
                      (F.col("_p") + F.col("_f")).cast("double").alias("grand_total"),
                      money_avg(F.col("_p") + F.col("_f"), "orders_placed")
                      .alias("avg_order_value"))


def q_top_customer_locations(spark, sf_dir):
    """(city, state) counts over the order-level ids of the most frequent
    person (multi-column value counts behind a top-1 semi join)."""
    cust = TestTables(spark, sf_dir).customers()
    top1 = rates.top_k(rates.orders_per_person(cust, PERSON, None), 1,
                       [F.col("order_count").desc(), F.col(PERSON).asc()]).select(PERSON)
    return profile.value_counts(cust.join(top1, PERSON, "left_semi"),
                                ["customer_city", "customer_state"], out="n_ids")


def q_order_date_range(spark, sf_dir):
    return profile.date_range(TestTables(spark, sf_dir).orders(), TS)


def q_avg_order_value(spark, sf_dir):
    t = TestTables(spark, sf_dir)
    tot = t.order_items().agg(F.sum("price").alias("_p"), F.sum("freight_value").alias("_f"))
    n = t.orders().agg(F.count(F.lit(1)).alias("n_orders"))
    return tot.crossJoin(n).select(
        F.col("_p").cast("double").alias("total_price"),
        F.col("_f").cast("double").alias("total_freight"), "n_orders",
        money_avg(F.col("_p") + F.col("_f"), "n_orders").alias("avg_order_value"))


def _money_out(df: DataFrame) -> DataFrame:
    return df.withColumn("price", F.col("price").cast("double")) \
        .withColumn("freight_value", F.col("freight_value").cast("double"))


def q_master_table(spark, sf_dir):
    return _money_out(analysis(spark, sf_dir).master)


def q_master_delivered(spark, sf_dir):
    return _money_out(analysis(spark, sf_dir).delivered)


def q_master_drop_report(spark, sf_dir):
    a = analysis(spark, sf_dir)
    keep = (F.col("order_status") == "delivered") & F.col("price").isNotNull()
    return master.row_drop_report(a.master, keep)


def q_master_checks(spark, sf_dir):
    m = analysis(spark, sf_dir).master
    distinct = profile.entity_counts(m, {"unique_orders": "order_id",
                                          "unique_customers": PERSON,
                                          "unique_products": "product_id",
                                          "unique_categories": "product_category_name_english"})
    return distinct.crossJoin(profile.revenue_totals(m))


# ---------------------------------------------------------------------------
# notebook 2: orders, cohorts, RFM


def q_orders_per_customer(spark, sf_dir):
    return analysis(spark, sf_dir).orders_per_customer \
        .withColumn("order_value", F.col("order_value").cast("double"))


def q_second_purchase_survival(spark, sf_dir):
    """Product-limit curve of the days from a person's first to the second
    delivered order, censored a day after the last purchase."""
    orders = analysis(spark, sf_dir).orders_per_customer
    if not analysis(spark, sf_dir).share:
        orders = materialize(orders.select(PERSON, TS, "order_id"))  # read twice: snapshot, events
    snapshot = rfm.snapshot_after_last(orders, TS)
    return survival.survival_curve(survival.time_to_kth(orders, PERSON, TS, "order_id", snapshot))


def q_monthly_shared_customers(spark, sf_dir):
    """Customers by month of purchase and those who buy again in the next
    month, from stored set sketches (exact up to 65,536 a month)."""
    orders = TestTables(spark, sf_dir).orders().join(
        TestTables(spark, sf_dir).customers().select("customer_id", PERSON), "customer_id")
    months = orders.select(month_start(TS).alias("order_month"), PERSON, "order_id")
    stored = write_stage(sketches.period_sketches(months, "order_month", {"orders": "order_id"}, PERSON))
    return sketches.shared_with_next(stored, "order_month", lambda m: F.add_months(m, 1))


def q_cohort_sizes(spark, sf_dir):
    return cohort.cohort_sizes(analysis(spark, sf_dir).person_months)


def q_cohort_activity(spark, sf_dir):
    return cohort.cohort_activity(analysis(spark, sf_dir).person_months) \
        .orderBy("cohort_month", "month_index")


def q_month_index_distribution(spark, sf_dir):
    return cohort.month_index_distribution(analysis(spark, sf_dir).person_months)


def _cells_out(df: DataFrame) -> DataFrame:
    """Cells as text, ``-`` where absent: comparable as one value."""
    cell = F.transform("cells", lambda c: F.coalesce(c.cast("string"), F.lit("-")))
    return df.withColumn("cells", F.array_join(cell, ","))


def q_cohort_matrix(spark, sf_dir):
    cells = cohort.cell_lists(cohort.cohort_activity(analysis(spark, sf_dir).person_months), "active_customers")
    return _cells_out(cells)


def q_retention_matrix(spark, sf_dir):
    a = analysis(spark, sf_dir)
    long = a.retention.withColumn("retention_pct", F.bround("retention_pct", 2))
    return _cells_out(cohort.cell_lists(long, "retention_pct"))


def q_retention_long(spark, sf_dir):
    return analysis(spark, sf_dir).retention \
        .withColumn("retention_pct", F.bround("retention_pct", 6))


def q_retention_heatmap_data(spark, sf_dir):
    a = analysis(spark, sf_dir)
    return cohort.heatmap_data(a.retention, a.p.heatmap_min_cohort, a.p.shown_month_index)


def q_retention_curve(spark, sf_dir):
    a = analysis(spark, sf_dir)
    return cohort.retention_curve(a.retention, a.p.curve_min_cohort, a.p.shown_month_index) \
        .orderBy("month_index")


def q_month1_cliff(spark, sf_dir):
    a = analysis(spark, sf_dir)
    return cohort.month1_cliff(a.retention, a.p.curve_min_cohort)


def _sql_universe(t: TestTables) -> DataFrame:
    """customers ⨝ orders, delivered only (the SQL queries' base)."""
    o = t.orders().filter(F.col("order_status") == "delivered")
    return t.customers().select("customer_id", PERSON).join(o, "customer_id")


def q_repeat_rate(spark, sf_dir):
    per = rates.orders_per_person(_sql_universe(TestTables(spark, sf_dir)), PERSON, "order_id")
    return rates.repeat_rate(per, mode="half_up")


def q_cohort_activity_sql(spark, sf_dir):
    """The SQL formulation: count distinct persons per (cohort, month)
    over delivered orders including those without items."""
    pm = cohort.person_months(_sql_universe(TestTables(spark, sf_dir)), PERSON, TS, "order_id")
    return cohort.cohort_activity(pm).orderBy("cohort_month", "month_index")


def _rfm_out(df: DataFrame) -> DataFrame:
    return df.withColumn("monetary", F.col("monetary").cast("double"))


def q_rfm_base(spark, sf_dir):
    return _rfm_out(analysis(spark, sf_dir).rfm.drop("last_purchase"))


def q_rfm_describe(spark, sf_dir):
    return rfm.describe_columns(analysis(spark, sf_dir).rfm,
                                {"recency": "recency", "frequency": "frequency",
                                 "monetary": "monetary"})


def q_rfm_scores_qcut(spark, sf_dir):
    return _rfm_out(analysis(spark, sf_dir).rfm_qcut.select(
        PERSON, "recency", "frequency", "monetary", "R_score", "F_score", "M_score",
        "RFM_score", "segment"))


def q_rfm_score_distribution(spark, sf_dir):
    return rfm.score_distribution(analysis(spark, sf_dir).rfm_qcut,
                                  {"R_score": "R_score", "F_score": "F_score",
                                   "M_score": "M_score"})


def _rfm_sql_base(t: TestTables) -> DataFrame:
    """SQL RFM input: delivered orders with at least one item; snapshot =
    calendar day after the last purchase of any order (all statuses)."""
    items = t.order_items().select("order_id", "price")
    orders = _sql_universe(t).join(items, "order_id")
    per_order = orders.groupBy(PERSON, "order_id", TS).agg(F.sum("price").alias("order_value"))
    snap = rfm.snapshot_after_last(t.orders(), TS, calendar=True)
    return rfm.rfm_base(per_order, PERSON, TS, "order_id", "order_value", snapshot=snap,
                        mode="calendar")


def q_rfm_scores_ntile(spark, sf_dir):
    scored = analysis(spark, sf_dir).rfm_ntile
    return _rfm_out(scored.select(PERSON, F.col("recency").alias("recency_days"), "frequency",
                                  "monetary", "r_score", "f_score", "m_score"))


def q_rfm_segments_sql(spark, sf_dir):
    scored = analysis(spark, sf_dir).rfm_ntile
    return rfm.segment_summary_sql(rfm.with_segment(scored, "r_score", "f_score", "m_score")) \
        .orderBy(F.col("total_revenue").desc(), "segment")


def q_rfm_segments_qcut(spark, sf_dir):
    return rfm.segment_summary(analysis(spark, sf_dir).rfm_qcut, PERSON) \
        .orderBy(F.col("total_monetary").desc(), "segment")


def q_segment_shares(spark, sf_dir):
    return rfm.segment_shares(analysis(spark, sf_dir).rfm_qcut, PERSON)


def q_one_time_revenue_share(spark, sf_dir):
    return rfm.one_time_revenue_share(analysis(spark, sf_dir).rfm)


# ---------------------------------------------------------------------------
# notebook 3: retention drivers


def q_repeat_flag_summary(spark, sf_dir):
    return rfm.repeat_flag_summary(analysis(spark, sf_dir).rfm)


def q_first_orders(spark, sf_dir):
    fo = analysis(spark, sf_dir).first_orders
    return fo.withColumn("price", F.col("price").cast("double")) \
        .withColumn("monetary", F.col("monetary").cast("double"))


def q_delivery_days_describe(spark, sf_dir):
    return rfm.describe_columns(analysis(spark, sf_dir).first_orders,
                                {"delivery_days": "delivery_days"})


def q_delivery_comparison(spark, sf_dir):
    return drivers.delivery_comparison(analysis(spark, sf_dir).delivery_stats)


def q_delivery_median_gap(spark, sf_dir):
    return drivers.delivery_median_gap(analysis(spark, sf_dir).delivery_stats)


def q_delivery_boxplot_data(spark, sf_dir):
    return drivers.boxplot_stats(analysis(spark, sf_dir).delivery_stats)


def q_review_retention_raw(spark, sf_dir):
    return drivers.review_retention(analysis(spark, sf_dir).first_orders, PERSON, rounded=False)


def q_review_retention(spark, sf_dir):
    return drivers.review_retention(analysis(spark, sf_dir).first_orders, PERSON, rounded=True)


def q_review_extremes(spark, sf_dir):
    raw = drivers.review_retention(analysis(spark, sf_dir).first_orders, PERSON, rounded=False)
    return rates.extremes(raw, "review_score", 1.0, 5.0, low_name="one_star_pct",
                          high_name="five_star_pct", ratio="five_over_one")


def q_category_retention_nb(spark, sf_dir):
    a = analysis(spark, sf_dir)
    return drivers.category_retention(a.first_orders, PERSON, a.p.category_min_customers) \
        .orderBy(F.col("repeat_rate_pct").desc(), "product_category_name_english")


def q_category_against_overall(spark, sf_dir):
    """Category rates beside the rate of the whole first-order universe."""
    a = analysis(spark, sf_dir)
    return drivers.category_against_overall(a.first_orders, PERSON, a.p.category_min_customers)


def q_category_top_bottom(spark, sf_dir):
    a = analysis(spark, sf_dir)
    return drivers.category_rankings(
        drivers.category_retention(a.first_orders, PERSON, a.p.category_min_customers))


def q_category_retention_sql(spark, sf_dir):
    """Category of the first *categorised* delivered item; order counts over
    categorised items only (inner joins before the first-row choice)."""
    t = TestTables(spark, sf_dir)
    items = t.order_items().select("order_id", "order_item_id", "product_id", "seller_id",
                                   "price")
    base = (_sql_universe(t).select(PERSON, "order_id", TS).join(items, "order_id")
            .join(t.products().select("product_id", "product_category_name"), "product_id")
            .join(t.category_translation(), "product_category_name")
            .withColumnRenamed("product_category_name_english", "category"))
    # first categorised item and distinct categorised orders, both hashed by
    # person: the join of the two needs no further exchange
    base = base.filter(F.col(PERSON).isNotNull())
    first = first_row_per_key(base, PERSON, drivers.FIRST_ROW_ORDER).select(PERSON, "category")
    flagged = first.join(base.groupBy(PERSON).agg(F.count_distinct("order_id").alias("total_orders")),
                         PERSON).withColumn("is_repeat", F.col("total_orders") >= 2)
    return rates.rate_by(flagged, "category", "is_repeat", PERSON, min_n=REGISTERED.category_min_customers,
                         mode="half_up", drop_null_dims=False) \
        .orderBy(F.col("repeat_rate_pct").desc(), "category")


def q_spend_bucket_retention(spark, sf_dir):
    return drivers.spend_buckets(analysis(spark, sf_dir).first_orders, PERSON)


def q_estimate_rank_sum(spark, sf_dir):
    """Delivery against the estimate, repeat against one-time customers:
    rank-sum statistic and the share delivered late."""
    out = ranksum.rank_sum(analysis(spark, sf_dir).first_orders.select("days_vs_estimate", "is_repeat"),
                           "days_vs_estimate", "is_repeat")
    return out.withColumnsRenamed({"n_true": "n_repeat", "n_false": "n_one_time", "positive_pct_true": "late_repeat_pct",
                                   "positive_pct_false": "late_one_time_pct"})


def q_published_outputs(spark, sf_dir):
    """All hand-over files of a run, written, published and read back: rows
    and the sum of one measure of each file."""
    from churnlens.plans import outputs
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/stages/published-{uuid.uuid4().hex}"
    outputs.run_outputs(spark, sf_dir, path)
    manifest = outputs.published(spark, path)
    measure = {"master_delivered": "price", "rfm_segmentation": "monetary", "segment_summary": "total_monetary",
               "first_orders_analysis": "price"}
    return profile.union_all([
        outputs.read_output(spark, path, name, fmt, manifest).agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.sum(F.col(measure.get(name, "total_customers")).cast("decimal(18,2)")).cast("double").alias("total"))
        .select(F.lit(name).alias("output"), F.lit(fmt).alias("format"), "n_rows", "total")
        for name, table in manifest["tables"].items() for fmt in table["formats"]])


def q_csv_monthly_revenue(spark, sf_dir):
    """Delivered revenue by month, starting from CSV: the source tables are
    written as CSV files, read with their declared schemas and joined to the
    master table."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/stages/csv-{uuid.uuid4().hex}"
    files.write_source_csvs(TestTables(spark, sf_dir).all(), path)
    t = files.read_source_csvs(spark, path)
    rows = master.delivered(master.master_table(t["orders"], t["customers"], t["order_items"], t["products"],
                                                t["category_translation"], t["order_reviews"]))
    return rows.groupBy(month_start(TS).alias("order_month")).agg(
        F.count(F.lit(1)).alias("n_items"), F.count_distinct("order_id").alias("n_orders"),
        F.count_distinct(PERSON).alias("n_customers"),
        F.count("product_category_name_english").alias("categorised_items"),
        F.count_if(F.col("has_review") > 0).alias("reviewed_items"),
        F.sum("price").cast("double").alias("revenue"), F.sum("freight_value").cast("double").alias("freight"))


def q_spend_extremes(spark, sf_dir):
    buckets = drivers.spend_buckets(analysis(spark, sf_dir).first_orders, PERSON)
    return rates.extremes(buckets, "bucket", 1, 5, low_name="lowest_bucket_pct",
                          high_name="highest_bucket_pct", ratio="high_over_low")


# ---------------------------------------------------------------------------
# second binding: the events table (person = user_id, purchases only)


WEEKS = {"cohort_month": "cohort_week", "month_index": "week_index"}


def _purchases(spark, sf_dir) -> DataFrame:
    return TestTables(spark, sf_dir).raw("events").filter(F.col("event_type") == "purchase")


def q_events_repeat_rate(spark, sf_dir):
    per = rates.orders_per_person(_purchases(spark, sf_dir), "user_id", "event_id")
    return rates.repeat_rate(per, mode="half_up")


def q_events_cohort_activity(spark, sf_dir):
    weeks = cohort.person_months(_purchases(spark, sf_dir), "user_id", "ts", "event_id", grain="week")
    return cohort.cohort_activity(weeks).withColumnsRenamed(WEEKS)


def q_events_cohort_activity_stream(spark, sf_dir):
    """The events table read as a file stream, pairs maintained by a
    streaming query (availableNow), cohorts computed from the pair table."""
    from churnlens.sources.testdata import RAW_SCHEMAS
    from churnlens.streaming import activity_from_pairs, run_pairs_available_now
    stream = (spark.readStream.schema(RAW_SCHEMAS["events"])
              .option("pathGlobFilter", "events.parquet").parquet(sf_dir)
              .filter(F.col("event_type") == "purchase"))
    path = run_pairs_available_now(spark, stream, "user_id", "ts", grain="week")
    return activity_from_pairs(spark, path, grain="week").withColumnsRenamed(WEEKS)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "table_profile": q_table_profile,
    "null_profile": q_null_profile,
    "duplicate_rows": q_duplicate_rows,
    "key_uniqueness": q_key_uniqueness,
    "key_report": q_key_report,
    "status_breakdown": q_status_breakdown,
    "missing_price_status": q_missing_price_status,
    "purchase_distribution": q_purchase_distribution,
    "repeat_rate_all": q_repeat_rate_all,
    "top_repeat_customers": q_top_repeat_customers,
    "top_customer_profile": q_top_customer_profile,
    "top_customer_locations": q_top_customer_locations,
    "order_date_range": q_order_date_range,
    "avg_order_value": q_avg_order_value,
    "master_table": q_master_table,
    "master_checks": q_master_checks,
    "master_delivered": q_master_delivered,
    "master_drop_report": q_master_drop_report,
    "orders_per_customer": q_orders_per_customer,
    "second_purchase_survival": q_second_purchase_survival,
    "monthly_shared_customers": q_monthly_shared_customers,
    "cohort_sizes": q_cohort_sizes,
    "cohort_activity": q_cohort_activity,
    "cohort_activity_sql": q_cohort_activity_sql,
    "month_index_distribution": q_month_index_distribution,
    "cohort_matrix": q_cohort_matrix,
    "retention_matrix": q_retention_matrix,
    "retention_long": q_retention_long,
    "retention_heatmap_data": q_retention_heatmap_data,
    "retention_curve": q_retention_curve,
    "month1_cliff": q_month1_cliff,
    "repeat_rate": q_repeat_rate,
    "rfm_base": q_rfm_base,
    "rfm_describe": q_rfm_describe,
    "rfm_scores_qcut": q_rfm_scores_qcut,
    "rfm_score_distribution": q_rfm_score_distribution,
    "rfm_scores_ntile": q_rfm_scores_ntile,
    "rfm_segments_sql": q_rfm_segments_sql,
    "rfm_segments_qcut": q_rfm_segments_qcut,
    "segment_shares": q_segment_shares,
    "one_time_revenue_share": q_one_time_revenue_share,
    "repeat_flag_summary": q_repeat_flag_summary,
    "first_orders": q_first_orders,
    "delivery_days_describe": q_delivery_days_describe,
    "delivery_comparison": q_delivery_comparison,
    "delivery_median_gap": q_delivery_median_gap,
    "delivery_boxplot_data": q_delivery_boxplot_data,
    "review_retention_raw": q_review_retention_raw,
    "review_retention": q_review_retention,
    "review_extremes": q_review_extremes,
    "category_retention_sql": q_category_retention_sql,
    "category_retention_nb": q_category_retention_nb,
    "category_against_overall": q_category_against_overall,
    "category_top_bottom": q_category_top_bottom,
    "spend_bucket_retention": q_spend_bucket_retention,
    "spend_extremes": q_spend_extremes,
    "estimate_rank_sum": q_estimate_rank_sum,
    "published_outputs": q_published_outputs,
    "csv_monthly_revenue": q_csv_monthly_revenue,
    "events_repeat_rate": q_events_repeat_rate,
    "events_cohort_activity": q_events_cohort_activity,
    "events_cohort_activity_stream": q_events_cohort_activity_stream,
}

