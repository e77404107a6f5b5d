"""First-order attribution and the retention 'driver' comparisons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlens.functions.dates import fractional_days
from churnlens.functions.rounding import money_avg, ratio_round
from churnlens.operators.ranking import exact_quantiles, first_row_per_key, quantile_bin
from churnlens.operators.rates import rate_by
from churnlens.session import materialize

# Total order used to pick a person's first item row: purchase time, then
# order id, then item number, product, seller and price (no ties left).
FIRST_ROW_ORDER = ("order_purchase_timestamp", "order_id", "order_item_id", "product_id",
                   "seller_id", "price")

# Spend-bucket labels, lowest to highest quintile.
SPEND_LABELS = ("Very Low (bottom 20%)", "Low", "Medium", "High", "Very High (top 20%)")
# Labels of the repeat flag in the delivery comparison.
FLAG_LABELS = {False: "One-time customers", True: "Repeat customers"}


FIRST_ORDER_FIELDS = ("order_purchase_timestamp", "order_delivered_customer_date",
                      "order_estimated_delivery_date", "review_score", "price",
                      "product_category_name_english")


def first_orders(delivered: DataFrame, person_col: str = "customer_unique_id",
                 order_cols: Sequence[str] = FIRST_ROW_ORDER, min_orders: int = 2,
                 drop_undelivered: bool = True, order_col: str = "order_id",
                 ts_col: str = "order_purchase_timestamp", value_col: str = "price") -> DataFrame:
    """One row per person: the first item row of the first order, its
    delivery time in days, delivery vs estimate (negative = early), and the
    person's repeat flag, frequency (distinct orders) and monetary value.

    Frequency and spend are hash aggregates; the first row is a
    ``row_number() = 1`` whose group limit keeps one candidate row a person
    and map task before the shuffle.  Both are hashed by person, so joining
    them moves nothing.  ``price`` is that item's price, not the order total
    (as analysed).  Orders without a purchase time count for neither
    frequency nor spend (they have no row in the order table the analysis
    derives them from).
    """
    src = delivered.filter(F.col(person_col).isNotNull())
    dated = F.col(ts_col).isNotNull() & F.col(order_col).isNotNull()
    totals = src.groupBy(person_col).agg(
        F.count_distinct(F.when(dated, F.col(order_col))).alias("_freq"),
        F.sum(F.when(dated, F.col(value_col))).alias("_spend"))
    needed = dict.fromkeys([person_col, *order_cols, *FIRST_ORDER_FIELDS])
    per = first_row_per_key(src.select(*needed), person_col, order_cols).join(totals, person_col)
    known = F.col("_freq") > 0
    out = per.select(
        person_col, *FIRST_ORDER_FIELDS,
        fractional_days(F.col("order_purchase_timestamp"),
                        F.col("order_delivered_customer_date")).alias("delivery_days"),
        fractional_days(F.col("order_estimated_delivery_date"),
                        F.col("order_delivered_customer_date")).alias("days_vs_estimate"),
        F.when(known, F.col("_freq") >= min_orders).alias("is_repeat"),
        F.when(known, F.col("_freq")).alias("frequency"),
        F.when(known, F.col("_spend")).alias("monetary"))
    if drop_undelivered:
        out = out.filter(F.col("delivery_days").isNotNull())
    return out


def _flag_label(flag: str = "is_repeat"):
    return F.when(F.col(flag), FLAG_LABELS[True]).otherwise(FLAG_LABELS[False])


def delivery_stats(fo: DataFrame, value: str = "delivery_days", flag: str = "is_repeat",
                   whisker: float = 1.5, num_partitions: int | None = None) -> DataFrame:
    """One row per flag value: mean, std, count, q1, median, q3 and the
    whiskers (furthest observations within ``whisker`` x IQR of the box),
    unrounded, from one ranking pass.  The delivery results below are
    selections from it."""
    src = materialize(fo.filter(F.col(flag).isNotNull() & F.col(value).isNotNull())
                      .select(flag, value))
    # a boolean flag: at most two groups
    q = exact_quantiles(src, value, [0.25, 0.5, 0.75], by=[flag], prefix="_q", materialized=True,
                        max_groups=2, num_partitions=num_partitions) \
        .select(flag, F.col("_q0").alias("q1"), F.col("_q1").alias("median"),
                F.col("_q2").alias("q3"))
    reach = whisker * (F.col("q3") - F.col("q1"))
    v = F.col(value)
    # q holds one row per value of a boolean flag: bounded broadcast
    return src.join(F.broadcast(q), flag).groupBy(flag, "q1", "median", "q3").agg(
        F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.count(v).alias("count"),
        F.min(F.when(v >= F.col("q1") - reach, v)).alias("lower_whisker"),
        F.max(F.when(v <= F.col("q3") + reach, v)).alias("upper_whisker"))


def delivery_comparison(stats: DataFrame, flag: str = "is_repeat", digits: int = 2) -> DataFrame:
    """By repeat flag: mean, median, std, count of delivery days."""
    return stats.select(_flag_label(flag).alias("customer_type"), flag,
                        *[F.bround(c, digits).alias(c) for c in ("mean", "median", "std")], "count")


def delivery_median_gap(stats: DataFrame, flag: str = "is_repeat", digits: int = 2) -> DataFrame:
    one = F.max(F.when(~F.col(flag), F.col("median")))
    rep = F.max(F.when(F.col(flag), F.col("median")))
    return stats.agg(one.alias("_o"), rep.alias("_r")).select(
        F.bround("_o", digits).alias("one_time_median"),
        F.bround("_r", digits).alias("repeat_median"),
        F.bround(F.col("_o") - F.col("_r"), digits).alias("difference"))


def boxplot_stats(stats: DataFrame, flag: str = "is_repeat", digits: int = 2) -> DataFrame:
    """Per group: q1, median, q3, their range and the whiskers."""
    return stats.select(
        _flag_label(flag).alias("customer_type"), flag,
        *[F.bround(c, digits).alias(c) for c in ("q1", "median", "q3")],
        F.bround(F.col("q3") - F.col("q1"), digits).alias("iqr"),
        F.bround("lower_whisker", digits).alias("lower_whisker"),
        F.bround("upper_whisker", digits).alias("upper_whisker"))


def review_retention(fo: DataFrame, person_col: str, rounded: bool) -> DataFrame:
    """Repeat rate by first-order review score (raw mean or rounded half-even)."""
    src = fo.filter(F.col("review_score").isNotNull())
    if rounded:
        src = src.withColumn("review_score_int", F.bround("review_score", 0).cast("int"))
        dim = "review_score_int"
    else:
        dim = "review_score"
    return rate_by(src, dim, "is_repeat", person_col)


def category_retention(fo: DataFrame, person_col: str, min_customers: int = 500,
                       cat_col: str = "product_category_name_english") -> DataFrame:
    """Repeat rate by first-order category; uncategorised persons dropped."""
    return rate_by(fo, cat_col, "is_repeat", person_col, min_n=min_customers)


def category_against_overall(fo: DataFrame, person_col: str, min_customers: int = 500,
                             cat_col: str = "product_category_name_english") -> DataFrame:
    """Repeat rate by first-order category beside that of all first orders
    (uncategorised persons and small categories included): the difference in
    percentage points and the ratio.  One pass: the overall counts are sums
    over the aggregated categories."""
    from pyspark.sql import Window
    every = Window.partitionBy()
    counted = rate_by(fo, cat_col, "is_repeat", person_col, drop_null_dims=False)
    overall = counted.withColumn("_t", F.sum("total_customers").over(every)) \
        .withColumn("_r", F.sum("repeat_customers").over(every)) \
        .withColumn("overall_rate_pct", ratio_round("_r", "_t", scale=100, digits=2))
    return overall.filter(F.col(cat_col).isNotNull() & (F.col("total_customers") >= min_customers)).select(
        cat_col, "total_customers", "repeat_customers", "repeat_rate_pct", "overall_rate_pct",
        F.bround(F.col("repeat_rate_pct") - F.col("overall_rate_pct"), 2).alias("points_above"),
        F.bround(F.try_divide(F.col("repeat_rate_pct"), F.col("overall_rate_pct")), 4).alias("ratio_to_overall"))


def category_rankings(rates: DataFrame, cat_col: str = "product_category_name_english",
                      top: int = 10, bottom: int = 10, chart: int = 15) -> DataFrame:
    """Each qualifying category with its rank (best first), top / bottom
    flags and its rate relative to the best category (small table)."""
    from pyspark.sql import Window
    w_desc = Window.orderBy(F.col("repeat_rate_pct").desc(), F.col(cat_col).asc())
    w_all = Window.partitionBy()
    ranked = rates.withColumn("rank_desc", F.row_number().over(w_desc)) \
        .withColumn("_n", F.count(F.lit(1)).over(w_all)) \
        .withColumn("_best", F.max("repeat_rate_pct").over(w_all))
    return ranked.select(
        cat_col, "total_customers", "repeat_customers", "repeat_rate_pct", "rank_desc",
        (F.col("rank_desc") <= top).alias("in_top"),
        (F.col("rank_desc") > F.col("_n") - bottom).alias("in_bottom"),
        (F.col("rank_desc") <= chart).alias("in_chart"),
        F.bround(F.try_divide(F.col("repeat_rate_pct"), F.col("_best")), 4).alias("ratio_to_best"))


def spend_buckets(fo: DataFrame, person_col: str, value: str = "price",
                  labels: Sequence[str] = SPEND_LABELS) -> DataFrame:
    """Repeat rate by quintile of first-item price (right-closed bins)."""
    k = len(labels)
    probs = [i / k for i in range(1, k)]
    # read twice: only the three columns that are needed are written
    binned = quantile_bin(fo.select(person_col, "is_repeat", value), value, probs, out="bucket", labels=labels,
                          label_col="spend_bucket")
    rates = rate_by(binned, ["bucket", "spend_bucket"],
                    "is_repeat", person_col,
                    extra_aggs=[F.sum(value).alias("_sum"), F.count(value).alias("_cnt"),
                                F.min(value).alias("_min"), F.max(value).alias("_max")])
    return rates.select("bucket", "spend_bucket", "total_customers", "repeat_customers",
                        money_avg("_sum", "_cnt").alias("avg_first_order_value"),
                        F.col("_min").cast("double").alias("min_value"),
                        F.col("_max").cast("double").alias("max_value"),
                        "repeat_rate_pct")


