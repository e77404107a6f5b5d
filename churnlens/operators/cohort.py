"""Monthly acquisition cohorts, retention matrix and retention curve.

Skew-safe plan: orders are first reduced to one row per (person, month)
(partial aggregation bounds a heavy person by the number of months, not by
its number of orders); the person's cohort is then the minimum month over
that small per-person set.  No self-join of orders with their cohort.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from churnlens.functions.dates import month_diff, month_start


def person_periods(orders: DataFrame, person_col: str, ts_col: str, order_col: str | None = None,
                   value_col: str | None = None, grain: str = "month") -> DataFrame:
    """One row per (person, period): person, order_month, ``n_orders``
    (distinct ``order_col`` values, or rows) and, with ``value_col``, the
    period's last_purchase and order_value.  Rows with a null person or time
    take no part.

    With ``grain="week"`` the periods are weeks that begin on Mondays (the
    column names stay)."""
    if grain not in ("month", "week"):
        raise ValueError(grain)
    start = month_start(ts_col) if grain == "month" else F.to_date(F.date_trunc("week", F.col(ts_col)))
    src = orders.filter(F.col(person_col).isNotNull() & F.col(ts_col).isNotNull()) \
        .select(person_col, start.alias("order_month"), *([order_col] if order_col else []),
                *([ts_col, value_col] if value_col else []))
    cnt = F.count_distinct(order_col) if order_col else F.count(F.lit(1))
    more = [F.max(ts_col).alias("last_purchase"), F.sum(value_col).alias("order_value")] if value_col else []
    return src.groupBy(person_col, "order_month").agg(cnt.alias("n_orders"), *more)


def with_cohorts(periods: DataFrame, person_col: str, grain: str = "month") -> DataFrame:
    """The rows of :func:`person_periods` with cohort_month and month_index."""
    # at most one row per period for each person: a bounded window partition
    first = F.min("order_month").over(Window.partitionBy(person_col))
    return (periods.select(person_col, "order_month", "n_orders").withColumn("cohort_month", first)
            .withColumn("month_index", month_diff("order_month", "cohort_month") if grain == "month"
                        else (F.datediff("order_month", "cohort_month") / 7).cast("int")))


def person_months(orders: DataFrame, person_col: str, ts_col: str,
                  order_col: str | None = None, grain: str = "month") -> DataFrame:
    """person, order_month, n_orders, cohort_month, month_index (see
    :func:`person_periods`)."""
    return with_cohorts(person_periods(orders, person_col, ts_col, order_col, grain=grain), person_col, grain)


def cohort_activity(pm: DataFrame) -> DataFrame:
    """(cohort_month, month_index) → active_customers (distinct persons)."""
    return pm.groupBy("cohort_month", "month_index") \
        .agg(F.count(F.lit(1)).alias("active_customers"))


def cohort_sizes(pm: DataFrame) -> DataFrame:
    """cohort_month → persons whose first purchase falls in that month."""
    return pm.filter(F.col("month_index") == 0).groupBy("cohort_month") \
        .agg(F.count(F.lit(1)).alias("cohort_size"))


def month_index_distribution(pm: DataFrame) -> DataFrame:
    """month_index → number of orders placed that many months after the
    customer's first month."""
    return pm.groupBy("month_index").agg(F.sum("n_orders").cast("long").alias("n_orders"))


def retention(activity: DataFrame, min_size: int = 0, max_index: int | None = None) -> DataFrame:
    """Long retention: cohort_month, month_index, active_customers,
    cohort_size, retention_pct (= active / size × 100, unrounded double).

    The cohort's size is its month-0 cell, found by a window over the
    (small) activity table."""
    size = F.max(F.when(F.col("month_index") == 0, F.col("active_customers"))) \
        .over(Window.partitionBy("cohort_month"))
    out = activity.withColumn("cohort_size", size) \
        .withColumn("retention_pct", F.col("active_customers").cast("double")
                    / F.col("cohort_size") * F.lit(100.0))
    if min_size:
        out = out.filter(F.col("cohort_size") >= min_size)
    if max_index is not None:
        out = out.filter(F.col("month_index") <= max_index)
    return out


def wide(long: DataFrame, value_col: str, indices: Sequence[int], row_key: str = "cohort_month",
         prefix: str = "m") -> DataFrame:
    """Pivot month_index into columns ``{prefix}{k}``; the column set is
    given, so the schema is stable and no extra job discovers values.
    Absent cells are null."""
    return long.groupBy(row_key).agg(*[
        F.max(F.when(F.col("month_index") == k, F.col(value_col))).alias(f"{prefix}{k}")
        for k in indices])


def matrix(long: DataFrame, value_col: str, row_key: str = "cohort_month", prefix: str = "m") -> DataFrame:
    """Pivot every observed month index into a column.  The indices (at most
    one per calendar month of the data) are read first, so the schema is
    known when the DataFrame is returned."""
    seen = long.select("month_index").distinct().orderBy("month_index").collect()
    return wide(long, value_col, [r["month_index"] for r in seen], row_key, prefix)


def cell_lists(long: DataFrame, value_col: str, row_key: str = "cohort_month") -> DataFrame:
    """The matrix with one schema whatever the data: row key, ``n_months``
    (largest month index with a cell, plus one) and ``cells``, the values by
    month index from 0, null where a cell is absent.

    One aggregation of the (small) activity table; a row's cells are at most
    one per calendar month."""
    cells = long.filter(F.col("month_index") >= 0).groupBy(row_key).agg(
        (F.max("month_index") + 1).alias("n_months"),
        F.map_from_entries(F.collect_list(F.struct("month_index", value_col))).alias("_m"))
    return cells.select(row_key, "n_months", F.transform(
        F.sequence(F.lit(0), F.col("n_months") - 1), lambda i: F.try_element_at(F.col("_m"), i)).alias("cells"))


def retention_curve(ret: DataFrame, min_size: int = 100, max_index: int = 12,
                    digits: int = 2) -> DataFrame:
    """month_index → unweighted mean retention over cohorts of at least
    ``min_size`` persons; absent cells are skipped, not zero."""
    return (ret.filter((F.col("cohort_size") >= min_size) & (F.col("month_index") <= max_index))
            .groupBy("month_index")
            .agg(F.count(F.lit(1)).alias("n_cohorts"),
                 F.bround(F.avg("retention_pct"), digits).alias("avg_retention_pct")))


def month1_cliff(ret: DataFrame, min_size: int = 100, digits: int = 2) -> DataFrame:
    """Average month-1 retention and the drop from month 0 (100 %)."""
    m1 = ret.filter((F.col("cohort_size") >= min_size) & (F.col("month_index") == 1)) \
        .agg(F.avg("retention_pct").alias("_m1"))
    return m1.select(F.bround(F.col("_m1"), digits).alias("month1_retention_pct"),
                     F.bround(F.lit(100.0) - F.col("_m1"), digits).alias("drop_pct"))


def heatmap_data(ret: DataFrame, min_size: int = 50, max_index: int = 12,
                 digits: int = 2) -> DataFrame:
    """cohort label (yyyy-MM), month_index, retention_pct for the heatmap."""
    return (ret.filter((F.col("cohort_size") >= min_size) & (F.col("month_index") <= max_index))
            .select(F.date_format("cohort_month", "yyyy-MM").alias("cohort"), "month_index",
                    F.bround("retention_pct", digits).alias("retention_pct")))

