"""Recency / frequency / monetary scoring and rule-based segments."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlens.functions.dates import add_days, elapsed_days
from churnlens.functions.rounding import int_avg, money_avg, money_share, ratio_round
from churnlens.functions.rules import frequency_score, segment_of
from churnlens.operators.ranking import exact_quantiles, ntile_score, quantile_bins
from churnlens.session import materialize


def snapshot_after_last(df: DataFrame, ts_col: str, days: int = 1,
                        calendar: bool = False) -> DataFrame:
    """One-row frame: the analysis 'today' = last timestamp + ``days``.

    ``calendar=True`` truncates to a date first (SQL ``::DATE + 1 day``)."""
    last = F.max(ts_col)
    snap = F.date_add(F.to_date(last), days) if calendar else add_days(last, days)
    return df.agg(snap.alias("snapshot"))


def rfm_base(orders: DataFrame, person_col: str = "customer_unique_id",
             ts_col: str = "order_purchase_timestamp", order_col: str = "order_id",
             value_col: str = "order_value", snapshot: DataFrame | None = None,
             mode: str = "elapsed") -> DataFrame:
    """person → recency, frequency, monetary (decimal), last_purchase.

    ``mode='elapsed'``: whole 24 h periods from the last purchase to the
    snapshot timestamp; ``mode='calendar'``: date difference in days.
    Default snapshot: one day after the last purchase in ``orders``.
    """
    src = orders.filter(F.col(person_col).isNotNull())
    per = src.groupBy(person_col).agg(F.max(ts_col).alias("last_purchase"),
                                      F.count_distinct(order_col).alias("frequency"),
                                      F.sum(value_col).alias("monetary"))
    if snapshot is None:
        # the snapshot needs a pass over all persons before recency can be
        # computed: keep the per-person rows once instead of re-running the
        # upstream plan for the second pass
        per = materialize(per)
        snapshot = snapshot_after_last(per, "last_purchase", calendar=(mode == "calendar"))
    return _with_recency(per, person_col, snapshot, mode)


def person_totals(periods: DataFrame, person_col: str = "customer_unique_id") -> DataFrame:
    """person → last_purchase, frequency, monetary from the rows of
    ``cohort.person_periods`` (an order lies in one period: order ids are a
    key of the orders).  Over a table bucketed by person nothing moves."""
    value = periods.schema["order_value"].dataType
    return periods.groupBy(person_col).agg(
        F.max("last_purchase").alias("last_purchase"), F.sum("n_orders").cast("long").alias("frequency"),
        F.sum("order_value").cast(value).alias("monetary"))


def rfm_from_periods(periods: DataFrame, person_col: str = "customer_unique_id", mode: str = "elapsed") -> DataFrame:
    """:func:`rfm_base` over ``cohort.person_periods``, with the default
    snapshot."""
    per = materialize(person_totals(periods, person_col))
    return _with_recency(per, person_col, snapshot_after_last(per, "last_purchase", calendar=(mode == "calendar")), mode)


def _with_recency(per: DataFrame, person_col: str, snapshot: DataFrame, mode: str) -> DataFrame:
    if mode == "elapsed":
        rec = elapsed_days("last_purchase", "snapshot")
    elif mode == "calendar":
        rec = F.datediff(F.to_date("snapshot"), F.to_date("last_purchase")).cast("long")
    else:
        raise ValueError("mode must be 'elapsed' or 'calendar'")
    # the snapshot is a single row: bounded broadcast
    return per.crossJoin(F.broadcast(snapshot)).select(
        person_col, rec.alias("recency"), "frequency", "monetary", "last_purchase")


def scores_ntile(rfm: DataFrame, person_col: str, tiles: int = 5) -> DataFrame:
    """SQL-style scores: R = tiles+1 − NTILE(recency), M = NTILE(monetary),
    F from manual buckets; ties split by person id (a total order)."""
    r = ntile_score(rfm, "recency", person_col, tiles, out="r_score", invert=True)
    # r reads the first ranking's checkpoint: no second copy of the input
    m = ntile_score(r, "monetary", person_col, tiles, out="m_score", materialized=True)
    return m.withColumn("f_score", frequency_score("frequency"))


def scores_qcut(rfm: DataFrame, probs=(0.2, 0.4, 0.6, 0.8),
                materialized: bool = False) -> DataFrame:
    """Notebook-style scores: quantile bins (ties stay together), R
    inverted, F from manual buckets, and the three-digit code.
    ``materialized=True`` when ``rfm`` comes from :func:`rfm_base` with its
    own snapshot (its per-person rows are already checkpointed)."""
    top = len(probs) + 1
    m = quantile_bins(rfm, {"_rbin": "recency", "M_score": "monetary"}, probs,
                      materialized=materialized)
    return (m.withColumn("R_score", (F.lit(top + 1) - F.col("_rbin")).cast("int")).drop("_rbin")
            .withColumn("F_score", frequency_score("frequency"))
            .withColumn("RFM_score", F.concat(F.col("R_score").cast("string"),
                                              F.col("F_score").cast("string"),
                                              F.col("M_score").cast("string"))))


def with_segment(scored: DataFrame, r: str, f: str, m: str, out: str = "segment") -> DataFrame:
    return scored.withColumn(out, segment_of(r, f, m))


def segment_summary_sql(seg: DataFrame) -> DataFrame:
    """segment → customer_count, avg_monetary, total_revenue (half-up)."""
    return seg.groupBy("segment").agg(F.count(F.lit(1)).alias("customer_count"),
                                      F.sum("monetary").alias("_sum")) \
        .select("segment", "customer_count",
                money_avg("_sum", "customer_count", mode="half_up").alias("avg_monetary"),
                F.col("_sum").cast("double").alias("total_revenue"))


def segment_summary(seg: DataFrame, person_col: str) -> DataFrame:
    """segment → count, avg/total monetary, avg frequency, avg recency
    (half-even, 2 dp; averages computed exactly)."""
    return seg.groupBy("segment").agg(F.count(person_col).alias("customer_count"),
                                      F.sum("monetary").alias("_m"),
                                      F.sum("frequency").alias("_f"),
                                      F.sum("recency").alias("_r")) \
        .select("segment", "customer_count",
                money_avg("_m", "customer_count").alias("avg_monetary"),
                F.col("_m").cast("double").alias("total_monetary"),
                int_avg("_f", "customer_count").alias("avg_frequency"),
                int_avg("_r", "customer_count").alias("avg_recency_days"))


def segment_shares(seg: DataFrame, person_col: str) -> DataFrame:
    """segment → customers and revenue with their shares of the total."""
    per = seg.groupBy("segment").agg(F.count(person_col).alias("customer_count"),
                                     F.sum("monetary").alias("_m"))
    tot = per.agg(F.sum("customer_count").alias("_tc"), F.sum("_m").alias("_tm"))  # one row
    return per.crossJoin(F.broadcast(tot)).select(
        "segment", "customer_count",
        ratio_round("customer_count", "_tc", scale=100).alias("pct_customers"),
        F.col("_m").cast("double").alias("total_revenue"),
        money_share("_m", "_tm").alias("pct_revenue"))


def one_time_revenue_share(rfm: DataFrame) -> DataFrame:
    """Share of revenue from persons with exactly one order."""
    agg = rfm.agg(F.sum(F.when(F.col("frequency") == 1, F.col("monetary"))).alias("_one"),
                  F.sum("monetary").alias("_all"))
    return agg.select(F.coalesce(F.col("_one"), F.lit(0)).cast("double").alias("one_time_revenue"),
                      F.col("_all").cast("double").alias("total_revenue"),
                      money_share(F.coalesce(F.col("_one"), F.lit(0).cast("decimal(12,2)")),
                                  "_all").alias("one_time_revenue_pct"))


def repeat_flag_summary(rfm: DataFrame, min_orders: int = 2) -> DataFrame:
    agg = rfm.agg(F.count(F.lit(1)).alias("total_customers"),
                  F.count_if(F.col("frequency") >= min_orders).alias("repeat_customers"))
    return agg.select("total_customers", "repeat_customers",
                      ratio_round("repeat_customers", "total_customers", 100).alias("repeat_pct"),
                      (F.col("total_customers") - F.col("repeat_customers"))
                      .alias("one_time_customers"),
                      ratio_round(F.col("total_customers") - F.col("repeat_customers"),
                                  "total_customers", 100).alias("one_time_pct"))


def score_distribution(scored: DataFrame, score_cols: Mapping[str, str]) -> DataFrame:
    """score_name, score, n_customers for several score columns at once."""
    stacked = scored.select(F.explode(F.array(*[
        F.struct(F.lit(name).alias("score_name"), F.col(c).cast("int").alias("score"))
        for name, c in score_cols.items()])).alias("s")).select("s.*")
    return stacked.groupBy("score_name", "score").agg(F.count(F.lit(1)).alias("n_customers"))


def describe_columns(df: DataFrame, cols: Mapping[str, str], digits: int = 2,
                     probs=(0.25, 0.5, 0.75)) -> DataFrame:
    """variable, count, mean, std, min, p25, p50, p75, max (pandas describe;
    exact quantiles; all rounded half-even to ``digits``)."""
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(name).alias("variable"), F.col(c).cast("double").alias("value"))
        for name, c in cols.items()])).alias("s")).select("s.*")
    return describe_long(long, "variable", "value", digits, probs, max_groups=len(cols))


def describe_long(long: DataFrame, by: str | None, value: str, digits: int = 2,
                  probs=(0.25, 0.5, 0.75), max_groups: int | None = None) -> DataFrame:
    keys = [by] if by else []
    src = materialize(long.filter(F.col(value).isNotNull()))  # stats + quantiles
    stats = src.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"),
                                   F.bround(F.avg(value), digits).alias("mean"),
                                   F.bround(F.stddev_samp(value), digits).alias("std"),
                                   F.bround(F.min(value), digits).alias("min"),
                                   F.bround(F.max(value), digits).alias("max"))
    qs = exact_quantiles(src, value, probs, by=keys, prefix="_q", materialized=True,
                         max_groups=max_groups)
    names = [f"p{int(round(p * 100))}" for p in probs]
    qs = qs.select(*keys, *[F.bround(F.col(f"_q{i}"), digits).alias(n)
                            for i, n in enumerate(names)])
    joined = stats.join(qs, keys, "left") if keys else stats.crossJoin(qs)
    return joined.select(*keys, "count", "mean", "std", "min", *names, "max")
