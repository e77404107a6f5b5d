"""Repeat-purchase rates, purchase distributions, rate-by-dimension."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnlens.functions.rounding import ratio_round


def orders_per_person(orders: DataFrame, person_col: str, order_col: str | None,
                      out: str = "order_count") -> DataFrame:
    """person → number of distinct orders (``order_col=None``: number of rows).

    Distinct orders are counted as distinct (person, order) pairs first, so
    a person with very many rows is reduced map-side before any shuffle.
    """
    src = orders.filter(F.col(person_col).isNotNull())
    if order_col is None:
        return src.groupBy(person_col).agg(F.count(F.lit(1)).alias(out))
    pairs = src.filter(F.col(order_col).isNotNull()).select(person_col, order_col).distinct()
    return pairs.groupBy(person_col).agg(F.count(F.lit(1)).alias(out))


def repeat_rate(per_person: DataFrame, count_col: str = "order_count", min_orders: int = 2,
                mode: str = "half_up") -> DataFrame:
    """total_customers, repeat_customers, repeat_rate_pct (2 dp)."""
    return per_person.agg(F.count(F.lit(1)).alias("total_customers"),
                          F.count_if(F.col(count_col) >= min_orders).alias("repeat_customers")) \
        .withColumn("repeat_rate_pct", ratio_round("repeat_customers", "total_customers",
                                                   scale=100, digits=2, mode=mode))


def purchase_distribution(per_person: DataFrame, count_col: str = "order_count") -> DataFrame:
    """orders per person → persons with that many orders, and their share."""
    dist = per_person.groupBy(count_col).agg(F.count(F.lit(1)).alias("n_customers"))
    total = dist.agg(F.sum("n_customers").alias("_tot"))  # one row
    return (dist.crossJoin(F.broadcast(total))
            .withColumn("pct_customers", ratio_round("n_customers", "_tot", scale=100, digits=2))
            .drop("_tot").orderBy(count_col))


def top_k(df: DataFrame, k: int, order: Sequence[Column]) -> DataFrame:
    """The k first rows under a total order (planned as TakeOrderedAndProject)."""
    return df.orderBy(*order).limit(k)


def rate_by(df: DataFrame, dims: Sequence[str] | str, flag_col: str, person_col: str,
            min_n: int = 0, mode: str = "half_even", extra_aggs: Sequence[Column] = (),
            drop_null_dims: bool = True) -> DataFrame:
    """dims → total_customers, repeat_customers, repeat_rate_pct (+ extras).

    ``total_customers`` counts non-null persons (pandas named ``count``),
    ``repeat_customers`` sums the boolean/0-1 flag.
    """
    dims = [dims] if isinstance(dims, str) else list(dims)
    src = df
    if drop_null_dims:
        for d in dims:
            src = src.filter(F.col(d).isNotNull())
    agg = src.groupBy(*dims).agg(
        F.count(person_col).alias("total_customers"),
        F.coalesce(F.sum(F.col(flag_col).cast("int")), F.lit(0)).cast("long")
        .alias("repeat_customers"), *extra_aggs)
    if min_n:
        agg = agg.filter(F.col("total_customers") >= min_n)
    return agg.withColumn("repeat_rate_pct", ratio_round("repeat_customers", "total_customers",
                                                         scale=100, digits=2, mode=mode))


def extremes(rates: DataFrame, dim: str, low, high, value_col: str = "repeat_rate_pct",
             low_name: str = "low_pct", high_name: str = "high_pct",
             ratio: str = "high_over_low", ratio_digits: int = 2) -> DataFrame:
    """Pick two labelled rows of a small rate table and compare them.

    A conditional aggregate replaces label lookups (no collect)."""
    picked = rates.agg(F.max(F.when(F.col(dim) == F.lit(low), F.col(value_col))).alias(low_name),
                       F.max(F.when(F.col(dim) == F.lit(high), F.col(value_col))).alias(high_name))
    return picked.withColumn(ratio, F.bround(F.try_divide(F.col(high_name), F.col(low_name)),
                                             ratio_digits))
