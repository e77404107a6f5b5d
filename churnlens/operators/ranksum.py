"""Rank-sum comparison of two groups with tie-corrected midranks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from churnlens.operators.ranking import _num_partitions
from churnlens.session import materialize


def running_counts(counts: DataFrame, value: str, cols: list[str], num_partitions: int | None = None) -> DataFrame:
    """``counts`` (one row a distinct value) and ``below``: the sum of
    ``cols[0]`` over all smaller values.  Values are range-partitioned, each
    partition adds up its own rows and the totals of the partitions before
    (one row each) are the offsets: no single-partition step."""
    ranged = materialize(counts.repartitionByRange(_num_partitions(counts, num_partitions), value)
                         .withColumn("_pid", F.spark_partition_id()))
    own = Window.partitionBy("_pid").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("_pid").agg(F.sum(cols[0]).alias("_n")).select(
        "_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    return (ranged.withColumn("_in", F.coalesce(F.sum(cols[0]).over(own), F.lit(0))).join(offsets, "_pid")
            .select(value, *cols, (F.col("_in") + F.col("_off")).alias("below")))


def rank_sum(df: DataFrame, value: str, flag: str, digits: int = 6, num_partitions: int | None = None) -> DataFrame:
    """One row: n_true, n_false, u (of the true group), z (tie-corrected,
    normal approximation), and the share of positive values by group in
    percent.  Rows with a null value or flag take no part; z is null where a
    group is empty or all values are equal.

    Rows are reduced to one a distinct value; ranks are sums of counts, exact
    in integers."""
    counts = (df.filter(F.col(value).isNotNull() & F.col(flag).isNotNull()).groupBy(F.col(value).alias("v"))
              .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(flag)).alias("t")))
    ranked = running_counts(counts, "v", ["n", "t"], num_partitions)
    wide = "decimal(38,0)"
    n, t = F.col("n").cast(wide), F.col("t").cast(wide)
    late = F.col("v") > 0
    sums = ranked.agg(
        F.coalesce(F.sum("t"), F.lit(0)).alias("n_true"), F.coalesce(F.sum(F.col("n") - F.col("t")), F.lit(0)).alias("n_false"),
        # twice the rank sum: a value's midrank is below + (n + 1) / 2
        F.sum((F.col("t") * (2 * F.col("below") + F.col("n") + 1)).cast(wide)).alias("r2"),
        F.sum(F.col("n").cast("double") * F.col("n") * F.col("n") - F.col("n")).alias("ties"),
        F.sum(F.when(late, F.col("t")).otherwise(0)).alias("late_t"),
        F.sum(F.when(late, F.col("n") - F.col("t")).otherwise(0)).alias("late_f"))
    a, b = F.col("n_true").cast("double"), F.col("n_false").cast("double")
    total = a + b
    u = (F.col("r2") - F.col("n_true") * (F.col("n_true") + 1)).cast("double") / 2
    spread = a * b / 12 * (total + 1 - F.try_divide(F.col("ties"), total * (total - 1)))
    return sums.select(
        F.col("n_true"), F.col("n_false"), u.alias("u"),
        F.round(F.when(spread > 0, (u - a * b / 2) / F.sqrt(spread)), digits).alias("z"),
        F.round(F.try_divide(F.col("late_t") * 100.0, a), digits).alias("positive_pct_true"),
        F.round(F.try_divide(F.col("late_f") * 100.0, b), digits).alias("positive_pct_false"))
