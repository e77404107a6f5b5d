"""Time to the k-th event of a person, and a product-limit survival curve."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from churnlens.functions.dates import elapsed_days


def time_to_kth(events: DataFrame, person: str, ts: str, order: str, snapshot: DataFrame, k: int = 2) -> DataFrame:
    """person, day, happened: whole days from a person's first event to the
    ``k``-th, or to the snapshot (one row) for those who have fewer.

    Events are ordered by time, then ``order``; null persons and times take
    no part.  The group limit keeps ``k`` rows a person and map task, so a
    person with very many events ships no more than that.
    """
    place = Window.partitionBy(person).orderBy(ts, order)
    first = (events.filter(F.col(person).isNotNull() & F.col(ts).isNotNull()).select(person, ts, order)
             .withColumn("_r", F.row_number().over(place)).filter(F.col("_r") <= k))
    per = first.groupBy(person).agg(F.min(ts).alias("_first"), F.max(F.when(F.col("_r") == k, F.col(ts))).alias("_kth"))
    # the snapshot is a single row: bounded broadcast
    return per.crossJoin(F.broadcast(snapshot)).withColumn("_end", F.coalesce("_kth", "snapshot")).select(
        person, elapsed_days("_first", "_end").alias("day"), F.col("_kth").isNotNull().alias("happened"))


def survival_curve(times: DataFrame, day: str = "day", happened: str = "happened", digits: int = 6) -> DataFrame:
    """day, at_risk, events, censored, survival: the product-limit estimate
    at every distinct time.  Persons censored at a time count as at risk
    there.  Rows are first reduced to one a day; the running sums are over
    that table."""
    per = times.filter(F.col(day).isNotNull()).groupBy(F.col(day).alias("day")).agg(
        F.count_if(F.col(happened)).alias("events"), F.count_if(~F.col(happened)).alias("censored"))
    onwards = Window.orderBy(F.desc("day")).rowsBetween(Window.unboundedPreceding, 0)
    so_far = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    risk = per.withColumn("at_risk", F.sum(F.col("events") + F.col("censored")).over(onwards))
    # a factor of zero ends the curve at zero
    factor = F.when(F.col("events") == F.col("at_risk"), F.lit(-1e9)).otherwise(F.ln(1 - F.col("events") / F.col("at_risk")))
    return risk.withColumn("_f", factor).select(
        "day", "at_risk", "events", "censored", F.round(F.exp(F.sum("_f").over(so_far)), digits).alias("survival"))
