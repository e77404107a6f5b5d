"""Distinct counts from mergeable sketches, stored by period.

``hll`` sketches give distinct counts of any union of periods with a relative
standard error of about ``1.04 / sqrt(2 ** lg)`` (1.6 % at lg 12).  ``theta``
sketches also intersect; they are exact up to ``2 ** lg`` distinct values and
have a relative error of about ``1 / sqrt(2 ** lg)`` beyond (of the union,
for an intersection).  Exact counts stay in ``profile.entity_counts``.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HLL_LG = 12
THETA_LG = 16


def period_sketches(df: DataFrame, period: str, entities: Mapping[str, str], person: str | None = None,
                    lg: int = HLL_LG, theta_lg: int = THETA_LG) -> DataFrame:
    """One row a period: an hll sketch for each entity (output name ->
    column) and, with ``person``, a theta sketch ``persons``.  One
    aggregation with partial sketches; null periods and values are left out."""
    aggs = [F.hll_sketch_agg(F.col(c).cast("string"), lg).alias(name) for name, c in entities.items()]
    if person:
        aggs.append(F.theta_sketch_agg(F.col(person).cast("string"), theta_lg).alias("persons"))
    return df.filter(F.col(period).isNotNull()).groupBy(period).agg(*aggs)


def union_counts(sketches: DataFrame, entities: Mapping[str, str]) -> DataFrame:
    """One row: the estimated distinct count of each entity over the given
    periods (filter ``sketches`` for a range)."""
    return sketches.agg(*[F.hll_sketch_estimate(F.hll_union_agg(name)).alias(name) for name in entities])


def shared_with_next(sketches: DataFrame, period: str, step) -> DataFrame:
    """period, persons, shared_with_next: persons of a period, and those of
    them who are also in the period ``step(period)`` (a column function), by
    intersecting two stored sketches."""
    later = sketches.select(F.col(period).alias("_next"), F.col("persons").alias("_later"))
    shared = F.theta_sketch_estimate(F.theta_intersection("persons", "_later"))
    return (sketches.withColumn("_next", step(F.col(period))).join(later, "_next", "left")
            .select(period, F.theta_sketch_estimate("persons").alias("persons"),
                    F.when(F.col("_later").isNotNull(), shared).otherwise(F.lit(0)).cast("long").alias("shared_with_next")))
