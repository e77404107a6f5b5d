"""Cohort activity kept up to date from a stream of purchases.

A person's cohort is the minimum of all their purchase months, which a
late, out-of-order event can still lower.  So the stream does not assign
cohorts; it only appends the (person, period) pairs:

* ``person_month_pairs``: a streaming projection without state;
* the pairs are appended to a Parquet table (exactly-once file sink with
  its own checkpoint);
* ``activity_from_pairs``: the batch cohort operator over that table, so
  repeated pairs are dropped and cohorts computed from every pair seen.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlens.functions.dates import month_start
from churnlens.operators import cohort
from churnlens.session import ensure_checkpoint_dir


def person_month_pairs(stream: DataFrame, person_col: str, ts_col: str, grain: str = "month") -> DataFrame:
    """Streaming: (person, purchase month or week) pairs."""
    start = month_start(ts_col) if grain == "month" else F.to_date(F.date_trunc("week", F.col(ts_col)))
    return (stream.filter(F.col(person_col).isNotNull() & F.col(ts_col).isNotNull())
            .select(F.col(person_col).alias("person"), start.alias("order_month")))


def run_pairs_available_now(spark: SparkSession, stream: DataFrame, person_col: str,
                            ts_col: str, table_path: str | None = None, grain: str = "month") -> str:
    """Process everything currently available in ``stream`` into the pair
    table and stop (``availableNow`` trigger).  The table and the stream's
    checkpoint live under the shared checkpoint folder unless a path is
    given.  Returns the table path."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = table_path or f"{base}/cohort-pairs-{uuid.uuid4().hex}"
    q = (person_month_pairs(stream, person_col, ts_col, grain).writeStream
         .format("parquet").outputMode("append")
         .option("path", f"{path}/data").option("checkpointLocation", f"{path}/_checkpoint")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return path


def activity_from_pairs(spark: SparkSession, path: str, grain: str = "month") -> DataFrame:
    """(cohort_month, month_index) → active_customers from the pair table."""
    pairs = spark.read.parquet(f"{path}/data")
    pm = cohort.person_months(pairs, "person", "order_month", grain=grain)
    return cohort.cohort_activity(pm)
