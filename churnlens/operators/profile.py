"""Profiling and data-quality operators.

Each returns a small DataFrame; counting happens in one aggregation pass
per table (no per-column jobs, nothing collected).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnlens.functions.rounding import ratio_round


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def table_shape(tables: Mapping[str, DataFrame]) -> DataFrame:
    """table_name, n_rows, n_cols for each named table."""
    return union_all([df.agg(F.count(F.lit(1)).alias("n_rows"))
                   .select(F.lit(name).alias("table_name"), "n_rows",
                           F.lit(len(df.columns)).alias("n_cols"))
                   for name, df in tables.items()])


def null_profile(df: DataFrame, table: str, cols: Sequence[str] | None = None,
                 only_missing: bool = True) -> DataFrame:
    """table_name, column_name, n_null, n_rows, pct_null (half-even, 2 dp).

    One pass: a null counter per column, then unpivot of the single row.
    """
    cols = list(cols or df.columns)
    wide = df.agg(F.count(F.lit(1)).alias("__rows"),
                  *[F.count_if(F.col(c).isNull()).alias(f"__n{i}") for i, c in enumerate(cols)])
    return null_rows(wide, table, cols, only_missing)


def null_rows(wide: DataFrame, table: str, cols: Sequence[str], only_missing: bool = True) -> DataFrame:
    """The rows of :func:`null_profile` from one row of counts: the number of
    rows, then the null cells of each of ``cols`` (columns by place)."""
    wide = wide.toDF("__rows", *[f"__n{i}" for i in range(len(cols))])
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"),
                                         F.col(f"__n{i}").alias("n_null"))
                                for i, c in enumerate(cols)]))
    out = wide.select(F.lit(table).alias("table_name"), F.col("__rows").alias("n_rows"),
                      pairs.alias("p")).select("table_name", "p.column_name", "p.n_null", "n_rows")
    if only_missing:
        out = out.filter(F.col("n_null") > 0)
    return out.withColumn("pct_null", ratio_round("n_null", "n_rows", scale=100, digits=2))


def duplicate_rows(df: DataFrame, table: str) -> DataFrame:
    """table_name, n_rows, n_duplicates (rows − distinct rows; nulls equal)."""
    per_row = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("__c"))
    return per_row.agg(F.coalesce(F.sum("__c"), F.lit(0)).cast("long").alias("n_rows"),
                       F.coalesce(F.sum(F.col("__c") - 1), F.lit(0)).cast("long")
                       .alias("n_duplicates")) \
        .select(F.lit(table).alias("table_name"), "n_rows", "n_duplicates")


def column_types(df: DataFrame, table: str) -> DataFrame:
    """table_name, position, column_name, data_type (schema as data; no job)."""
    spark = df.sparkSession
    rows = [(table, i, c, t) for i, (c, t) in enumerate(df.dtypes)]
    return spark.createDataFrame(rows, "table_name string, position int, column_name string, "
                                       "data_type string")


def key_uniqueness(df: DataFrame, id_col: str, person_col: str) -> DataFrame:
    """Total rows vs distinct order-level ids vs distinct persons.

    Two exact distinct counts are computed with one Expand-based
    aggregation (partial aggregation on each distinct key).
    """
    return df.agg(F.count(F.lit(1)).alias("n_rows"),
                  F.count_distinct(id_col).alias("n_ids"),
                  F.count_distinct(person_col).alias("n_persons")) \
        .withColumn("rows_minus_persons", F.col("n_rows") - F.col("n_persons"))


def entity_counts(df: DataFrame, cols: Mapping[str, str]) -> DataFrame:
    """Exact distinct counts, output name → column."""
    return df.agg(*[F.count_distinct(c).alias(name) for name, c in cols.items()])


def value_counts(df: DataFrame, cols: Sequence[str] | str, where: Column | None = None,
                 out: str = "n", digits: int = 2) -> DataFrame:
    """Frequency of each value (combination), nulls dropped, with share in %.

    Sorted by count descending, then value (a stable total order).
    """
    cols = [cols] if isinstance(cols, str) else list(cols)
    src = df if where is None else df.filter(where)
    for c in cols:
        src = src.filter(F.col(c).isNotNull())
    counts = src.groupBy(*cols).agg(F.count(F.lit(1)).alias(out))
    # the grand total is one row: bounded broadcast
    total = counts.agg(F.sum(out).alias("__tot"))
    return (counts.crossJoin(F.broadcast(total))
            .withColumn("pct", ratio_round(out, "__tot", scale=100, digits=digits))
            .drop("__tot").orderBy(F.col(out).desc(), *[F.col(c).asc() for c in cols]))


def date_range(df: DataFrame, col: str) -> DataFrame:
    return df.agg(F.min(col).alias("min_ts"), F.max(col).alias("max_ts"))


def revenue_totals(df: DataFrame, price_col: str = "price",
                   freight_col: str = "freight_value") -> DataFrame:
    """Exact decimal sums of price and freight and their total (as doubles)."""
    p = F.coalesce(F.sum(price_col), F.lit(0).cast("decimal(12,2)"))
    f = F.coalesce(F.sum(freight_col), F.lit(0).cast("decimal(12,2)"))
    return df.agg(p.alias("_p"), f.alias("_f")).select(
        F.col("_p").cast("double").alias("total_price"),
        F.col("_f").cast("double").alias("total_freight"),
        (F.col("_p") + F.col("_f")).cast("double").alias("grand_total"))


def preview(df: DataFrame, n: int = 3, order_cols: Sequence[str] | None = None) -> DataFrame:
    """First ``n`` rows; pass ``order_cols`` for a stable choice."""
    return (df.orderBy(*order_cols) if order_cols else df).limit(n)


def describe_by(df: DataFrame, col: str, by: str | None = None,
                probs: Sequence[float] = (0.25, 0.5, 0.75), digits: int = 2) -> DataFrame:
    """pandas ``describe`` of one column, optionally per group: count, mean,
    std (sample), min, exact linear quantiles ``p{100p}``, max; rounded
    half-even.  Groups with a null key are dropped."""
    from churnlens.operators.rfm import describe_long
    src = df.select(*([by] if by else []), F.col(col).cast("double").alias("value"))
    if by:
        src = src.filter(F.col(by).isNotNull())
    return describe_long(src, by, "value", digits, probs)
