"""File readers and sinks (CSV with declared schema, Parquet)."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlens.functions.dates import TIMESTAMP_FORMAT, parse_timestamp
from churnlens.sources.schemas import SCHEMAS, TIMESTAMP_COLUMNS


# Tables whose quoted text may hold line breaks.
MULTILINE_TABLES = ("order_reviews",)


def read_csv_table(spark: SparkSession, path: str, table: str) -> DataFrame:
    """Read one source CSV with its declared schema; parse timestamp text.

    No schema inference (it would scan the data twice and guess types).
    Quotes inside quoted text are doubled; only the tables with free text
    (``MULTILINE_TABLES``) are read with line breaks inside quotes, since
    such a file cannot be split: convert it to Parquet once.  A row that does
    not fit the schema fails the job instead of shifting columns; bad
    timestamp text becomes null.
    """
    df = (spark.read.schema(SCHEMAS[table]).option("header", True)
          .option("quote", '"').option("escape", '"').option("mode", "FAILFAST")
          .option("multiLine", table in MULTILINE_TABLES).csv(path))
    ts_cols = set(TIMESTAMP_COLUMNS.get(table, ()))
    return df.select([parse_timestamp(c).alias(c) if c in ts_cols else F.col(c)
                      for c in df.columns])


def read_parquet_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Overwrite a Parquet dataset (replaces the drop-and-recreate idiom)."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def write_csv(df: DataFrame, path: str, timestamp_format: str | None = None) -> None:
    """Overwrite a CSV dataset with a header row; group labels are plain
    columns.  Quotes in text are doubled; an empty text is written as ``""``
    and a null as nothing, so that both come back.  ``timestamp_format``
    replaces Spark's own form of zone-free timestamps."""
    w = (df.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"')
         .option("escapeQuotes", True).option("emptyValue", '""').option("nullValue", ""))
    if timestamp_format:
        w = w.option("timestampNTZFormat", timestamp_format)
    w.csv(path)


def write_source_csvs(tables: Mapping[str, DataFrame], path: str) -> None:
    """Write source tables as CSV folders ``path/<table>.csv`` in the form that
    :func:`read_source_csvs` declares: its columns in its order, timestamps as
    source text."""
    for name, df in tables.items():
        write_csv(df.select(*SCHEMAS[name].names), f"{path}/{name}.csv", TIMESTAMP_FORMAT)


def read_source_csvs(spark: SparkSession, path: str, names: Iterable[str] = tuple(SCHEMAS)) -> dict[str, DataFrame]:
    """The source tables of a folder of CSV files, each with its declared schema."""
    return {name: read_csv_table(spark, f"{path}/{name}.csv", name) for name in names}
