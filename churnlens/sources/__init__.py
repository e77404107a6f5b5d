"""Readers, writers and the binding of the provided test tables."""

from churnlens.sources.files import (  # noqa: F401
    read_csv_table, read_parquet_table, write_csv, write_parquet,
)
from churnlens.sources.schemas import SCHEMAS, TIMESTAMP_COLUMNS  # noqa: F401
from churnlens.sources.testdata import TestTables  # noqa: F401
