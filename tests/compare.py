"""Spark-vs-DuckDB comparison used by the tests and by hand.

Mirrors the driver's check: same row count, same column names, and the
same multiset of rows after normalising values (floats rounded to 6
places, dates/timestamps as ISO text)."""

from __future__ import annotations

import datetime as dt
import decimal
import glob
import os

import duckdb


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in sorted(glob.glob(os.path.join(sf_dir, "*.parquet"))):
        name = os.path.basename(p)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 6) + 0.0
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
                 "date": "DATE", "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN"}


def type_mismatches(spark_df, description) -> list[str]:
    duck_types = {d[0]: str(d[1]) for d in description}
    out = []
    for name, t in spark_df.dtypes:
        want = SPARK_TO_DUCK.get(t, t)
        if duck_types.get(name) != want:
            out.append(f"{name}: spark {t} vs duckdb {duck_types.get(name)}")
    return out


def compare(spark_df, con, sql: str, check_types: bool = True) -> tuple[bool, str]:
    s_cols = spark_df.columns
    s_rows = [tuple(r) for r in spark_df.collect()]
    con.execute("CREATE OR REPLACE VIEW _oracle AS " + sql)  # an oracle must work as a view
    res = con.execute("SELECT * FROM _oracle")
    d_cols = [d[0] for d in res.description]
    d_rows = res.fetchall()
    if sorted(s_cols) != sorted(d_cols):
        return False, f"columns differ: spark={s_cols} duckdb={d_cols}"
    if check_types:
        bad = type_mismatches(spark_df, res.description)
        if bad:
            return False, "types differ: " + "; ".join(bad)
    if len(s_rows) != len(d_rows):
        return False, f"row count differs: spark={len(s_rows)} duckdb={len(d_rows)}"
    a, b = rows_of(s_cols, s_rows), rows_of(d_cols, d_rows)
    if a != b:
        diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
        return False, f"values differ, e.g. {diff}"
    return True, f"{len(s_rows)} rows"
