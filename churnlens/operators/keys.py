"""Declared keys and references, and whole-row duplicates by narrow hashes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlens.operators.profile import union_all

#: Declared primary keys: table -> column.
PRIMARY_KEYS = {
    "customers": "customer_id", "orders": "order_id", "products": "product_id",
    "sellers": "seller_id", "category_translation": "product_category_name",
}
#: References: (table, column) -> the table whose primary key it names.
REFERENCES = {
    ("orders", "customer_id"): "customers", ("order_items", "order_id"): "orders",
    ("order_items", "product_id"): "products", ("order_items", "seller_id"): "sellers",
    ("order_payments", "order_id"): "orders", ("order_reviews", "order_id"): "orders",
    ("products", "product_category_name"): "category_translation",
}


def key_report(tables: Mapping[str, DataFrame], primary: Mapping[str, str] = PRIMARY_KEYS,
               references: Mapping[tuple[str, str], str] = REFERENCES) -> DataFrame:
    """table_name, key_column, refers_to, n_rows, n_null, n_distinct,
    n_duplicate_keys, n_orphans for every declared key and reference.

    Each table is read once: all its keys are stacked and reduced to one row
    a key value before anything is shuffled, so a hot key costs one row a
    task.  Orphans (rows whose non-null key has no row in the referenced
    table; null for columns that refer to nothing) come from joining the
    reduced values with the reduced primary keys.
    """
    columns: dict[str, list[str]] = {}
    for t, c in [*primary.items(), *references]:
        if c not in columns.setdefault(t, []):
            columns[t].append(c)
    stacked = union_all([
        tables[t].select(F.explode(F.array(*[
            F.struct(F.lit(c).alias("key_column"), F.col(c).cast("string").alias("v")) for c in cs])).alias("k"))
        .select(F.lit(t).alias("table_name"), "k.*") for t, cs in columns.items()])
    held = stacked.groupBy("table_name", "key_column", "v").agg(F.count(F.lit(1)).alias("c"))
    named = F.lit(None).cast("string")
    for (t, c), parent in references.items():
        named = F.when((F.col("table_name") == t) & (F.col("key_column") == c), F.lit(parent)).otherwise(named)
    is_primary = F.lit(False)
    for t, c in primary.items():
        is_primary = is_primary | ((F.col("table_name") == t) & (F.col("key_column") == c))
    parents = held.filter(is_primary & F.col("v").isNotNull()).select(
        F.col("table_name").alias("refers_to"), F.col("v").alias("pv"), F.lit(True).alias("known"))
    children = held.withColumn("refers_to", named)
    joined = children.join(parents, (children.refers_to == parents.refers_to) & (children.v == parents.pv), "left") \
        .select("table_name", "key_column", children.refers_to, "v", "c", "known")
    some = F.col("v").isNotNull()
    orphans = F.sum(F.when(some & F.col("known").isNull(), F.col("c")).otherwise(0))
    return joined.groupBy("table_name", "key_column", "refers_to").agg(
        F.sum("c").alias("n_rows"), F.sum(F.when(~some, F.col("c")).otherwise(0)).alias("n_null"),
        F.count("v").alias("n_distinct"), F.count_if(some & (F.col("c") > 1)).alias("n_duplicate_keys"),
        F.when(F.col("refers_to").isNotNull(), orphans).alias("n_orphans"))


def row_hash(columns: Sequence[str], bits: int = 128) -> list:
    """128 bits of a row in two longs (fewer ``bits`` for tests); the second
    also tells which columns are null."""
    nulls = [F.col(c).isNull() for c in columns]
    high, low = F.xxhash64(*columns), F.xxhash64(F.lit(1), *nulls, *columns)
    if bits < 64:
        return [F.lit(0).cast("long").alias("_h1"), F.pmod(low, F.lit(1 << bits)).alias("_h2")]
    return [high.alias("_h1"), low.alias("_h2")]


def duplicate_rows_by_hash(df: DataFrame, table: str, bits: int = 128) -> DataFrame:
    """table_name, n_rows, n_duplicates (rows - distinct rows; nulls equal).

    Only two longs a row are shuffled and counted; whole rows are compared
    only where a hash occurs more than once, so the result is exact whatever
    the hash does.
    """
    hashed = df.select("*", *row_hash(df.columns, bits))
    counts = hashed.groupBy("_h1", "_h2").agg(F.count(F.lit(1)).alias("_c"))
    total = counts.agg(F.coalesce(F.sum("_c"), F.lit(0)).cast("long").alias("n_rows"))
    met = counts.filter("_c > 1").select("_h1", "_h2")
    whole = hashed.join(met, ["_h1", "_h2"], "left_semi").groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
    again = whole.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("long").alias("n_duplicates"))
    # both are single rows
    return total.crossJoin(again).select(F.lit(table).alias("table_name"), "n_rows", "n_duplicates")
