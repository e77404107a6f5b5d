"""Denormalised item-level master table and its order-level collapse."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ORDER_COLS = ("order_id", "customer_id", "order_status", "order_purchase_timestamp",
              "order_approved_at", "order_delivered_carrier_date",
              "order_delivered_customer_date", "order_estimated_delivery_date")
CUSTOMER_COLS = ("customer_unique_id", "customer_zip_code_prefix", "customer_city",
                 "customer_state")
ITEM_COLS = ("order_item_id", "product_id", "seller_id", "shipping_limit_date", "price",
             "freight_value")
MASTER_COLS = (ORDER_COLS + CUSTOMER_COLS + ITEM_COLS
               + ("product_category_name", "product_category_name_english",
                  "review_score", "has_review"))


def review_summary(reviews: DataFrame, order_col: str = "order_id",
                   score_col: str = "review_score", id_col: str = "review_id") -> DataFrame:
    """One row per order: mean score (double) and number of reviews.

    Aggregating before the join keeps several reviews of one order from
    multiplying the order's item rows.
    """
    return (reviews.filter(F.col(order_col).isNotNull()).groupBy(order_col)
            .agg(F.avg(score_col).alias("review_score"),
                 F.count(id_col).alias("has_review")))


def master_table(orders: DataFrame, customers: DataFrame, items: DataFrame,
                 products: DataFrame, translation: DataFrame, reviews: DataFrame) -> DataFrame:
    """orders ⟕ customers ⟕ items ⟕ products(category) ⟕ translation ⟕ reviews.

    Every join is a left join from the order side, so orders without items
    stay (with null price).  Join strategy is left to AQE: dimension sides
    are broadcast once their runtime size is under the broadcast threshold,
    otherwise sort-merge; skewed partitions of the preserved (left) side are
    split by AQE's skew-join handling.
    """
    cust = customers.select("customer_id", *CUSTOMER_COLS)
    # Items get their category first (product-keyed joins), and the result
    # stays partitioned by order_id for the order collapse.
    # (Left joins re-associate here: the category joins only test item
    # columns, which are null for an order without items either way.)
    item = categorised_items(items, products, translation)
    # Customers come last here: the base then is hashed by customer_id, so
    # both sides of the item join are exchanged by order_id and AQE can split
    # an order that holds very many items on either side.
    base = (orders.select(*ORDER_COLS)
            .join(review_summary(reviews), "order_id", "left")
            .join(cust, "customer_id", "left"))
    return left_join_skew_safe(base, item, "order_id").select(*MASTER_COLS)


def categorised_items(items: DataFrame, products: DataFrame, translation: DataFrame) -> DataFrame:
    """Item rows with their category and its label.

    Lookups keyed by their primary key are stated as one row per key, so the
    optimizer drops these left joins from every plan that reads no category
    column (cohorts, RFM, rates): the item rows are then not shuffled by
    product at all."""
    prod = unique_by(products, "product_id", ["product_category_name"])
    trans = unique_by(translation, "product_category_name", ["product_category_name_english"])
    return (items.select("order_id", *ITEM_COLS)
            .join(prod, "product_id", "left")
            .join(trans, "product_category_name", "left"))


def master_nulls(orders: DataFrame, customers: DataFrame, items: DataFrame, products: DataFrame,
                 translation: DataFrame, reviews: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row: the master table's rows (``n_rows``) and the null cells of
    ``cols`` (named as they are), without building its item rows.

    Items are reduced to one row an order, map-side first, before they meet
    the orders: no order fans out, a hot order is one row, and the join's anti
    branch is not needed.  An order without items is one row whose item
    columns are null."""
    order_cols = [c for c in cols if c in (*ORDER_COLS, *CUSTOMER_COLS, "review_score", "has_review")]
    item_cols = [c for c in cols if c not in order_cols]
    per_order = (categorised_items(items, products, translation).filter(F.col("order_id").isNotNull())
                 .groupBy("order_id")
                 .agg(F.count(F.lit(1)).alias("_rows"),
                      *[F.count_if(F.col(c).isNull()).alias(f"_null_{c}") for c in item_cols]))
    base = (orders.select(*ORDER_COLS)
            .join(review_summary(reviews), "order_id", "left")
            .join(per_order, "order_id", "left")
            .join(customers.select("customer_id", *CUSTOMER_COLS), "customer_id", "left"))
    rows = F.coalesce("_rows", F.lit(1))
    nulls = {**{c: F.when(F.col(c).isNull(), rows).otherwise(0) for c in order_cols},
             **{c: F.coalesce(F.col(f"_null_{c}"), F.lit(1)) for c in item_cols}}
    return base.agg(F.coalesce(F.sum(rows), F.lit(0)).alias("n_rows"),
                    *[F.coalesce(F.sum(nulls[c]), F.lit(0)).alias(c) for c in cols])


def unique_by(df: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """A lookup table with one row per ``key`` (its primary key), written as
    an aggregate so that Catalyst knows the key is unique.  With a unique
    key the ``max`` of each column is that row's value.  The aggregate's
    output is hash-partitioned by ``key``, which is what a sort-merge join
    on ``key`` needs anyway."""
    return df.filter(F.col(key).isNotNull()).groupBy(key) \
        .agg(*[F.max(c).alias(c) for c in cols])


def left_join_skew_safe(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """``left ⟕ right`` on ``key`` written as inner join ∪ anti join.

    In an outer join AQE can split skewed partitions of the preserved side
    only; one order holding a third of all item rows would stay one task.
    The inner join can be split on both sides, and the anti join meets the
    right side's distinct keys (reduced map-side, so a hot key ships one
    row per task).  Filters that need a right-hand value (e.g. a price)
    remove the anti branch at planning time.
    """
    matched = left.join(right, key, "inner")
    keys = right.select(key).filter(F.col(key).isNotNull()).distinct()
    unmatched = left.join(keys, key, "left_anti").select(
        *[F.col(c) for c in left.columns],
        *[F.lit(None).cast(f.dataType).alias(f.name) for f in right.schema.fields
          if f.name != key])
    return matched.unionByName(unmatched)


def delivered(master: DataFrame, status_col: str = "order_status", status: str = "delivered",
              price_col: str = "price") -> DataFrame:
    """The analysis universe: delivered orders' priced item rows.

    Catalyst pushes the status test below the joins into the order scan and
    turns the item left join into an inner join (price is not null).
    """
    return master.filter((F.col(status_col) == status) & F.col(price_col).isNotNull())


def row_drop_report(before: DataFrame, keep: "F.Column") -> DataFrame:
    """Rows before and after a filter, and the difference, in one pass."""
    return before.agg(F.count(F.lit(1)).alias("rows_before"),
                      F.count_if(F.coalesce(keep, F.lit(False))).alias("rows_after")) \
        .withColumn("rows_dropped", F.col("rows_before") - F.col("rows_after"))


def collapse_orders(df: DataFrame, keys: Sequence[str] = ("order_id", "customer_unique_id",
                                                          "order_purchase_timestamp"),
                    value_col: str = "price", out: str = "order_value") -> DataFrame:
    """One row per order: the sum of its item values.  Rows with a null key
    are dropped (group-by semantics of the analysed notebooks)."""
    keep = F.lit(True)
    for k in keys:
        keep = keep & F.col(k).isNotNull()
    return df.filter(keep).groupBy(*keys).agg(F.sum(value_col).alias(out))
