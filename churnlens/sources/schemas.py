"""Declared schemas of the nine source tables.

Timestamps are declared as strings for CSV input and parsed with
``try_to_timestamp`` afterwards (unparsable text → null).  Money is exact
``decimal(10,2)``; bare sizes and coordinates are doubles.
"""

from __future__ import annotations

from pyspark.sql import types as T

S, I, D = T.StringType(), T.IntegerType(), T.DoubleType()
MONEY = T.DecimalType(10, 2)


def _schema(*fields) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


SCHEMAS: dict[str, T.StructType] = {
    "customers": _schema(
        ("customer_id", S), ("customer_unique_id", S), ("customer_zip_code_prefix", I),
        ("customer_city", S), ("customer_state", S)),
    "orders": _schema(
        ("order_id", S), ("customer_id", S), ("order_status", S),
        ("order_purchase_timestamp", S), ("order_approved_at", S),
        ("order_delivered_carrier_date", S), ("order_delivered_customer_date", S),
        ("order_estimated_delivery_date", S)),
    "order_items": _schema(
        ("order_id", S), ("order_item_id", I), ("product_id", S), ("seller_id", S),
        ("shipping_limit_date", S), ("price", MONEY), ("freight_value", MONEY)),
    "order_payments": _schema(
        ("order_id", S), ("payment_sequential", I), ("payment_type", S),
        ("payment_installments", I), ("payment_value", MONEY)),
    "order_reviews": _schema(
        ("review_id", S), ("order_id", S), ("review_score", I),
        ("review_comment_title", S), ("review_comment_message", S),
        ("review_creation_date", S), ("review_answer_timestamp", S)),
    "products": _schema(
        ("product_id", S), ("product_category_name", S),
        ("product_name_lenght", D), ("product_description_lenght", D),
        ("product_photos_qty", D), ("product_weight_g", D), ("product_length_cm", D),
        ("product_height_cm", D), ("product_width_cm", D)),
    "sellers": _schema(
        ("seller_id", S), ("seller_zip_code_prefix", I), ("seller_city", S),
        ("seller_state", S)),
    "geolocation": _schema(
        ("geolocation_zip_code_prefix", I), ("geolocation_lat", D), ("geolocation_lng", D),
        ("geolocation_city", S), ("geolocation_state", S)),
    "category_translation": _schema(
        ("product_category_name", S), ("product_category_name_english", S)),
}

TIMESTAMP_COLUMNS: dict[str, tuple[str, ...]] = {
    "orders": ("order_purchase_timestamp", "order_approved_at",
               "order_delivered_carrier_date", "order_delivered_customer_date",
               "order_estimated_delivery_date"),
    "order_items": ("shipping_limit_date",),
    "order_reviews": ("review_creation_date", "review_answer_timestamp"),
}

# Single-column primary keys declared by the source DDL (not enforced by
# Spark; checked with the key_uniqueness operator instead).
PRIMARY_KEYS = {
    "customers": "customer_id",
    "orders": "order_id",
    "products": "product_id",
    "sellers": "seller_id",
    "category_translation": "product_category_name",
}
