"""Binding of the provided TPC-H-like test tables to the nine logical tables.

The operators only ever see the logical tables (same column names as the
source CSVs).  This adapter derives them lazily from ``{sf_dir}/*.parquet``;
nothing is collected, every derived table grows with the input.

Binding rules (kept in step with ``churnlens.plans.oracle.BINDING_SQL``):

* customers: one row per order; ``customer_id`` = order key as text (the
  order-level id), ``customer_unique_id`` = customer key (the person);
  city/state = nation/region name of the customer.
* orders: status F/O/P → delivered/shipped/processing; purchase time =
  order date; delivered = last ship date of the order's lines (null when
  before the order date or when the order has no lines); estimated =
  order date + 5 × priority digit days.
* order_items: one row per line; price = extended price as decimal(12,2);
  freight = price × tax rounded to cents.
* order_reviews: every line of an order carries a review of score
  1 + floor((quantity - 1) / 10); title and message come from the return
  flag and line status, the answer follows the review by a day.
* products: category = part type, missing when the part size is 1; the
  lengths and sizes come from name, type and size of the part.
* category_translation: fixed lower-case labels; PROMO has none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Category label table (source name → English label).
CATEGORY_LABELS = (
    ("ECONOMY", "economy"),
    ("LARGE", "large"),
    ("MEDIUM", "medium"),
    ("SMALL", "small"),
    ("STANDARD", "standard"),
)

# Declared schemas of the raw test tables: reading with a schema skips the
# footer-inference job that ``spark.read.parquet`` otherwise runs per table.
RAW_SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
                "c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
            "p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
                "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
                "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
              "value double, props string",
}

# Days added to the order date per priority digit 1..5.
ESTIMATE_DAYS_PER_PRIORITY = 5


def _status(code):
    """Status code → label, nested so that ``label = 'x'`` folds back into
    ``code = 'y'`` and reaches the Parquet scan as a pushed filter."""
    return F.when(code == "F", "delivered").otherwise(
        F.when(code == "O", "shipped").otherwise("processing"))


class TestTables:
    """Lazy logical tables over one test-data folder."""

    __test__ = False  # not a pytest class

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self._raw: dict[str, DataFrame] = {}

    def raw(self, name: str) -> DataFrame:
        """One relation per file, shared by this object's logical tables."""
        if name not in self._raw:
            reader = self.spark.read
            if name in RAW_SCHEMAS:
                reader = reader.schema(RAW_SCHEMAS[name])
            self._raw[name] = reader.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._raw[name]

    # -- logical tables -------------------------------------------------
    def customers(self) -> DataFrame:
        o = self.raw("orders").select("o_orderkey", "o_custkey")
        c = self.raw("customer").select("c_custkey", "c_nationkey")
        n = self.raw("nation").select("n_nationkey", "n_name", "n_regionkey")
        r = self.raw("region").select("r_regionkey", "r_name")
        # nation and region have 25 and 5 rows by definition: broadcast is bounded
        return (o.join(c, o.o_custkey == c.c_custkey, "left")
                .join(F.broadcast(n), F.col("c_nationkey") == n.n_nationkey, "left")
                .join(F.broadcast(r), F.col("n_regionkey") == r.r_regionkey, "left")
                .select(F.col("o_orderkey").cast("string").alias("customer_id"),
                        F.col("o_custkey").alias("customer_unique_id"),
                        F.col("c_nationkey").alias("customer_zip_code_prefix"),
                        F.col("n_name").alias("customer_city"),
                        F.col("r_name").alias("customer_state")))

    def orders(self) -> DataFrame:
        o = self.raw("orders").select("o_orderkey", "o_orderstatus", "o_orderdate",
                                      "o_orderpriority")
        ship = (self.raw("lineitem").groupBy("l_orderkey")
                .agg(F.min("l_shipdate").alias("first_ship"),
                     F.max("l_shipdate").alias("last_ship")))
        ts = F.col("o_orderdate")
        prio = F.substring("o_orderpriority", 1, 1).cast("int")
        return (o.join(ship, o.o_orderkey == ship.l_orderkey, "left")
                .select(F.col("o_orderkey").alias("order_id"),
                        F.col("o_orderkey").cast("string").alias("customer_id"),
                        _status(F.col("o_orderstatus")).alias("order_status"),
                        ts.alias("order_purchase_timestamp"),
                        ts.alias("order_approved_at"),
                        F.when(F.col("first_ship") >= ts, F.col("first_ship"))
                         .alias("order_delivered_carrier_date"),
                        F.when(F.col("last_ship") >= ts, F.col("last_ship"))
                         .alias("order_delivered_customer_date"),
                        F.timestamp_add("DAY", prio * ESTIMATE_DAYS_PER_PRIORITY, ts)
                         .alias("order_estimated_delivery_date")))

    def order_items(self) -> DataFrame:
        price = F.col("l_extendedprice").cast("decimal(12,2)")
        return self.raw("lineitem").select(
            F.col("l_orderkey").alias("order_id"),
            F.col("l_linenumber").alias("order_item_id"),
            F.col("l_partkey").alias("product_id"),
            F.col("l_suppkey").alias("seller_id"),
            F.col("l_shipdate").alias("shipping_limit_date"),
            price.alias("price"),
            F.round(price * F.col("l_tax").cast("decimal(4,2)"), 2)
             .cast("decimal(12,2)").alias("freight_value"))

    def order_reviews(self) -> DataFrame:
        return self.raw("lineitem").select(
            F.concat_ws("-", F.col("l_orderkey").cast("string"),
                        F.col("l_linenumber").cast("string")).alias("review_id"),
            F.col("l_orderkey").alias("order_id"),
            (F.floor((F.col("l_quantity") - 1) / 10) + 1).cast("int").alias("review_score"),
            F.when(F.col("l_returnflag") == "R", F.col("l_linestatus")).alias("review_comment_title"),
            F.when(F.col("l_linestatus") == "F", F.concat("l_returnflag", F.lit("-"), "l_linestatus"))
             .alias("review_comment_message"),
            F.col("l_shipdate").alias("review_creation_date"),
            F.timestamp_add("DAY", F.lit(1), F.col("l_shipdate")).alias("review_answer_timestamp"))

    def products(self) -> DataFrame:
        return self.raw("part").select(
            F.col("p_partkey").alias("product_id"),
            F.when(F.col("p_size") != 1, F.col("p_type")).alias("product_category_name"),
            F.length("p_name").cast("double").alias("product_name_lenght"),
            F.length("p_type").cast("double").alias("product_description_lenght"),
            (F.col("p_size") % 6).cast("double").alias("product_photos_qty"),
            F.col("p_retailprice").alias("product_weight_g"),
            F.col("p_size").cast("double").alias("product_length_cm"),
            (F.col("p_size") / 2).cast("double").alias("product_height_cm"),
            F.when(F.col("p_size") % 7 != 0, F.col("p_size").cast("double")).alias("product_width_cm"))

    def category_translation(self) -> DataFrame:
        # a literal VALUES relation: its size is known to the planner, and it
        # is a fixed five-row table, so broadcasting it is bounded
        rows = ", ".join(f"('{a}', '{b}')" for a, b in CATEGORY_LABELS)
        return F.broadcast(self.spark.sql(
            f"SELECT * FROM VALUES {rows} "
            "AS t(product_category_name, product_category_name_english)"))

    def sellers(self) -> DataFrame:
        s = self.raw("supplier").select("s_suppkey", "s_nationkey")
        n = self.raw("nation").select("n_nationkey", "n_name", "n_regionkey")
        r = self.raw("region").select("r_regionkey", "r_name")
        return (s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey, "left")
                .join(F.broadcast(r), F.col("n_regionkey") == r.r_regionkey, "left")
                .select(F.col("s_suppkey").alias("seller_id"),
                        F.col("s_nationkey").alias("seller_zip_code_prefix"),
                        F.col("n_name").alias("seller_city"),
                        F.col("r_name").alias("seller_state")))

    def order_payments(self) -> DataFrame:
        prio = F.substring("o_orderpriority", 1, 1).cast("int")
        return self.raw("orders").select(
            F.col("o_orderkey").alias("order_id"),
            F.lit(1).alias("payment_sequential"),
            F.when(prio <= 2, "credit_card").otherwise("boleto").alias("payment_type"),
            prio.alias("payment_installments"),
            F.col("o_totalprice").cast("decimal(12,2)").alias("payment_value"))

    def geolocation(self) -> DataFrame:
        c = self.raw("customer").select("c_nationkey")
        n = self.raw("nation").select("n_nationkey", "n_name", "n_regionkey")
        r = self.raw("region").select("r_regionkey", "r_name")
        # one row per customer → many exact duplicates, like the source table
        return (c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey, "left")
                .join(F.broadcast(r), F.col("n_regionkey") == r.r_regionkey, "left")
                .select(F.col("c_nationkey").alias("geolocation_zip_code_prefix"),
                        F.col("n_nationkey").cast("double").alias("geolocation_lat"),
                        F.col("n_regionkey").cast("double").alias("geolocation_lng"),
                        F.col("n_name").alias("geolocation_city"),
                        F.col("r_name").alias("geolocation_state")))

    TABLES = ("customers", "geolocation", "order_items", "order_payments", "order_reviews",
              "orders", "products", "sellers", "category_translation")

    def table(self, name: str) -> DataFrame:
        return getattr(self, name)()

    def all(self) -> dict[str, DataFrame]:
        return {t: self.table(t) for t in self.TABLES}
