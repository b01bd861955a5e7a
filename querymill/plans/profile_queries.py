"""Profiles and integrity checks over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querymill.operators import profile as P
from querymill.plans.base import query, table


@query("""
SELECT 'o_orderkey' AS column_name, min(o_orderkey)::DOUBLE AS min_value, max(o_orderkey)::DOUBLE AS max_value, count(DISTINCT o_orderkey) AS n_distinct, count(*) AS n_rows,
       count(*) - count(o_orderkey) AS n_null, count(DISTINCT o_orderkey) = count(o_orderkey) AS is_unique FROM orders
UNION ALL SELECT 'o_custkey', min(o_custkey)::DOUBLE, max(o_custkey)::DOUBLE, count(DISTINCT o_custkey), count(*), count(*) - count(o_custkey), count(DISTINCT o_custkey) = count(o_custkey) FROM orders""")
def profile_keys(spark: SparkSession, d: str) -> DataFrame:
    return P.key_profile(table(spark, d, "orders"), ["o_orderkey", "o_custkey"])


@query("""
SELECT 'order_id' AS column_name, min(order_id)::DOUBLE AS min_value, max(order_id)::DOUBLE AS max_value, count(DISTINCT order_id) AS n_distinct, count(*) AS n_rows,
       count(*) - count(order_id) AS n_null, count(DISTINCT order_id) = count(order_id) AS is_unique FROM shop_orders
UNION ALL SELECT 'customer_id', min(customer_id)::DOUBLE, max(customer_id)::DOUBLE, count(DISTINCT customer_id), count(*), count(*) - count(customer_id), count(DISTINCT customer_id) = count(customer_id) FROM shop_orders""")
def profile_shop_keys(spark: SparkSession, d: str) -> DataFrame:
    return P.key_profile(table(spark, d, "shop_orders"), ["order_id", "customer_id"])


@query("SELECT customer_id AS missing_key, count(*) AS n_rows FROM shop_orders WHERE customer_id IS NOT NULL AND customer_id NOT IN (SELECT customer_id FROM customers) GROUP BY 1")
def fk_orphans(spark: SparkSession, d: str) -> DataFrame:
    return P.orphans(table(spark, d, "shop_orders"), "customer_id", table(spark, d, "customers"), "customer_id")


@query("SELECT c_custkey AS parent_key FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def parent_coverage(spark: SparkSession, d: str) -> DataFrame:
    return P.childless(table(spark, d, "customer"), "c_custkey", table(spark, d, "orders"), "o_custkey")


@query("SELECT count(*) AS n_shared FROM (SELECT DISTINCT customer_id FROM customers) c JOIN (SELECT DISTINCT item_id FROM items) i ON c.customer_id = i.item_id")
def key_domain_overlap(spark: SparkSession, d: str) -> DataFrame:
    return P.key_overlap(table(spark, d, "customers"), "customer_id", table(spark, d, "items"), "item_id")


@query("""
SELECT 'quantity out of range' AS rule, count(*) FILTER (WHERE quantity NOT BETWEEN 1 AND 10) AS n_rows FROM shop_orders
UNION ALL SELECT 'quantity missing', count(*) FILTER (WHERE quantity IS NULL) FROM shop_orders
UNION ALL SELECT 'status not lower case', count(*) FILTER (WHERE status <> lower(status)) FROM shop_orders
UNION ALL SELECT 'date invalid', count(*) FILTER (WHERE order_date IS NOT NULL AND (try_cast(order_date AS DATE) IS NULL OR strftime(try_cast(order_date AS DATE), '%Y-%m-%d') <> order_date)) FROM shop_orders""")
def range_violations(spark: SparkSession, d: str) -> DataFrame:
    day = F.col("order_date").try_cast("date")
    return P.rule_violations(table(spark, d, "shop_orders"), {
        "quantity out of range": ~F.col("quantity").between(1, 10),
        "quantity missing": F.col("quantity").isNull(),
        "status not lower case": F.col("status") != F.lower("status"),
        "date invalid": F.col("order_date").isNotNull() & (day.isNull() | (F.date_format(day, "yyyy-MM-dd") != F.col("order_date"))),
    })


@query("""
SELECT 'name upper case' AS rule, count(*) FILTER (WHERE item_name <> lower(item_name)) AS n_rows FROM items
UNION ALL SELECT 'name without blank', count(*) FILTER (WHERE strpos(item_name, ' ') = 0) FROM items
UNION ALL SELECT 'price not two decimals', count(*) FILTER (WHERE abs(price - round(price, 2)) > 1e-9) FROM items""")
def text_case_violations(spark: SparkSession, d: str) -> DataFrame:
    return P.rule_violations(table(spark, d, "items"), {
        "name upper case": F.col("item_name") != F.lower("item_name"),
        "name without blank": F.instr("item_name", " ") == 0,
        "price not two decimals": F.abs(F.col("price") - F.round("price", 2)) > 1e-9,
    })


@query("""
WITH domain AS (SELECT unnest(['basic', 'plus', 'prime', 'elite', 'staff']) AS value),
seen AS (SELECT membership AS value, count(*) AS n FROM customers GROUP BY 1)
SELECT coalesce(s.value, w.value) AS value, coalesce(n, 0) AS n_rows, w.value IS NOT NULL AS expected, coalesce(n, 0) >= 20 AS reaches_floor
FROM seen s FULL JOIN domain w ON s.value = w.value""")
def profile_domain_histogram(spark: SparkSession, d: str) -> DataFrame:
    domain = spark.createDataFrame([(v,) for v in ("basic", "plus", "prime", "elite", "staff")], "value string")
    return P.domain_histogram(table(spark, d, "customers"), "membership", domain, 20)


@query("SELECT count(*) AS n_items, count(*) FILTER (WHERE stock = 0) AS n_sold_out, round(avg(price), 2) AS mean_price FROM items")
def conditional_summary(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "items").agg(F.count(F.lit(1)).alias("n_items"), F.count_if(F.col("stock") == 0).alias("n_sold_out"), F.round(F.avg("price"), 2).alias("mean_price"))


@query("""
WITH long AS (SELECT 'city' AS column_name, city AS value FROM customers UNION ALL SELECT 'name', name FROM customers UNION ALL SELECT 'customer_id', customer_id::VARCHAR FROM customers)
SELECT column_name, count(DISTINCT value) AS n_values, count(DISTINCT value) * 5 AS n_queries FROM long
WHERE NOT (column_name = 'customer_id' AND value::VARCHAR IN (SELECT customer_id::VARCHAR FROM customers WHERE customer_id % 10 = 0)) GROUP BY 1""")
def query_space_size(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customers")
    banned = c.where("customer_id % 10 = 0").select(F.lit("customer_id").alias("column_name"), F.col("customer_id").cast("string").alias("value"))
    return P.query_space(c, ["city", "name", "customer_id"], banned, 5)


@query("SELECT count(*) AS n_bad FROM items WHERE price <> CAST(printf('%.2f', price) AS DOUBLE)")
def price_literal_equality(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "items").where(F.col("price") != F.format_string("%.2f", F.col("price")).cast("double")).agg(F.count(F.lit(1)).alias("n_bad"))


@query()
def content_hash(spark: SparkSession, d: str) -> DataFrame:
    """Hash of the whole order table, whatever the order of its rows."""
    return P.content_hash(table(spark, d, "shop_orders"))


@query()
def ordered_digest(spark: SparkSession, d: str) -> DataFrame:
    return P.ordered_digest(table(spark, d, "customers"), "customer_id", ["customer_id", "name", "city", "membership"])


@query("""
SELECT DISTINCT value FROM (
  SELECT lower(name) AS value FROM customers UNION ALL SELECT lower(city) FROM customers UNION ALL SELECT lower(membership) FROM customers
  UNION ALL SELECT lower(item_name) FROM items UNION ALL SELECT lower(category) FROM items UNION ALL SELECT lower(status) FROM shop_orders) WHERE value IS NOT NULL""")
def protected_catalog_values(spark: SparkSession, d: str) -> DataFrame:
    sources = (("customers", ("name", "city", "membership")), ("items", ("item_name", "category")), ("shop_orders", ("status",)))
    out = None
    for t, columns in sources:
        df = table(spark, d, t)
        part = df.select(F.explode(F.array(*[F.lower(c) for c in columns])).alias("value"))
        out = part if out is None else out.unionByName(part)
    return out.where("value is not null").distinct()


@query("""
SELECT table_name, column_name FROM (VALUES ('customers','customer_id'),('customers','name'),('customers','city'),('customers','membership'),
('items','item_id'),('items','item_name'),('items','category'),('items','price'),('items','stock')) t(table_name, column_name)""")
def catalog_columns(spark: SparkSession, d: str) -> DataFrame:
    """Tables and columns as the files declare them."""
    rows = [(t, c) for t in ("customers", "items") for c in table(spark, d, t).columns]
    return spark.createDataFrame(rows, "table_name string, column_name string")
