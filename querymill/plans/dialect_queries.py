"""Statements of the dialect, compiled to DataFrames, beside the same statements in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querymill.dialect.catalog import SHOP, STAR
from querymill.dialect.compiler import run, widened
from querymill.dialect.statement import parse
from querymill.functions.sqlkey import sql_key
from querymill.plans.base import query, table
from querymill.session import spread

#: name -> (catalog, statement, SQL; {same} where only the table's file name and alias differ)
STATEMENTS = {
    "flat_eq": (SHOP, "SELECT name FROM customers WHERE city = 'hoofom'", None),
    "flat_eq_id": (SHOP, "SELECT item_name FROM items WHERE item_id = 3100", None),
    "flat_ne": (SHOP, "SELECT customer_id FROM customers WHERE membership != 'basic'", None),
    "flat_range": (SHOP, "SELECT item_id FROM items WHERE price >= 50.00", None),
    "flat_float_eq": (SHOP, "SELECT item_id FROM items WHERE stock = 0", None),
    "flat_between": (SHOP, "SELECT item_name FROM items WHERE price BETWEEN 20.00 AND 40.00", None),
    "flat_date_between": (STAR, "SELECT o_custkey FROM orders WHERE o_orderdate BETWEEN '1996-01-01' AND '1996-06-30'", None),
    "flat_in": (STAR, "SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')", None),
    "flat_like_prefix": (STAR, "SELECT p_partkey FROM part WHERE p_name LIKE 'red%'", None),
    "flat_like_suffix": (STAR, "SELECT p_partkey FROM part WHERE p_name LIKE '%widget'", None),
    "flat_like_contains": (SHOP, "SELECT item_name FROM items WHERE item_name LIKE '%oo%'", None),
    "flat_and3": (STAR, "SELECT l_partkey FROM lineitem WHERE l_discount >= 0.05 AND l_returnflag = 'R' AND l_shipdate >= '1996-01-01'", None),
    "flat_or": (SHOP, "SELECT item_id FROM items WHERE price < 5.00 OR stock = 0", None),
    "flat_or3": (SHOP, "SELECT item_name FROM items WHERE category = 'lighting' OR price < 10.00 OR stock > 95", None),
    "flat_star": (SHOP, "SELECT * FROM customers WHERE city = 'hoofom' AND membership = 'plus'", None),
    "flat_exists": (SHOP, "SELECT status FROM orders WHERE status = 'open'", None),
    "flat_missing_key": (SHOP, "SELECT name FROM customers WHERE customer_id = 999999", None),
    "order_no_limit": (STAR, "SELECT p_name FROM part WHERE p_size < 5 ORDER BY p_retailprice DESC, p_partkey ASC", None),
    "topk_tiebreak": (STAR, "SELECT p_partkey FROM part WHERE p_size >= 10 ORDER BY p_retailprice DESC, p_partkey ASC LIMIT 10", None),
    "topk_limit1": (SHOP, "SELECT item_name FROM items ORDER BY price ASC, item_id ASC LIMIT 1", None),
    "agg_count": (STAR, "SELECT COUNT(*) FROM lineitem WHERE l_returnflag = 'A'", None),
    "agg_sum": (SHOP, "SELECT SUM(quantity) FROM orders WHERE status = 'open'", None),
    "agg_avg": (STAR, "SELECT AVG(l_extendedprice) FROM lineitem", None),
    "agg_min": (SHOP, "SELECT MIN(price) FROM items WHERE stock > 10", None),
    "agg_max": (STAR, "SELECT MAX(o_totalprice) FROM orders WHERE o_orderstatus = 'F'", None),
    "agg_date_min": (SHOP, "SELECT MIN(order_date) FROM orders", None),
    "agg_date_max": (SHOP, "SELECT MAX(order_date) FROM orders WHERE quantity > 5", None),
    "agg_empty_is_null": (SHOP, "SELECT SUM(stock) FROM items WHERE price > 100000.00", None),
    "agg_empty_count_zero": (SHOP, "SELECT COUNT(*) FROM items WHERE price > 100000.00", None),
    "group_count": (SHOP, "SELECT city, COUNT(*) FROM customers GROUP BY city", None),
    "group_avg": (STAR, "SELECT p_brand, AVG(p_retailprice) FROM part GROUP BY p_brand", None),
    "group_filtered_sum": (STAR, "SELECT o_custkey, SUM(o_totalprice) FROM orders WHERE o_orderstatus = 'O' AND o_orderdate >= '1997-01-01' GROUP BY o_custkey", None),
    "group_date": (SHOP, "SELECT order_date, COUNT(*) FROM orders GROUP BY order_date", None),
    "group_having": (SHOP, "SELECT customer_id, SUM(quantity) FROM orders GROUP BY customer_id HAVING SUM(quantity) > 30", None),
    "group_having_topk": (STAR, "SELECT l_suppkey, SUM(l_quantity) FROM lineitem WHERE l_shipdate >= '1996-01-01' GROUP BY l_suppkey HAVING SUM(l_quantity) > 100 ORDER BY SUM(l_quantity) DESC, l_suppkey ASC LIMIT 5", None),
    "group_topk_count": (SHOP, "SELECT item_id, COUNT(*) FROM orders GROUP BY item_id ORDER BY COUNT(*) DESC, item_id ASC LIMIT 10", None),
    "subq_avg": (SHOP, "SELECT item_name FROM items WHERE price > (SELECT AVG(price) FROM items)", None),
    "subq_max_ties": (SHOP, "SELECT item_id FROM items WHERE stock = (SELECT MAX(stock) FROM items)", None),
    "subq_filtered_inner_outer": (STAR, "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal >= (SELECT AVG(c_acctbal) FROM customer WHERE c_mktsegment = 'MACHINERY')", None),
}


def oracle(catalog, text: str) -> str:
    """The same statement for SQL over the files, with the aggregate's column named value."""
    s = parse(text)
    sql = s.render(catalog).replace(f"FROM {s.table}", f"FROM {catalog.tables[s.table].source}")
    if s.aggregate:
        head, _, tail = sql.partition(" FROM ")
        value = f"CAST({s.aggregate} AS BIGINT)" if s.aggregate.function == "SUM" and s.aggregate.column not in catalog.tables[s.table].floats else str(s.aggregate)
        sql = head.replace(str(s.aggregate), f"{value} AS value") + " FROM " + tail
        if s.aggregate.function in ("SUM", "AVG") and (s.aggregate.function == "AVG" or s.aggregate.column in catalog.tables[s.table].floats):
            columns = f"{s.group}, " if s.group else ""
            sql = f"SELECT {columns}round(value, 4) AS value FROM ({sql})"
    return sql


def _add(name: str, catalog, text: str) -> None:
    s = parse(text)
    floating = s.aggregate and (s.aggregate.function == "AVG" or s.aggregate.function == "SUM" and s.aggregate.column in catalog.tables[s.table].floats)

    def f(spark: SparkSession, d: str) -> DataFrame:
        df = run(spark, text, catalog, d)
        return df.withColumn("value", F.round("value", 4)) if floating else df

    query(oracle(catalog, text), name)(f)


for _name, (_catalog, _text, _) in STATEMENTS.items():
    _add(_name, _catalog, _text)

FLAGSHIP = "SELECT l_returnflag, SUM(l_quantity) FROM lineitem WHERE l_shipdate >= '1996-01-01' GROUP BY l_returnflag HAVING SUM(l_quantity) > 100 ORDER BY SUM(l_quantity) DESC, l_returnflag ASC LIMIT 3"


@query(oracle(STAR, FLAGSHIP))
def flagship_top_groups(spark: SparkSession, d: str) -> DataFrame:
    return run(spark, FLAGSHIP, STAR, d).withColumn("value", F.round("value", 4))


@query("SELECT * FROM items WHERE price > (SELECT AVG(price) FROM items)")
def projection_widened(spark: SparkSession, d: str) -> DataFrame:
    """The rows that a projection reads."""
    return run(spark, widened(parse("SELECT item_name FROM items WHERE price > (SELECT AVG(price) FROM items)")).render(SHOP), SHOP, d)


@query("SELECT count(*) AS n_records, count(*) FILTER (WHERE sql IS NOT NULL) AS n_with_sql, count(DISTINCT sql) AS n_statements FROM query_records")
def statement_keys_of_records(spark: SparkSession, d: str) -> DataFrame:
    """Canonical records have one key each."""
    q = table(spark, d, "query_records").select("sql", sql_key(F.col("sql")).alias("key"))
    return q.agg(F.count(F.lit(1)).alias("n_records"), F.count("sql").alias("n_with_sql"), F.countDistinct("key").alias("n_statements"))


@query()
def statement_keys_of_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Records by canonical statement over all pairs, however the statement is written."""
    p = spread(table(spark, d, "pairs").select("sql")).select(sql_key(F.col("sql")).alias("sql_key"))
    return p.groupBy("sql_key").agg(F.count(F.lit(1)).alias("n_records"))
