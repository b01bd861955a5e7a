"""Round trips, rejections and levels of the dialect, and its compiler on a tiny table."""

import pytest
from pyspark.sql import functions as F

from querymill.dialect.catalog import SHOP
from querymill.dialect.compiler import compile_statement, run
from querymill.dialect.rules import is_iso_date, violations
from querymill.dialect.statement import DialectError, from_record, identity, like_mode, parse
from querymill.functions.sqlkey import sql_key

GOOD = [
    "SELECT * FROM customers",
    "SELECT name FROM customers WHERE city = 'rome'",
    "SELECT item_name FROM items WHERE price BETWEEN 10.00 AND 20.50 AND stock >= 5",
    "SELECT customer_id FROM customers WHERE city IN ('paris', 'rome') AND membership != 'gold'",
    "SELECT item_id FROM items WHERE item_name LIKE '%oo%' OR price < 5.00",
    "SELECT item_name FROM items ORDER BY price DESC, item_id ASC LIMIT 3",
    "SELECT COUNT(*) FROM orders WHERE order_date >= '2025-01-01'",
    "SELECT MIN(order_date) FROM orders",
    "SELECT status, SUM(quantity) FROM orders WHERE item_id = 3001 GROUP BY status HAVING SUM(quantity) > 12.5 ORDER BY SUM(quantity) DESC, status ASC LIMIT 5",
    "SELECT item_name FROM items WHERE stock < 3 AND price > (SELECT AVG(price) FROM items WHERE category = 'lighting')",
    "SELECT order_id FROM orders WHERE order_id = 5001",
]
BAD = [
    ("SELECT nosuch FROM items", "unknown column"),
    ("SELECT * FROM nosuch", "unknown table"),
    ("SELECT * FROM items WHERE category > 'a'", "is not for category"),
    ("SELECT * FROM items WHERE price IN (1.00, 2.00)", "IN is not for price"),
    ("SELECT * FROM items WHERE price BETWEEN 9.00 AND 2.00", "smaller to the larger"),
    ("SELECT * FROM items WHERE stock = 'x'", "wrong type"),
    ("SELECT * FROM orders WHERE order_date = '2025-02-30'", "ISO date"),
    ("SELECT * FROM items WHERE item_name LIKE 'abc'", "LIKE takes"),
    ("SELECT * FROM items WHERE stock > 1 AND stock < 5", "different columns"),
    ("SELECT * FROM items WHERE stock > 1 AND price < 5.00 AND category = 'a' AND item_name = 'b'", "more than 3"),
    ("SELECT * FROM items LIMIT 3", "LIMIT needs"),
    ("SELECT * FROM items ORDER BY price ASC LIMIT 11", "LIMIT is 1 to 10"),
    ("SELECT * FROM items ORDER BY category ASC", "not sortable"),
    ("SELECT * FROM items WHERE stock = 4 ORDER BY stock ASC", "fixed"),
    ("SELECT city FROM customers WHERE city = 'rome' AND membership = 'gold'", "existence"),
    ("SELECT AVG(category) FROM items", "aggregates are of numbers"),
    ("SELECT COUNT(stock) FROM items", "COUNT takes"),
    ("SELECT item_name, COUNT(*) FROM items GROUP BY item_name", "not a group key"),
    ("SELECT SUM(stock) FROM items HAVING SUM(stock) > 3", "HAVING needs"),
    ("SELECT SUM(stock) FROM items WHERE price < 2.00 OR category = 'a'", "joined by AND"),
    ("SELECT * FROM items WHERE price > (SELECT MAX(stock) FROM items)", "compared column"),
]
UNREADABLE = [
    "", "DROP TABLE items", "SELECT * FROM items WHERE", "SELECT * FROM items WHERE a = 1 AND b = 2 OR c = 3", "SELECT a, b FROM items", "SELECT * FROM items; SELECT 1",
    "SELECT price, COUNT(*) FROM items GROUP BY category", "SELECT * FROM items WHERE price > (SELECT AVG(price) FROM orders)", "SELECT category, COUNT(*) FROM items GROUP BY category HAVING SUM(stock) > 3",
]


@pytest.mark.parametrize("text", GOOD)
def test_round_trip(text):
    s = parse(text)
    assert s.render(SHOP) == text
    assert violations(s, SHOP, canonical=True) in ([], ["not in canonical order"])
    assert from_record(s.record(SHOP)) == s
    assert parse(text.lower().replace(" from ", "\n  from  ") + " ;").canonical(SHOP) == s.canonical(SHOP)
    assert s.canonical(SHOP).canonical(SHOP) == s.canonical(SHOP)


@pytest.mark.parametrize(("text", "why"), BAD)
def test_violations(text, why):
    assert any(why in v for v in violations(parse(text), SHOP))


@pytest.mark.parametrize("text", UNREADABLE)
def test_outside_the_dialect(text):
    with pytest.raises(DialectError):
        parse(text)
    assert identity(text, SHOP) is None


def test_levels_grow():
    one = parse("SELECT name FROM customers WHERE city = 'rome'")
    dated = parse("SELECT order_id FROM orders WHERE order_date > '2025-01-01'")
    agg = parse("SELECT COUNT(*) FROM items")
    assert not violations(one, SHOP, 1) and not violations(one, SHOP, 3)
    assert violations(dated, SHOP, 2) and not violations(dated, SHOP, 3)
    assert violations(agg, SHOP, 2) and not violations(agg, SHOP, 3)
    assert violations(parse("SELECT name FROM customers WHERE customer_id = 1001 AND city = 'rome'"), SHOP, 2)


def test_small_parts():
    assert [like_mode(x) for x in ("a%", "%a", "%a%")] == [("prefix", "a"), ("suffix", "a"), ("contains", "a")]
    assert is_iso_date("2024-02-29") and not is_iso_date("2025-02-29") and not is_iso_date("2025-2-1") and not is_iso_date(None)
    assert parse(GOOD[8]).kind == "group" and parse(GOOD[9]).kind == "subquery"
    assert parse(GOOD[5]).skeleton(SHOP) == "items|sel=ident|-|-|ord=price:DESC|lim=n"
    assert ("op", "LIKE") in parse(GOOD[4]).features()


def test_key_expression_agrees_with_the_parser(spark, data):
    p = spark.read.parquet(f"{data}/pairs.parquet")
    texts = p.select("sql").unionByName(p.select(F.col("sql_group").alias("sql"))).unionByName(p.select(F.col("orig_sql").alias("sql"))).where("sql <> ''").distinct()
    rows = texts.select("sql", sql_key(F.col("sql")).alias("k")).collect()
    by_key, by_id = {}, {}
    for r in rows:
        i = identity(r["sql"], SHOP)
        assert i is not None
        by_key.setdefault(r["k"], set()).add(i)
        by_id.setdefault(i, set()).add(r["k"])
    assert all(len(v) == 1 for v in by_key.values()) and all(len(v) == 1 for v in by_id.values())


@pytest.mark.parametrize(
    ("a", "b"),
    [
        ("select * from items where price<5.50 and stock = 03", "SELECT *\nFROM items WHERE stock=3 AND price < 5.5;"),
        ("SELECT * FROM items WHERE a IN ('b','a') OR c <> 'X and Y'", "select * from items where c != 'X and Y' or a in ( 'a' , 'b' )"),
        ("select x from t where p between 1 and 2.0 and q = 'a b'", "select x from t where q = 'a b' and p between 1.0 and 2"),
        ("select x from t where p > (select avg(p) from t where a=1 and b=2) and c = 3", "select x from t where c=3 and p > (select AVG(p) from t where b = 2 and a = 1)"),
    ],
)
def test_equal_keys(spark, a, b):
    got = spark.createDataFrame([(a,), (b,)], "s string").select(sql_key(F.col("s")).alias("k")).distinct().collect()
    assert len(got) == 1 and got[0]["k"] is not None


def test_different_keys_and_nulls(spark):
    texts = ["SELECT a FROM t WHERE b = 'X'", "SELECT a FROM t WHERE b = 'x'", "SELECT a FROM t WHERE b = 'x' ORDER BY a ASC", "select a from t where b = 'x' or c = 1", "select a from t where b = 'x' and c = 1", "garbage"]
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "s string")
    keys = [r["k"] for r in df.select(sql_key(F.col("s")).alias("k")).collect()]
    assert len(set(keys[:-1])) == len(texts) and keys[-1] is None


def test_compiler_on_a_tiny_table(spark):
    items = spark.createDataFrame(
        [(1, "red chair", "seating", 10.0, 3), (2, "blue lamp", "lighting", 10.0, 0), (3, "old rug", None, None, 7), (4, "red rug", "seating", 30.5, 7)],
        "item_id long, item_name string, category string, price double, stock long",
    )
    rows = lambda text: [tuple(r) for r in compile_statement(parse(text), SHOP, items).collect()]
    assert rows("SELECT item_id FROM items ORDER BY price DESC LIMIT 3") == [(4,), (1,), (2,)]
    assert sorted(rows("SELECT item_id FROM items WHERE price = (SELECT MIN(price) FROM items)")) == [(1,), (2,)]
    assert sorted(rows("SELECT item_id FROM items WHERE item_name LIKE '%rug' OR stock = 0")) == [(2,), (3,), (4,)]
    assert rows("SELECT SUM(stock) FROM items WHERE price > 99.00") == [(None,)]
    assert rows("SELECT COUNT(*) FROM items WHERE price > 99.00") == [(0,)]
    assert rows("SELECT category, COUNT(*) FROM items GROUP BY category HAVING COUNT(*) > 1") == [("seating", 2)]
    assert compile_statement(parse("SELECT * FROM items"), SHOP, items.limit(0)).count() == 0


def test_filters_reach_the_scan(spark, data):
    plan = run(spark, "SELECT item_name FROM items WHERE stock = 0", SHOP, data)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "EqualTo(stock,0)" in plan and "price" not in plan.split("ReadSchema")[-1]


def test_unparsed_text_never_runs(spark, data):
    with pytest.raises(DialectError):
        run(spark, "SELECT * FROM items; DROP TABLE x", SHOP, data)
