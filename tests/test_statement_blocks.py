"""Results of statements do not depend on how tables and statements are cut into blocks and packs."""

from __future__ import annotations

import re

import duckdb
import pytest

from querymill.dialect.catalog import SHOP
from querymill.operators import execute as X
from querymill.plans import registry


@pytest.fixture
def in_small_parts(spark, monkeypatch):
    """Blocks of 60 rows, packs of 16 statements, two packs a job."""
    for name, value in (("BLOCK_ROWS", 60), ("PACK", 16), ("PACKS", 2)):
        monkeypatch.setattr(X, name, value)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "50")
    yield
    spark.conf.set(key, before)


@pytest.fixture
def shop(data):
    c = duckdb.connect()
    for name, source in (("customers", "customers"), ("items", "items"), ("orders", "shop_orders"), ("records", "query_records")):
        c.execute(f"CREATE TABLE {name} AS SELECT * FROM read_parquet('{data}/{source}.parquet')")
    return c


def _kind(sql: str, rows: list[tuple]) -> str:
    if not rows:
        return "empty"
    if re.match(r"SELECT (COUNT|SUM|AVG|MIN|MAX)\(", sql):
        return "null" if rows[0][0] is None else "zero_count" if sql.startswith("SELECT COUNT(") and rows[0][0] == 0 else "nonempty"
    return "nonempty"


def test_statement_kinds(spark, data, shop, in_small_parts):
    got = {r["query_id"]: (r["n_rows"], r["result_kind"]) for r in registry.queries()["statement_kinds"](spark, data).collect()}
    want = {}
    for i, sql in shop.execute("SELECT query_id, sql FROM records WHERE sql IS NOT NULL").fetchall():
        rows = shop.execute(sql).fetchall()
        want[i] = (len(rows), _kind(sql, rows))
    assert got == want


def test_meaningless_statements(spark, data, shop, in_small_parts):
    got = {r["query_id"]: r["reason"] for r in registry.queries()["meaningless_statements"](spark, data).collect()}
    want = {}
    for i, sql, table, conds, new, order, limit in shop.execute(
        "SELECT query_id, sql, table_name, len(coalesce(conds, [])), coalesce(is_nonexistent, FALSE), order_spec IS NOT NULL, row_limit FROM records WHERE query_kind IS NULL AND sql IS NOT NULL"
    ).fetchall():
        n = len(shop.execute(sql.split(" ORDER BY ")[0]).fetchall())
        whole = shop.execute(f"SELECT count(*) FROM {table}").fetchone()[0]
        reason = "selects all" if conds and n == whole else "selects none" if conds and not n and not new else "sorts nothing" if order and n < 2 else "cuts nothing" if limit is not None and n <= limit else None
        if reason:
            want[i] = reason
    assert got == want and want


def test_meaningless_statements_are_only_counted(spark, data, in_small_parts, monkeypatch):
    """Hashes of rows were made for every statement, and statements that differ only in what they show were asked apart."""
    seen, kept = {}, X.materialize

    def noted(df, to):
        seen.setdefault(to, []).append(out := kept(df, to))
        return out

    monkeypatch.setattr(X, "materialize", noted)
    registry.queries()["meaningless_statements"](spark, data).count()
    (jobs,) = seen["jobs"]
    asked = spark.read.parquet(f"{data}/query_records.parquet").where("query_kind is null and sql is not null").selectExpr(r"regexp_replace(regexp_replace(sql, ' ORDER BY .*$', ''), '^SELECT .*? FROM ', '') asked").distinct()
    assert 0 < jobs.count() <= asked.count()
    assert {(r["way"], r["shown"]) for r in jobs.select("way", "shown").distinct().collect()} == {("count", "")}
    for parts in seen["parts"]:
        assert parts.where("a1 is not null or b1 is not null").isEmpty()


def test_counts_equal_the_rows_of_results(spark, data, in_small_parts):
    """Conditions that all or no rows meet, OR, nulls, wrong texts, and statements that are more than counted."""
    where = ["", " WHERE stock >= 0", " WHERE stock < 0", " WHERE stock < 0 OR price > 20.00", " WHERE stock >= 0 OR price > 20.00", " WHERE stock >= 0 AND price > 20.00", " WHERE stock > 9 AND price BETWEEN 90.00 AND 20.00",
             " WHERE stock > 9 OR price < 50.00 OR category = 'lighting'", " WHERE stock > 9 AND price < 150.00 AND category != 'lighting'", " WHERE category IN ('lighting', 'outerwear')", " WHERE item_name LIKE '%a%' AND stock < 50"]
    texts = [f"SELECT {x} FROM items{w}" for x in ("*", "stock", "item_name") for w in where]
    texts += [f"SELECT * FROM orders WHERE {w}" for w in ("quantity >= 1", "quantity > 5 AND status != 'void'", "quantity > 5 OR order_date < '2025-06-01'")]
    texts += ["SELECT stock FROM items WHERE stock > (SELECT AVG(stock) FROM items)", "SELECT COUNT(*) FROM items WHERE stock < 0", "SELECT stock FROM items ORDER BY stock DESC LIMIT 3", "SELECT nothing FROM items", "no statement"]
    df = spark.createDataFrame([(x,) for x in texts], "text string")
    told = lambda **how: {r["text"]: (r["n_rows"], r["result_kind"]) for r in X.statement_results(df, SHOP, data, **how).collect()}
    assert told(counted=True) == told() and len(told()) == len(set(texts))
