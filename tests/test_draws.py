"""Drawn statements, repair of short pairs, results of many statements, contracts and readers."""

import gzip
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from querymill.dialect.catalog import SHOP
from querymill.dialect.compiler import run
from querymill.dialect.rules import violations
from querymill.dialect.statement import parse
from querymill.operators import execute as X
from querymill.operators import generate as G
from querymill.operators import responses as A
from querymill.operators import rewrite as R
from querymill.operators import sampler as D
from querymill.operators import textforms as T
from querymill.operators import tokenizer as K
from querymill.operators import workload as W
from querymill.sources import readers

STATEMENTS = [
    "SELECT * FROM items WHERE stock = 0",
    "SELECT item_name FROM items WHERE price < 50.00 OR stock > 90",
    "SELECT item_id FROM items ORDER BY price DESC, item_id ASC LIMIT 3",
    "SELECT item_id FROM items WHERE stock < 50 ORDER BY stock ASC, item_id ASC",
    "SELECT COUNT(*) FROM customers WHERE city = 'nowhere'",
    "SELECT AVG(price) FROM items WHERE stock > 1000",
    "SELECT status, SUM(quantity) FROM orders GROUP BY status",
    "SELECT item_id, COUNT(*) FROM orders GROUP BY item_id HAVING COUNT(*) > 2 ORDER BY COUNT(*) DESC, item_id ASC LIMIT 5",
    "SELECT status, MAX(order_date) FROM orders GROUP BY status ORDER BY MAX(order_date) DESC, status ASC LIMIT 3",
    "SELECT item_name FROM items WHERE price > (SELECT AVG(price) FROM items WHERE stock > 5)",
    "SELECT item_id FROM items WHERE item_id = -5",
]


def test_results_of_many_statements(spark, data):
    """Rows as when each runs alone; unsorted ones have the digest of their bag; other spellings have the same result."""
    odd = STATEMENTS[0].lower() + " ;"
    texts = spark.createDataFrame([(t,) for t in [*STATEMENTS, odd, "SELECT 1", None]], "text string")
    got = {r["text"]: r for r in X.statement_results(texts, SHOP, data).collect()}
    assert set(got) == {*STATEMENTS, odd, "SELECT 1"} and got["SELECT 1"]["digest"] is None
    for t in STATEMENTS:
        alone = run(spark, t, SHOP, data)
        assert got[t]["n_rows"] == alone.count(), t
        if "ORDER BY" not in t and "GROUP BY" not in t:
            assert got[t]["digest"] == X.result_digest(alone).first()["digest"], t
    assert got[odd]["digest"] == got[STATEMENTS[0]]["digest"]
    assert [got[t]["result_kind"] for t in (STATEMENTS[4], STATEMENTS[5], STATEMENTS[10], STATEMENTS[0])] == ["zero_count", "null", "empty", "nonempty"]


def test_order_counts_where_statements_sort(spark, data):
    up, down = (f"SELECT item_id FROM items ORDER BY price {d}, item_id ASC LIMIT 4" for d in ("ASC", "DESC"))
    bag = "SELECT item_id FROM items WHERE stock < 50"
    texts = [up, down, bag, bag + " ORDER BY stock ASC, item_id ASC", bag + " ORDER BY stock DESC, item_id ASC"]
    got = {r["text"]: r["digest"] for r in X.statement_results(spark.createDataFrame([(t,) for t in texts], "text string"), SHOP, data).collect()}
    assert len(set(got.values())) == 5


@pytest.fixture(scope="module")
def sampler(spark, data):
    banned = spark.createDataFrame([("items", "category", "lighting")], "tbl string, col string, value string")
    return D.Sampler(SHOP, D.literal_pools(spark, data, SHOP, banned, size=300))


def test_draws_keep_the_rules_and_repeat(spark, sampler):
    flat = D.drawn_statements(spark, sampler, 300).collect()
    advanced = D.drawn_statements(spark, sampler, 200, family=None).collect()
    for r in flat + advanced:
        s = parse(r["sql"])
        assert violations(s, SHOP, canonical=True) == [] and "lighting" not in r["sql"] and (r["table_name"], r["query_kind"]) == (s.table, s.kind)
    assert {r["query_kind"] for r in advanced} == {"aggregate", "group", "subquery"} and len(flat) > 150
    again = D.drawn_statements(spark.newSession(), sampler, 300).collect()
    assert {(r["draw"], r["sql"]) for r in again} == {(r["draw"], r["sql"]) for r in flat}


def test_forced_draws(spark, sampler):
    cell = D.drawn_statements(spark, sampler, 60, cell=("orders", "quantity", "BETWEEN")).collect()
    assert cell and all(any(c.column == "quantity" and c.op == "BETWEEN" for c in parse(r["sql"]).conds) for r in cell)
    pin = D.drawn_statements(spark, sampler, 60, pin=("items", "stock", "=", 0)).collect()
    assert pin and all("stock = 0" in r["sql"] for r in pin)
    exist = [parse(r["sql"]) for r in D.drawn_statements(spark, sampler, 60, existence=True).collect()]
    assert exist and all(len(s.conds) == 1 and s.select == s.conds[0].column and not s.order for s in exist)


def test_lookups_hold_shares(spark, sampler):
    rows = D.lookups(spark, D.Pools({k: v[:20] for k, v in sampler.pools.values.items()}, {}, {}, {}), SHOP).collect()
    n_id = sum(SHOP.tables[r["table_name"]].columns[r["where_col"]] == "id" for r in rows)
    assert n_id <= 0.3 * len(rows) + 1 and 0.15 < sum(r["part"] == "evaluation" for r in rows) / len(rows) < 0.25
    assert len({r["sql"] for r in rows}) == len(rows)


def test_repair_fills_short_pairs_and_breaks_none(spark):
    import random

    rng = random.Random(3)
    features = lambda i: sorted({f"t={rng.choice('ab')}", f"o={rng.choice('xyz')}", f"n={rng.choices('123', (20, 5, 1))[0]}"})
    rows = [(i, features(i), [f"atom{i % 3}"] if i % 40 == 0 else ["many"]) for i in range(1200)]
    df = spark.createDataFrame(rows, "id long, f array<string>, atoms array<string>")
    train, rest = df.where("id < 500"), df.where("id >= 500")
    added, removed = W.pair_floor_repair(train, rest, "id", "f", 12, "atoms")
    ins, outs = {r["id"] for r in added.collect()}, {r["id"] for r in removed.collect()}
    assert ins and len(ins) == len(outs) and min(ins) >= 500 and max(outs) < 500

    def counts(ids):
        out = {}
        for i, f, _ in rows:
            if i in ids:
                for a in f:
                    for b in f:
                        if a < b:
                            out[a, b] = out.get((a, b), 0) + 1
        return out

    before, after = counts(set(range(500))), counts(set(range(500)) - outs | ins)
    assert all(after.get(p, 0) >= min(n, 12) for p, n in before.items())
    assert sum(n < 12 for n in after.values()) < sum(n < 12 for n in before.values())
    atoms = lambda ids: {a for i, _, x in rows if i in ids for a in x}
    assert atoms(set(range(500)) - outs) == atoms(set(range(500)))


def test_hints_fit_both_sides(spark):
    short = spark.createDataFrame([("col=price", "cond=BETWEEN", 1), ("table=orders", "cond=IN", 1), ("n=1", "order=y", 1)], "a string, b string, n long")
    got = {(r["a"], r["table_name"], r["col"], r["op"]) for r in W.pair_hints(spark, short, SHOP).collect()}
    assert ("col=price", "items", "price", "BETWEEN") in got and not any(a == "n=1" for a, *_ in got)
    assert {c for a, t, c, op in got if a == "table=orders"} == {c for c in SHOP.tables["orders"].columns if "IN" in SHOP.tables["orders"].operators(c)}


def test_cells_and_pins(spark):
    rows = {(r["table_name"], r["col"], r["op"]): r["exempt"] for r in W.exempt_cells(spark, SHOP, [(("table", "orders"), ("op", "!="))]).collect()}
    assert rows["orders", "status", "!="] and not rows["customers", "city", "!="] and ("items", "price", "IN") not in rows
    assert W.pinned("items.stock = 0") == ("items", "stock", "=", "0")


def test_invented_names_are_new(spark):
    known = spark.createDataFrame([(n,) for n in ("ana", "anna", "hanna", "nana", "banana", None)], "name string")
    got = [r["name"] for r in W.markov_names(spark, W.transitions(known.where("name is not null"), "name"), 5, known).collect()]
    assert got and len(set(got)) == len(got) and not set(got) & {"ana", "anna", "hanna", "nana", "banana"}


def test_layouts_and_seeds():
    good = K.Layout(256, 257, 258, 259, 260, 263, ("SELECT", "FROM"))
    assert good.problems(400) == []
    assert K.Layout(256, 256, 258, 259, 260, 263).problems(400) == ["special ids are not different"]
    assert K.Layout(1, 257, 258, 259, 260, 263).problems(400) == ["ids must be whole numbers from 256 on"]
    assert "seeds reach into the merges" in K.Layout(256, 257, 258, 259, 260, 261, ("AB", "CD")).problems(400)
    assert K.seed_problems(["AB", "AB", "C", " DE"]) == ["repeated seeds", "too short: 'C'", "blanks around: ' DE'"]


def test_six_digits(spark):
    values = [0.0, 12.5, 1234567.0, 999999.4, 0.00001234, 0.00012, -2500000.0, 3.14159265, None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x double")
    got = {r["i"]: r["t"] for r in df.select("i", T.six_digits(F.col("x")).alias("t")).collect()}
    assert [got[i] for i in range(len(values))] == [None if v is None else f"{v:.6g}" for v in values]


def test_phrases_signs_and_map(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(R.phrase_rules(F.lit("avg of qty, largest ordered quantity desc"))) == "average quantity, highest ordered quantity descending"
    assert one(R.symbol_rules(F.lit("price>=5 and a<>b"))) == "price at least 5 and a<>b"
    n = R.Normaliser({"clients": ("customers", 1)}, ["red chair"], trained=("customers",))
    assert n("clients starting with clients, avg price of the Red Chair") == ("customers starting with clients, average price of the Red Chair", 2)
    with pytest.raises(ValueError):
        R.Normaliser({"clients": ("buyers", 1)}, trained=("customers",))
    assert set(R.map_profiles({"a": ("b", 1)})) == {"domain", "phrases", "combined", "combined_symbols"}


def test_caps_presets_and_dates(spark):
    rows = spark.range(100).withColumnRenamed("id", "k")
    got = {r["v"]: r["n"] for r in G.balanced(rows, "k", ("a", "b", "c"), 10, "v", 1, {"a": 15}).groupBy("v").agg(F.count("k").alias("n")).collect()}
    assert got["a"] <= 15 and sum(got.values()) == 100 and min(got.values()) >= 10
    with pytest.raises(ValueError):
        G.balanced(rows, "k", ("a", "b"), 10, "v", 1, {"a": 15, "b": 15})
    assert not G.preset("small").problems() and G.preset("small", orders=10).problems() and G.preset("large", dates=("2025-02-30", "2026-01-01")).problems()
    days = spark.createDataFrame([(f"2025-01-{i:02d}",) for i in range(1, 21)], "order_date string")
    assert G.held_dates(days, 0.1, 1).count() == 2


def test_files(spark, tmp_path):
    (tmp_path / "sets" / "one").mkdir(parents=True)
    for name, q in (("b", "second"), ("a", "first")):
        (tmp_path / "sets" / "one" / f"{name}.json").write_text(json.dumps([{"question": q, "sql": "SELECT * FROM items"}]))
    folder = str(tmp_path / "sets")
    rows = readers.read_evaluation_set(spark, "one", folder).orderBy("file_no").collect()
    assert [r["question"] for r in rows] == ["first", "second"]
    combined = spark.createDataFrame([("two", "q", "SELECT * FROM items", None), ("x", "p", "s", None)], "set string, question string, sql string, sql_group string")
    assert readers.read_evaluation_set(spark, "two", folder, combined).count() == 1
    with pytest.raises(ValueError):
        readers.read_evaluation_set(spark, "two", folder, combined, spark.createDataFrame([("other",)], "sql string"))
    with zipfile.ZipFile(tmp_path / "w.zip", "w") as z:
        z.writestr("db/index.noun", "  1 notice\nred_chair n 1\nlamp n 2\n")
        z.writestr("db/data.noun", "ignored n 1\n")
    assert sorted(r[0] for r in readers.read_words(spark, str(tmp_path / "w.zip")).collect()) == ["lamp", "red chair"]
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "x.gz").write_bytes(gzip.compress(b"hello"))
    (tmp_path / "d" / "y.txt").write_bytes(b"hello")
    got = {r["name"]: r for r in readers.file_digests(spark, str(tmp_path / "d")).collect()}
    assert got["x.gz"]["content_sha256"] == got["y.txt"]["sha256"] and got["y.txt"]["content_sha256"] is None
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "a.json").write_text('[{"id": 1, "questions": ["old"]}, {"id": 2, "questions": ["two"]}]')
    (tmp_path / "r" / "b.json").write_text('[{"id": 1, "questions": ["new"]}]')
    (tmp_path / "r" / "c.json").write_text("no answer")
    answers, errors, repeated = A.read_response_folder(spark, str(tmp_path / "r"))
    assert {r["id"]: r["questions"] for r in answers.collect()} == {1: ["new"], 2: ["two"]}
    assert [r["file"] for r in errors.collect()] == ["c.json"] and [tuple(r) for r in repeated.collect()] == [(1, 2)]
