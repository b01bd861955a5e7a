"""Operators on small fixtures, with nulls, ties, empty tables and hot groups."""

import hashlib
import json
import random
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from querymill.dialect.catalog import SHOP
from querymill.dialect.statement import parse
from querymill.functions.labels import label_key
from querymill.functions.text import fold, words
from querymill.operators import compose as K
from querymill.operators import corpus as C
from querymill.operators import evaluate as E
from querymill.operators import execute as X
from querymill.operators import fuzzy as Z
from querymill.operators import graph as G
from querymill.operators import profile as P
from querymill.operators import ranking as N
from querymill.operators import responses as A
from querymill.operators import rewrite as R
from querymill.operators import sampling as S
from querymill.operators import tokenizer as T
from querymill.operators.components import connected_components
from querymill.operators.ranking import hash_rank, ordered_rank
from querymill.operators.sampling import product, seeded
from querymill.sources import readers, writers


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


def test_words_fold_forms_and_case(spark):
    df = spark.createDataFrame([("ＡＢ-c１ ﬁne", ), (None,), ("",), ("don't STOP",), ("Größe GRÖSSE",)], "t string")
    assert [r["w"] for r in df.select(words(F.col("t")).alias("w")).collect()] == [["ab", "c1", "fine"], [], [], ["don", "t", "stop"], ["grösse", "grösse"]]
    assert one(spark, fold(F.lit(None).cast("string"))) == ""


def test_labels(spark):
    got = [r["k"] for r in spark.createDataFrame([(x,) for x in (" Scalar-Subquery ", "scalar_subquery", "SCALAR  subquery", "", None, "_")], "t string").select(label_key(F.col("t")).alias("k")).collect()]
    assert got == ["scalar_subquery"] * 3 + [None] * 3


def test_components_of_a_long_path_a_star_and_loops(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(0, i) for i in range(1, 50)] + [(7, 7), (900, None), (500, 501), (501, 500)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {i: 0 for i in range(50)} | {500: 500, 501: 500}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_ranks_and_totals_are_exact_in_a_hot_group(spark):
    df = spark.range(5000).select(F.col("id"), F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 0, F.lit(None)).otherwise(F.concat(F.lit("g"), F.col("id") % 5)).alias("g"), (F.col("id") % 11).alias("v"))
    r = N.running_total(df, ["g"], N.random_key(1, "id"), ["id"], F.col("v"), "total").join(N.rank_in_group(df, ["g"], N.random_key(1, "id"), ["id"]).select("id", "rank"), "id").collect()
    groups = {}
    for x in r:
        groups.setdefault(x["g"], []).append((x["rank"], x["v"], x["total"]))
    assert len(r) == 5000
    for rows in groups.values():
        rows.sort()
        assert [k for k, _, _ in rows] == list(range(1, len(rows) + 1))
        acc = 0
        for _, v, t in rows:
            acc += v
            assert t == acc
    assert N.rank_in_group(df.limit(0), ["g"], N.random_key(1, "id"), ["id"]).count() == 0


@pytest.mark.parametrize(
    ("weights", "total", "floors", "caps", "want"),
    [
        ([0.5, 0.3, 0.2], 10, None, None, [5, 3, 2]), ([1, 1, 1], 10, None, None, [4, 3, 3]), ([0.9, 0.1], 10, [0, 4], None, [6, 4]), ([0.5, 0.5], 10, None, [2, 100], [2, 8]),
        ([0.5, 0.5], 10, None, [2, 3], [2, 3]), ([0, 0], 4, None, None, [4, 0]), ([], 5, None, None, []),
    ],
)
def test_largest_remainder(weights, total, floors, caps, want):
    assert N.largest_remainder(weights, total, floors, caps) == want


def test_wilson_golden_values(spark):
    lo, hi = E.wilson(F.lit(50), F.lit(100))
    assert round(one(spark, lo), 4) == 0.4038 and round(one(spark, hi), 4) == 0.5962
    lo, hi = E.wilson(F.lit(0), F.lit(0))
    assert (one(spark, lo), one(spark, hi)) == (0.0, 0.0)


def test_bags(spark):
    a, b = spark.createDataFrame([(1,), (2,), (2,)], "a long"), spark.createDataFrame([(2.0,), (1.0,), (2.0,)], "b double")
    assert E.bag_difference(a, b.select(F.col("b").cast("long"))).count() == 0
    assert X.result_digest(a).first() == X.result_digest(b).first()
    assert [tuple(r) for r in E.bag_difference(a, a.distinct()).collect()] == [(2, 2, 1)]
    assert X.result_digest(a).first() != X.result_digest(a.distinct()).first()


def test_error_parts():
    parts = lambda g, p: E.error_parts(parse(g), parse(p), SHOP)
    base = "SELECT name FROM customers WHERE city = 'rome' AND membership != 'gold'"
    assert parts(base, "SELECT name FROM customers WHERE membership != 'gold' AND city = 'rome'") == []
    assert parts(base, "SELECT * FROM customers WHERE city = 'paris' OR membership != 'gold'") == ["select", "literal", "conn"]
    assert parts(base, "SELECT COUNT(*) FROM customers") == ["structure"]
    assert parts("SELECT COUNT(*) FROM items", "SELECT SUM(stock) FROM items") == ["aggregate"]
    assert E._judge(base, "nonsense", SHOP, False) == (False, False, False, ["malformed"])
    assert E._judge("SELECT name FROM customers", "SELECT * FROM customers", SHOP, False, open_=True)[:2] == (False, True)
    assert E._judge("SELECT name FROM customers", "SELECT * FROM customers", SHOP, False)[:2] == (False, False)  # the question says which


def test_scores_keep_every_row(spark):
    df = spark.createDataFrame([(1, "SELECT * FROM items", "select * from items;"), (2, "SELECT * FROM items", None), (3, None, None), (1, "SELECT * FROM items", "select * from items;")], "id long, g string, p string")
    got = E.score_statements(df, "g", "p", SHOP).collect()
    assert len(got) == 4 and sum(r["em"] for r in got) == 2


def test_fuzzy(spark):
    words_, dic = spark.createDataFrame([("custmer",), ("zzz",), ("a",), (None,)], "word string"), spark.createDataFrame([("customer",), ("item",), ("customers",)], "word string")
    assert [tuple(r)[:2] for r in Z.ngram_best(words_.where("word is not null"), dic).collect()] == [("custmer", "customer")]
    assert [tuple(r)[:2] for r in Z.levenshtein_best(words_, dic).collect()] == [("custmer", "customer")]
    assert [tuple(r)[:2] for r in Z.sequence_best(words_, dic).collect()] == [("custmer", "customer")]
    assert one(spark, Z.like_case(F.lit("ITEM"), F.lit("order"))) == "ORDER" and one(spark, Z.like_case(F.lit("Item"), F.lit("order"))) == "Order"
    assert one(spark, Z.first_change(F.lit("a"), F.lit("a"), F.lit(None).cast("string"), F.lit("b"), F.lit("c"))) == "b"
    assert one(spark, Z.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(0.0)))) == 0.0
    assert one(spark, Z.snake_parts(F.lit("Customer__ID"))) == ["customer", "id"]


def test_nearest_vectors_skip_null_and_zero(spark):
    rows = spark.createDataFrame([(20, [1.0, 0.0]), (1, [0.9, 0.1]), (2, None), (3, [0.0, 0.0]), (4, [0.9, 0.1])], "vec_id long, e array<double>")
    assert [tuple(r)[:3] for r in Z.nearest_vectors(rows, rows.where("vec_id % 20 = 0"), "vec_id", "e", 2).collect()] == [(20, 1, 1), (20, 2, 4)]


def test_graph(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("d", "e")], "src string, dst string")
    got = {r["node"]: (r["distance"], r["source"]) for r in G.nearest_sources(edges, spark.createDataFrame([("a", "A", 1), ("e", "E", 5)], "node string, source string, weight long"), 2).collect()}
    assert got == {"a": (0, "A"), "b": (1, "A"), "c": (2, "E"), "d": (1, "E"), "e": (0, "E")}
    reach = G.anchored_reach(edges, spark.createDataFrame([("x", "a"), ("y", "c")], "grp string, node string"), spark.createDataFrame([("x", 1), ("y", 1)], "grp string, r int"))
    assert {r["node"]: r["grp"] for r in G.clear_winners(reach).collect()} == {"a": "x", "c": "y", "d": "y"}


def test_text_checks(spark):
    yes = [("show amys orders", "amy"), ("amy's order", "amy"), ("for Amy.", "amy")]
    no = [("amygdala", "amy"), ("xamy", "amy")]
    df = spark.createDataFrame([(*x, True) for x in yes] + [(*x, False) for x in no], "q string, l string, want boolean")
    assert all(r["got"] == r["want"] for r in df.select("want", C.word_literal(F.col("q"), F.col("l")).alias("got")).collect())
    df = spark.createDataFrame([("over 20.", "20", True), ("2020", "20", False), ("20.5", "20", False), ("3.20", "20", False), ("20", "20", True)], "q string, l string, want boolean")
    assert all(r["got"] == r["want"] for r in df.select("want", C.isolated_number(F.col("q"), F.col("l")).alias("got")).collect())
    assert one(spark, C.missing_numerals(F.lit("below $20 please"), F.lit("SELECT a FROM t WHERE p < 20.00 AND q > 7 LIMIT 3"))) == [7.0]
    assert one(spark, C.skeleton(F.lit("Show Rome orders over 20"), F.lit("SELECT * FROM t WHERE c = 'rome' AND q > 20"))) == "show _v_ orders over _v_"
    assert one(spark, C.check_reasons(F.lit("Show three item_names"), F.lit("SELECT a FROM t WHERE c = 'rome'"))) == ["not lower case", "literal missing", "number word", "column name"]


def test_conflicts_and_repeats(spark):
    df = spark.createDataFrame([(1, "g", "A b!", "s1"), (2, "g", "a  B", "s2"), (3, "g", "c", "s1"), (4, "h", "c", "s1"), (5, "h", None, "s1"), (6, "h", "d", None)], "id long, grp string, q string, s string")
    norm = C.normalise(F.col("q"))
    assert [tuple(r) for r in C.label_conflicts(df, norm, F.col("s")).collect()] == [("a b", 2, 2)]
    assert sorted(r["id"] for r in C.drop_conflicts(df, norm, F.col("s")).collect()) == [3, 4, 5, 6]
    assert [r["id"] for r in C.repeats_within_group(df, "grp", "q", "id").collect()] == [2]


def test_sampling_is_exact_and_repeatable(spark):
    df = spark.range(100).select(F.col("id"), F.when(F.col("id") < 10, None).when(F.col("id") < 40, "a").otherwise("b").alias("s"))
    q = {r["s"]: r["quota"] for r in S.stratified_quotas(df, ["s"], 20).collect()}
    assert q == {None: 2, "a": 6, "b": 12}
    pick = lambda: sorted(r["id"] for r in S.stratified_sample(df, ["s"], "id", 20).collect())
    assert len(pick()) == 20 and pick() == pick()
    parts = S.group_split(df.withColumn("g", F.col("id") % 20), "g", "id", 0.1).groupBy("g").agg(F.collect_set("part").alias("p")).collect()
    assert sum(r["p"] == ["validation"] for r in parts) == 2 and all(len(r["p"]) == 1 for r in parts)
    w = S.repeat_by_weight(spark.createDataFrame([(1, 2), (2, 0), (3, None)], "id long, w int"), F.col("w")).collect()
    assert [(r["id"], r["copy_no"]) for r in w] == [(1, 1), (1, 2)]


def test_profile_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "a long, b long")
    assert P.key_profile(empty, ["a"]).count() == 0
    assert P.content_hash(empty).first()["n_rows"] == 0
    a = spark.createDataFrame([(1, "x"), (2, None)], "a long, b string")
    assert P.content_hash(a).first() == P.content_hash(a.orderBy(F.desc("a")).select("b", "a")).first()
    assert P.content_hash(a).first() != P.content_hash(a.unionByName(a)).first()
    assert P.ordered_digest(a, "a", ["a", "b"]).first() == P.ordered_digest(a.orderBy(F.desc("a")), "a", ["a", "b"]).first()


def test_merges_and_round_trip(spark):
    df = spark.createDataFrame([(1, "aaab aab"), (2, "größe 東京 12"), (3, ""), (4, None)], "id long, t string")
    m = T.train_merges(df, "t", 5)
    assert m[0] == (97, 97, 256)
    got = {r["id"]: r["ids"] for r in T.encode(df, "id", "t", m).collect()}
    assert set(got) == {1, 2} and all(T.decode(got[i], m) == t for i, t in ((1, "aaab aab"), (2, "größe 東京 12")))
    assert T.decode([0xFF], m) is None
    assert one(spark, T.merge(F.array(*[F.lit(x) for x in (1, 1, 1, 2, 1, 1)]), 1, 1, 9)) == [9, 1, 2, 9]
    row = one(spark, T.padded(F.array(*[F.lit(x) for x in (1, 5, 2, 6, 7, 3)]), F.lit(3), 7, 0))
    assert (row["inputs"], row["targets"], row["mask"]) == ([1, 5, 2, 6, 7, 0, 0], [5, 2, 6, 7, 3, 0, 0], [False, False, True, True, True, False, False])


def test_spans_and_rewrites(spark):
    df = spark.createDataFrame([("a", 1, 3), ("a", 3, 5), ("a", 7, 9), ("b", 1, 2), ("a", 2, 4)], "k string, s int, e int")
    assert sorted(tuple(r) for r in R.merged_spans(df, "k", "s", "e").collect()) == [("a", 1, 5), ("a", 7, 9), ("b", 1, 2)]
    n = R.Normaliser({"clients": ("customers", 1), "gold": ("x", 1)}, ["gold lamp"], keep=("stock",))
    assert n("Clients with 'clients' and gold lamp avg over 5") == ("customers with 'clients' and gold lamp average over 5", 2)
    assert n(None) == (None, 0)
    with pytest.raises(ValueError):
        R.Normaliser({"stock": ("x", 1)}, keep=("stock",))
    assert one(spark, R.replace_word(F.lit("amys and amy, not amyx"), F.lit("amy"), F.lit("bob"))) == "bobs and bob, not amyx"
    assert one(spark, R.finish(F.lit("Give  me a apple , please"))) == "give me an apple, please"


@pytest.mark.parametrize(
    ("raw", "how", "n"),
    [
        ('[{"id": 1, "questions": ["a"]}]', "parsed", 1), ('<think>hm</think>```json\n[{"id": 1, "questions": ["a"]}]\n```', "parsed", 1),
        ('[{"id": 1, "questions": ["a"]} {"id": 2, "questions": ["b"]}]', "repaired", 2), ('[{"id": 1, "questions": ["a"]}, {"id": 2, "questions": ["b"]}', "repaired", 2),
        ('oops {"id": 1, "questions": ["a"]} text {"id": 2, "questions": ["b", "c"]} end', "salvaged", 2), ("no json", "unreadable", None), ("", "empty", None), (None, "empty", None),
        ('{"id": 1}', "no array", None),
    ],
)
def test_response_reader(raw, how, n):
    items, got = A.read_array(raw)
    assert got == how and (None if items is None else len(items)) == n


def test_compose_and_judge():
    for text in ("SELECT AVG(price) FROM items WHERE category = 'lighting' AND stock > 5", "SELECT status, COUNT(*) FROM orders GROUP BY status", "SELECT item_name FROM items WHERE price BETWEEN 5.00 AND 9.50 ORDER BY price ASC, item_id ASC LIMIT 3"):
        s = parse(text)
        q = K.wording(s, "7")
        assert q == K.wording(s, "7") and not K.literal_problems(q, s) and K.judge(q, text, SHOP)[0] == "pass"
    assert K.judge("what is the total price", "SELECT AVG(price) FROM items", SHOP)[0] == "violation"
    assert K.judge(None, "SELECT AVG(price) FROM items", SHOP)[0] == "violation"
    assert K.judge("x", "nonsense", SHOP)[0] == "review"
    kinds = {k for k, _ in K.contrast_variants(parse("SELECT item_name FROM items WHERE price < 5.00 AND item_name LIKE 'a%' ORDER BY stock ASC"), SHOP)}
    assert kinds == {"projection", "comparison", "like", "ordering"}


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text(json.dumps([{"question": "q1", "sql": "s1"}, {"question": "q2", "sql": "s2", "style": 3}]), encoding="utf-8-sig")
    got = readers.read_pairs(spark, [str(tmp_path / "in")])
    assert sorted((r["question"], r["style"], r["file_ord"]) for r in got.collect()) == [("q1", None, 0), ("q2", 3, 0)]
    (tmp_path / "w.csv").write_text("id,question\n1,a\n1,b\n2,c\n")
    pref = spark.createDataFrame([(2, "z")], "id long, question string")
    assert sorted(tuple(r) for r in readers.read_csv_answers(spark, str(tmp_path / "w.csv"), pref).collect()) == [(1, "a"), (2, "z")]
    (tmp_path / "v.txt").write_text("cat 0.1 0.2\ndog 0.3 0.4\nbad 1\n")
    assert {r["word"] for r in readers.read_vectors(spark, str(tmp_path / "v.txt")).collect()} == {"cat", "dog"}
    (tmp_path / "words.txt").write_text("# note\nOne two\ntwo\n")
    assert {r["word"] for r in readers.read_words(spark, str(tmp_path / "words.txt")).collect()} == {"one", "two"}
    (tmp_path / "data.noun").write_text("00000001 03 n 02 cat 0 true_cat 0 002 @ 00000002 n 0000 ! 00000009 n 0000 | a cat\n00000002 03 n 01 animal 0 000 | any\n")
    (tmp_path / "noun.exc").write_text("mice mouse\n")
    lemmas, edges, exc = readers.read_lexical_graph(spark, str(tmp_path / "data.noun"), str(tmp_path / "noun.exc"))
    assert {(r["lemma"], r["node"]) for r in lemmas.collect()} == {("cat", "n:00000001"), ("true cat", "n:00000001"), ("animal", "n:00000002")}
    assert [tuple(r) for r in edges.collect()] == [("n:00000001", "n:00000002")] and [tuple(r) for r in exc.collect()] == [("noun", "mice", "mouse")]
    assert readers.file_digests(spark, str(tmp_path / "words.txt")).first()["n_bytes"] == (tmp_path / "words.txt").stat().st_size
    writers.write_frozen(pref, str(tmp_path / "out"))
    with pytest.raises(Exception, match="(?i)exist"):
        writers.write_frozen(pref, str(tmp_path / "out"))


def test_stream_windows(spark, data, tmp_path):
    from querymill.streaming.windows import event_stream, windowed_counts

    events = spark.read.parquet(f"{data}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(str(tmp_path / "in"))
    stream = event_stream(spark, str(tmp_path / "in"), events.schema)
    q = windowed_counts(stream, late="3650 days").writeStream.format("memory").queryName("w").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("w").agg(F.sum("n")).first()[0] == events.count()


def test_alike_words_equal_all_pairs(spark):
    """Both ratios against every pair of random words over few letters, ties to the smaller entry."""
    rng = random.Random(3)
    draw = lambda: "".join(rng.choice("abcd") for _ in range(rng.randint(1, 7)))
    a, b = sorted({draw() for _ in range(40)}), sorted({draw() for _ in range(40)})
    left, right = (spark.createDataFrame([(w,) for w in x], "word string") for x in (a, b))
    for t in (0.5, 0.7, 1.0):
        best = {}
        for w in a:
            r, x = max(((SequenceMatcher(a=x, b=w).ratio(), x) for x in b), key=lambda p: (p[0], [-ord(c) for c in p[1]] + [0]))
            if r >= t:
                best[w] = (min(x for x in b if SequenceMatcher(a=x, b=w).ratio() == r), round(r, 6))
        assert {r["word"]: (r["match"], r["ratio"]) for r in Z.sequence_best(left, right, t).collect()} == best

        def distance(x, y):
            row = list(range(len(y) + 1))
            for i, c in enumerate(x, 1):
                row = _next_row(row, c, y, i)
            return row[-1]

        lev = {w: max((round(1 - distance(w, x) / max(len(w), len(x)), 6), x) for x in b)[0] for w in a}
        want = {w: (min(x for x in b if round(1 - distance(w, x) / max(len(w), len(x)), 6) == r), r) for w, r in lev.items() if r >= t}
        assert {r["word"]: (r["match"], r["ratio"]) for r in Z.levenshtein_best(left, right, t).collect()} == want


def _next_row(row, c, y, i):
    out = [i]
    for j, d in enumerate(y, 1):
        out.append(min(row[j] + 1, out[-1] + 1, row[j - 1] + (c != d)))
    return out


def test_vectors_in_many_blocks(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(90, 5)).round(2)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, e array<double>").repartition(5)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = set()
    for q in range(0, 90, 10):
        s = np.round(u @ u[q], 9)
        want |= {(q, r + 1, int(i)) for r, i in enumerate(sorted((i for i in range(90) if i != q), key=lambda i: (-s[i], i))[:3])}
    got = Z.nearest_vectors(rows, rows.where("vec_id % 10 = 0"), "vec_id", "e", 3, block=2).collect()
    assert {tuple(r)[:3] for r in got} == want


def test_ranks_of_groups_in_many_tasks(spark):
    """A group that holds most rows, ties and null groups, by hash and by order, against plain Python."""
    rng = random.Random(5)
    rows = [(i, rng.choice(["hot"] * 6 + ["a", None]), rng.randint(0, 9)) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, g string, v int").repartition(4)
    by = {}
    for i, g, v in rows:
        by.setdefault(g, []).append((v, i))
    want = {i: k for g in by for k, (_, i) in enumerate(sorted(by[g]), 1)}
    assert {r["id"]: r["rank"] for r in ordered_rank(df, ["g"], ["v", "id"]).collect()} == want
    want = {i: k for g in by for k, (_, i) in enumerate(sorted((hashlib.md5(f"42:{i}".encode()).hexdigest(), i) for _, i in by[g]), 1)}
    assert {r["id"]: r["rank"] for r in hash_rank(df, ["g"], seeded(42, "id"), ["id"]).collect()} == want
    picked = hash_rank(df, ["g"], seeded(42, "id"), ["id"], limit=F.lit(3)).where("rank <= 3").collect()
    assert {r["id"] for r in picked} == {i for i, k in want.items() if k <= 3}
    assert {r["rank"] for r in ordered_rank(df.limit(0), ["g"], ["v", "id"]).collect()} == set()


def test_product_in_blocks(spark):
    a, b = spark.range(7).toDF("x"), spark.range(11).toDF("y")
    assert {tuple(r) for r in product(a, b, 3).collect()} == {(x, y) for x in range(7) for y in range(11)}
    assert product(a, b.limit(0)).count() == product(a.limit(0), b).count() == 0


def test_near_any_scores_all_targets(spark):
    rows = spark.createDataFrame([(i, [float(i == k) for k in range(5)]) for i in range(5)], "id long, v array<double>")
    assert sorted(r[0] for r in Z.near_any(rows, rows, "id", "v", 0.9).collect()) == [0, 1, 2, 3, 4]
    assert sorted(r[0] for r in Z.near_any(rows, rows, "id", "v", 0.9, 2).collect()) == [0, 1, 2, 3, 4]
    assert Z.near_any(rows, rows.limit(0), "id", "v", 0.9).count() == 0


def test_collated_rows_are_whole(spark):
    rows = spark.createDataFrame([(n, list(range(1, n + 1)), 2) for n in (2, 5, 16, 17, 40)], "n int, ids array<int>, start int")
    got = {r["n"]: r["row"] for r in T.collated(rows, "ids", "start", 0).collect()}
    assert {n: len(r["inputs"]) for n, r in got.items()} == {2: 15, 5: 15, 16: 15, 17: 16, 40: 39}
    for n, r in got.items():
        assert [x for x in r["inputs"] if x] == list(range(1, n)) and [x for x in r["targets"] if x] == list(range(2, n + 1))
        assert len(r["mask"]) == len(r["targets"]) and [i + 1 for i, m in enumerate(r["mask"]) if m] == list(range(2, n))
    with pytest.raises(Exception, match="longer than width"):
        rows.select(T.padded(F.col("ids"), F.col("start"), 8, 0).alias("row")).collect()
