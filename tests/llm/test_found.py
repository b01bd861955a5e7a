"""The pN_found queries against plain Python on the smallest tables, and defined results for odd input."""

import os
import random
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import plain  # noqa: E402

from querymill.dialect.catalog import SHOP  # noqa: E402
from querymill.dialect.statement import identity  # noqa: E402
from querymill.llm import p1_group_splits as splits  # noqa: E402
from querymill.llm import p2_near_duplicates as near  # noqa: E402
from querymill.llm import p3_format_duplicates as fmt  # noqa: E402
from querymill.llm import p4_category_sample as sample  # noqa: E402
from querymill.llm import p5_split_overlap as overlap  # noqa: E402
from querymill.llm.queries import queries  # noqa: E402
from querymill.llm.questions import question_table  # noqa: E402


def key(text):
    return identity(text, SHOP) or " ".join(text.split())


@pytest.fixture(scope="module")
def pairs(spark, data):
    return spark.read.parquet(f"{data}/pairs.parquet")


@pytest.fixture(scope="module")
def rows(pairs):
    return [r.asDict() for r in pairs.collect()]


def result(df):
    got = [tuple(r) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_p1_found(spark, data, rows):
    assert result(queries()["p1_found"](spark, data)) == plain.parted(rows, key)


def test_p1_new_splits_keep_sets_whole_and_meet_shares(spark, data, rows):
    got = {r["pair_id"]: (r["root_id"], r["split"]) for r in queries()["p1_splits"](spark, data).collect()}
    assert set(got) == {r["pair_id"] for r in rows}
    root = plain.related_sets(rows, key)
    assert {i: r for i, (r, _) in got.items()} == root
    by_root = {}
    for r, s in got.values():
        by_root.setdefault(r, set()).add(s)
    assert all(len(s) == 1 for s in by_root.values())
    share = sum(s == "train" for _, s in got.values()) / len(got)
    assert abs(share - 0.8) < 0.02


def test_p2_found(spark, data, rows):
    want = plain.close_pairs([(r["pair_id"], r["question"]) for r in rows])
    got = result(queries()["p2_found"](spark, data))
    assert got == want


def test_p3_found(spark, data, rows):
    assert result(queries()["p3_found"](spark, data)) == plain.first_equal([(r["pair_id"], r["question"]) for r in rows])


def test_p3_copies_add_up(spark, data, rows):
    got = queries()["p3_collapsed"](spark, data).collect()
    assert sum(r["n_copies"] for r in got) == sum(bool(plain.words(r["question"])) for r in rows)


def test_p4(spark, data, rows):
    targets = [r.asDict() for r in spark.read.parquet(f"{data}/category_targets.parquet").collect()]
    have = {}
    for r in rows:
        for f in ("family", "style", "source"):
            if r[f] is not None:
                k = (f, sample._key(r[f]))
                have[k] = have.get(k, 0) + 1
    part = len(rows) // 10
    want = {(t["field_name"], t["category"]) for t in targets if have.get((t["field_name"], sample._key(t["category"])), 0) < max(t["min_rows"], round(t["target_share"] * part, 6))}
    assert result(queries()["p4_found"](spark, data)) == want
    for r in queries()["p4_report"](spark, data).collect():
        need = max(r["needed_rows"], 0)
        assert r["available_rows"] == have.get((r["field_name"], sample._key(r["category"])), 0) and r["can_be_met"] == (r["drawn_rows"] >= round(need, 6))
        assert r["cause"] == (None if r["can_be_met"] else "too few records" if r["available_rows"] < round(need, 6) else "other targets")
    drawn = queries()["p4_sample"](spark, data).collect()
    assert len(drawn) == len({r["pair_id"] for r in drawn}) == part


def test_p5_found(spark, data, rows):
    got = result(queries()["p5_found"](spark, data))
    assert got == plain.overlaps(rows, key)


def test_small_edits_one_letter_and_order(spark):
    base = "show names of goods under ten with low stock for the team in rome please"
    rows = [
        (1, base), (2, base.upper() + "??"), (3, base.replace("rome", "paris")), (4, " ".join(reversed(base.split()))),
        (5, None), (6, "..."), (7, ""), (8, "entirely different words here"), (9, "x " * 20000), (10, "x " * 19000), (11, base),
    ]
    t = question_table(spark.createDataFrame(rows, "pair_id long, question string"), "pair_id", "question")
    want = plain.close_pairs(rows)
    assert result(near.close_records(t)) == want
    groups = {r["pair_id"]: r["root_id"] for r in near.near_duplicate_groups(t).collect()}
    assert groups == {1: 1, 2: 1, 3: 1, 4: 1, 11: 1, 9: 9, 10: 9}


def test_classes_equal_groups(spark, data, rows):
    """Star links and the prefix filter between classes tie the same records as all pairs do."""
    t = question_table(spark.read.parquet(f"{data}/pairs.parquet"), "pair_id", "question")
    got = result(near.near_duplicate_classes(t))
    assert got == {(r["root_id"], r["pair_id"]) for r in near.near_duplicate_groups(t).collect()} and got


def test_large_buckets_batches_and_partitions_change_nothing(spark, data):
    """Buckets dealt as grids of small blocks, tiny batches and other partitions give the same pairs."""
    few = spark.read.parquet(f"{data}/pairs.parquet").where("question is not null")
    t = question_table(few, "pair_id", "question")
    want = result(near.close_records(t))
    small = near.NearDupParams(hot_rows=2, sampled=1, keys=50, task_rows=64)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "11")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        assert result(near.close_records(t, small)) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_bags_that_agree_in_a_node_are_renamed(spark):
    """Bags of one node get nodes of their own with the same sketch; copies of a bag keep one node."""
    rows = [(i, 0x123450007, i // 2, 5) for i in range(12)] + [(20, 0x990007, 1, 1)]
    t = spark.createDataFrame(rows, "id long, node long, b1 long, b2 long")
    got = {r["id"]: r["node"] for r in near.with_nodes(t).collect()}
    assert len(got) == 13 and all(got[i] == got[i + 1] for i in range(0, 12, 2))
    assert len({got[i] for i in range(12)}) == 6 and {n >> 16 for i, n in got.items() if i < 12} == {0x12345} and got[20] == 0x990007


def test_many_edits_of_one_text_are_all_found(spark):
    """A hot bucket: every text close to every other one."""
    words = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(words[:i] + [f"e{i}"] + words[i + 1 :])) for i in range(40)]
    t = question_table(spark.createDataFrame(rows, "pair_id long, question string"), "pair_id", "question")
    got = result(near.close_records(t))
    assert got == {(a, b) for a in range(40) for b in range(a + 1, 40)}


@pytest.mark.parametrize("length, edits", [(4, 0), (5, 1), (10, 2), (14, 2), (15, 3), (20, 4), (30, 6), (99, 19), (100, 20)])
def test_isolated_pairs_at_the_bound_are_all_found(spark, length, edits):
    """Pairs with as many words replaced as may be, and pairs with as many added, none close to any other pair."""
    rows = []
    for k in range(60):
        words = [f"p{k}w{i}" for i in range(length)]
        rows.append((3 * k, " ".join(words)))
        rows.append((3 * k + 1, " ".join([f"p{k}e{i}" for i in range(edits)] + words[edits:])))
        rows.append((3 * k + 2, " ".join(words + [f"p{k}a{i}" for i in range(length * 5 // 4 - length)])))
    t = question_table(spark.createDataFrame(rows, "pair_id long, question string"), "pair_id", "question")
    assert result(near.close_records(t)) == plain.close_pairs(rows)


def test_edits_of_one_text_that_are_not_all_close(spark):
    """Small sets of edited copies: many of a bucket's texts are close to some of its texts and far from others."""
    draw = random.Random(7)
    rows = []
    for k in range(40):
        base = [f"c{k}w{i}" for i in range(15)]
        for m in range(12):
            words = list(base)
            for i in draw.sample(range(15), draw.randint(1, 3)):
                words[i] = f"c{k}m{m}e{i}"
            rows.append((12 * k + m, " ".join(words)))
    t = question_table(spark.createDataFrame(rows, "pair_id long, question string"), "pair_id", "question")
    want = plain.close_pairs(rows)
    assert 0 < len(want) < 40 * 66
    assert result(near.close_records(t)) == want


def test_links_count_other_orders_of_the_words(spark):
    a, near_a = "one two three four five", "one two three four six"
    turn = lambda x: " ".join(reversed(x.split()))
    rows = [(1, a), (2, a.upper()), (3, turn(a)), (4, near_a), (5, turn(near_a)), (6, "seven eight nine"), (7, "nine eight seven"), (8, "k: v | l: w"), (9, "l: w | k: v")]
    t = question_table(spark.createDataFrame(rows, "pair_id long, question string"), "pair_id", "question")
    got = {r["pair_id"]: (r["root_id"], r["n_links"]) for r in near.near_duplicate_groups(t).collect()}
    assert got == {i: (1, 3) for i in range(1, 6)} | {6: (6, 1), 7: (6, 1), 8: (8, 0), 9: (8, 0)}


def test_every_reading_of_fields_counts(spark):
    """Two records with the same words have different fields; each ties in records of its own reading."""
    rows = [(1, "a: b c | d: e"), (2, "a: b | c d: e"), (3, "d: e | a: b c"), (4, "c d: e | a: b"), (5, "z: y | x: w"), (6, "x: w | z: y")]
    df = spark.createDataFrame(rows, "pair_id long, question string")
    assert result(fmt.duplicates(df)) == {(1, 2), (1, 3), (1, 4), (5, 6)}
    assert {(r["keep_id"], r["n_copies"]) for r in fmt.collapsed(df).collect()} == {(1, 4), (5, 2)}


def test_texts_that_agree_in_128_bits_stay_apart(spark):
    rows = [(1, "one two"), (2, "three four"), (3, "One, two"), (4, "three four!"), (5, "k: v | l: w"), (6, "l: w; k: v"), (7, "m: x | n: y")]
    same = lambda c: F.when(F.col(c).isNotNull(), F.lit(1)).alias(c)
    t = fmt.table_of(spark.createDataFrame(rows, "pair_id long, question string"), "pair_id", "question")
    forced = t.select("id", "n", *[same(c) for c in ("s1", "s2", "f1", "f2")], "chk", "fchk")
    groups, keys = fmt.collapse(forced)
    hit = forced.join(keys, fmt.SEQ)
    assert {(r["keep_id"], r["id"]) for r in hit.collect()} == {(1, 1), (1, 3), (2, 2), (2, 4), (5, 5), (5, 6)}
    assert sorted(r["n_copies"] for r in groups.collect()) == [1, 2, 2, 2]


def test_overlap_report_counts_records_without_pairs(spark, pairs, rows):
    want = set()
    ids = {r["pair_id"]: r for r in rows}
    for a, b in plain.overlaps(rows, key):
        want |= {x for x in (a, b) if ids[x]["split"] in ("validation", "test")}
    got = {r["id"] for r in overlap.overlapping_records(pairs).collect()}
    assert got == want
    report = overlap.overlap_report(pairs).collect()
    assert sum(r["n_overlapping"] for r in report) == len(want) and sum(r["n_records"] for r in report) == sum(r["split"] in ("validation", "test") for r in rows)


def test_fields_in_another_order_are_equal(spark):
    rows = [(5, "want: a b | by: c"), (3, "By = C ; Want = A, B"), (9, "by: c\nwant: a b"), (4, "want a b by c"), (6, "want: a b; by: d"), (7, "ｗａｎｔ： a b ｜ by: c")]
    df = spark.createDataFrame(rows, "pair_id long, question string")
    assert result(fmt.duplicates(df)) == {(3, 4), (3, 5), (3, 7), (3, 9)}


def test_empty_tables(spark, pairs, data):
    none = pairs.limit(0)
    targets = spark.read.parquet(f"{data}/split_targets.parquet")
    assert splits.assign_splits(none, targets).count() == 0
    assert fmt.duplicates(none).count() == 0
    assert overlap.overlap_pairs(none).count() == 0
    plan = sample.pairs_sample(none, spark.read.parquet(f"{data}/category_targets.parquet"))
    assert plan.rows().count() == 0
    assert near.close_records(question_table(none, "pair_id", "question")).count() == 0


def test_extra_columns_do_not_clash(spark, pairs):
    odd = pairs.select("*", F.lit(1).alias("id"), F.lit(2).alias("n"), F.lit("x").alias("b1"), F.lit("y").alias("rank"))
    assert result(fmt.duplicates(odd)) == result(fmt.duplicates(pairs))


def test_null_in_every_column(spark, pairs, data):
    blank = pairs.select("pair_id", *[F.lit(None).cast(t).alias(c) for c, t in pairs.dtypes if c != "pair_id"])
    got = splits.assign_splits(blank, spark.read.parquet(f"{data}/split_targets.parquet")).collect()
    assert len({r["root_id"] for r in got}) == len(got) == pairs.count()
    assert overlap.overlap_pairs(blank).count() == 0
