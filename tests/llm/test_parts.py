"""Parts of the training-data operators: flow, packing, mixture, subjects, sample, tokens."""

from itertools import combinations, product

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from querymill.llm import p1_group_splits as splits
from querymill.llm import p4_category_sample as sample
from querymill.llm import p6_packing as packing
from querymill.llm import p7_mixture as mixture
from querymill.llm import p8_subjects as subjects
from querymill.llm.flow import Bundle, FlowNetwork, allocate
from querymill.llm.p2_near_duplicates import NearDupParams, one_permutation_bands
from querymill.llm.queries import oracle_sql, queries
from querymill.llm.tokens import encoder, VOCABULARY, with_token_counts


def test_flow_takes_the_cheaper_way_first():
    n = FlowNetwork()
    a, b, c, t = (n.node() for _ in range(4))
    n.arc(a, b, 5)
    cheap, dear = n.arc(b, t, 3, 1), n.arc(b, c, 9, 2)
    n.arc(c, t, 9, 2)
    assert n.solve(a, t) == 3 * 1 + 2 * 4 and (n.flow(cheap), n.flow(dear)) == (3, 2)


def test_allocation_meets_quotas_with_one_set_of_a_third():
    bundles = [Bundle("hot", 1, {"a": 300}), Bundle("small", 400, {"a": 1}), Bundle("pair", 100, {"b": 2}), Bundle("mix", 50, {"a": 1, "b": 1})]
    plan = allocate(bundles, [0.8, 0.1, 0.1])
    assert plan["hot"] == [1, 0, 0] and all(sum(plan[b.key]) == b.count for b in bundles)
    rows = [sum(plan[b.key][k] * b.size for b in bundles) for k in range(3)]
    assert all(abs(got - want) <= 2 for got, want in zip(rows, (800, 100, 100)))


def test_flow_equals_enumeration():
    """Least cost of small networks with one source, three ways and unequal costs."""
    rng = np.random.default_rng(2)
    for _ in range(20):
        caps, costs, supply = rng.integers(0, 5, (2, 3)), rng.integers(0, 4, (2, 3)), rng.integers(0, 6, 2)
        room = rng.integers(0, 6, 3)
        n = FlowNetwork()
        s, t = n.node(), n.node()
        left, right = [n.node() for _ in range(2)], [n.node() for _ in range(3)]
        for i in range(2):
            n.arc(s, left[i], int(supply[i]))
            for j in range(3):
                n.arc(left[i], right[j], int(caps[i][j]), int(costs[i][j]))
        for j in range(3):
            n.arc(right[j], t, int(room[j]))
        best = (0, 0)
        for x in product(*[range(int(c) + 1) for c in caps.ravel()]):
            m = np.array(x).reshape(2, 3)
            if (m.sum(axis=1) <= supply).all() and (m.sum(axis=0) <= room).all():
                best = max(best, (int(m.sum()), -int((m * costs).sum())))
        assert n.solve(s, t) == -best[1]


def test_bundles_spread_evenly_where_quotas_allow():
    plan = allocate([Bundle("one", 100, {"a": 1}), Bundle("three", 50, {"a": 3}), Bundle("two", 40, {"a": 1, "b": 1})], [0.8, 0.1, 0.1])
    assert plan == {"one": [80, 10, 10], "three": [40, 5, 5], "two": [32, 4, 4]}


def test_sets_beyond_the_bundles_of_the_driver_are_dealt_too(spark):
    rows = [(i, i, 1 + i % 97, f"a:{1 + i % 97}", False) for i in range(3000)]
    sets = spark.createDataFrame(rows, "label long, root_id long, size long, profile string, mixed boolean")
    names = [("test", 0.1), ("train", 0.8), ("validation", 0.1)]
    for most in (5, 1000):
        got = splits.dealt_sets(sets, names, splits.SplitParams(max_bundles=most)).collect()
        assert len(got) == 3000 == len({r["label"] for r in got})
        total = sum(r[2] for r in rows)
        for name, share in names:
            assert abs(sum(rows[r["label"]][2] for r in got if r["split"] == name) - share * total) <= 100


@pytest.mark.parametrize("seed", range(5))
def test_packs_hold_every_item_within_capacity(seed):
    rng = np.random.default_rng(seed)
    capacity = 100
    h = {int(x): int(rng.integers(1, 50)) for x in rng.choice(np.arange(1, 101), 30, replace=False)}
    plan = packing.shortest_pack_first(h, capacity)
    placed = {}
    for p in plan:
        assert p.count > 0 and sum(length * k for length, k in p.items.items()) <= capacity
        for length, k in p.items.items():
            placed[length] = placed.get(length, 0) + k * p.count
    assert placed == h
    used = sum(x * n for x, n in h.items()) / (capacity * sum(p.count for p in plan))
    assert used > 0.85
    ranges = {}
    for length, lo, hi, _, _ in packing.slots(plan):
        ranges.setdefault(length, []).append((lo, hi))
    for length, rs in ranges.items():
        assert sorted(rs)[0][0] == 0 and max(hi for _, hi in rs) == h[length]


def test_packing_splits_only_what_does_not_fit(spark):
    docs = spark.createDataFrame([(1, "word " * 250), (2, "one two three"), (3, ""), (4, None), (5, "한국어 문서입니다")], "doc_id long, text string")
    packs = spark.createDataFrame([("tiny", 100), ("big", 1000)], "pack_name string, capacity_tokens long")
    got = packing.pack_documents(docs, packs).collect()
    assert {(r["pack_name"], r["doc_id"]) for r in got} == {(p, i) for p in ("tiny", "big") for i in (1, 2, 5)}
    parts = sorted((r["piece_no"], r["start_token"], r["length"]) for r in got if r["pack_name"] == "tiny" and r["doc_id"] == 1)
    assert [p[1] for p in parts] == [0, 100, 200] and sum(p[2] for p in parts) == sum(r["length"] for r in got if r["pack_name"] == "big" and r["doc_id"] == 1)
    fill = {}
    for r in got:
        fill[r["pack_name"], r["pack_id"]] = fill.get((r["pack_name"], r["pack_id"]), 0) + r["length"]
    assert all(v <= {"tiny": 100, "big": 1000}[k[0]] for k, v in fill.items())
    assert packing.pack_documents(docs.limit(0), packs).count() == 0


def test_splitting_tree_is_exact():
    tree = mixture.splitting_tree([100, 7, 0, 33], 9, 1)
    assert tree.sum(axis=0).tolist() == [100, 7, 0, 33] and tree.sum(axis=1).max() - tree.sum(axis=1).min() <= 4
    assert (tree == mixture.splitting_tree([100, 7, 0, 33], 9, 1)).all() and tree.min() >= 0


def test_mixture_counts_and_caps(spark):
    docs = spark.createDataFrame(
        [(i, "Big-Source", "alpha beta gamma delta " * 5) for i in range(200)] + [(1000 + i, " small source", "alpha beta " * 5) for i in range(10)] + [(2000, None, "x y z"), (2001, "other", "a b"), (2002, "small_source", None)],
        "doc_id long, source string, text string",
    )
    targets = spark.createDataFrame([("big_source", 0.5, 1), ("small_source", 0.4, 3), ("absent", 0.1, 2)], "source string, target_share double, max_repeats long")
    rep = {r["source"]: r for r in mixture.mix_report(docs, targets).collect()}
    assert rep["small_source"]["short"] and rep["absent"]["short"] and not rep["big_source"]["short"]
    assert abs(rep["big_source"]["reached_share"] - 0.5) < 0.01 and rep["small_source"]["most_copies"] == 3
    mix = mixture.mix_sources(docs, targets, mixture.MixParams(shard_tokens=500, block_items=4)).collect()
    assert len({(r["doc_id"], r["copy"]) for r in mix}) == len(mix)
    assert sum(r["n_tokens"] for r in mix if r["source"] == "small_source") == rep["small_source"]["mixed_tokens"]
    assert len({r["shard"] for r in mix}) > 1 and len({(r["shard"], r["position"]) for r in mix}) == len(mix)
    assert mixture.mix_sources(docs.limit(0), targets).count() == 0


def test_sentences_and_terms(spark):
    long_tag = "<b title='" + "x" * 500 + "'>"
    text = "<p>From the shop. Is it so? yes!</p>\n- LEDGER: must be paid\nfrom: someone\nto: other\nQ: why is it? a: ask me." + long_tag + "Cold &amp; wet. Q: why? a: rain"
    df = spark.createDataFrame([(1, text), (2, None), (3, "..."), (4, "서버보다 서버가 12 급하다")], "id int, text string")
    cut = subjects.sentences(F.col("text"))
    got = {r["id"]: (r["s"], r["t"]) for r in df.select("id", cut.alias("s"), F.transform(cut, lambda x: subjects.terms(x)).alias("t")).collect()}
    assert got[1][0] == ["from the shop.", "is it so?", "yes!", "ledger: must be paid", "q: why is it? a: ask me.", "cold & wet.", "q: why? a: rain"]
    assert got[1][1][:2] == [["from", "shop", "the"], ["is", "it", "so"]]
    assert got[2] == ([], []) and got[3] == ([], [])
    assert got[4][1] == [["급하", "서버"]]


def test_mined_rules_equal_plain_counts(spark):
    """Every set of up to three terms in three sentences or more, long equal sentences among them."""
    rng = np.random.default_rng(1)
    rows = [({f"t{x}" for x in rng.choice(8, 4, replace=False)}, "ab"[int(rng.integers(2))]) for _ in range(40)] + [({f"u{i}" for i in range(40)}, "a")] * 3
    p = subjects.SubjectParams(change=0.0)
    got, empty = subjects.mine(spark, [rows, []], ["a", "b"], p)
    want = {}
    for ts, s in rows:
        for k in (1, 2, 3):
            for c in combinations(sorted(ts), k):
                want.setdefault(frozenset(c), [0, 0])["ab".index(s)] += 1
    assert empty == {} and {r: c[:-1].tolist() for r, c in got.items()} == {r: c for r, c in want.items() if sum(c) >= 3}


def test_specific_rules_overrule_general_ones():
    share = lambda a, b, n: np.array([a, b, n], float)
    m = subjects.RuleModel(["el", "law"], {frozenset(["fuse"]): share(40, 4, 44), frozenset(["fuse", "short"]): share(6, 6, 12), frozenset(["deed"]): share(0, 30, 30)}, none=1.0)
    assert m.subject("replace the fuse") == 0 and m.subject("a deed") == 1 and m.subject("a short fuse is typical") == -1 and m.subject("nothing known") == -1


def test_many_sentences_at_once_equal_one_by_one():
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(12)]
    rules = {}
    for _ in range(60):
        n = int(rng.integers(1, 4))
        counts = rng.integers(0, 30, 3).astype(float)
        rules[frozenset(rng.choice(words, n, replace=False).tolist())] = np.r_[counts, counts.sum() + 1]
    m = subjects.RuleModel(["a", "b", "c"], rules, 0.7, 0.5)
    keys = [" ".join(sorted(set(rng.choice([*words, "other"], int(rng.integers(0, 9))).tolist()))) for _ in range(400)]
    want = []
    for key in keys:
        p = m.probabilities(m.evidence(set(key.split()) & m.vocabulary))
        want.append(int(np.argmax(p[:-1])) if p[:-1].max() >= 0.5 else -1)
    assert m.subjects_of(pa.array(keys)).tolist() == want and len(set(want)) == 4


def test_held_out_sentences(spark, data):
    """Of held-out sentences that get a subject, most get their text's."""
    p = subjects.SubjectParams()
    texts = subjects.labelled_sentences(spark.read.parquet(f"{data}/subject_samples.parquet"), p)
    names = sorted({s for _, s in texts})
    train = [(ts, s) for i, (sents, s) in enumerate(texts) if i % 4 for ts in sents]
    m = subjects.RuleModel(names, subjects.mine(spark, [train], names, p)[0], 1.0, 4.0)
    got = [(m.subject(" ".join(ts)), names.index(s)) for i, (sents, s) in enumerate(texts) if i % 4 == 0 for ts in sents]
    hit = [k == y for k, y in got if k >= 0]
    assert len(hit) > 0.4 * len(got) and sum(hit) > 0.93 * len(hit)


def test_documents_without_text(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "...")], "doc_id long, text string")
    m = subjects.RuleModel(["a", "b"], {})
    assert subjects.score_documents(docs.limit(0), m).count() == 0 and subjects.fit(docs.selectExpr("doc_id sample_id", "text subject", "text").where("doc_id = 1")).subjects == []
    assert sorted(tuple(r) for r in subjects.score_documents(docs, m).collect()) == [(1, 0, None, 0), (2, 0, None, 0), (3, 0, None, 0)]


def test_cells_meet_reachable_quotas():
    rng = np.random.default_rng(3)
    have = rng.integers(50, 200, (3, 4, 3))
    quotas = [[30, 40, 30], [25, 25, 25, 25], [50, 30, 20]]
    none = [[0] * 3, [0] * 4, [0] * 3]
    cells = sample.fit_cells(have, none, quotas, quotas)
    assert (cells <= have).all() and cells.sum() == 100 and sample.deviation(cells, none, quotas, quotas) <= 8


def test_signatures_of_short_and_equal_sets():
    p = NearDupParams()
    band = one_permutation_bands(np.array([5, 5, 7, 9, 5, 7, 9], np.int64), np.array([1, 3, 3]), p)
    assert band.shape == (3, p.bands) and (band[1] == band[2]).all() and (band[0] != band[1]).any()


def test_linear_program_against_enumeration():
    """Least deviation of small tables, by trying every whole sample."""
    rng = np.random.default_rng(5)
    for _ in range(6):
        have = rng.integers(0, 4, (2, 3))
        size = int(min(have.sum(), 4))
        if not size:
            continue
        quotas = [[size, 0], [size - size // 2, size // 2, 0]]
        floors = [[1, 0], [1, 1, 0]]
        needs = [[max(a, b) for a, b in zip(q, f)] for q, f in zip(quotas, floors)]
        best = min(
            sample.deviation(np.array(c).reshape(2, 3), floors, needs, quotas)
            for c in product(*[range(int(h) + 1) for h in have.ravel()]) if sum(c) == size
        )
        _, bound = sample.least_deviation(have, floors, needs, quotas)
        cells = sample.fit_cells(have, floors, needs, quotas)
        assert bound <= best + 1e-6 and sample.deviation(cells, floors, needs, quotas) == best and (cells <= have).all() and cells.sum() == size


def test_driver_and_tasks_split_the_same_tree(spark):
    p = mixture.MixParams(driver_leaves=3)
    tree = mixture.splitting_tree([100, 7, 0, 33], 9, p.seed)
    got = mixture.shard_ranges(spark, ["a", "b", "c", "d"], [100, 7, 0, 33], 9, p).collect()
    assert {(r["source"], r["shard"]): r["hi"] - r["lo"] for r in got} == {("abcd"[j], i): int(tree[i, j]) for i in range(9) for j in range(4) if tree[i, j]}
    by = sorted((r["source"], r["lo"], r["hi"]) for r in got)
    assert all(a[2] == b[1] for a, b in zip(by, by[1:]) if a[0] == b[0])


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, None), (3, "")], "doc_id long, text string")
    got = {r["doc_id"]: r["n_tokens"] for r in with_token_counts(df, "text", ["doc_id"]).collect()}
    assert got == {1: len(encoder(VOCABULARY).encode_ordinary("hello world")), 2: 0, 3: 0}


def test_names_and_columns(spark, data):
    want = {
        "p1_found": ["root_id", "pair_id"], "p2_found": ["id_a", "id_b"], "p3_found": ["keep_id", "dup_id"], "p4_found": ["field_name", "category"],
        "p5_found": ["id_a", "id_b"], "p6_found": ["pack_name", "doc_id"], "p7_found": ["source"], "p8_found": ["doc_id", "subject"],
    }
    qs = queries()
    assert set(want) <= set(qs) and set(oracle_sql()) <= set(qs)
    for name in ("p4_found", "p6_found", "p7_found", "p8_found"):
        assert qs[name](spark, data).columns == want[name]
    assert qs["p8_composition"](spark, data).agg(F.count("subject")).first()[0] == 8
