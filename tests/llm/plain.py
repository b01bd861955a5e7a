"""Plain Python forms of the definitions, for comparison on small tables."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from itertools import combinations

WORD = re.compile(r"[^\W_]+")


def words(text):
    return tuple(WORD.findall(unicodedata.normalize("NFKC", text or "").casefold()))


def fields(text):
    folded = unicodedata.normalize("NFKC", text or "").casefold()
    for sep in (r"\|", ";", r"[\r\n]+(?=[^:=\r\n]*[:=])"):
        parts = [x for x in re.split(sep, folded) if WORD.search(x)]
        if len(parts) > 1 and all(re.match(r"[^:=]*[^\W_][^:=]*[:=]", x) for x in parts):
            return tuple(sorted(" ".join(WORD.findall(x)) for x in parts))
    return None


def equal(a, b):
    return words(a) == words(b) or (fields(a) is not None and fields(a) == fields(b))


def close(a, b):
    x, y = Counter(words(a)), Counter(words(b))
    n = max(sum(x.values()), sum(y.values()))
    return bool(n) and not equal(a, b) and 5 * sum((x & y).values()) >= 4 * n


def close_pairs(rows):
    """rows: (id, text)."""
    rows = [(i, t) for i, t in rows if words(t)]
    bags = {i: Counter(words(t)) for i, t in rows}
    texts = dict(rows)
    out = set()
    for a, b in combinations(sorted(bags), 2):
        n = max(sum(bags[a].values()), sum(bags[b].values()))
        if 5 * sum((bags[a] & bags[b]).values()) >= 4 * n and not equal(texts[a], texts[b]):
            out.add((a, b))
    return out


def first_equal(rows):
    """(keep, dup) by words in order, or by fields."""
    by_words, by_fields, out = {}, {}, set()
    for i, t in sorted((i, t) for i, t in rows if words(t)):
        f = fields(t)
        hits = [x for x in (by_words.get(words(t)), by_fields.get(f) if f else None) if x is not None]
        keep = min(hits, default=i)
        by_words.setdefault(words(t), keep)
        if f:
            by_fields.setdefault(f, keep)
        if keep != i:
            out.add((keep, i))
    return out


def query_of(row):
    """The text of a record's query."""
    group = row["sql_group"]
    if group is not None and group.strip():
        return group
    return row["orig_sql"] if row["orig_sql"] is not None else row["sql"]


def related_sets(rows, identity):
    """id -> root by union-find over query and contrast group within a round."""
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for r in rows:
        me = find(("id", r["pair_id"]))
        q = query_of(r)
        ties = [("q", identity(q))] if q else []
        if r["contrast_group"] is not None:
            ties.append(("c", r["contrast_group"], r["round"]))
        for t in ties:
            parent[find(t)] = find(("id", r["pair_id"]))
    low = {}
    for r in rows:
        root = find(("id", r["pair_id"]))
        low[root] = min(low.get(root, r["pair_id"]), r["pair_id"])
    return {r["pair_id"]: low[find(("id", r["pair_id"]))] for r in rows}


def parted(rows, identity):
    root = related_sets(rows, identity)
    splits = {}
    for r in rows:
        if r["split"] is not None:
            splits.setdefault(root[r["pair_id"]], set()).add(r["split"])
    return {(root[r["pair_id"]], r["pair_id"]) for r in rows if len(splits.get(root[r["pair_id"]], ())) > 1}


def overlaps(rows, identity):
    out = set()
    held = [r for r in rows if r["split"] in ("validation", "test")]
    train = [r for r in rows if r["split"] == "train"]
    near = close_pairs([(r["pair_id"], r["question"]) for r in held + train])
    key = {r["pair_id"]: (identity(query_of(r)) if query_of(r) else None) for r in held + train}
    text = {r["pair_id"]: (words(r["question"]), fields(r["question"])) for r in held + train}
    for h in held:
        for t in train:
            a, b = h["pair_id"], t["pair_id"]
            same = key[a] is not None and key[a] == key[b]
            (wa, fa), (wb, fb) = text[a], text[b]
            if same or (wa and wa == wb) or (fa is not None and fa == fb) or (min(a, b), max(a, b)) in near:
                out.add((min(a, b), max(a, b)))
    return out
