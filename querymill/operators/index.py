"""A block of a table's rows in a task, with an index of each column, and what it says of statements.

A column is its sorted distinct values and a code for each row (null: -1), so that every condition is a few ranges of codes,
and the rows of a range lie together in the index. Only the rows of a statement's most selective condition are looked at.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from querymill.dialect.statement import like_mode

#: n rows, halves of the sums of their hashes (of one row: the hashes); c values, their sum s, the smallest or largest m; key or tie-break k; order o. l, d and t: whole numbers, doubles, text.
PARTS = "i long, way string, n long, a1 long, a0 long, b1 long, b0 long, c long, s double, ml long, md double, mt string, kl long, kd double, kt string, ol long, od double, ot string"
SCHEMA = pa.schema([(f.split()[0], {"long": pa.int64(), "double": pa.float64(), "string": pa.string()}[f.split()[1]]) for f in PARTS.split(", ")])
FLUSH = 1 << 16
Ranges = list[tuple[int, int]]


class IndexedColumn:
    def __init__(self, values: pa.ChunkedArray):
        null = values.is_null().to_numpy().astype(bool)
        self.kind = "t" if pa.types.is_string(values.type) or pa.types.is_large_string(values.type) else "d" if pa.types.is_floating(values.type) else "l"
        self.codes = np.full(len(values), -1, np.int64)
        if self.kind == "t":
            coded = values.combine_chunks().dictionary_encode()
            words = coded.dictionary.to_pylist()
            order = sorted(range(len(words)), key=words.__getitem__)
            at = np.empty(len(words), np.int64)
            at[order] = np.arange(len(words))
            self.values = [words[k] for k in order]
            self.codes[~null] = at[pc.fill_null(coded.indices, 0).to_numpy(zero_copy_only=False)[~null]] if words else 0
            self.n = len(words)
        else:
            self.raw = pc.fill_null(values, 0).to_numpy()
            distinct, codes = np.unique(self.raw[~null], return_inverse=True)
            self.codes[~null] = codes
            self.n = len(distinct)
            self.values = distinct[~np.isnan(distinct)].tolist() if self.kind == "d" else distinct.tolist()
        self.likes: dict[str, Ranges] = {}

    @cached_property
    def start(self) -> list[int]:
        """Where the rows of each code begin in the index."""
        return np.cumsum(np.bincount(self.codes + 1, minlength=self.n + 1)).tolist()

    @cached_property
    def order(self) -> np.ndarray:
        return np.argsort(self.codes, kind="stable")

    def told(self, codes: np.ndarray) -> list:
        """Values of codes; not-a-number is the last code of a column that has it."""
        values = self.values if len(self.values) == self.n else [*self.values, float("nan")]
        return [values[c] if c >= 0 else None for c in codes.tolist()]

    def ranges(self, op: str, values: list) -> Ranges:
        """Codes that meet a condition."""
        v, n = self.values, self.n
        if op == "BETWEEN":
            return [(bisect_left(v, values[0]), bisect_right(v, values[1]))]
        if op == "LIKE":
            return self._like(values[0])
        if op in ("=", "IN"):
            return [(bisect_left(v, x), bisect_right(v, x)) for x in set(values)]
        lo, hi = bisect_left(v, values[0]), bisect_right(v, values[0])
        return {"!=": [(0, lo), (hi, n)], "<": [(0, lo)], "<=": [(0, hi)], ">": [(hi, n)], ">=": [(lo, n)]}[op]

    def _like(self, pattern: str) -> Ranges:
        if pattern not in self.likes:
            mode, part = like_mode(pattern)
            test = {"prefix": str.startswith, "suffix": str.endswith, "contains": str.__contains__}[mode]
            self.likes[pattern] = [(k, k + 1) for k, x in enumerate(self.values) if test(x, part)]
        return self.likes[pattern]

    def count(self, ranges: Ranges) -> int:
        return sum(self.start[hi] - self.start[lo] for lo, hi in ranges if lo < hi)

    def rows(self, ranges: Ranges) -> np.ndarray:
        found = [self.order[self.start[lo] : self.start[hi]] for lo, hi in ranges if lo < hi]
        return found[0] if len(found) == 1 else np.concatenate(found) if found else self.order[:0]

    def within(self, rows: np.ndarray, ranges: Ranges) -> np.ndarray:
        codes = self.codes[rows]
        if len(ranges) > 3:
            meets = np.zeros(self.n + 1, bool)  # null's code, -1, is the last
            for lo, hi in ranges:
                meets[lo:hi] = True
            return meets[codes]
        out = np.zeros(len(rows), bool)
        for lo, hi in ranges:
            out |= codes == lo if hi == lo + 1 else (codes >= lo) & (codes < hi)
        return out


class Rows:
    def __init__(self, table: pa.Table):
        self.n = table.num_rows
        self.table = table
        self.columns: dict[str, IndexedColumn] = {}
        self.hashes: dict[str, np.ndarray] = {}

    def column(self, name: str) -> IndexedColumn:
        if name not in self.columns:
            self.columns[name] = IndexedColumn(self.table.column(name))
        return self.columns[name]

    def hash(self, which: str, shown: str, rows: np.ndarray) -> np.ndarray:
        name = f"{which}:{shown}"
        if name not in self.hashes:
            self.hashes[name] = self.table.column(name).to_numpy()
        return self.hashes[name][rows]

    def conditions(self, s: dict, value: float | None) -> list[tuple[int, IndexedColumn, Ranges]]:
        """(rows that meet it, column, ranges) of each condition; value is the subquery's, null meets nothing."""
        conds = []
        for name, op, values in s["where"]:
            c = self.column(name)
            values = [value] if values is None else values
            ranges = [] if None in values else c.ranges(op, values)
            conds.append((c.count(ranges), c, ranges))
        return conds

    def number(self, s: dict, value: float | None) -> int:
        """How many rows meet a statement's conditions. Those that all or no rows meet are not looked at."""
        conds = self.conditions(s, value)
        some = [x for x in conds if 0 < x[0] < self.n]
        if s["or"] and len(conds) > 1:
            if any(n == self.n for n, _, _ in conds):
                return self.n
            if len(some) < 2:
                return some[0][0] if some else 0
            met = np.zeros(self.n, bool)
            for _, c, ranges in some:
                met[c.rows(ranges)] = True
            return int(np.count_nonzero(met))
        if any(n == 0 for n, _, _ in conds):
            return 0
        if len(some) < 2:
            return some[0][0] if some else self.n
        some.sort(key=lambda x: x[0])
        rows = some[0][1].rows(some[0][2])
        for _, c, ranges in some[1:-1]:
            rows = rows[c.within(rows, ranges)]
        return int(np.count_nonzero(some[-1][1].within(rows, some[-1][2])))

    def matching(self, s: dict, value: float | None) -> np.ndarray:
        """Rows that meet a statement's conditions, in their order."""
        conds = self.conditions(s, value)
        if not conds:
            return np.arange(self.n)
        if s["or"] and len(conds) > 1:
            found = np.concatenate([c.rows(ranges) for _, c, ranges in conds])
            return np.unique(found)
        conds.sort(key=lambda x: x[0])
        rows = conds[0][1].rows(conds[0][2])
        for _, c, ranges in conds[1:]:
            rows = rows[c.within(rows, ranges)]
        return np.sort(rows)


def _added(x: np.ndarray) -> float:
    """The sum from first to last, as the engine adds."""
    return float(np.add.accumulate(x)[-1]) if len(x) else 0.0


def _flat(t: Rows, s: dict, rows: np.ndarray) -> dict[str, list]:
    a, b = (t.hash(k, s["show"], rows) for k in "ab")
    return {"n": [len(rows)]} | {k: [int(x)] for k, x in (("a1", (a >> 32).sum()), ("a0", (a & 0xFFFFFFFF).sum()), ("b1", (b >> 32).sum()), ("b0", (b & 0xFFFFFFFF).sum()))}


def _sorted(t: Rows, s: dict, rows: np.ndarray) -> dict[str, list]:
    """All matching rows; with LIMIT those that can be among the first here, and what ties with them."""
    order, tie = t.column(s["order"]), t.column(s["tie"])
    if s["k"] is not None and len(rows) > s["k"]:
        place = (order.codes[rows] * (-1 if s["down"] else 1)) * (tie.n + 2) + tie.codes[rows] * (-1 if s["tie_down"] else 1)
        rows = rows[place <= np.partition(place, s["k"] - 1)[s["k"] - 1]]
    hashes = {k: t.hash(k[0], s["show"], rows).tolist() for k in ("a1", "b1")}
    return hashes | {"o" + order.kind: order.told(order.codes[rows]), "k" + tie.kind: tie.told(tie.codes[rows])}


def _aggregate(t: Rows, s: dict, rows: np.ndarray) -> dict[str, list]:
    out: dict[str, list] = {"n": [len(rows)]}
    if s["f"] == "COUNT":
        return out
    c = t.column(s["of"])
    rows = rows[c.codes[rows] >= 0]
    out["c"] = [len(rows)]
    if not len(rows):
        return out
    if s["f"] in ("SUM", "AVG"):
        return out | {"s": [_added(c.raw[rows]) if c.kind == "d" else float(c.raw[rows].sum())]}
    codes = c.codes[rows]
    return out | {"m" + c.kind: c.told(np.array([codes.min() if s["f"] == "MIN" else codes.max()]))}


def _grouped(t: Rows, s: dict, rows: np.ndarray) -> dict[str, list]:
    key = t.column(s["by"])
    codes, group, n = np.unique(key.codes[rows], return_inverse=True, return_counts=True)
    out: dict[str, list] = {"k" + key.kind: key.told(codes), "n": n.tolist()}
    if s["f"] == "COUNT" or not len(rows):
        return out
    c = t.column(s["of"])
    known = c.codes[rows] >= 0
    rows, group = rows[known], group[known]
    counts = np.bincount(group, minlength=len(codes))
    out["c"] = counts.tolist()
    if s["f"] in ("SUM", "AVG"):
        return out | {"s": np.bincount(group, c.raw[rows], len(codes)).tolist()}
    best = np.full(len(codes), -1)
    by = np.argsort(group, kind="stable")
    filled = np.flatnonzero(counts)
    if len(filled):
        begins = (np.cumsum(counts) - counts)[filled]
        best[filled] = (np.minimum if s["f"] == "MIN" else np.maximum).reduceat(c.codes[rows][by], begins)
    return out | {"m" + c.kind: c.told(best)}


WAYS = {"flat": _flat, "first": _sorted, "sorted": _sorted, "aggregate": _aggregate, "group": _grouped}


def part_rows(t: Rows, items: list[tuple[int, dict, float | None]]) -> Iterator[pa.RecordBatch]:
    """PARTS of the rows for every statement: (number, spec, value of the subquery)."""
    held: dict[str, list] = {f.name: [] for f in SCHEMA}
    for i, s, value in items:
        part = {"n": [t.number(s, value)]} if s["way"] == "count" else WAYS[s["way"]](t, s, t.matching(s, value))
        n = max(map(len, part.values()))
        part |= {"i": [i] * n, "way": [s["way"]] * n}
        for name, column in held.items():
            column.extend(part.get(name) or [None] * n)
        if len(held["i"]) >= FLUSH:
            yield _batch(held)
    yield _batch(held)


def _batch(held: dict[str, list]) -> pa.RecordBatch:
    out = pa.RecordBatch.from_arrays([pa.array(held[f.name], f.type) for f in SCHEMA], schema=SCHEMA)
    for column in held.values():
        column.clear()
    return out
