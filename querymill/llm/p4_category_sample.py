"""Sample matching target category proportions (problem 4).

One aggregation counts the cells (one category per field, at most the product of the targets' categories plus one each
for all others). On those counts the driver sets each field's quotas by largest remainder with floors and availability
caps, fits the cells to the quotas of all fields, and the rows of a cell with the smallest random keys are taken.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querymill.functions.labels import label_key
from querymill.operators.ranking import largest_remainder, random_key, rank_in_group

OTHER = ""


@dataclass(frozen=True)
class SampleParams:
    seed: int = 42
    part: int = 10  # one of so many rows
    rounds: int = 200  # of fitting


def _key(text: str) -> str:
    return "_".join(str(text).replace("-", " ").replace("_", " ").lower().split())


def _sums(cells: np.ndarray, axis: int) -> np.ndarray:
    return cells.sum(axis=tuple(i for i in range(cells.ndim) if i != axis))


def _along(values: np.ndarray, axis: int, ndim: int) -> np.ndarray:
    shape = [1] * ndim
    shape[axis] = -1
    return np.asarray(values, float).reshape(shape)


def _weights(n: int) -> np.ndarray:
    return np.r_[np.full(n - 1, 2), 1]


def deviation(cells: np.ndarray, floors: Sequence[Sequence[int]], needs: Sequence[Sequence[int]], quotas: Sequence[Sequence[int]]) -> float:
    """40 for each row below a category's floor, 4 for each row below a category's need, 2 for each row above its quota, 1 for each row of the unlisted (last) category."""
    total = 0.0
    for a in range(cells.ndim):
        s = _sums(cells, a)
        total += 36 * np.maximum(np.asarray(floors[a]) - s, 0).sum() + 4 * np.maximum(np.asarray(needs[a]) - s, 0).sum() + (_weights(len(s)) * np.maximum(s - np.asarray(quotas[a]), 0)).sum()
    return float(total)


def linear_program(a: np.ndarray, b: np.ndarray, cost: np.ndarray, upper: np.ndarray) -> tuple[np.ndarray, float]:
    """x with the least cost @ x, where a @ x = b >= 0 and 0 <= x <= upper, and that cost, by the two-phase bounded simplex method."""
    m, n = a.shape
    a, upper = np.hstack([a, np.eye(m)]), np.r_[upper, np.full(m, np.inf)]
    basis, high = np.arange(n, n + m), np.zeros(n + m, bool)
    x = np.zeros(n + m)
    for c in (np.r_[np.zeros(n), np.ones(m)], np.r_[cost, np.zeros(m)]):
        idle, last = 0, np.inf
        while True:
            inverse = np.linalg.inv(a[:, basis])
            x = np.where(high, np.where(np.isfinite(upper), upper, 0.0), 0.0)
            x[basis] = 0.0
            x[basis] = inverse @ (b - a @ x)
            reduced = c - (c[basis] @ inverse) @ a
            gain = np.where(high, reduced, -reduced)
            gain[basis] = 0.0
            gain[upper == 0] = 0.0
            value = float(c @ x)
            idle, last = (idle + 1, last) if value > last - 1e-9 else (0, value)
            good = np.flatnonzero(gain > 1e-9)
            if not len(good):
                break
            enter = int(good[0] if idle > 40 else good[np.argmax(gain[good])])  # the first one when idle: no cycles
            column = inverse @ a[:, enter] * (-1.0 if high[enter] else 1.0)
            room = np.full(m, np.inf)
            down, up = column > 1e-9, column < -1e-9
            room[down] = np.maximum(x[basis[down]], 0) / column[down]
            room[up] = np.maximum(upper[basis[up]] - x[basis[up]], 0) / -column[up]
            least = float(room.min())
            if least >= upper[enter]:
                high[enter] = not high[enter]
                continue
            ties = np.flatnonzero(room <= least + 1e-12)
            leave = int(ties[np.argmin(basis[ties])])
            high[basis[leave]] = bool(up[leave])
            basis[leave], high[enter] = enter, False
        upper[n:] = 0.0
    return x[:n], float(cost @ x[:n])


def least_deviation(available: np.ndarray, floors: Sequence[Sequence[int]], needs: Sequence[Sequence[int]], quotas: Sequence[Sequence[int]]) -> tuple[np.ndarray, float]:
    """Cells (fractions allowed) of the least deviation that the fields together leave open, and that deviation: a bound for any sample."""
    size, nd = sum(quotas[0]), available.ndim
    cells = np.flatnonzero(available.ravel())
    place = np.indices(available.shape).reshape(nd, -1)[:, cells]
    rows, cost, upper, constant = [], [], [], 0.0
    columns: list[tuple[int, float]] = []
    row = 1
    for a in range(nd):
        weights = _weights(available.shape[a])
        for i in range(available.shape[a]):
            f, n, q = int(floors[a][i]), int(needs[a][i]), int(quotas[a][i])
            constant += 36 * f + 4 * n
            points = sorted({0, f, n, q})
            for lo, hi in zip(points, [*points[1:], np.inf]):
                cost.append(-36.0 * (hi <= f) - 4.0 * (hi <= n) + float(weights[i]) * (lo >= q))
                upper.append(hi - lo)
                columns.append((row, -1.0))
            rows.append(place[a] == i)
            row += 1
    matrix = np.zeros((row, len(cells) + len(columns)))
    matrix[0, : len(cells)] = 1.0
    for r, members in enumerate(rows, 1):
        matrix[r, : len(cells)] = members
    for k, (r, v) in enumerate(columns):
        matrix[r, len(cells) + k] = v
    b = np.zeros(row)
    b[0] = size
    x, value = linear_program(matrix, b, np.r_[np.zeros(len(cells)), cost], np.r_[available.ravel()[cells].astype(float), upper])
    out = np.zeros(available.size)
    out[cells] = x[: len(cells)]
    return out.reshape(available.shape), value + constant


def whole_cells(x: np.ndarray, available: np.ndarray, size: int) -> np.ndarray:
    """Whole numbers near x within available that sum to size, by largest remainder."""
    flat = largest_remainder((x.ravel() + 1e-9 * available.ravel()).tolist(), size, None, available.ravel().tolist())
    return np.asarray(flat, np.int64).reshape(available.shape)


def moved_cells(cells: np.ndarray, available: np.ndarray, floors, needs, quotas, bound: float, level_moves: int = 150, wide: int = 512) -> np.ndarray:
    """cells after moves of single rows that lower the deviation, or keep it for at most level_moves in a row, until bound is met.

    Of many cells the `wide` most promising ones to add to and to take from are weighed against each other.
    """
    nd = cells.ndim
    place = np.indices(cells.shape).reshape(nd, -1)
    have = available.ravel()
    rng = np.random.default_rng(0)
    cost, idle = deviation(cells, floors, needs, quotas), 0
    best, least = cells, cost
    while least > bound + 1e-6 and idle <= level_moves:
        flat, up, down = cells.ravel(), [], []
        for a in range(nd):
            s, floor, need, quota = _sums(cells, a), np.asarray(floors[a]), np.asarray(needs[a]), np.asarray(quotas[a])
            w = _weights(len(s))
            up.append((np.where(s < floor, 36, 0) + np.where(s < need, 4, 0) - np.where(s >= quota, w, 0))[place[a]])
            down.append((np.where(s > quota, w, 0) - np.where(s <= need, 4, 0) * (s > 0) - np.where(s <= floor, 36, 0) * (s > 0))[place[a]])
        more, less = np.flatnonzero(flat < have), np.flatnonzero(flat > 0)
        if not len(more) or not len(less):
            break
        more = more[np.argsort(-sum(up)[more] + rng.random(len(more)) / 2)[:wide]]
        less = less[np.argsort(-sum(down)[less] + rng.random(len(less)) / 2)[:wide]]
        gain = np.zeros((len(more), len(less)))
        for a in range(nd):
            apart = place[a][more][:, None] != place[a][less][None, :]
            gain += np.where(apart, up[a][more][:, None] + down[a][less][None, :], 0)
        gain[more[:, None] == less[None, :]] = -99
        top = np.flatnonzero(gain == gain.max())
        i, j = np.unravel_index(top[rng.integers(len(top))], gain.shape)
        if gain[i, j] < 0:
            break
        after = flat.copy()
        after[more[i]] += 1
        after[less[j]] -= 1
        cells = after.reshape(cells.shape)
        cost -= gain[i, j]
        if cost < least:
            best, least, idle = cells, cost, 0
        else:
            idle += 1
    return best


def fit_cells(available: np.ndarray, floors: Sequence[Sequence[int]], needs: Sequence[Sequence[int]], quotas: Sequence[Sequence[int]], rounds: int = 200) -> np.ndarray:
    """Integer cells within available that sum to the size of the sample, with axis sums near the quotas.

    A linear program finds the least deviation that all fields together leave open; its cells, made whole, give the sums of
    every category. Cells with these sums that spread over all combinations (proportional fitting with caps) are taken
    where whole ones are found, else those of the program. A scarce category may draw rows whose other fields are unlisted.
    """
    size, nd = sum(quotas[0]), available.ndim
    fraction, bound = least_deviation(available, floors, needs, quotas)
    exact = moved_cells(whole_cells(fraction, available, size), available, floors, needs, quotas, bound)
    sums = [_sums(exact, a) for a in range(nd)]
    x = available * (size / max(1, available.sum()))
    for _ in range(rounds):
        for a in range(nd):
            now = _sums(x, a)
            factor = np.divide(sums[a].astype(float), now, out=np.zeros(len(now)), where=now > 0)
            x = np.minimum(x * _along(factor, a, nd), available)
    none = [np.zeros(len(s), np.int64) for s in sums]
    spread = moved_cells(whole_cells(x, available, size), available, none, sums, sums, 0.0, 400)
    same = all((_sums(spread, a) == sums[a]).all() for a in range(nd))
    return spread if same else exact


class CategorySample:
    """The plan of a sample: quotas, cells and the report; rows() draws it.

    fields: column -> expression of its category as text. Labels are compared by label_key; a null or unlisted label is
    'other', which has no target and is drawn from only where the listed categories cannot fill the sample.
    """

    def __init__(self, df: DataFrame, targets: DataFrame, fields: dict[str, Column], id_col: str = "pair_id", p: SampleParams = SampleParams()):
        self.p, self.id_col, self.names = p, id_col, list(fields)
        self.targets = [r.asDict() for r in targets.collect()]
        self.lists = {f: [r["category"] for r in self.targets if r["field_name"] == f] for f in self.names}
        keyed = {}
        for f, e in fields.items():
            known = [_key(c) for c in self.lists[f]]
            k = label_key(e.cast("string"))
            keyed[f] = F.when(k.isin(known), k).otherwise(F.lit(OTHER))
        self.cells_df = df.select(F.col(id_col), *[e.alias(f) for f, e in keyed.items()])
        self.counts = [r.asDict() for r in self.cells_df.groupBy(*self.names).agg(F.count(F.lit(1)).alias("n")).collect()]
        self.total = sum(r["n"] for r in self.counts)
        self.size = self.total // p.part
        self._plan()

    def _plan(self) -> None:
        self.index = {f: {_key(c): i for i, c in enumerate(self.lists[f])} | {OTHER: len(self.lists[f])} for f in self.names}
        shape = tuple(len(self.index[f]) for f in self.names)
        self.available = np.zeros(shape, np.int64)
        for r in self.counts:
            self.available[tuple(self.index[f][r[f]] for f in self.names)] += r["n"]
        axes = range(len(shape))
        quotas, needs, least, self.margins = [], [], [], []
        for a, f in enumerate(self.names):
            have = self.available.sum(axis=tuple(i for i in axes if i != a))
            self.margins.append(have)
            goal = {_key(r["category"]): r for r in self.targets if r["field_name"] == f}
            weights = [float(goal[_key(c)]["target_share"]) for c in self.lists[f]] + [0.0]
            floors = [int(goal[_key(c)]["min_rows"] or 0) for c in self.lists[f]] + [0]
            quotas.append(largest_remainder(weights, self.size, floors, have.tolist()))
            least.append([min(int(h), f) for h, f in zip(have, floors)])
            needs.append([min(int(h), max(f, int(np.ceil(w * self.size - 1e-9)))) for h, f, w in zip(have, floors, weights)])
        self.quotas = quotas
        self.cells = fit_cells(self.available, least, needs, quotas, self.p.rounds) if self.size else np.zeros(shape, np.int64)

    def drawn(self) -> list[int]:
        """Drawn rows of each row of the targets, counted over the sample itself."""
        counts = self.rows().groupBy(*self.names).agg(F.count(F.lit(1)).alias("n")).collect()  # at most a row per cell
        per: dict[tuple[str, str], int] = {}
        for r in counts:
            for f in self.names:
                per[f, r[f]] = per.get((f, r[f]), 0) + r["n"]
        return [per.get((t["field_name"], _key(t["category"])), 0) for t in self.targets]

    def report(self) -> list[tuple]:
        """(field_name, category, target_share, needed_rows, available_rows, drawn_rows, shortfall, can_be_met, cause) per row of the targets.

        shortfall: rows by which the sample stays below the need; can_be_met: it does not. cause: 'too few records' where the table
        itself has fewer rows than needed, else 'other targets' where rows were left because the fields' targets exclude each other.
        """
        out = []
        for r, drawn in zip(self.targets, self.drawn()):
            a = self.names.index(r["field_name"])
            i = self.index[r["field_name"]][_key(r["category"])]
            need = max(Decimal(r["min_rows"] or 0), Decimal(str(r["target_share"])) * self.size)
            have, lack = int(self.margins[a][i]), max(Decimal(0), need - drawn)
            cause = None if not lack else "too few records" if have < need else "other targets"
            out.append((r["field_name"], r["category"], float(r["target_share"]), float(need), have, drawn, float(lack), not lack, cause))
        return out

    def report_df(self, spark) -> DataFrame:
        return spark.createDataFrame(
            self.report(),
            "field_name string, category string, target_share double, needed_rows double, available_rows long, drawn_rows long, shortfall double, can_be_met boolean, cause string",
        )

    def rows(self) -> DataFrame:
        """The drawn ids with their categories; exactly the planned number of rows of each cell."""
        spark = self.cells_df.sparkSession
        back = {f: {i: k for k, i in self.index[f].items()} for f in self.names}
        quota = [(*[back[f][i] for f, i in zip(self.names, idx)], int(n)) for idx, n in np.ndenumerate(self.cells) if n]
        ddl = ", ".join(f"{f} string" for f in self.names) + ", quota long"
        wanted = self.cells_df.join(spark.createDataFrame(quota, ddl), self.names)
        ranked = rank_in_group(wanted, self.names, random_key(self.p.seed, self.id_col), [self.id_col], limit=F.col("quota"))
        return ranked.where("rank <= quota").select(self.id_col, *self.names)


def pairs_sample(df: DataFrame, targets: DataFrame, p: SampleParams = SampleParams()) -> CategorySample:
    """The sample of pairs by family, style and source. An empty table gives an empty sample and a report of shortfalls."""
    return CategorySample(df, targets, {c: F.col(c) for c in ("family", "style", "source")}, p=p)


def unmet(df: DataFrame, targets: DataFrame, p: SampleParams = SampleParams()) -> DataFrame:
    """(field_name, category) of the targets that the drawn sample misses because there are fewer records than needed."""
    plan = pairs_sample(df, targets, p)
    return plan.report_df(df.sparkSession).where("shortfall > 0 and cause = 'too few records'").select("field_name", "category")
