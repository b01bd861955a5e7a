"""Drawing statements of the dialect: conditions, orders, groups and subqueries from pools of literals.

A draw is a function of its number and the seed, so any number of tasks draw the same statements. Pools are bounded samples of
the tables' values (their size is a parameter of the operator); a statement against the rules of the dialect is dropped.
"""

from __future__ import annotations

import random
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querymill.dialect.catalog import Catalog, Table
from querymill.dialect.rules import violations
from querymill.dialect.statement import Aggregate, Predicate, Statement, Subselect
from querymill.operators.ranking import hash_rank
from querymill.operators.sampling import seeded

# Shares of a workload.
CONDITIONS = {0: 5, 1: 35, 2: 40, 3: 20}
LIMITS = {1: 35, 2: 6, 3: 15, 4: 3, 5: 15, 6: 2, 7: 2, 8: 2, 9: 2, 10: 15}
FAMILIES = {"aggregate": 30, "group": 25, "having": 25, "scalar_subquery": 20}
ROUND_PRICES = (5, 10, 15, 20, 25, 30, 40, 50, 60, 75, 80, 100, 120, 150)
MODES = {"prefix": "{}%", "suffix": "%{}", "contains": "%{}%"}


@dataclass(frozen=True)
class Shares:
    in_list: float = 0.10
    in_list_unique: float = 0.5
    three_values: float = 0.4
    either: float = 0.04  # OR between conditions
    order: float = 0.5
    limit: float = 0.85
    id_weight: float = 0.5
    missing_id: float = 0.2
    round_number: float = 0.5
    ends_99: float = 0.4
    tables: Mapping[str, float] = field(default_factory=lambda: {"customers": 1.0, "items": 1.0, "orders": 1.6})


@dataclass(frozen=True)
class Pools:
    """values and missing: (table, column) -> literals; fragments: (table, column) -> mode -> texts; bounds: (table, group key,
    aggregate) -> values that groups really have."""

    values: Mapping[tuple[str, str], list]
    missing: Mapping[tuple[str, str], list]
    fragments: Mapping[tuple[str, str], Mapping[str, list[str]]]
    bounds: Mapping[tuple[str, str, str], list[float]]


def literal_pools(spark: SparkSession, directory: str, catalog: Catalog, banned: DataFrame | None = None, size: int = 2_000, seed: int = 42) -> Pools:
    """Up to `size` values of every column by seeded hash, without those of banned (tbl, col, value). Also fragments of names that are
    no whole name, ids that do not occur, and up to `size` group values of each aggregate."""
    values, missing, fragments, bounds = {}, {}, {}, {}
    for t in catalog.tables.values():
        df = catalog.load(spark, directory, t.name)
        for c, kind in t.columns.items():
            free = df.select(F.col(c).alias("v")).where("v is not null").distinct()
            if kind == "date":
                free = free.where(F.col("v").try_cast("date").cast("string") == F.col("v"))
            if banned is not None:
                out = banned.where((F.col("tbl") == t.name) & (F.col("col") == c)).select(F.col("value").alias("__b"))
                free = free.join(out, F.col("v").cast("string") == F.col("__b"), "left_anti")
            values[t.name, c] = sorted(r["v"] for r in free.orderBy(seeded(seed, "v"), "v").limit(size).collect())
            if kind == "id" and values[t.name, c]:
                row = df.agg(F.min(c).alias("lo"), F.max(c).alias("hi")).first()
                span = spark.range(row["lo"], row["hi"] + 1).select(F.col("id").alias("v")).join(df.select(F.col(c).alias("v")).distinct(), "v", "left_anti")
                gap = [r["v"] for r in span.orderBy("v").limit(size).collect()]
                missing[t.name, c] = gap or [row["hi"] + 1 + i for i in range(10)]
            if kind == "name" and t.is_text(c):
                names = set(values[t.name, c])
                cut: dict[str, set[str]] = {"prefix": set(), "suffix": set(), "contains": set()}
                for name in names:
                    cut["prefix"] |= {name[:k] for k in (1, 2)}
                    cut["suffix"] |= {name[-k:] for k in (2, 3)}
                    cut["contains"] |= {name[i : i + k] for k in (2, 3) for i in range(1, len(name) - k)}
                fragments[t.name, c] = {m: sorted(f for f in fs if f.isascii() and f.isalpha() and f.islower() and f not in names) for m, fs in cut.items()}
        for g in t.groups:
            aggregates = [Aggregate("COUNT"), *[Aggregate(f, c) for c in t.numbers() for f in ("SUM", "AVG", "MIN", "MAX")]]
            one = lambda a: F.count(F.lit(1)) if a.function == "COUNT" else getattr(F, a.function.lower())(a.column)
            wide = df.groupBy(g).agg(*[one(a).cast("double").alias(f"v{i}") for i, a in enumerate(aggregates)])
            some = wide.orderBy(seeded(seed, g), g).limit(size).collect()
            for i, a in enumerate(aggregates):
                bounds[t.name, g, str(a)] = sorted({round(r[f"v{i}"], 2) for r in some if r[f"v{i}"] is not None})
    return Pools(values, missing, fragments, bounds)


class Sampler:
    """Draws one statement at a time from a random.Random."""

    def __init__(self, catalog: Catalog, pools: Pools, shares: Shares = Shares()):
        self.catalog, self.pools, self.shares = catalog, pools, shares

    def bound(self, rng: random.Random, t: Table, column: str) -> float | int:
        """A value for a comparison: half of them round numbers; prices end in .99 at times."""
        known = [v for v in self.pools.values[t.name, column] if isinstance(v, (int, float))]
        hi = max(known, default=10)
        if column in t.floats:
            if rng.random() < self.shares.round_number:
                return float(rng.choice([p for p in ROUND_PRICES if p <= hi] or [5]))
            return rng.randint(1, max(1, int(hi) - 1)) + 0.99 if rng.random() < self.shares.ends_99 else round(rng.uniform(1, max(2.0, hi)), 2)
        step = 5 if hi >= 50 else 1
        return rng.randrange(0, int(hi) + 1, step) if rng.random() < self.shares.round_number else rng.randint(0 if hi >= 50 else 1, max(1, int(hi)))

    def equal(self, rng: random.Random, t: Table, column: str):
        if t.columns[column] == "id" and self.pools.missing.get((t.name, column)) and rng.random() < self.shares.missing_id:
            return rng.choice(self.pools.missing[t.name, column])
        return rng.choice(self.pools.values[t.name, column])

    def in_list(self, rng: random.Random, t: Table, column: str, k: int | None = None, include=None) -> Predicate | None:
        """IN with k different values (2 or 3), with include among them if given; None when the pool is too small."""
        k = k or (3 if rng.random() < self.shares.three_values else 2)
        got = [] if include is None else [include]
        for _ in range(10 * k):
            v = self.equal(rng, t, column)
            got += [v] if v not in got and len(got) < k else []
        rng.shuffle(got)
        return Predicate(column, "IN", tuple(got)) if len(got) == k else None

    def operator(self, rng: random.Random, t: Table, column: str) -> str:
        ops = t.operators(column)
        share = self.shares.in_list_unique if column in t.unique else self.shares.in_list
        if "IN" in ops and rng.random() < share:
            return "IN"
        return rng.choice([o for o in ops if o != "IN"])

    def condition(self, rng: random.Random, t: Table, column: str, op: str | None = None) -> Predicate | None:
        op = op or self.operator(rng, t, column)
        if not self.pools.values[t.name, column]:
            return None
        if op == "IN":
            return self.in_list(rng, t, column)
        if op == "LIKE":
            mode = rng.choice(sorted(MODES))
            texts = self.pools.fragments.get((t.name, column), {}).get(mode)
            return Predicate(column, op, (MODES[mode].format(rng.choice(texts)),)) if texts else None
        free = op in ("=", "!=") or t.columns[column] == "date"
        value = (lambda: self.equal(rng, t, column)) if free else (lambda: self.bound(rng, t, column))
        if op == "BETWEEN":
            lo, hi = sorted((value(), value()))
            return Predicate(column, op, (lo, hi)) if lo < hi else None
        return Predicate(column, op, (value(),))

    def columns(self, rng: random.Random, t: Table, k: int, without: Sequence[str] = ()) -> list[str]:
        """k different columns; ids have id_weight, others 1."""
        left, out = [c for c in t.columns if c not in without], []
        while left and len(out) < k:
            c = rng.choices(left, [self.shares.id_weight if t.columns[c] == "id" else 1.0 for c in left])[0]
            out.append(c)
            left.remove(c)
        return out

    def table(self, rng: random.Random) -> Table:
        names = sorted(self.catalog.tables)
        return self.catalog.tables[rng.choices(names, [self.shares.tables.get(n, 1.0) for n in names])[0]]

    def flat(self, rng: random.Random, cell: tuple[str, str, str] | None = None, pin: tuple[str, str, str, object] | None = None, fixed: tuple[str, str, object] | None = None, existence: bool = False) -> Statement | None:
        """A projection. cell: (table, column, operator) of one condition; pin: one whole condition; fixed: an equality with a
        given value; existence: one equality that shows its own column."""
        forced = cell or pin or fixed
        t = self.catalog.tables[forced[0]] if forced else self.table(rng)
        n = 1 if existence else rng.choices(list(CONDITIONS), list(CONDITIONS.values()))[0]
        n = max(n, 1) if forced else n
        first = None
        if pin:
            first = Predicate(pin[1], pin[2], (pin[3],))
        elif fixed:
            first = Predicate(fixed[1], "=", (fixed[2],))
        elif cell:
            first = self.condition(rng, t, cell[1], cell[2])
        rest = self.columns(rng, t, n - 1 if forced else n, [forced[1]] if forced else ())
        conds = ([first] if forced else []) + [self.condition(rng, t, c, "=" if existence else None) for c in rest]
        if any(c is None for c in conds):
            return None
        conn = None if len(conds) < 2 else "OR" if rng.random() < self.shares.either else "AND"
        equal = {c.column for c in conds if c.op in ("=", "IN")}
        sortable = [c for c in t.columns if t.orderable(c) and c not in equal]
        order = limit = None
        if not existence and sortable and rng.random() < self.shares.order:
            order = (rng.choice(sortable), rng.choice(("ASC", "DESC")))
            if rng.random() < self.shares.limit:
                limit = rng.choices(list(LIMITS), list(LIMITS.values()))[0]
        select = conds[0].column if existence else rng.choice([*t.columns, "*"])
        return self.checked(Statement(t.name, select, None, tuple(conds), conn, order=order, limit=limit))

    def row_conditions(self, rng: random.Random, t: Table, forced: Sequence[str] = ()) -> tuple[Predicate, ...]:
        """Up to two conditions joined by AND; forced: kinds of columns that must occur."""
        cols = [next(iter(rng.sample([c for c, k in t.columns.items() if k == kind], 1)), None) for kind in forced if kind in t.columns.values()]
        k = max(len(cols), rng.choices((0, 1, 2), (30, 50, 20))[0])
        cols += rng.sample([c for c in t.columns if c not in cols], min(k - len(cols), len(t.columns) - len(cols)))
        return tuple(p for p in (self.condition(rng, t, c) for c in cols) if p is not None)

    def advanced(self, rng: random.Random, family: str | None = None, table: str | None = None, forced: Sequence[str] = ()) -> Statement | None:
        """An aggregate, a group, a group with HAVING, or a scalar subquery. A HAVING bound is a value that groups really have."""
        family = family or rng.choices(list(FAMILIES), list(FAMILIES.values()))[0]
        t = self.catalog.tables[table] if table else self.table(rng)
        conds = self.row_conditions(rng, t, forced)
        if family == "scalar_subquery":
            if not t.numbers():
                return None
            c = rng.choice(t.numbers())
            sub = Subselect(Aggregate(rng.choice(("AVG", "MIN", "MAX")), c), self.row_conditions(rng, t))
            outer = tuple(p for p in conds if p.column != c) + (Predicate(c, rng.choice(("<", ">", "<=", ">=", "=")), (), sub),)
            return self.checked(Statement(t.name, rng.choice(("*", t.ident, c)), None, outer, "AND" if len(outer) > 1 else None))
        choices = [Aggregate("COUNT"), *[Aggregate(f, c) for c in t.numbers() for f in ("SUM", "AVG", "MIN", "MAX")]]
        if family != "having":
            choices += [Aggregate(f, c) for c, k in t.columns.items() if k == "date" for f in ("MIN", "MAX")]
        agg = rng.choice(choices)
        s = Statement(t.name, "*", agg, conds, "AND" if len(conds) > 1 else None, None if family == "aggregate" else rng.choice(t.groups))
        if family == "having":
            known = self.pools.bounds.get((t.name, s.group, str(agg))) or [0.0]
            s = replace(s, having=(rng.choice(("=", "!=", ">", ">=", "<", "<=")), float(rng.choice(known))))
        if s.group and rng.random() < 0.5:
            s = replace(s, order=(str(agg), rng.choice(("ASC", "DESC"))), limit=rng.choice((1, 3, 5, 10)) if rng.random() < 0.6 else None)
        return self.checked(s)

    def checked(self, s: Statement) -> Statement | None:
        s = s.with_default_tie(self.catalog).canonical(self.catalog)
        return None if violations(s, self.catalog) else s


def drawn_statements(spark: SparkSession, sampler: Sampler, n: int, seed: int = 42, family: str | None = "flat", **forced) -> DataFrame:
    """(draw, sql, table_name, query_kind): n draws, those that break a rule left out, each statement once (its first draw). family:
    flat, a family of FAMILIES, or None for any of these. forced goes to the sampler."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i in b["id"]:
                rng = random.Random(f"{seed}:{i}")
                s = sampler.flat(rng, **forced) if family == "flat" else sampler.advanced(rng, family, **forced)
                if s is not None:
                    out.append((int(i), s.render(sampler.catalog), s.table, s.kind))
            yield pd.DataFrame(out, columns=["draw", "sql", "table_name", "query_kind"])

    rows = spark.range(n).mapInPandas(run, "draw long, sql string, table_name string, query_kind string")
    first = rows.groupBy("sql").agg(F.min(F.struct("draw", "table_name", "query_kind")).alias("m"))
    return first.select("m.draw", "sql", "m.table_name", "m.query_kind")


def lookups(spark: SparkSession, pools: Pools, catalog: Catalog, held: float = 0.2, id_share: float = 0.3, seed: int = 42) -> DataFrame:
    """(sql, table_name, where_col, select_cols, part): every literal of the pools as an equality, with every projection of its
    table. Of each table, column and projection the share `held` goes to evaluation, the rest to train, by seeded hash; conditions
    on ids are cut to id_share of all, those with the smallest hash staying."""
    rows = [(t.name, c, str(v), s, Statement(t.name, s, None, (Predicate(c, "=", (v,)),)).render(catalog), k == "id")
            for t in catalog.tables.values() for c, k in t.columns.items() for v in pools.values[t.name, c] for s in ("*", *t.columns)]
    df = spark.createDataFrame(rows, "table_name string, where_col string, value string, select_cols string, sql string, is_id boolean")
    n_other = df.where("not is_id").count()
    most = int(id_share / (1 - id_share) * n_other) if id_share < 1 else len(rows)
    kept = hash_rank(df, ["is_id"], seeded(f"{seed}:id", "sql"), ["sql"], "r").where(~F.col("is_id") | (F.col("r") <= most)).drop("r")
    combos = ["table_name", "where_col", "select_cols"]
    sizes = kept.groupBy(*combos).agg(F.bround(F.count(F.lit(1)) * F.lit(held)).cast("long").alias("k"))
    ranked = hash_rank(kept, combos, seeded(seed, "sql"), ["sql"], "r").join(sizes, combos)
    return ranked.select("sql", *combos, F.when(F.col("r") <= F.col("k"), "evaluation").otherwise("train").alias("part"))
