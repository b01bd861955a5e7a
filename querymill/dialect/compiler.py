"""Statements to DataFrames. Only the DataFrame API is used: unparsed text never reaches the engine."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from querymill.dialect.catalog import Catalog, Table
from querymill.dialect.rules import violations
from querymill.dialect.statement import Aggregate, DialectError, Predicate, Statement, like_mode, parse

COMPARE: dict[str, Callable[[Column, Column], Column]] = {
    "=": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b,
}


def _literal(v, column: str, t: Table) -> Column:
    if column in t.timestamps:
        return F.lit(v).cast("timestamp")
    return F.lit(float(v)) if column in t.floats else F.lit(v)


def predicate(p: Predicate, t: Table, source: DataFrame) -> Column:
    c = F.col(p.column)
    if p.sub:
        inner = source.where(conjunction(p.sub.conds, "AND", t, source)) if p.sub.conds else source
        return COMPARE[p.op](c, inner.agg(aggregate(p.sub.aggregate).alias("v")).scalar())
    lit = [_literal(v, p.column, t) for v in p.values]
    if p.op == "IN":
        return c.isin(*lit)
    if p.op == "BETWEEN":
        return c.between(*lit)
    if p.op == "LIKE":
        mode, fragment = like_mode(p.values[0])
        return {"prefix": c.startswith, "suffix": c.endswith, "contains": c.contains}[mode](fragment)
    return COMPARE[p.op](c, lit[0])


def conjunction(conds: tuple[Predicate, ...], conn: str | None, t: Table, source: DataFrame) -> Column:
    join = (lambda a, b: a | b) if conn == "OR" else (lambda a, b: a & b)
    return reduce(join, [predicate(p, t, source) for p in conds])


def aggregate(a: Aggregate) -> Column:
    return F.count(F.lit(1)) if a.function == "COUNT" else getattr(F, a.function.lower())(a.column)


def compile_statement(s: Statement, catalog: Catalog, source: DataFrame, alias: str = "value") -> DataFrame:
    """The statement over source, the rows of its table. An aggregate's column is called alias.

    Ties are always broken (by the table's key, or the group key), so ordered and limited results are deterministic
    as far as the key is unique. Null order: ASC puts nulls first, DESC last.
    """
    wrong = violations(s, catalog)
    if wrong:
        raise DialectError("; ".join(wrong))
    t, s = catalog.tables[s.table], s.with_default_tie(catalog)
    df = source.where(conjunction(s.conds, s.conn, t, source)) if s.conds else source
    if s.aggregate:
        value = aggregate(s.aggregate).alias(alias)
        df = df.groupBy(s.group).agg(value) if s.group else df.agg(value)
        if s.having:
            df = df.where(COMPARE[s.having[0]](F.col(alias), F.lit(s.having[1])))
    if s.order:
        names = [(alias if s.aggregate and s.order[0] == str(s.aggregate) else s.order[0], s.order[1])] + ([s.tie] if s.tie else [])
        df = df.orderBy(*[F.col(c).desc() if d == "DESC" else F.col(c).asc() for c, d in names])
    if s.limit is not None:
        df = df.limit(s.limit)
    return df if s.aggregate or s.select == "*" else df.select(s.select)


def run(spark: SparkSession, text: str, catalog: Catalog, directory: str, alias: str = "value") -> DataFrame:
    """The front door: text to DataFrame. DialectError for text outside the dialect or against its rules."""
    s = parse(text)
    if s.table not in catalog.tables:
        raise DialectError(f"unknown table {s.table}")
    return compile_statement(s, catalog, catalog.load(spark, directory, s.table), alias)


def widened(s: Statement) -> Statement:
    """The rows a projection reads: the same statement with SELECT *."""
    from dataclasses import replace

    return s if s.aggregate else replace(s, select="*")
