"""Many statements at once: results of all statements over a table, as digests, row counts and kinds.

Statements are data, not plans. Texts are parsed in Arrow batches, equal statements run once, and the statements of a table
travel in packs to tasks that hold some of its rows (at most BLOCK_ROWS at a time) with an index of each column. There a statement
costs the rows of its most selective condition. What a task says of a statement (counts, sums of row hashes, partial aggregates,
groups, first rows) is merged by plans whose size depends on the number of tables only. The driver holds PACKS packs at a time.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator
from itertools import islice

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from querymill.dialect.catalog import Catalog, Table
from querymill.dialect.rules import MAX_CONDITIONS, MAX_LIMIT, MAX_ROW_CONDITIONS, violations
from querymill.dialect.statement import DialectError, Predicate, Statement, parse
from querymill.operators.index import PARTS, Rows, part_rows
from querymill.operators.ranking import ordered_rank
from querymill.session import materialize

NUMERIC = ("int", "bigint", "double", "float")
WHOLE = ("tinyint", "smallint", "int", "bigint")
DDL = "text string, digest string, n_rows long, result_kind string"
PLAN = "tbl string, way string, shown string, func string, k int, down boolean, tie_down boolean, having_op string, having_value double, sub string, spec string"
# Statements in a pack, packs in a job, rows of a table in a task.
PACK, PACKS, BLOCK_ROWS = 8192, 12, 1 << 18
#: Broken rules of statements that run like any other.
RUNNABLE = {f"more than {n} conditions" for n in (MAX_CONDITIONS, MAX_ROW_CONDITIONS)}


def _cells(columns: list[tuple[str, str]]) -> str:
    """Cells as text, 1 and 1.0 alike, null apart from every text."""
    return ", ".join(f"coalesce(cast({f'cast(`{c}` as double)' if k in NUMERIC else f'`{c}`'} as string), '\\0')" for c, k in columns)


def _hashes(cells: str) -> tuple[str, str]:
    return f"cast(xxhash64({cells}) as decimal(38,0))", f"cast(xxhash64('b', {cells}) as decimal(38,0))"


def _digest(width: int | str, n: str, a: str, b: str) -> str:
    return f"concat_ws(':', cast({width} as string), cast({n} as string), coalesce(cast({a} as string), '-'), coalesce(cast({b} as string), '-'))"


def result_digest(df: DataFrame) -> DataFrame:
    """One row (digest, n_rows) that is the same for equal bags of rows, names of columns and 1 against 1.0 aside."""
    a, b = _hashes(_cells(df.dtypes))
    return df.selectExpr(f"{a} a", f"{b} b").selectExpr(f"{_digest(len(df.columns), 'count(1)', 'sum(a)', 'sum(b)')} digest", "count(1) n_rows")


def _conditions(conds: tuple[Predicate, ...], t: Table) -> list:
    """[column, operator, values], values null for a subquery's; literals of timestamps as the column's text."""
    return [[c.column, c.op, None if c.sub else [f"{v} 00:00:00" if c.column in t.timestamps else v for v in c.values]] for c in conds]


def _planned(s: Statement, catalog: Catalog, counted: bool = False) -> tuple:
    """The fields of PLAN. spec is all that a task needs, and the same for equal statements; sub the spec of the subquery's aggregate.
    counted: of unsorted projections only the rows are counted, so that those with the same conditions are equal."""
    s = s.canonical(catalog).with_default_tie(catalog)
    t = catalog.tables[s.table]
    way = "group" if s.group else "aggregate" if s.aggregate else ("count" if counted else "flat") if not s.order else "sorted" if s.limit is None else "first"
    down = bool(s.order and s.order[1] == "DESC")
    tie, tie_down = (s.tie[0], s.tie[1] == "DESC") if s.tie else (t.key, False)
    spec = {"t": s.table, "way": way, "where": _conditions(s.conds, t), "or": s.conn == "OR"}
    if s.aggregate:
        spec |= {"f": s.aggregate.function, "of": s.aggregate.column, "by": s.group, "order": bool(s.order), "down": down, "k": s.limit, "having": s.having}
    elif way != "count":
        spec |= {"show": s.select} | ({"order": s.order[0], "down": down, "tie": tie, "tie_down": tie_down, "k": s.limit} if s.order else {})
    sub = next((_planned(Statement(s.table, aggregate=c.sub.aggregate, conds=c.sub.conds, conn="AND"), catalog)[-1] for c in s.conds if c.sub), None)
    text = json.dumps(spec | ({"sub": sub} if sub else {}))
    return s.table, way, "" if s.aggregate or way == "count" else s.select, s.aggregate and s.aggregate.function, s.limit, down if s.order else None, tie_down, *(s.having or (None, None)), sub, text


def _read(texts: DataFrame, catalog: Catalog, allowed: set[str], counted: bool) -> DataFrame:
    """(text, the fields of PLAN) in Arrow batches; all null but the text where it is outside the dialect or against its rules, those
    of allowed aside."""

    def one(text: str) -> tuple:
        try:
            s = parse(text)
            return (None,) * 11 if set(violations(s, catalog)) - allowed else _planned(s, catalog, counted)
        except (DialectError, KeyError):
            return (None,) * 11

    schema = pa.schema([("text", pa.string())] + [(f.split()[0], {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "double": pa.float64()}[f.split()[1]]) for f in PLAN.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(0).to_pylist()
            columns = list(zip(*[(x, *one(x)) for x in texts])) or [()] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return texts.mapInArrow(run, f"text string, {PLAN}")


def _subqueries(read: DataFrame) -> DataFrame:
    """Subqueries as statements of their own: aggregates."""
    s = read.where("sub is not null").select("tbl", F.col("sub").alias("spec")).distinct()
    none = {"k": "int", "down": "boolean", "tie_down": "boolean", "having_op": "string", "having_value": "double", "sub": "string"}
    return s.select("tbl", F.lit("aggregate").alias("way"), F.lit("").alias("shown"), F.get_json_object("spec", "$.f").alias("func"), *[F.lit(None).cast(k).alias(c) for c, k in none.items()], "spec")


def _packs(jobs: DataFrame) -> DataFrame:
    """(tbl, pack): statements of one table, PACK at most, with their numbers and the values of their subqueries."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, list] = {}
        packed = lambda name: pd.DataFrame({"tbl": [name], "pack": [zlib.compress(json.dumps(held.pop(name)).encode(), 1)]})
        for b in batches:
            for name, i, spec, value in zip(b["tbl"], b["i"], b["spec"], b["value"].astype(object).where(b["value"].notna(), None)):
                held.setdefault(name, []).append([i, spec, value])
                if len(held[name]) >= PACK:
                    yield packed(name)
        for name in list(held):
            yield packed(name)

    few = max(1, jobs.count() // (4 * PACK))
    return jobs.select("tbl", "i", "spec", "value").coalesce(few).mapInPandas(run, "tbl string, pack binary")


def _waves(packs: Iterator, size: int) -> Iterator[list]:
    while wave := list(islice(packs, size)):
        yield wave


def _source(spark: SparkSession, catalog: Catalog, directory: str, name: str, shapes: list[str]) -> DataFrame:
    """Columns of the table as whole numbers, doubles or text, and two hashes of a row for each projection."""
    t, df = catalog.tables[name], catalog.load(spark, directory, name)
    kinds = dict(df.dtypes)
    as_ = lambda c: "bigint" if kinds[c] in WHOLE else "double" if kinds[c] in NUMERIC or kinds[c].startswith("decimal") else "string"
    own = [f"cast({f'cast(`{c}` as timestamp)' if c in t.timestamps else f'`{c}`'} as {as_(c)}) `{c}`" for c in t.columns if c in kinds]
    row = [f"{h} `{k}:{x}`" for x in shapes for k, cells in (("a", ""), ("b", "'b', ")) for h in [f"xxhash64({cells}{_cells([c for c in df.dtypes if x in ('*', c[0])])})"]]
    return df.selectExpr(*own, *row).coalesce(max(1, df.count() // BLOCK_ROWS))


def _task(pack: bytes) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = None
        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) >= BLOCK_ROWS:
                items = items or [(i, json.loads(spec), v) for i, spec, v in json.loads(zlib.decompress(pack))]
                yield from part_rows(Rows(pa.Table.from_batches(held)), items)
                held = []
        if sum(x.num_rows for x in held):
            items = items or [(i, json.loads(spec), v) for i, spec, v in json.loads(zlib.decompress(pack))]
            yield from part_rows(Rows(pa.Table.from_batches(held)), items)

    return run


def _parts(jobs: DataFrame, catalog: Catalog, directory: str) -> DataFrame:
    """PARTS: what every block of rows says of every statement."""
    spark = jobs.sparkSession
    shapes: dict[str, list[str]] = {}
    for r in jobs.select("tbl", "shown").distinct().orderBy("tbl", "shown").collect():  # columns of the catalog's tables at most
        shapes.setdefault(r["tbl"], []).extend([r["shown"]] if r["shown"] else [])
    sources = {name: _source(spark, catalog, directory, name, some) for name, some in shapes.items()}
    paths = []
    for wave in _waves(_packs(jobs).toLocalIterator(), PACKS):
        out = None
        for name, pack in wave:
            part = sources[name].mapInArrow(_task(bytes(pack)), PARTS)
            out = part if out is None else out.union(part)
        paths.append(materialize(out, "parts")._querymill_path)
    return spark.read.schema(PARTS).parquet(*paths) if paths else spark.createDataFrame([], PARTS)


#: Partial sums are added in order of size, so that equal rows give equal sums whatever task ends first.
MERGED = [
    "sum(n) n", "sum(c) c", "aggregate(array_sort(collect_list(s)), 0D, (x, y) -> x + y) s", "min(ml) min_l", "max(ml) max_l", "min(md) min_d", "max(md) max_d", "min(mt) min_t", "max(mt) max_t",
]
PICK = "case func when 'MIN' then min_{0} when 'MAX' then max_{0} end"
NUMBER = f"case when func = 'COUNT' then cast(coalesce(n, 0) as double) when coalesce(c, 0) = 0 then null when func = 'SUM' then s when func = 'AVG' then s / c else coalesce({PICK.format('d')}, cast({PICK.format('l')} as double)) end"
KEY_CELL = "coalesce(kt, cast(coalesce(kd, cast(kl as double)) as string), '\\0')"
VALUE_CELL = "coalesce(vt, cast(v as string), '\\0')"


def _whole(hi: str, lo: str) -> str:
    """The exact sum of hashes from the sums of their upper and lower halves."""
    return f"cast(sum({hi}) as decimal(38,0)) * 4294967296BD + cast(sum({lo}) as decimal(38,0))"


def _values(jobs: DataFrame, parts: DataFrame) -> DataFrame:
    """Aggregates of the whole table: jobs with v, a number, or vt, a text."""
    merged = parts.where("way = 'aggregate'").groupBy("i").agg(*map(F.expr, MERGED))
    return jobs.where("way = 'aggregate'").join(merged, "i", "left").selectExpr("i", "spec", "func", f"{NUMBER} v", f"{PICK.format('t')} vt")


def _aggregated(jobs: DataFrame, parts: DataFrame) -> DataFrame:
    a, b = _hashes(VALUE_CELL)
    kind = "case when v is null and vt is null then 'null' when func = 'COUNT' and v = 0 then 'zero_count' else 'nonempty' end"
    return _values(jobs, parts).selectExpr("i", f"{_digest(1, '1', a, b)} digest", "cast(1 as bigint) n_rows", f"{kind} result_kind")


def _flat(jobs: DataFrame, parts: DataFrame, width: str) -> DataFrame:
    merged = parts.where("way = 'flat'").groupBy("i").agg(F.expr("sum(n) n"), F.expr(f"{_whole('a1', 'a0')} a"), F.expr(f"{_whole('b1', 'b0')} b"))
    digest = _digest(width, "coalesce(n, 0)", "if(n > 0, a, null)", "if(n > 0, b, null)")
    return jobs.where("way = 'flat'").join(merged, "i", "left").selectExpr("i", f"{digest} digest", "coalesce(n, 0) n_rows", "if(coalesce(n, 0) = 0, 'empty', 'nonempty') result_kind")


def _counted(jobs: DataFrame, parts: DataFrame) -> DataFrame:
    merged = parts.where("way = 'count'").groupBy("i").agg(F.expr("sum(n) n"))
    return jobs.where("way = 'count'").join(merged, "i", "left").selectExpr("i", "cast(null as string) digest", "coalesce(n, 0) n_rows", "if(coalesce(n, 0) = 0, 'empty', 'nonempty') result_kind")


def _summed(jobs: DataFrame, placed: DataFrame, place: str, width: str) -> DataFrame:
    """Rows, by their place where the statement sorts, as one digest for each of jobs."""
    a, b = _hashes(f"{place}, a, b")
    per = placed.groupBy("i").agg(F.expr("count(1) n"), F.expr(f"sum({a}) a"), F.expr(f"sum({b}) b"))
    digest = _digest(width, "coalesce(n, 0)", "a", "b")
    return jobs.join(per, "i", "left").selectExpr(
        "i", f"if(down is not null and coalesce(n, 0) > 1, concat({digest}, ':ordered'), {digest}) digest", "coalesce(n, 0) n_rows", "if(coalesce(n, 0) = 0, 'empty', 'nonempty') result_kind"
    )


def _by(down: bool, *names: str) -> list[Column]:
    return [F.col(c).desc() if down else F.col(c).asc() for c in names]


def _sorted(jobs: DataFrame, parts: DataFrame, width: str) -> list[DataFrame]:
    """Statements sorted alike: the rows that each one matches, by their place. Those with LIMIT have few rows of each task."""
    out = []
    for down in (False, True):
        for tie_down in (False, True):
            by = [*_by(down, "ol", "od", "ot"), *_by(tie_down, "kl", "kd", "kt"), F.col("a").asc()]
            for way in ("first", "sorted"):
                some = jobs.where(f"way = '{way}' and down = {down} and tie_down = {tie_down}")
                if some.isEmpty():
                    continue
                rows = parts.where(f"way = '{way}'").withColumnsRenamed({"a1": "a", "b1": "b"}).join(some.select("i", "k"), "i").select("i", "k", "ol", "od", "ot", "kl", "kd", "kt", "a", "b")
                if way == "first":
                    placed = rows.withColumn("p", F.row_number().over(Window.partitionBy("i").orderBy(*by))).where(F.col("p") <= MAX_LIMIT).where("p <= k")
                else:
                    placed = ordered_rank(rows, ["i"], by, "p")
                out.append(_summed(some, placed, "p", width))
    return out


def _grouped(jobs: DataFrame, parts: DataFrame) -> list[DataFrame]:
    """Statements that group: HAVING, order and LIMIT per statement over its groups."""
    grouped = jobs.where("way = 'group'")
    if grouped.isEmpty():
        return []
    merged = parts.where("way = 'group'").groupBy("i", "kl", "kd", "kt").agg(*map(F.expr, MERGED))
    valued = merged.join(grouped.select("i", "func", "k", "down", "having_op", "having_value"), "i").selectExpr("*", f"{NUMBER} v", f"{PICK.format('t')} vt")
    having = " ".join(f"when having_op = '{op}' then coalesce(v {op} having_value, false)" for op in ("=", "!=", "<", ">", "<=", ">="))
    a, b = _hashes(f"{KEY_CELL}, {VALUE_CELL}")
    rows = valued.where(F.expr(f"case when having_op is null then true {having} end")).selectExpr("i", "k", "down", "v", "vt", "kl", "kd", "kt", f"{a} a", f"{b} b")
    out = [_summed(grouped.where("down is null"), rows.where("down is null"), "0", "2")]
    for down in (False, True):
        placed = rows.where(f"down = {down}").withColumn("p", F.row_number().over(Window.partitionBy("i").orderBy(*_by(down, "v", "vt"), *_by(False, "kl", "kd", "kt"))))
        out.append(_summed(grouped.where(f"down = {down}"), placed.where("k is null or p <= k"), "p", "2"))
    return out


def _numbered(jobs: DataFrame, name: str) -> DataFrame:
    return materialize(jobs.withColumn("i", F.monotonically_increasing_id()), name)


def statement_results(texts: DataFrame, catalog: Catalog, directory: str, any_length: bool = False, counted: bool = False) -> DataFrame:
    """(text, digest, n_rows, result_kind) for every distinct text of a table with a column text; all null but the text where it is
    outside the dialect or against its rules. With any_length, statements with more conditions than the rules allow run too. With
    counted, projections that do not sort have no digest: their rows are counted, once for all with the same conditions.

    digest is the same for equal results: equal lists of rows where a statement sorts, equal bags elsewhere; names of columns and 1
    against 1.0 aside. result_kind: empty, null (an aggregate of nothing), zero_count or nonempty.
    """
    spark = texts.sparkSession
    read = materialize(_read(texts.select("text").where("text is not null").distinct(), catalog, RUNNABLE if any_length else set(), counted), "statements")
    inner = _numbered(_subqueries(read).withColumn("value", F.lit(None).cast("double")), "subqueries")
    found = _values(inner, _parts(inner, catalog, directory)).select(F.col("spec").alias("sub"), F.col("v").alias("value"))
    distinct = read.where("spec is not null").drop("text").dropDuplicates(["spec"])
    jobs = _numbered(distinct.join(found, "sub", "left"), "jobs")
    parts = _parts(jobs, catalog, directory)
    sizes = {name: len(catalog.load(spark, directory, name).columns) for name in [r[0] for r in jobs.select("tbl").distinct().collect()]}
    width = "case " + " ".join(f"when shown = '*' and tbl = '{name}' then {n}" for name, n in sizes.items()) + " else 1 end" if sizes else "1"
    results = (_counted(jobs, parts) if counted else _flat(jobs, parts, width)).unionByName(_aggregated(jobs, parts))
    for part in [*_sorted(jobs, parts, width), *_grouped(jobs, parts)]:
        results = results.unionByName(part)
    by_spec = jobs.select("i", "spec").join(results, "i").drop("i")
    return materialize(read.select("text", "spec").join(by_spec, "spec", "left").select("text", "digest", "n_rows", "result_kind"), "results")


def execution_match(df: DataFrame, gold: str, pred: str, em: str, results: DataFrame) -> DataFrame:
    """df with exec_match: exact, or the gold statement ran and both results are equal (in order, where both sort)."""
    g = results.select(F.col("text").alias("__g"), F.col("digest").alias("__dg"))
    p = results.select(F.col("text").alias("__p"), F.col("digest").alias("__dp"))
    joined = df.join(g, F.col(gold) == F.col("__g"), "left").join(p, F.col(pred) == F.col("__p"), "left")
    return joined.select(*df.columns, (F.col(em) | F.coalesce(F.col("__dg") == F.col("__dp"), F.lit(False))).alias("exec_match"))
