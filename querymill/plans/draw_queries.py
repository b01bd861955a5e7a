"""Workloads: drawn statements, hold-outs and floors of records, repair of short pairs, results of statements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querymill.dialect.catalog import SHOP
from querymill.operators import sampler as A
from querymill.operators import tokenizer as T
from querymill.operators import workload as W
from querymill.operators.execute import statement_results
from querymill.operators.repair import parsed_statements
from querymill.plans.base import query, table
from querymill.plans.workload_queries import ATOMS


def _q(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "query_records")


def _banned(spark: SparkSession, d: str) -> DataFrame:
    """Literals of held-out customers at every place."""
    c = table(spark, d, "customers").where("customer_id % 10 = 0")
    at = lambda t, col: F.struct(F.lit(t).alias("tbl"), F.lit(col).alias("col"), F.col(col).cast("string").alias("value"))
    return c.select(F.explode(F.array(at("customers", "customer_id"), at("orders", "customer_id"), at("customers", "name"))).alias("s")).select("s.*")


@query("""
SELECT query_id, CASE WHEN group_key IS NOT NULL AND having_spec IS NOT NULL AND row_limit IS NOT NULL THEN 'having_limit' WHEN group_key = 'order_date' AND aggregate LIKE 'AVG%' THEN 'date_group_avg'
 WHEN query_kind = 'subquery' AND len(inner_conds) > 0 AND len(list_filter(coalesce(conds, []), lambda c: c.col = 'order_date')) > 0 THEN 'date_outer_filtered_subquery' END AS holdout FROM query_records""")
def aggregate_holdouts(spark: SparkSession, d: str) -> DataFrame:
    q = _q(spark, d)
    return q.select("query_id", W.aggregate_holdout(q).alias("holdout"))


FLAGS = """f AS (SELECT *, coalesce(conds, []) AS cs FROM query_records),
e AS (SELECT *, len(cs) = 1 AND coalesce(cs[1].op = '=', FALSE) AS single, len(list_filter(cs, lambda c: c.col = 'order_date')) > 0 AS dw, coalesce(select_cols = 'order_date', FALSE) AS ds, coalesce(order_spec.col = 'order_date', FALSE) AS dord FROM f),
x AS (SELECT *, coalesce(single AND cs[1].col = select_cols, FALSE) AS existence FROM e)"""


@query(f"""
WITH {FLAGS} SELECT 'existence' AS requirement, count(*) FILTER (WHERE existence) AS n FROM x UNION ALL SELECT 'trivial', count(*) FILTER (WHERE single AND order_spec IS NULL AND NOT existence) FROM x
UNION ALL SELECT 'empty', count(*) FILTER (WHERE n_rows = 0 AND NOT coalesce(is_nonexistent, FALSE)) FROM x UNION ALL SELECT 'date_where', count(*) FILTER (WHERE dw) FROM x UNION ALL SELECT 'date_select', count(*) FILTER (WHERE ds) FROM x
UNION ALL SELECT 'date_order', count(*) FILTER (WHERE dord) FROM x UNION ALL SELECT 'date_any', count(*) FILTER (WHERE dw OR ds OR dord) FROM x""")
def shape_flag_counts(spark: SparkSession, d: str) -> DataFrame:
    """Existence, trivial, empty and dated records."""
    q = _q(spark, d)
    return W.requirements(q, W.shape_flags(q), 1).select("requirement", "n")


@query("""
WITH b AS (SELECT *, len(list_filter(coalesce(conds, []), lambda c: c.col = 'order_date')) > 0 AS dated FROM query_records),
l AS (SELECT unnest(['family:aggregate', 'family:group', 'family:having', 'family:scalar_subquery', 'function:COUNT', 'function:SUM', 'function:AVG', 'function:MIN', 'function:MAX', 'having_without_limit', 'limit_without_having', 'date_group', 'filtered_subquery', 'date_outer_subquery']) AS requirement,
 unnest([family = 'aggregate', family = 'group', family = 'having', family = 'scalar_subquery', query_kind <> 'subquery' AND aggregate LIKE 'COUNT(%', query_kind <> 'subquery' AND aggregate LIKE 'SUM(%', query_kind <> 'subquery' AND aggregate LIKE 'AVG(%',
 query_kind <> 'subquery' AND aggregate LIKE 'MIN(%', query_kind <> 'subquery' AND aggregate LIKE 'MAX(%', having_spec IS NOT NULL AND row_limit IS NULL, row_limit IS NOT NULL AND having_spec IS NULL, group_key = 'order_date',
 query_kind = 'subquery' AND len(inner_conds) > 0, query_kind = 'subquery' AND dated]) AS hit FROM b)
SELECT requirement, count(*) FILTER (WHERE hit) AS n, count(*) FILTER (WHERE hit) >= 1 AS met FROM l GROUP BY 1""")
def atom_coverage(spark: SparkSession, d: str) -> DataFrame:
    """The 14 predicates that training statements must each meet."""
    q = _q(spark, d)
    return W.requirements(q, W.coverage_atoms(q), 1)


@query(f"""
WITH {FLAGS} SELECT 'items.stock = 0' AS requirement, count(*) FILTER (WHERE p) AS n, count(*) FILTER (WHERE p) >= 5 AS met FROM (SELECT table_name = 'items' AND len(list_filter(cs, lambda c: c.col = 'stock' AND c.op = '=' AND TRY_CAST(c.val AS DOUBLE) = 0)) > 0 AS p FROM x)
UNION ALL SELECT 'items.stock > 0', count(*) FILTER (WHERE p), count(*) FILTER (WHERE p) >= 5 FROM (SELECT table_name = 'items' AND len(list_filter(cs, lambda c: c.col = 'stock' AND c.op = '>' AND TRY_CAST(c.val AS DOUBLE) = 0)) > 0 AS p FROM x)
UNION ALL SELECT 'existence', count(*) FILTER (WHERE existence), count(*) FILTER (WHERE existence) >= 5 FROM x""")
def pinned_floors(spark: SparkSession, d: str) -> DataFrame:
    return W.pin_floor(_q(spark, d), ["items.stock = 0", "items.stock > 0"], 5)


@query(f"""
WITH {ATOMS}, g AS (SELECT query_id, list(x) AS fs FROM f GROUP BY 1),
h AS (SELECT query_id, CASE WHEN list_has_all(fs, ['n=3', 'limit=y']) THEN 0 WHEN list_has_all(fs, ['op=LIKE', 'order=y']) THEN 1 WHEN list_has_all(fs, ['op=LIKE', 'op=BETWEEN']) THEN 2
 WHEN list_has_all(fs, ['op=LIKE', 'op=!=', 'table=items']) THEN 3 WHEN list_has_all(fs, ['op=BETWEEN', 'op=!=']) THEN 4 END AS holdout FROM g),
r AS (SELECT *, row_number() OVER (PARTITION BY holdout ORDER BY md5('42:' || query_id), query_id) AS k FROM h)
SELECT query_id, holdout, CASE WHEN holdout IS NULL THEN 'main' WHEN k <= 20 THEN 'struct' ELSE 'dropped' END AS route FROM r""")
def routed_records(spark: SparkSession, d: str) -> DataFrame:
    q = _q(spark, d)
    return W.routed(q, "query_id", W.atomic_features(q), 20)


@query()
def exempt_cells(spark: SparkSession, d: str) -> DataFrame:
    """Cells of conditions; those of a hold-out of table and operator need no floor."""
    return W.exempt_cells(spark, SHOP, [*W.HOLDOUTS, (("table", "orders"), ("op", "!="))])


@query()
def short_pair_hints(spark: SparkSession, d: str) -> DataFrame:
    q = _q(spark, d)
    counts = W.pair_counts(q.select(W.coverage_features(q).alias("f")), "f")
    return W.pair_hints(spark, W.short_pairs(counts, 50), SHOP)


@query()
def repaired_pair_floor(spark: SparkSession, d: str) -> DataFrame:
    """Records with an even id as training, the others as candidates: short pairs before and after candidates are swapped in."""
    q = _q(spark, d)
    atoms = F.array_compact(F.array(*[F.when(c, k) for k, c in W.coverage_atoms(q).items()]))
    rows = q.select("query_id", W.coverage_features(q).alias("f"), atoms.alias("atoms"))
    train, rest = rows.where("query_id % 2 = 0"), rows.where("query_id % 2 = 1")
    added, removed = W.pair_floor_repair(train, rest, "query_id", "f", 30, "atoms")
    after = train.join(removed, "query_id", "left_anti").unionByName(rest.join(added, "query_id", "left_semi"))
    count = lambda df, name: W.pair_counts(df, "f").agg(F.lit(name).alias("state"), F.count_if(F.col("n") < 30).alias("n_short"), F.sum("n").alias("n_pairs"))
    return count(train, "before").unionByName(count(after, "after"))


@query()
def drawn_projections(spark: SparkSession, d: str) -> DataFrame:
    s = A.Sampler(SHOP, A.literal_pools(spark, d, SHOP, _banned(spark, d)))
    return A.drawn_statements(spark, s, 2_000)


@query()
def drawn_aggregates(spark: SparkSession, d: str) -> DataFrame:
    s = A.Sampler(SHOP, A.literal_pools(spark, d, SHOP, _banned(spark, d)))
    return A.drawn_statements(spark, s, 2_000, family=None)


@query()
def drawn_cells(spark: SparkSession, d: str) -> DataFrame:
    """Draws that must hold a range of quantities, and draws that ask whether something exists."""
    s = A.Sampler(SHOP, A.literal_pools(spark, d, SHOP))
    ranges = A.drawn_statements(spark, s, 300, cell=("orders", "quantity", "BETWEEN"))
    pins = A.drawn_statements(spark, s, 300, pin=("items", "stock", "=", 0))
    return ranges.unionByName(pins).unionByName(A.drawn_statements(spark, s, 300, existence=True))


@query()
def lookup_workload(spark: SparkSession, d: str) -> DataFrame:
    pools = A.literal_pools(spark, d, SHOP, _banned(spark, d), size=200)
    rows = A.lookups(spark, pools, SHOP)
    return rows.groupBy("table_name", "where_col", "part").agg(F.count(F.lit(1)).alias("n"))


@query()
def statement_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Every record's statement run: rows and kind of its result."""
    q = _q(spark, d).where("sql is not null").select("query_id", F.col("sql").alias("text"))
    return q.join(statement_results(q, SHOP, d, any_length=True), "text").select("query_id", "n_rows", "result_kind")


@query()
def meaningless_statements(spark: SparkSession, d: str) -> DataFrame:
    """Projections that ask nothing: their conditions select all rows or none, or their order or LIMIT has no effect."""
    q = _q(spark, d).where("query_kind is null and sql is not null").withColumn("text", F.regexp_replace("sql", r" ORDER BY .*$", ""))
    base = statement_results(q.select("text"), SHOP, d, counted=True).select("text", F.col("n_rows").alias("base_rows"))
    sizes = None
    for t in SHOP.tables.values():
        one = SHOP.load(spark, d, t.name).agg(F.lit(t.name).alias("table_name"), F.count(F.lit(1)).alias("table_rows"))
        sizes = one if sizes is None else sizes.unionByName(one)
    j = q.join(base, "text").join(sizes, "table_name")
    return j.select("query_id", W.meaningless(j, F.col("base_rows"), F.col("table_rows")).alias("reason")).where("reason is not null")


@query()
def invented_names(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customers").where("name is not null")
    return W.markov_names(spark, W.transitions(c, "name"), 200, c.select("name"))


@query("SELECT query_id, skeleton FROM query_records WHERE skeleton IS NOT NULL AND sql IS NOT NULL AND table_name IS NOT NULL")
def record_signatures(spark: SparkSession, d: str) -> DataFrame:
    """The signature of every parsed statement in the records' form: table, columns with operators, group."""
    q = _q(spark, d).where("skeleton is not null and sql is not null and table_name is not null")
    return parsed_statements(q, "query_id", "sql", SHOP).select("query_id", F.col("signature").alias("skeleton"))


@query()
def token_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Statements encoded with merges trained on them, and decoded again."""
    q = _q(spark, d).where("sql is not null")
    merges = T.train_merges(q, "sql", 12, ["SELECT", "FROM", "WHERE"])
    return T.round_trip_report(q, "query_id", "sql", merges, {"SELECT": 400, "FROM": 401, "WHERE": 402}, 12)
