"""Workload reports over query_records and the shop tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querymill.dialect.catalog import SHOP
from querymill.operators import workload as W
from querymill.operators.execute import statement_results
from querymill.plans.base import query, table


def _q(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "query_records")


@query("""
WITH b AS (SELECT *, coalesce(len(conds), 0) AS nc FROM query_records),
l AS (SELECT 'table' AS dimension, table_name AS value FROM b UNION ALL SELECT 'kind', query_kind FROM b UNION ALL SELECT 'conds', nc::VARCHAR FROM b UNION ALL SELECT 'conn', conn FROM b
 UNION ALL SELECT 'order', CASE WHEN order_spec IS NOT NULL THEN 'y' ELSE '-' END FROM b UNION ALL SELECT 'limit', CASE WHEN row_limit IS NULL THEN '-' WHEN row_limit = 1 THEN '1' ELSE 'n' END FROM b
 UNION ALL SELECT 'family', family FROM b UNION ALL SELECT 'op', c.op FROM (SELECT unnest(conds) AS c FROM b))
SELECT dimension, CASE WHEN dimension = 'op' THEN value ELSE coalesce(value, '-') END AS value, count(*) AS n FROM l GROUP BY 1, 2""")
def workload_dim_counts(spark: SparkSession, d: str) -> DataFrame:
    return W.dimension_counts(_q(spark, d))


@query("SELECT count(DISTINCT skeleton) AS n_skeletons, round(avg(has_id::INT), 4) AS id_share, round(avg((n_rows = 0)::INT), 4) AS empty_share, round(avg(is_nonexistent::INT), 4) AS missing_share FROM query_records")
def workload_ratios(spark: SparkSession, d: str) -> DataFrame:
    share = lambda c, n: F.round(F.avg(c.cast("int")), 4).alias(n)
    return _q(spark, d).agg(F.countDistinct("skeleton").alias("n_skeletons"), share(F.col("has_id"), "id_share"), share(F.col("n_rows") == 0, "empty_share"), share(F.col("is_nonexistent"), "missing_share"))


ATOMS = """f AS (SELECT query_id, unnest(list_concat(['table=' || coalesce(table_name, '-'), 'n=' || coalesce(len(conds), 0), 'conn=' || coalesce(conn, '-'),
 'order=' || CASE WHEN order_spec IS NOT NULL THEN 'y' ELSE '-' END, 'limit=' || CASE WHEN row_limit IS NOT NULL THEN 'y' ELSE '-' END],
 coalesce(list_distinct(list_transform(conds, lambda c: 'op=' || c.op)), []))) AS x FROM query_records)"""


@query(f"WITH {ATOMS} SELECT x AS feature, count(*) AS n FROM f GROUP BY 1")
def atomic_feature_counts(spark: SparkSession, d: str) -> DataFrame:
    q = _q(spark, d)
    return q.select(F.explode(W.atomic_features(q)).alias("feature")).groupBy("feature").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {ATOMS} SELECT a.x AS a, b.x AS b, count(*) AS n FROM f a JOIN f b ON a.query_id = b.query_id AND a.x < b.x GROUP BY 1, 2")
def pair_coverage(spark: SparkSession, d: str) -> DataFrame:
    q = _q(spark, d)
    return W.pair_counts(q.select(W.atomic_features(q).alias("f")), "f")


@query(f"WITH {ATOMS}, p AS (SELECT a.x AS a, b.x AS b, count(*) AS n FROM f a JOIN f b ON a.query_id = b.query_id AND a.x < b.x GROUP BY 1, 2) SELECT a, b, n, 50 - n AS missing FROM p WHERE n < 50")
def pair_shortfall(spark: SparkSession, d: str) -> DataFrame:
    q = _q(spark, d)
    return W.short_pairs(W.pair_counts(q.select(W.atomic_features(q).alias("f")), "f"), 50)


@query()
def coverage_feature_counts(spark: SparkSession, d: str) -> DataFrame:
    q = _q(spark, d)
    return q.select(F.explode(W.coverage_features(q)).alias("feature")).groupBy("feature").agg(F.count(F.lit(1)).alias("n"))


@query(f"""
WITH {ATOMS}, g AS (SELECT query_id, list(x) AS fs FROM f GROUP BY 1)
SELECT query_id, CASE WHEN list_has_all(fs, ['n=3', 'limit=y']) THEN 0 WHEN list_has_all(fs, ['op=LIKE', 'order=y']) THEN 1 WHEN list_has_all(fs, ['op=LIKE', 'op=BETWEEN']) THEN 2
 WHEN list_has_all(fs, ['op=LIKE', 'op=!=', 'table=items']) THEN 3 WHEN list_has_all(fs, ['op=BETWEEN', 'op=!=']) THEN 4 END AS holdout FROM g""")
def struct_holdout_first_match(spark: SparkSession, d: str) -> DataFrame:
    q = _q(spark, d)
    return q.select("query_id", W.first_holdout(W.atomic_features(q)).alias("holdout"))


@query("""
WITH o AS (SELECT query_id, query_kind, row_number() OVER (PARTITION BY query_kind ORDER BY md5('42:' || query_id), query_id) AS r, count(*) OVER () AS n FROM query_records)
SELECT query_id FROM o WHERE r <= floor(CASE query_kind WHEN 'aggregate' THEN 0.1 WHEN 'group' THEN 0.05 ELSE 1.0 END * n)""")
def ratio_caps(spark: SparkSession, d: str) -> DataFrame:
    return W.cap_classes(_q(spark, d), "query_kind", {"aggregate": 0.1, "group": 0.05}, "query_id").select("query_id")


@query("""
WITH c AS (SELECT query_id, table_name, unnest(conds) AS c FROM query_records), o AS (SELECT query_id, table_name, c.col AS col, c.op AS op, row_number() OVER (PARTITION BY table_name, c.col, c.op ORDER BY md5('42:' || query_id), query_id) AS r FROM c)
SELECT query_id, table_name, col, op FROM o WHERE r <= 3""")
def coverage_floor(spark: SparkSession, d: str) -> DataFrame:
    cells = _q(spark, d).select("query_id", "table_name", F.explode("conds").alias("c")).select("query_id", "table_name", F.col("c.col").alias("col"), F.col("c.op").alias("op"))
    return W.floor_picks(cells, ["table_name", "col", "op"], "query_id", 3)


@query("""
WITH c AS (SELECT query_id, unnest(conds) AS c FROM query_records),
l AS (SELECT query_id, c.col AS col, unnest(list_concat([replace(c.val, '%', ''), c.val2], coalesce(c.vals, []))) AS value FROM c)
SELECT DISTINCT query_id FROM l WHERE col = 'category' AND value IN (SELECT category FROM items GROUP BY 1 HAVING count(*) < 60)""")
def banned_literals(spark: SparkSession, d: str) -> DataFrame:
    rare = table(spark, d, "items").groupBy("category").agg(F.count(F.lit(1)).alias("n")).where("n < 60 and category is not null")
    return W.with_banned_literal(_q(spark, d), rare.select(F.lit("category").alias("col"), F.col("category").alias("value")))


@query("""
SELECT 'customers' AS tbl, 'customer_id' AS col, customer_id::VARCHAR AS value FROM customers WHERE customer_id % 10 = 0
UNION ALL SELECT 'orders', 'customer_id', customer_id::VARCHAR FROM customers WHERE customer_id % 10 = 0
UNION ALL SELECT 'customers', 'name', name FROM customers WHERE customer_id % 10 = 0""")
def holdout_literals(spark: SparkSession, d: str) -> DataFrame:
    """Held-out customers at every place where they can occur in a statement."""
    c = table(spark, d, "customers").where("customer_id % 10 = 0")
    at = lambda t, col: F.struct(F.lit(t).alias("tbl"), F.lit(col).alias("col"), F.col(col).cast("string").alias("value"))
    return c.select(F.explode(F.array(at("customers", "customer_id"), at("orders", "customer_id"), at("customers", "name"))).alias("s")).select("s.*")


FRAGS = """w AS (SELECT DISTINCT unnest(string_split(lower(item_name), ' ')) AS w FROM items), v AS (SELECT w FROM w WHERE regexp_matches(w, '^[a-z]+$')),
a AS (SELECT 'prefix' AS mode, substr(w, 1, 3) AS fragment FROM v WHERE len(w) > 3 UNION SELECT 'suffix', right(w, 3) FROM v WHERE len(w) > 3
 UNION SELECT 'contains', substr(w, i, 3) FROM v, generate_series(2, 40) t(i) WHERE len(w) > 4 AND i <= len(w) - 3), fr AS (SELECT * FROM a WHERE fragment NOT IN (SELECT w FROM v))"""


@query(f"WITH {FRAGS} SELECT mode, fragment FROM fr")
def like_fragment_sets(spark: SparkSession, d: str) -> DataFrame:
    return W.fragments(table(spark, d, "items"), "item_name", 3)


@query(f"""
WITH {FRAGS}, t AS (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS token FROM documents), n AS (SELECT token, count(*) AS n FROM t GROUP BY 1)
SELECT mode, fragment, CASE WHEN coalesce(n, 0) >= 100 THEN 'common' WHEN coalesce(n, 0) > 0 THEN 'rare' ELSE 'multi' END AS bucket FROM fr LEFT JOIN n ON n.token = fr.fragment""")
def fragment_buckets(spark: SparkSession, d: str) -> DataFrame:
    tokens = table(spark, d, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    return W.fragment_buckets(W.fragments(table(spark, d, "items"), "item_name", 3), tokens, 100)


@query("""
WITH p AS (SELECT '^^' || lower(name) || '$' AS w FROM customers WHERE name IS NOT NULL)
SELECT substr(w, i, 2) AS context, substr(w, i + 2, 1) AS next, count(*) AS n FROM p, generate_series(1, 80) t(i) WHERE i <= len(w) - 2 GROUP BY 1, 2""")
def markov_transitions(spark: SparkSession, d: str) -> DataFrame:
    return W.transitions(table(spark, d, "customers"), "name")


SHAPES = ("SELECT name FROM customers WHERE city = '{v}'", "SELECT * FROM customers WHERE city = '{v}'", "SELECT COUNT(*) FROM customers WHERE city = '{v}'")


@query(f"""
WITH s AS (SELECT unnest([{', '.join("'" + s.replace("'", "''") + "'" for s in SHAPES)}]) AS shape), v AS (SELECT DISTINCT city AS value FROM customers WHERE city IS NOT NULL),
o AS (SELECT shape, value, row_number() OVER (PARTITION BY shape ORDER BY md5('42:' || shape || ':' || value), value) AS r FROM s, v)
SELECT shape, value, replace(shape, '{{v}}', value) AS text FROM o WHERE r <= 3""")
def candidate_statements(spark: SparkSession, d: str) -> DataFrame:
    shapes = spark.createDataFrame([(s,) for s in SHAPES], "shape string")
    return W.candidates(table(spark, d, "customers").where("city is not null").select(F.col("city").alias("value")), shapes, 3)


@query()
def candidates_that_run(spark: SparkSession, d: str) -> DataFrame:
    """Candidates with the digest of their result: null where one is outside the dialect."""
    return statement_results(candidate_statements(spark, d), SHOP, d).select("text", "digest")


@query("""
WITH g AS (SELECT customer_id, sum(quantity) AS v FROM shop_orders GROUP BY 1 HAVING sum(quantity) IS NOT NULL), b AS (SELECT v AS bound FROM g ORDER BY md5('42:' || v), v LIMIT 1)
SELECT bound::BIGINT AS bound, count(*) FILTER (WHERE v > bound) AS n_above, count(*) AS n_groups FROM g, b GROUP BY 1""")
def having_threshold(spark: SparkSession, d: str) -> DataFrame:
    return W.group_threshold(table(spark, d, "shop_orders"), "customer_id", F.sum("quantity"))


@query("SELECT query_kind, CASE WHEN n_rows IS NULL THEN 'unknown' WHEN n_rows = 0 THEN 'empty' ELSE 'nonempty' END AS result_kind, count(*) AS n FROM query_records GROUP BY 1, 2")
def result_profiles(spark: SparkSession, d: str) -> DataFrame:
    return _q(spark, d).groupBy("query_kind", W.result_kind(F.col("n_rows"), F.col("query_kind")).alias("result_kind")).agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT 'group by date' AS requirement, count(*) FILTER (WHERE group_key = 'order_date') AS n, count(*) FILTER (WHERE group_key = 'order_date') >= 5 AS met FROM query_records
UNION ALL SELECT 'having with limit', count(*) FILTER (WHERE having_spec IS NOT NULL AND row_limit IS NOT NULL), count(*) FILTER (WHERE having_spec IS NOT NULL AND row_limit IS NOT NULL) >= 5 FROM query_records
UNION ALL SELECT 'average', count(*) FILTER (WHERE aggregate LIKE 'AVG%'), count(*) FILTER (WHERE aggregate LIKE 'AVG%') >= 5 FROM query_records
UNION ALL SELECT 'inner condition', count(*) FILTER (WHERE len(inner_conds) > 0), count(*) FILTER (WHERE len(inner_conds) > 0) >= 5 FROM query_records""")
def coverage_requirements(spark: SparkSession, d: str) -> DataFrame:
    return W.requirements(_q(spark, d), {
        "group by date": F.col("group_key") == "order_date", "having with limit": F.col("having_spec").isNotNull() & F.col("row_limit").isNotNull(),
        "average": F.col("aggregate").startswith("AVG"), "inner condition": F.size("inner_conds") > 0,
    }, 5)


@query("""
SELECT 'repeated statements' AS requirement, count(*) - count(DISTINCT sql) AS n, count(*) = count(DISTINCT sql) AS met FROM query_records
UNION ALL SELECT 'statements shared by hold-out tiers', count(*), count(*) = 0 FROM (SELECT sql FROM query_records WHERE holdout_tier IS NOT NULL GROUP BY 1 HAVING count(DISTINCT holdout_tier) > 1)
UNION ALL SELECT 'missing keys that return rows', count(*) FILTER (WHERE is_nonexistent AND n_rows > 0), count(*) FILTER (WHERE is_nonexistent AND n_rows > 0) = 0 FROM query_records""")
def workload_verification(spark: SparkSession, d: str) -> DataFrame:
    q = _q(spark, d)
    check = lambda df, name: df.select(F.lit(name).alias("requirement"), "n", (F.col("n") == 0).alias("met"))
    shared = q.where("holdout_tier is not null").groupBy("sql").agg(F.countDistinct("holdout_tier").alias("k")).where("k > 1").agg(F.count(F.lit(1)).alias("n"))
    return (
        check(q.agg((F.count(F.lit(1)) - F.countDistinct("sql")).alias("n")), "repeated statements")
        .unionByName(check(shared, "statements shared by hold-out tiers"))
        .unionByName(check(q.agg(F.count_if(F.col("is_nonexistent") & (F.col("n_rows") > 0)).alias("n")), "missing keys that return rows"))
    )
