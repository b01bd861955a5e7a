"""Sampling, splits, quotas and batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querymill.operators import sampling as S
from querymill.operators.components import connected_components
from querymill.plans.base import query, table

QUOTAS = """
c AS (SELECT lang, count(*) AS n_rows FROM documents GROUP BY 1),
b AS (SELECT *, CAST(round_even(n_rows * 100 / sum(n_rows) OVER (), 0) AS BIGINT) AS base, row_number() OVER (ORDER BY n_rows DESC, lang NULLS FIRST) AS rank FROM c),
r AS (SELECT *, 100 - sum(base) OVER () AS rest FROM b),
q AS (SELECT lang, n_rows, CAST(greatest(least(base + CASE WHEN rank <= abs(rest) THEN sign(rest) ELSE 0 END, n_rows), 0) AS BIGINT) AS quota FROM r)"""


@query(f"WITH {QUOTAS} SELECT * FROM q")
def stratified_quota(spark: SparkSession, d: str) -> DataFrame:
    return S.stratified_quotas(table(spark, d, "documents"), ["lang"], 100)


@query(f"""WITH {QUOTAS}, o AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || doc_id), doc_id) AS r FROM documents)
SELECT doc_id FROM o JOIN q ON o.lang IS NOT DISTINCT FROM q.lang WHERE r <= quota""")
def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    return S.stratified_sample(table(spark, d, "documents"), ["lang"], "doc_id", 100).select("doc_id")


@query("""
WITH t AS (SELECT query_id, family, row_number() OVER (PARTITION BY family ORDER BY md5('7:' || query_id), query_id) AS turn FROM query_records)
SELECT query_id, turn FROM t ORDER BY turn, family NULLS FIRST, query_id LIMIT 60""")
def round_robin_pick(spark: SparkSession, d: str) -> DataFrame:
    return S.round_robin(table(spark, d, "query_records"), ["family"], "query_id", 60, 7).select("query_id", "turn")


@query("""
WITH g AS (SELECT DISTINCT thread_key FROM documents), o AS (SELECT thread_key, row_number() OVER (ORDER BY md5('42:' || thread_key), thread_key) AS n, count(*) OVER () AS k FROM g)
SELECT doc_id, CASE WHEN n <= greatest(floor(k * 0.1), 1) THEN 'validation' ELSE 'train' END AS part FROM documents JOIN o USING (thread_key)""")
def split_assignment(spark: SparkSession, d: str) -> DataFrame:
    return S.group_split(table(spark, d, "documents"), "thread_key", "doc_id", 0.1).select("doc_id", "part")


@query("SELECT doc_id, CASE WHEN ('0x' || substr(md5('42:' || thread_key), 1, 8))::BIGINT / 4294967296.0 < 0.1 THEN 'validation' ELSE 'train' END AS part FROM documents")
def split_assignment_hashed(spark: SparkSession, d: str) -> DataFrame:
    return S.group_split_hashed(table(spark, d, "documents"), "thread_key", 0.1).select("doc_id", "part")


@query("SELECT query_id, (row_number() OVER (PARTITION BY family ORDER BY query_id) - 1) // 50 AS batch_no FROM query_records")
def batch_assign(spark: SparkSession, d: str) -> DataFrame:
    return S.batches(table(spark, d, "query_records"), ["query_id"], 50, ["family"]).select("query_id", "batch_no")


@query("SELECT source, max_repeats, unnest(generate_series(1, max_repeats)) AS copy_no FROM source_targets")
def repeat_weighted(spark: SparkSession, d: str) -> DataFrame:
    return S.repeat_by_weight(table(spark, d, "source_targets"), F.col("max_repeats")).select("source", "max_repeats", "copy_no")


@query("""
WITH s AS (SELECT source, target_share * 997 AS ideal, floor(target_share * 997) AS base FROM source_targets), r AS (SELECT *, row_number() OVER (ORDER BY round(ideal - base, 9) DESC, source) AS k, 997 * round((SELECT sum(target_share) FROM source_targets), 9) - sum(base) OVER () AS rest FROM s)
SELECT source, CAST(base + CASE WHEN k <= round(rest) THEN 1 ELSE 0 END AS BIGINT) AS quota FROM r""")
def largest_remainder_quotas(spark: SparkSession, d: str) -> DataFrame:
    from querymill.operators.ranking import largest_remainder

    rows = table(spark, d, "source_targets").orderBy("source").collect()
    got = largest_remainder([r["target_share"] for r in rows], 997)
    return spark.createDataFrame([(r["source"], q) for r, q in zip(rows, got)], "source string, quota long")


@query("SELECT event_type, max(event_id) AS event_id, arg_max(user_id, event_id) AS user_id FROM events GROUP BY 1")
def last_wins(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_type", "event_id", "user_id")
    return S.last_wins(e, ["event_type"], ["event_id"])


@query("SELECT sql, min(pair_id) AS pair_id, arg_min(round, pair_id) AS round FROM (SELECT sql, pair_id, coalesce(round, '-') AS round FROM pairs WHERE sql IS NOT NULL) GROUP BY 1")
def first_wins(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pairs").where("sql is not null").select("sql", "pair_id", F.coalesce("round", F.lit("-")).alias("round"))
    return S.first_wins(p, ["sql"], ["pair_id"])


@query()
def weighted_sample(spark: SparkSession, d: str) -> DataFrame:
    return S.weighted_without_replacement(table(spark, d, "part"), F.col("p_size").cast("double"), 50, "p_partkey").select("p_partkey", "p_size")


@query("""
WITH o AS (SELECT query_id, family, query_kind, row_number() OVER (PARTITION BY family, query_kind ORDER BY query_id) AS r FROM query_records)
SELECT query_id, family, query_kind FROM o WHERE r <= 4""")
def cell_preview(spark: SparkSession, d: str) -> DataFrame:
    """Up to four records of each cell, for review."""
    return S.first_of_cell(table(spark, d, "query_records"), ["family", "query_kind"], ["query_id"], 4).select("query_id", "family", "query_kind")


@query("""
WITH RECURSIVE e AS (SELECT DISTINCT 'q' || sql_group AS u, 'c' || contrast_group || '/' || round AS v FROM pairs WHERE contrast_group IS NOT NULL AND round IS NOT NULL AND sql_group IS NOT NULL),
b AS (SELECT u, v FROM e UNION SELECT v, u FROM e),
reach(a, z) AS (SELECT u, u FROM b UNION SELECT r.a, b.v FROM reach r JOIN b ON r.z = b.u),
roots AS (SELECT a, min(z) AS root FROM reach GROUP BY 1)
SELECT substr(a, 2) AS sql_group, count(*) OVER (PARTITION BY root) AS n_statements FROM roots WHERE a LIKE 'q%'""")
def split_components(spark: SparkSession, d: str) -> DataFrame:
    """Statements tied by contrast groups of a round, with the size of their set."""
    from pyspark.sql import Window

    p = table(spark, d, "pairs").where("contrast_group is not null and round is not null and sql_group is not null").select("sql_group", "contrast_group", "round").distinct()
    e = p.select("sql_group", F.xxhash64(F.lit("q"), "sql_group").alias("u"), F.xxhash64(F.lit("c"), "contrast_group", "round").alias("v"))
    comp = connected_components(e, "u", "v")
    names = e.select("sql_group", F.col("u").alias("node")).distinct()
    return names.join(comp, "node").select("sql_group", F.count(F.lit(1)).over(Window.partitionBy("component")).alias("n_statements"))
