"""Scoring, fuzzy matching, vectors and graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querymill.dialect.catalog import SHOP
from querymill.functions.labels import label_key
from querymill.operators import evaluate as E
from querymill.operators import fuzzy as Z
from querymill.operators import graph as G
from querymill.operators.execute import execution_match, statement_results
from querymill.plans.base import query, table

WILSON = """round(greatest((hits / n + 3.8416 / (2 * n)) / (1 + 3.8416 / n) - 1.96 * sqrt((hits / n) * (1 - hits / n) / n + 3.8416 / (4.0 * n * n)) / (1 + 3.8416 / n), 0), 6) AS low,
round(least((hits / n + 3.8416 / (2 * n)) / (1 + 3.8416 / n) + 1.96 * sqrt((hits / n) * (1 - hits / n) / n + 3.8416 / (4.0 * n * n)) / (1 + 3.8416 / n), 1), 6) AS high"""


def _scored(spark: SparkSession, d: str) -> DataFrame:
    """Statement as written against the canonical one of its group: a prediction is right when the texts are equal."""
    p = table(spark, d, "pairs").where("sql_group is not null and sql_group <> ''")
    return p.withColumn("em", F.col("sql") == F.col("sql_group"))


@query(f"""
WITH g AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE sql = sql_group) AS hits FROM pairs WHERE sql_group IS NOT NULL AND sql_group <> '' GROUP BY 1)
SELECT source, n, hits, round(hits / n, 6) AS rate, {WILSON} FROM g""")
def wilson_summary(spark: SparkSession, d: str) -> DataFrame:
    return E.rates(_scored(spark, d), ["source"], "em")


@query(f"""
WITH b AS (SELECT * FROM pairs WHERE sql_group IS NOT NULL AND sql_group <> ''),
l AS (SELECT 'split' AS dimension, split AS value, sql = sql_group AS em FROM b UNION ALL SELECT 'style', style::VARCHAR, sql = sql_group FROM b UNION ALL SELECT 'persona', persona, sql = sql_group FROM b),
g AS (SELECT dimension, value, count(*) AS n, count(*) FILTER (WHERE em) AS hits FROM l WHERE value IS NOT NULL GROUP BY 1, 2)
SELECT dimension, value, n, hits, round(hits / n, 6) AS rate, {WILSON} FROM g""")
def summary_by_dimension(spark: SparkSession, d: str) -> DataFrame:
    return E.rates_by_dimensions(_scored(spark, d), ["split", "style", "persona"], "em")


def _gold(spark: SparkSession, d: str) -> DataFrame:
    """Records with the statement they should have: of their group, else the original one, else their own."""
    group = F.when(F.trim("sql_group") != "", F.col("sql_group"))
    return table(spark, d, "pairs").withColumn("gold", F.coalesce(group, F.col("orig_sql"), F.col("sql"))).where("gold is not null")


@query()
def error_part_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Parts in which the statements of the records differ from those of their group, or else from their originals."""
    return E.part_histogram(E.score_statements(_gold(spark, d), "gold", "sql", SHOP), "error_parts")


@query()
def statement_scores(spark: SparkSession, d: str) -> DataFrame:
    """Matches modulo spelling, by family."""
    s = E.score_statements(table(spark, d, "pairs").where("sql_group is not null and sql_group <> ''"), "sql_group", "sql", SHOP)
    return E.rates(s.withColumn("family", label_key(F.col("family"))), ["family"], "em")


@query()
def execution_scores(spark: SparkSession, d: str) -> DataFrame:
    """Exact and execution match of every record's statement with that of its group; every distinct statement runs once."""
    p = _gold(spark, d).select("pair_id", "gold", "sql")
    s = E.score_statements(p, "gold", "sql", SHOP)
    texts = p.select(F.col("sql").alias("text")).unionByName(p.select(F.col("gold").alias("text")))
    return execution_match(s, "gold", "sql", "em", statement_results(texts, SHOP, d)).select("pair_id", "em", "exec_match")


@query("""
WITH a AS (SELECT o_orderstatus AS s, count(*) AS n_a FROM orders GROUP BY 1), b AS (SELECT o_orderstatus AS s, count(*) AS n_b FROM orders WHERE o_totalprice > 1000 GROUP BY 1)
SELECT coalesce(a.s, b.s) AS o_orderstatus, coalesce(n_a, 0) AS n_a, coalesce(n_b, 0) AS n_b FROM a FULL JOIN b ON a.s = b.s WHERE coalesce(n_a, 0) <> coalesce(n_b, 0)""")
def bag_equality(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return E.bag_difference(o.select("o_orderstatus"), o.where("o_totalprice > 1000").select("o_orderstatus"))


@query("SELECT doc_id, len(string_split(text, ' ')) AS prompt_length, (row_number() OVER (PARTITION BY len(string_split(text, ' ')) ORDER BY doc_id) - 1) // 4 AS chunk FROM documents")
def length_buckets(spark: SparkSession, d: str) -> DataFrame:
    return E.vectorised_length_buckets(table(spark, d, "documents"), F.size(F.split("text", " ")), "doc_id", 4).select("doc_id", "prompt_length", "chunk")


GRAMS = "list_distinct(list_transform(generate_series(1, len({0}) - 1), lambda i: substr({0}, i, 2)))"


@query(f"""
WITH w AS (SELECT DISTINCT lower(city) AS word FROM customers WHERE city IS NOT NULL), x AS (SELECT DISTINCT name AS match FROM customers),
a AS (SELECT word, {GRAMS.format('word')} AS g FROM w), b AS (SELECT match, {GRAMS.format('match')} AS h FROM x),
s AS (SELECT word, match, len(list_intersect(g, h)) / (len(g) + len(h) - len(list_intersect(g, h))) AS s FROM a, b WHERE len(list_intersect(g, h)) > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY s DESC, match) AS k FROM s WHERE s >= 0.1)
SELECT word, match, round(s, 6) AS similarity FROM r WHERE k = 1""")
def ngram_jaccard_best(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customers")
    return Z.ngram_best(c.where("city is not null").select(F.lower("city").alias("word")), c.select(F.col("name").alias("word")), 2, 0.1)


@query("""
WITH w AS (SELECT DISTINCT split_part(item_name, ' ', 1) AS word FROM items WHERE item_name IS NOT NULL), x AS (SELECT DISTINCT split_part(item_name, ' ', 2) AS match FROM items WHERE item_name IS NOT NULL),
s AS (SELECT word, match, 1 - levenshtein(word, match) / greatest(len(word), len(match)) AS s FROM w, x),
r AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY s DESC, match) AS k FROM s)
SELECT word, match, round(s, 6) AS ratio FROM r WHERE k = 1 AND round(s, 6) >= 0.5""")
def levenshtein_best(spark: SparkSession, d: str) -> DataFrame:
    part = lambda i: table(spark, d, "items").where("item_name is not null").select(F.split_part("item_name", F.lit(" "), F.lit(i)).alias("word"))
    return Z.levenshtein_best(part(1), part(2), 0.5)


@query()
def sequence_ratio_best(spark: SparkSession, d: str) -> DataFrame:
    part = lambda i: table(spark, d, "items").where("item_name is not null").select(F.split_part("item_name", F.lit(" "), F.lit(i)).alias("word"))
    return Z.sequence_best(part(1), part(2), 0.6)


@query("""
WITH s AS (SELECT q.vec_id AS query_id, e.vec_id AS match_id, list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS s FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0 AND q.vec_id <> e.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, match_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, match_id, round(s, 4) AS similarity FROM r WHERE rank <= 3""")
def cosine_top3(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose id is divisible by 20 are the queries, against all rows."""
    e = table(spark, d, "embeddings")
    return Z.nearest_vectors(e, e.where("vec_id % 20 = 0"), "vec_id", "embedding", 3)


@query("SELECT DISTINCT e.vec_id FROM embeddings e, embeddings t WHERE t.vec_id % 20 = 0 AND list_cosine_similarity(e.embedding::DOUBLE[], t.embedding::DOUBLE[]) >= 0.3")
def reduced_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return Z.near_any(e, e.where("vec_id % 20 = 0"), "vec_id", "embedding", 0.3)


@query("""
WITH u AS (SELECT label, i, round(avg(embedding[i]::DOUBLE), 5) AS m FROM embeddings, generate_series(1, 64) t(i) GROUP BY 1, 2)
SELECT label, list(m ORDER BY i) AS mean_vector FROM u GROUP BY 1""")
def vector_mean_pool(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").withColumn("embedding", F.col("embedding").cast("array<double>"))
    return Z.mean_pool(e, ["label"], "embedding")


@query("SELECT DISTINCT status, coalesce(nullif(trim(status), status), nullif(lower(status), status), nullif(replace(status, '-', ' '), status), status) AS fixed FROM shop_orders WHERE status IS NOT NULL")
def strategy_chain(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("status")
    return table(spark, d, "shop_orders").where("status is not null").select("status", Z.first_change(s, F.trim(s), F.lower(s), F.replace(s, F.lit("-"), F.lit(" "))).alias("fixed")).distinct()


EDGES = "e AS (SELECT DISTINCT 'q' || sql_group AS src, 'c' || contrast_group AS dst FROM pairs WHERE contrast_group IS NOT NULL AND sql_group IS NOT NULL AND sql_group <> '')"


def _edges(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pairs").where("contrast_group is not null and sql_group is not null and sql_group <> ''")
    return p.select(F.concat(F.lit("q"), "sql_group").alias("src"), F.concat(F.lit("c"), "contrast_group").alias("dst")).distinct()


@query(f"""
WITH RECURSIVE {EDGES}, b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e),
s AS (SELECT 'c' || contrast_group AS node, contrast_group AS source, count(*) AS weight FROM pairs WHERE contrast_kind = 'like' AND contrast_group IS NOT NULL GROUP BY 1, 2),
r(node, source, weight, distance) AS (SELECT node, source, weight, 0 FROM s UNION SELECT b.dst, r.source, r.weight, r.distance + 1 FROM r JOIN b ON r.node = b.src WHERE r.distance < 3),
k AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY distance, weight DESC, source) AS i FROM r)
SELECT node, distance, source FROM k WHERE i = 1""")
def multi_source_path(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pairs").where("contrast_kind = 'like' and contrast_group is not null")
    sources = p.groupBy("contrast_group").agg(F.count(F.lit(1)).alias("weight")).select(F.concat(F.lit("c"), "contrast_group").alias("node"), F.col("contrast_group").alias("source"), "weight")
    return G.nearest_sources(_edges(spark, d), sources, 3)


@query(f"""
WITH RECURSIVE {EDGES}, b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e),
a AS (SELECT DISTINCT contrast_kind AS grp, 'c' || contrast_group AS node FROM pairs WHERE contrast_group IS NOT NULL AND contrast_kind IS NOT NULL),
r(grp, node, distance) AS (SELECT grp, node, 0 FROM a UNION SELECT r.grp, b.dst, r.distance + 1 FROM r JOIN b ON r.node = b.src WHERE r.distance < CASE WHEN r.grp = 'like' THEN 1 ELSE 2 END),
m AS (SELECT grp, node, min(distance) AS distance FROM r GROUP BY 1, 2), n AS (SELECT *, min(distance) OVER (PARTITION BY node) AS d FROM m)
SELECT node, min(grp) AS grp, min(distance) AS distance FROM n WHERE distance = d GROUP BY 1 HAVING count(*) = 1""")
def anchored_reach_tie_reject(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pairs").where("contrast_group is not null and contrast_kind is not null")
    anchors = p.select(F.col("contrast_kind").alias("grp"), F.concat(F.lit("c"), "contrast_group").alias("node"))
    radius = spark.createDataFrame([("like", 1), ("comparison", 2), ("ordering", 2), ("projection", 2)], "grp string, r int")
    return G.clear_winners(G.anchored_reach(_edges(spark, d), anchors, radius))
