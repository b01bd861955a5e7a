"""Parsing in bulk, repair, word forms, generated tables, and the rest of the text forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querymill.dialect.catalog import SHOP
from querymill.dialect.statement import DialectError, parse
from querymill.operators import compose as K
from querymill.operators import corpus as C
from querymill.operators import evaluate as E
from querymill.operators import generate as G
from querymill.operators import profile as P
from querymill.operators import repair as R
from querymill.operators import textforms as T
from querymill.operators.execute import statement_results
from querymill.plans.base import query, table
from querymill.session import materialize


@query("SELECT query_id, table_name, conn, row_limit, len(conds) AS n_conds FROM query_records WHERE table_name IS NOT NULL AND query_kind IS NOT NULL AND query_kind NOT IN ('subquery') AND sql IS NOT NULL")
def parsed_records(spark: SparkSession, d: str) -> DataFrame:
    """Statements parsed from their text against the parts that the records give."""
    q = table(spark, d, "query_records").where("table_name is not null and query_kind is not null and query_kind <> 'subquery' and sql is not null")
    return R.parsed_statements(q, "query_id", "sql", SHOP).select("query_id", "table_name", "conn", "row_limit", F.col("n_conds").cast("long").alias("n_conds"))


@query("SELECT query_id, sql AS canonical FROM query_records WHERE sql IS NOT NULL")
def canonical_records(spark: SparkSession, d: str) -> DataFrame:
    """The records' statements are canonical: parsing and rendering gives them back."""
    return R.parsed_statements(table(spark, d, "query_records").where("sql is not null"), "query_id", "sql", SHOP).select("query_id", "canonical")


@query()
def dialect_violations(spark: SparkSession, d: str) -> DataFrame:
    p = R.parsed_statements(table(spark, d, "pairs").where("sql is not null"), "pair_id", "sql", SHOP)
    return C.reason_histogram(p.select(F.col("violations").alias("reasons")), "reasons")


@query()
def repaired_statements(spark: SparkSession, d: str) -> DataFrame:
    """Statements with a letter of each keyword FROM and of some columns lost, repaired."""
    p = table(spark, d, "query_records").where("sql is not null").select("query_id", F.regexp_replace(F.regexp_replace("sql", " FROM ", " FRM "), "category", "categry").alias("sql"))
    return R.repair_statements(p, "query_id", "sql", SHOP).groupBy("how").agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH c AS (SELECT query_id, unnest(conds) AS c FROM query_records)
SELECT query_id, CASE WHEN c.val LIKE '\\%%\\%' ESCAPE '\\' THEN 'contains' WHEN c.val LIKE '\\%%' ESCAPE '\\' THEN 'suffix' WHEN c.val LIKE '%\\%' ESCAPE '\\' THEN 'prefix' ELSE 'exact' END AS mode, trim(c.val, '%') AS fragment FROM c WHERE c.op = 'LIKE'""".replace("\\\\", "\\"))
def like_modes(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "query_records").select("query_id", F.explode("conds").alias("c")).where("c.op = 'LIKE'")
    return c.select("query_id", T.like_mode(F.col("c.val")).alias("mode"), T.fragment(F.col("c.val")).alias("fragment"))


@query("SELECT query_id, CASE WHEN select_cols = '*' THEN '*' WHEN list_contains(list_transform(coalesce(conds, []), lambda c: c.col), select_cols) THEN 'cond_col' WHEN select_cols = CASE table_name WHEN 'customers' THEN 'name' WHEN 'items' THEN 'item_name' ELSE 'order_id' END THEN 'ident' WHEN select_cols = CASE table_name WHEN 'customers' THEN 'customer_id' WHEN 'items' THEN 'item_id' ELSE '' END THEN 'own_id' ELSE 'attr' END AS role FROM query_records WHERE select_cols IS NOT NULL AND table_name IS NOT NULL")
def projection_roles(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "query_records").where("select_cols is not null and table_name is not null")
    return q.select("query_id", T.projection_role(F.col("table_name"), F.col("select_cols"), F.col("conds"), SHOP).alias("role"))


BARE = "regexp_replace(sql, '''[^'']*''', chr(1), 'g')"


@query(f"SELECT query_id, sql AS restored, len(regexp_extract_all({BARE}, chr(1))) + len(regexp_extract_all(regexp_replace({BARE}, '[A-Za-z_][A-Za-z0-9_]*', '', 'g'), '[0-9]+(?:[.][0-9]+)?')) AS n_slots FROM query_records WHERE sql IS NOT NULL")
def masks_restored(spark: SparkSession, d: str) -> DataFrame:
    """Statements masked and restored, with the number of their literals."""
    q = table(spark, d, "query_records").where("sql is not null").withColumn("m", T.masked(F.col("sql")))
    return q.select("query_id", T.unmasked(F.col("m.mask"), F.col("m.literals")).alias("restored"), F.size("m.literals").cast("long").alias("n_slots"))


@query("""
WITH p AS (SELECT pair_id, lower(question) AS q, string_split(regexp_replace(regexp_extract(sql, 'status IN \\(([^)]*)\\)', 1), '''', '', 'g'), ', ') AS vs FROM pairs WHERE regexp_matches(sql, 'status IN \\(') AND question IS NOT NULL),
u AS (SELECT pair_id, q, unnest(vs) AS v FROM p)
SELECT pair_id, list(v ORDER BY CASE WHEN strpos(q, v) > 0 THEN strpos(q, v) ELSE 1000000 END, v) AS vals FROM u GROUP BY 1""")
def values_in_question_order(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pairs").where("sql rlike 'status IN \\\\(' and question is not null")
    values = F.split(F.replace(F.regexp_extract("sql", r"status IN \(([^)]*)\)", 1), F.lit("'"), F.lit("")), ", ")
    return p.select("pair_id", T.in_text_order(values, F.col("question")).alias("vals"))


@query()
def stated_comparisons(spark: SparkSession, d: str) -> DataFrame:
    """Comparisons that questions word, by operator."""
    p = table(spark, d, "pairs").where("question is not null").select(F.explode(T.comparisons(F.col("question"))).alias("c"))
    return p.groupBy(F.split_part("c", F.lit(" "), F.lit(1)).alias("op")).agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH k AS (SELECT DISTINCT category FROM items WHERE category IS NOT NULL), w AS (SELECT pair_id, lower(sql) AS s, unnest(list_distinct(regexp_extract_all(lower(question), '[\\p{L}\\p{N}]+'))) AS w FROM pairs WHERE sql IS NOT NULL)
SELECT pair_id, category AS extra FROM w JOIN k ON w.w = k.category WHERE strpos(s, category) = 0""")
def extra_values(spark: SparkSession, d: str) -> DataFrame:
    """Categories that a question names and its statement lacks."""
    known = sorted(r[0] for r in table(spark, d, "items").where("category is not null").select("category").distinct().collect())
    p = table(spark, d, "pairs").where("question is not null and sql is not null")
    return p.select("pair_id", F.explode(T.extra_values(F.col("question"), F.col("sql"), known)).alias("extra"))


@query("""
WITH w AS (SELECT DISTINCT unnest(string_split(lower(item_name), ' ')) AS word FROM items WHERE item_name IS NOT NULL)
SELECT word, CASE WHEN regexp_matches(word, '(s|x|z|ch|sh)$') THEN word || 'es' WHEN regexp_matches(word, '[^aeiou]y$') THEN substr(word, 1, len(word) - 1) || 'ies' ELSE word || 's' END AS plural FROM w""")
def plurals(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "items").where("item_name is not null").select(F.explode(F.split(F.lower("item_name"), " ")).alias("word")).distinct()
    return w.select("word", T.plural(F.col("word")).alias("plural"))


@query()
def known_stems(spark: SparkSession, d: str) -> DataFrame:
    """Words of the questions with a base form among the words of the documents."""
    words = lambda t, c: table(spark, d, t).where(F.col(c).isNotNull()).select(F.explode(F.regexp_extract_all(F.lower(c), F.lit("[a-z]+"), F.lit(0))).alias("word")).distinct()
    return T.stem_in(words("pairs", "question"), words("documents", "text"))


@query("SELECT item_id, lower(hex(encode(item_name))) AS code FROM items")
def hex_codes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "items").select("item_id", T.hex_ids(F.col("item_name")).alias("code"))


@query("SELECT DISTINCT w AS word FROM (SELECT unnest(regexp_extract_all(lower(question), '[a-z]+')) AS w FROM pairs) WHERE len(w) <= 3")
def short_words(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "pairs").where("question is not null").select(F.explode(F.regexp_extract_all(F.lower("question"), F.lit("[a-z]+"), F.lit(0))).alias("word"))
    return w.where(F.length("word") <= 3).distinct()


@query("""
WITH s AS (SELECT split_part(item_name, ' ', 1) AS a, split_part(item_name, ' ', 2) AS b FROM items WHERE item_name IS NOT NULL)
SELECT x.a || ' ' || y.b AS name FROM (SELECT DISTINCT a FROM s) x, (SELECT DISTINCT b FROM s) y WHERE x.a || ' ' || y.b NOT IN (SELECT item_name FROM items WHERE item_name IS NOT NULL)""")
def replacement_pool(spark: SparkSession, d: str) -> DataFrame:
    return G.product_pool(table(spark, d, "items"), "item_name")


@query("SELECT round(sum(value * (event_type = 'purchase')::INT) / nullif(sum((event_type = 'purchase')::INT), 0), 4) AS masked_mean FROM events")
def masked_mean(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").agg(F.round(E.masked_mean(F.col("value"), F.col("event_type") == "purchase"), 4).alias("masked_mean"))


@query("""
WITH r AS (SELECT query_id AS id, sql FROM query_records), a AS (SELECT sql, list(DISTINCT question) AS qs FROM pairs WHERE sql IS NOT NULL AND question IS NOT NULL AND trim(question) <> '' GROUP BY 1)
SELECT id, CASE WHEN a.sql IS NULL THEN 'missing' WHEN len(qs) <> 1 THEN 'wrong number of texts' END AS problem FROM r LEFT JOIN a USING (sql)""")
def response_envelopes(spark: SparkSession, d: str) -> DataFrame:
    """Each record is a request; the questions with its statement are the response, one text expected."""
    q = table(spark, d, "query_records").select(F.col("query_id").alias("id"), "sql")
    p = table(spark, d, "pairs").where("sql is not null and question is not null and trim(question) <> ''").groupBy("sql").agg(F.collect_set("question").alias("questions"))
    return C.envelope_checks(q, q.join(p, "sql").select("id", "sql", "questions"), 1)


@query()
def generated_shop_checks(spark: SparkSession, d: str) -> DataFrame:
    """Rules that the generated tables keep: no rows against them."""
    t = G.shop(spark)
    o = P.rule_violations(t["orders"], {"quantity": ~F.col("quantity").between(1, 10), "date": F.col("order_date").try_cast("date").isNull()})
    i = P.rule_violations(t["items"], {"price": ~F.col("price").between(1, 199.99), "decimals": F.abs(F.col("price") - F.round("price", 2)) > 1e-9})
    uncovered = P.childless(t["customers"], "customer_id", t["orders"], "customer_id").agg(F.lit("customers without order").alias("rule"), F.count(F.lit(1)).alias("n_rows"))
    return o.unionByName(i).unionByName(uncovered)


@query()
def generated_holdout(spark: SparkSession, d: str) -> DataFrame:
    h = G.holdout(G.shop(spark)["customers"], "customer_id", 120, 60, 42)
    return h.groupBy("tier").agg(F.count(F.lit(1)).alias("n"))


@query()
def contrast_groups(spark: SparkSession, d: str) -> DataFrame:
    """Variants of every record's statement that differ observably from it."""
    variants = materialize(K.variants_of(table(spark, d, "query_records"), "sql", SHOP), "variants")
    results = statement_results(variants.select("text").unionByName(variants.select(F.col("base").alias("text"))), SHOP, d)
    digests = results.select("text", "digest").where("digest is not null")
    own = digests.select(F.col("text").alias("base"), F.col("digest").alias("base_digest"))
    return variants.join(digests, "text").join(own, "base").where("digest <> base_digest").select("base", "kind", "text")


@query("SELECT norm, count(*) AS n_keys FROM (SELECT DISTINCT lower(trim(status)) AS norm, status FROM shop_orders WHERE status IS NOT NULL) GROUP BY 1 HAVING count(*) > 1")
def wording_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Texts that stand for several keys once they are normalised."""
    s = table(spark, d, "shop_orders").where("status is not null").select(F.lower(F.trim("status")).alias("norm"), "status").distinct()
    return s.groupBy("norm").agg(F.count(F.lit(1)).alias("n_keys")).where("n_keys > 1")


def in_dialect(text: str) -> bool:
    try:
        parse(text)
    except DialectError:
        return False
    return True
