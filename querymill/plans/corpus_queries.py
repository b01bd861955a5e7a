"""Corpus quality over pairs and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querymill.functions.labels import label_key
from querymill.operators import corpus as C
from querymill.plans.base import query, table

NORM = r"trim(regexp_replace(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}_ \t\r\n\f]', '', 'g'), '[ \t\r\n\f]+', ' ', 'g'))"
LABEL = r"nullif(regexp_replace(lower(regexp_replace({0}, '^[\s_-]+|[\s_-]+$', '', 'g')), '[\s_-]+', '_', 'g'), '')"


def norm(column: str) -> str:
    return NORM.format(column)


@query(f"SELECT {norm('text')} AS norm, count(*) AS n_rows FROM documents GROUP BY 1 HAVING count(*) > 1")
def dup_normalised(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy(C.normalise(F.col("text")).alias("norm")).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")


@query(f"""
WITH k AS (SELECT sql_group, pair_id, {norm('question')} AS norm FROM pairs WHERE sql_group IS NOT NULL AND question IS NOT NULL)
SELECT sql_group, pair_id, norm, first_pos FROM (SELECT *, min(pair_id) OVER (PARTITION BY sql_group, norm) AS first_pos FROM k) WHERE pair_id > first_pos""")
def dup_within_group(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pairs").where("sql_group is not null and question is not null")
    return C.repeats_within_group(p, "sql_group", "question", "pair_id")


@query(f"""
SELECT norm, count(DISTINCT sql_group) AS n_labels, count(*) AS n_rows FROM (SELECT {norm('question')} AS norm, sql_group FROM pairs WHERE sql_group IS NOT NULL)
WHERE norm IS NOT NULL AND norm <> '' GROUP BY 1 HAVING count(DISTINCT sql_group) > 1""")
def label_conflicts(spark: SparkSession, d: str) -> DataFrame:
    return C.label_conflicts(table(spark, d, "pairs"), C.normalise(F.col("question")), F.col("sql_group"))


@query("SELECT question AS norm, count(DISTINCT sql) AS n_labels, count(*) AS n_rows FROM pairs WHERE question <> '' AND sql IS NOT NULL GROUP BY 1 HAVING count(DISTINCT sql) > 1")
def exact_question_conflicts(spark: SparkSession, d: str) -> DataFrame:
    return C.label_conflicts(table(spark, d, "pairs"), F.col("question"), F.col("sql"))


@query(f"""
WITH k AS (SELECT pair_id, sql_group, {norm('question')} AS norm FROM pairs),
bad AS (SELECT norm FROM k WHERE norm <> '' AND sql_group IS NOT NULL GROUP BY 1 HAVING count(DISTINCT sql_group) > 1)
SELECT pair_id FROM k WHERE norm IS NULL OR norm NOT IN (SELECT norm FROM bad)""")
def conflict_drop_both(spark: SparkSession, d: str) -> DataFrame:
    return C.drop_conflicts(table(spark, d, "pairs"), C.normalise(F.col("question")), F.col("sql_group")).select("pair_id")


@query()
def template_reuse(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pairs").where("question is not null and sql is not null")
    keyed = p.select("sql", label_key(F.col("family")).alias("family"), "style", C.skeleton(F.col("question"), F.col("sql")).alias("skeleton"))
    return C.template_reuse(keyed.where("family is not null and style is not null"), ["family", "style"], "sql", "skeleton")


@query("""
SELECT pair_id FROM pairs WHERE len(list_filter(regexp_extract_all(sql, '''([^'']*)''', 1), lambda x: NOT regexp_matches(x, '^%|%$|^[0-9]{4}-') AND strpos(lower(question), x) = 0)) > 0""")
def literal_missing(spark: SparkSession, d: str) -> DataFrame:
    literals = F.filter(C.quoted_literals(F.col("sql")), lambda x: ~x.rlike("^%|%$|^[0-9]{4}-"))
    return table(spark, d, "pairs").where(F.exists(literals, lambda x: ~F.contains(F.lower("question"), x))).select("pair_id")


@query(r"""
SELECT i.item_name, count(*) AS n_questions FROM (SELECT DISTINCT item_name FROM items WHERE item_name IS NOT NULL) i
JOIN (SELECT regexp_extract(sql, 'item_name\s*=\s*''([^'']*)''', 1) AS item_name, question FROM pairs WHERE sql LIKE '%item_name%') p USING (item_name)
WHERE regexp_matches(lower(p.question), '(^|[^\p{L}\p{N}_])' || i.item_name || '(''s|s|es)?($|[^\p{L}\p{N}_])') GROUP BY 1""")
def literal_in_text(spark: SparkSession, d: str) -> DataFrame:
    """Questions that hold their statement's item name as a whole word. The name is an equi-join key, so nothing is compared crosswise."""
    p = table(spark, d, "pairs").where("sql like '%item_name%'").select(F.regexp_extract("sql", r"item_name\s*=\s*'([^']*)'", 1).alias("item_name"), "question")
    names = table(spark, d, "items").select("item_name").where("item_name is not null").distinct()
    return p.join(names, "item_name").where(C.word_literal(F.col("question"), F.col("item_name"))).groupBy("item_name").agg(F.count(F.lit(1)).alias("n_questions"))


@query(r"SELECT doc_id, len(list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda x: x IN ('zero','two','three','four','five','six','seven','eight','nine','ten','eleven','twelve','thirteen','fourteen','fifteen','sixteen','seventeen','eighteen','nineteen','twenty','thirty','forty','fifty','sixty','seventy','eighty','ninety','hundred'))) AS n_number_words FROM documents")
def number_word_flags(spark: SparkSession, d: str) -> DataFrame:
    words = F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda x: x.isin(C.NUMBER_WORDS))
    return table(spark, d, "documents").select("doc_id", F.size(words).cast("long").alias("n_number_words"))


@query()
def missing_numerals(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pairs").where("question is not null and sql is not null")
    return p.select("pair_id", C.missing_numerals(F.col("question"), F.col("sql")).alias("missing")).where(F.size("missing") > 0)


HARD = f"""
WITH p AS (SELECT question AS q, sql AS s, string_split_regex(lower(question), '[^a-z]+') AS ws, list_filter(regexp_extract_all(sql, '\'\'([^\'\']*)\'\'', 1), lambda x: NOT regexp_matches(x, '^%|%$|^[0-9]{{4}}-')) AS ls FROM pairs),
r AS (SELECT CASE WHEN q <> lower(q) THEN 'not lower case' END AS reason FROM p UNION ALL SELECT CASE WHEN len(list_filter(ls, lambda x: strpos(lower(q), x) = 0)) > 0 THEN 'literal missing' END FROM p WHERE q IS NOT NULL
 UNION ALL SELECT CASE WHEN list_has_any(ws, [{", ".join("'" + w + "'" for w in C.NUMBER_WORDS)}]) THEN 'number word' END FROM p UNION ALL SELECT CASE WHEN regexp_matches(q, '[a-z]_[a-z]') THEN 'column name' END FROM p
 UNION ALL SELECT CASE WHEN {" OR ".join(f"(regexp_matches(q, '{chr(92)}b{w}{chr(92)}b') AND strpos(lower(s), {chr(39) * 3}{w}{chr(39) * 3}) = 0)" for w in C.SWAPPED_WORDS)} THEN 'synonym' END FROM p)
SELECT reason, count(*) AS n_rows FROM r WHERE reason IS NOT NULL GROUP BY 1"""


@query(HARD)
def hard_check_reasons(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pairs")
    return C.reason_histogram(p.select(C.check_reasons(F.col("question"), F.col("sql")).alias("reasons")), "reasons")


@query("""
SELECT platform, persona, count(*) AS n_rows, round(avg(CASE WHEN question = lower(question) THEN 1 ELSE 0 END), 4) AS pass_rate
FROM pairs WHERE question IS NOT NULL GROUP BY 1, 2""")
def pass_rate_by_platform(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pairs").where("question is not null")
    reasons = F.array_compact(F.array(F.when(F.col("question") != F.lower("question"), "not lower case")))
    return C.pass_rates(p.withColumn("reasons", reasons), ["platform", "persona"], "reasons")


@query("SELECT p.pair_id FROM pairs p WHERE p.split = 'train' AND p.sql IN (SELECT sql FROM pairs WHERE split IN ('validation', 'test') AND sql IS NOT NULL)")
def contaminated_training(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pairs")
    held = p.where(F.col("split").isin("validation", "test")).select(F.col("sql").alias("key"))
    return C.contamination(p.where("split = 'train'"), F.col("sql"), held).select("pair_id")


@query("SELECT p.pair_id FROM pairs p WHERE p.split = 'train' AND (p.sql IS NULL OR p.sql NOT IN (SELECT sql FROM pairs WHERE split IN ('validation', 'test') AND sql IS NOT NULL))")
def contamination_anti(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pairs")
    held = p.where(F.col("split").isin("validation", "test")).select(F.col("sql").alias("key"))
    return C.without(p.where("split = 'train'"), F.col("sql"), held).select("pair_id")


@query("SELECT count(*) AS n_shared FROM (SELECT DISTINCT sql FROM pairs WHERE split = 'train' AND sql IS NOT NULL) a JOIN (SELECT DISTINCT sql FROM pairs WHERE split = 'test' AND sql IS NOT NULL) b USING (sql)")
def leak_check(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pairs").where("sql is not null")
    return p.where("split = 'train'").select("sql").intersect(p.where("split = 'test'").select("sql")).agg(F.count(F.lit(1)).alias("n_shared"))


@query(r"""
SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[\p{L}]+')) AS word FROM documents) GROUP BY 1""")
def vocab_counts(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}]+"), F.lit(0))).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


@query(r"""
SELECT word, sum(k)::BIGINT AS n FROM (SELECT sql, count(*) AS k, unnest(list_distinct(regexp_extract_all(lower(sql), '[a-z_]+'))) AS word FROM pairs WHERE sql IS NOT NULL GROUP BY sql) GROUP BY 1""")
def weighted_token_counts(spark: SparkSession, d: str) -> DataFrame:
    """Each distinct statement is read once and counts by its multiplicity."""
    p = table(spark, d, "pairs").where("sql is not null").groupBy("sql").agg(F.count(F.lit(1)).alias("k"))
    words = p.select("k", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("sql"), F.lit("[a-z_]+"), F.lit(0)))).alias("word"))
    return words.groupBy("word").agg(F.sum("k").alias("n"))


@query("""
WITH o AS (SELECT n_chars AS v, row_number() OVER (ORDER BY n_chars) AS i, count(*) OVER () AS n FROM documents)
SELECT min(v) AS min_value, round(avg(v), 4) AS mean_value, max(v) AS max_value, max(CASE WHEN i = floor(n * 0.5) + 1 THEN v END) AS p50, max(CASE WHEN i = floor(n * 0.99) + 1 THEN v END) AS p99 FROM o""")
def nearest_rank_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return C.nearest_rank(table(spark, d, "documents"), "n_chars", [0.5, 0.99])


@query(f"SELECT {LABEL.format('source')} AS source, count(*) AS n_docs FROM documents GROUP BY 1")
def source_labels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy(label_key(F.col("source")).alias("source")).agg(F.count(F.lit(1)).alias("n_docs"))


@query("SELECT pair_id, coalesce(orig_question, question) AS question, coalesce(orig_sql, sql) AS sql FROM pairs")
def original_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Records with augmentation undone."""
    return table(spark, d, "pairs").select("pair_id", F.coalesce("orig_question", "question").alias("question"), F.coalesce("orig_sql", "sql").alias("sql"))


@query("SELECT count(*) FILTER (WHERE source LIKE 'llm:%') AS n_llm, count(*) FILTER (WHERE source LIKE 'composer%') AS n_composer FROM pairs")
def source_classes(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("source")
    return table(spark, d, "pairs").agg(F.count_if(s.startswith("llm:")).alias("n_llm"), F.count_if(s.startswith("composer")).alias("n_composer"))


@query("""
SELECT p.pair_id, coalesce(g.skeleton, s.skeleton) AS skeleton FROM pairs p LEFT JOIN query_records g ON p.sql_group = g.sql LEFT JOIN query_records s ON p.sql = s.sql""")
def metadata_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Statement metadata by sql_group, else by sql."""
    p, q = table(spark, d, "pairs").select("pair_id", "sql_group", "sql"), table(spark, d, "query_records")
    by = lambda c, n: q.select(F.col("sql").alias(c), F.col("skeleton").alias(n))
    return p.join(by("sql_group", "g"), "sql_group", "left").join(by("sql", "s"), "sql", "left").select("pair_id", F.coalesce("g", "s").alias("skeleton"))


@query("SELECT DISTINCT sql FROM pairs p WHERE split IN ('validation', 'test') AND sql IS NOT NULL AND sql NOT IN (SELECT sql FROM query_records)")
def metadata_missing(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pairs").where(F.col("split").isin("validation", "test") & F.col("sql").isNotNull())
    return p.select("sql").distinct().join(table(spark, d, "query_records").select("sql"), "sql", "left_anti")


@query("SELECT pair_id, question, sql FROM pairs WHERE eval_set = 'composed'")
def evaluation_set(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pairs").where("eval_set = 'composed'").select("pair_id", "question", "sql")


@query("SELECT DISTINCT eval_set FROM pairs WHERE eval_set IS NOT NULL")
def evaluation_sets(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pairs").where("eval_set is not null").select("eval_set").distinct()


@query("""
WITH g AS (SELECT style, source, count(*) AS n FROM pairs WHERE style BETWEEN 0 AND 4 GROUP BY 1, 2)
SELECT style, source, n FROM g""")
def style_source_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pairs").where("style between 0 and 4").groupBy("style", "source").agg(F.count(F.lit(1)).alias("n"))
