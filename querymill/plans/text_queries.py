"""Tokens, rewriting, wording, responses, set writers and stream windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querymill.dialect.catalog import SHOP
from querymill.functions.labels import label_key
from querymill.operators import compose as K
from querymill.operators import responses as A
from querymill.operators import rewrite as R
from querymill.operators import tokenizer as T
from querymill.plans.base import query, table
from querymill.sources import writers as S
from querymill.streaming.windows import windowed_counts

PIECES = r"p AS (SELECT piece, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '(?s)[\p{L}]+|[\p{N}]|\s+|.')) AS piece FROM documents) GROUP BY 1)"
ASCII = r"p AS (SELECT piece, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(p_name), '[a-z]+|[0-9]|\s+|.')) AS piece FROM part) GROUP BY 1)"
PAIRS = "b AS (SELECT ascii(substr(piece, i, 1)) AS a, ascii(substr(piece, i + 1, 1)) AS b, sum(n)::BIGINT AS n FROM p, generate_series(1, 60) t(i) WHERE i < len(piece) GROUP BY 1, 2)"


@query("WITH p AS (SELECT unnest(regexp_extract_all(text, '[\\p{L}]+')) AS piece FROM documents) SELECT piece, count(*) AS n FROM p GROUP BY 1")
def piece_counts(spark: SparkSession, d: str) -> DataFrame:
    return T.piece_counts(table(spark, d, "documents"), "text").where(F.col("piece").rlike(r"^\p{L}+$"))


def _part_pieces(spark: SparkSession, d: str) -> DataFrame:
    pieces = T.piece_counts(table(spark, d, "part").select(F.lower("p_name").alias("t")), "t")
    return pieces.select(T.byte_ids(F.col("piece")).alias("ids"), "n")


@query(f"WITH {ASCII}, {PAIRS} SELECT a, b, n FROM b")
def bpe_pair_counts(spark: SparkSession, d: str) -> DataFrame:
    return T.pair_counts(_part_pieces(spark, d))


@query(f"WITH {ASCII}, {PAIRS} SELECT a, b, n FROM b ORDER BY n DESC, a, b LIMIT 1")
def bpe_first_merge(spark: SparkSession, d: str) -> DataFrame:
    return T.pair_counts(_part_pieces(spark, d)).orderBy(F.desc("n"), "a", "b").limit(1)


@query()
def bpe_merges(spark: SparkSession, d: str) -> DataFrame:
    m = T.train_merges(table(spark, d, "items").select("item_name"), "item_name", 12)
    return spark.createDataFrame([(i, *x) for i, x in enumerate(m)], "rank int, a int, b int, new int")


@query()
def bpe_encoded_lengths(spark: SparkSession, d: str) -> DataFrame:
    """Lengths of the customers' names under merges learnt from the items' names."""
    m = T.train_merges(table(spark, d, "items").select("item_name"), "item_name", 12)
    return T.encode(table(spark, d, "customers"), "customer_id", "name", m).select("customer_id", F.size("ids").alias("n_ids"))


@query("SELECT step, round(CASE WHEN step < 10 THEN 0.001 * (step + 1) / 10 ELSE 0.0001 + 0.0009 * (1 + cos(3.141592653589793 * least((step - 10) / 90.0, 1.0))) / 2 END, 9) AS rate FROM (SELECT unnest(generate_series(0, 120)) AS step)")
def rate_schedule(spark: SparkSession, d: str) -> DataFrame:
    return spark.range(121).withColumnRenamed("id", "step").select("step", F.round(T.warm_cosine(F.col("step"), 10, 100, 0.001, 0.0001), 9).alias("rate"))


@query("SELECT doc_id, list_concat(x, list_transform(generate_series(1, 8 - len(x)), lambda i: 0)) AS inputs FROM (SELECT doc_id, list_slice(list_transform(string_split(text, ' '), lambda w: len(w)), 1, 8) AS x FROM documents)")
def padded_rows(spark: SparkSession, d: str) -> DataFrame:
    ids = F.transform(F.split("text", " "), lambda w: F.length(w))
    return table(spark, d, "documents").select("doc_id", F.slice(F.concat(ids, F.array_repeat(F.lit(0), 8)), 1, 8).alias("inputs"))


@query()
def collated_rows(spark: SparkSession, d: str) -> DataFrame:
    """Whole documents as framed rows of word lengths, shifted, masked and padded to the longest row of their length class."""
    words = F.transform(F.split("text", " "), lambda w: F.length(w))
    ids, start = T.framed(F.array().cast("array<int>"), words, -1, -2, -3)
    framed = table(spark, d, "documents").where("text is not null").select("doc_id", ids.alias("ids"), start.alias("start"))
    return T.collated(framed, "ids", "start", 0).select("doc_id", "batch", "row.inputs", "row.targets", "row.mask")


@query("""
WITH o AS (SELECT user_id, floor(epoch(ts))::BIGINT AS s, floor(epoch(ts))::BIGINT + 3600 AS e FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
m AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM o),
i AS (SELECT *, sum(CASE WHEN reach >= s THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM m)
SELECT user_id, min(s) AS span_start, max(e) AS span_end FROM i GROUP BY user_id, k""")
def merge_spans(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").where("user_id is not null and ts is not null")
    s = F.unix_seconds(F.col("ts").cast("timestamp"))
    return R.merged_spans(e.select("user_id", s.alias("s"), (s + 3600).alias("e")), "user_id", "s", "e")


@query()
def first_span_selection(spark: SparkSession, d: str) -> DataFrame:
    """Non-overlapping spans of number and word runs of each document, the first and longest kept."""
    words = F.array_distinct(F.regexp_extract_all("text", F.lit(r"[\p{L}]{8,}"), F.lit(0)))
    spans = F.transform(words, lambda w: F.struct(F.instr(F.col("text"), w).alias("s"), (F.instr(F.col("text"), w) + F.length(w)).alias("e")))
    return table(spark, d, "documents").select("doc_id", F.size(R.first_spans(spans)).alias("n_spans"))


def _sql(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


@query(f"SELECT pair_id, CASE WHEN regexp_matches(lower(trim(question)), {_sql(R.CONTEXTUAL)}) THEN 'contextual' WHEN regexp_matches(lower(trim(question)), {_sql(R.CONVERSATIONAL)}) THEN 'conversational' ELSE 'common' END AS style FROM pairs WHERE question IS NOT NULL")
def style_inference(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pairs").where("question is not null").select("pair_id", R.style_of(F.col("question")).alias("style"))


def _phrases(column: str) -> str:
    for pattern, new in R.PHRASES:
        column = f"regexp_replace({column}, {_sql(pattern)}, {_sql(new.replace('$1', chr(92) + '1'))}, 'gi')"
    return column


@query(f"SELECT pair_id, {_phrases('question')} AS rewritten FROM pairs WHERE question IS NOT NULL AND {_phrases('question')} <> question")
def phrase_rewrites(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pairs").where("question is not null").select("pair_id", "question", R.phrase_rules(F.col("question")).alias("rewritten"))
    return p.where("rewritten <> question").select("pair_id", "rewritten")


@query()
def finished_questions(spark: SparkSession, d: str) -> DataFrame:
    """Questions cleaned up after their phrases and signs are rewritten."""
    p = table(spark, d, "pairs").where("question is not null").select("pair_id", "question", R.finish(R.symbol_rules(R.phrase_rules(F.col("question")))).alias("finished"))
    return p.where("finished <> lower(question)").select("pair_id", "finished")


WORDS = {"clients": ("customers", 1), "buyers": ("customers", 1), "goods": ("items", 1), "purchases": ("orders", 1), "pieces": ("quantity", 2), "cost": ("price", 1)}


@query()
def normalised_questions(spark: SparkSession, d: str) -> DataFrame:
    """Words to the dialect's own, outside quotes, numbers and catalog names."""
    names = [r[0] for r in table(spark, d, "items").where("item_name is not null").select("item_name").distinct().orderBy("item_name").collect()]
    return R.normalise_texts(table(spark, d, "pairs").select("pair_id", "question"), "pair_id", "question", R.Normaliser(WORDS, names, keep=("stock",))).select("pair_id", "changes")


@query()
def swapped_names(spark: SparkSession, d: str) -> DataFrame:
    pool = table(spark, d, "items").select(F.col("item_name").alias("name"), "category")
    return R.swap_names(table(spark, d, "pairs").select("pair_id", "question", "sql").where("question is not null and sql is not null"), "pair_id", "question", "sql", pool)


@query()
def composed_questions(spark: SparkSession, d: str) -> DataFrame:
    return K.compose(table(spark, d, "query_records"), "query_id", "sql", 2)


@query()
def judged_pairs(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pairs")
    return K.judge_pairs(p, "pair_id", "question", "sql", SHOP).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


@query(r"""
SELECT reason, count(*) AS n FROM (SELECT CASE WHEN question IS NULL OR sql IS NULL THEN 'incomplete'
 WHEN fn = 'AVG' AND NOT regexp_matches(q, '\b(average|mean|typical)\b') THEN 'average without cue'
 WHEN fn = 'SUM' AND NOT regexp_matches(q, '\b(total|sum|summed|overall|altogether)\b') THEN 'sum without cue'
 WHEN fn = 'COUNT' AND NOT regexp_matches(q, '\b(count|number|how many|how often)\b') THEN 'count without cue'
 WHEN regexp_matches(upper(sql), '\bLIMIT 1\b') AND NOT regexp_matches(q, '\b(first|top|highest|lowest|sorted|order(?:ed)? by|biggest|smallest|largest|latest|earliest|cheapest|most|least|rows)\b') THEN 'limit without cue'
 WHEN regexp_matches(upper(sql), '\bGROUP BY\b') AND NOT regexp_matches(q, '\b(per|by|each|every|for each|split|break|broken|grouped)\b') THEN 'group without cue' END AS reason
 FROM (SELECT question, sql, lower(question) AS q, regexp_extract(upper(sql), '\b(COUNT|SUM|AVG|MIN|MAX)\s*\(', 1) AS fn FROM pairs)) GROUP BY 1""")
def drop_reasons(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pairs")
    return p.groupBy(K.drop_reason(F.col("question"), F.col("sql")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query()
def repaired_responses(spark: SparkSession, d: str) -> DataFrame:
    """Answers made of the records' questions, every other one damaged, read back."""
    p = table(spark, d, "pairs").where("question is not null").select("pair_id", F.to_json(F.array(F.struct(F.col("pair_id").alias("id"), F.array("question").alias("questions")))).alias("raw"))
    damaged = F.when(F.col("pair_id") % 2 == 0, F.concat(F.lit("```json\n"), F.rtrim(F.col("raw"), F.lit("]")), F.lit("\n```"))).otherwise(F.col("raw"))
    return A.read_responses(p.withColumn("raw", damaged), "pair_id", "raw").groupBy("how").agg(F.count("id").alias("n"))


@query("""
SELECT eval_set, count(*) AS n FROM (SELECT eval_set FROM pairs WHERE (eval_set IS NULL OR eval_set NOT IN ('composed', 'human_style')) UNION ALL SELECT eval_set FROM pairs WHERE eval_set = 'composed' AND split = 'test') GROUP BY 1""")
def upserted_sets(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pairs").select("pair_id", "eval_set", "split")
    got = S.upsert_sets(p, p.where("eval_set = 'composed' and split = 'test'"), "eval_set", ["human_style"])
    return got.groupBy("eval_set").agg(F.count(F.lit(1)).alias("n"))


@query(f"""
WITH n AS (SELECT *, trim(regexp_replace(regexp_replace(lower(question), '[^\\p{{L}}\\p{{N}}_ \\t\\r\\n\\f]', '', 'g'), '[ \\t\\r\\n\\f]+', ' ', 'g')) AS norm FROM pairs),
fresh AS (SELECT * FROM n WHERE round = 'r09'), kept AS (SELECT * FROM n WHERE NOT EXISTS (SELECT 1 FROM fresh f WHERE f.round = n.round AND f.platform = n.platform)),
bad AS (SELECT norm FROM (SELECT norm, sql_group FROM kept UNION ALL SELECT norm, sql_group FROM fresh) WHERE norm <> '' AND sql_group IS NOT NULL GROUP BY 1 HAVING count(DISTINCT sql_group) > 1)
SELECT pair_id FROM kept UNION ALL SELECT pair_id FROM fresh WHERE norm IS NULL OR norm NOT IN (SELECT norm FROM bad)""")
def promoted_pairs(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pairs").select("pair_id", "question", "sql_group", "round", "platform")
    return S.promote(p, p.where("round = 'r09'")).select("pair_id")


@query("SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts)::VARCHAR AS window_start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_windows(spark: SparkSession, d: str) -> DataFrame:
    """An extension: the stream operator over the batch table."""
    w = windowed_counts(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return w.select("event_type", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "n", F.round("total", 4).alias("total"))
