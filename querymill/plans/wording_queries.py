"""Questions against their statements: what a question leaves open, rules on wording, break-downs, and forms of pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querymill.functions.labels import label_key
from querymill.operators import evaluate as E
from querymill.operators import pairforms as Q
from querymill.operators import rewrite as R
from querymill.operators import wordrules as U
from querymill.operators.wordrules import Worded
from querymill.plans.base import query, table
from querymill.plans.match_queries import WILSON


def flat_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs with the flat record of their statement, by sql_group."""
    q = table(spark, d, "query_records").where("query_kind is null and select_cols is not null and table_name is not null")
    q = q.select(F.col("sql").alias("__sql"), "table_name", "select_cols", "conds", "conn", "order_spec", "row_limit", "inner_conds", "struct_combo")
    return table(spark, d, "pairs").join(q, F.col("sql_group") == F.col("__sql")).drop("__sql")


def worded(p: DataFrame) -> Worded:
    return Worded(p["question"], p["table_name"], p["select_cols"], p["conds"], p["order_spec"])


def _s(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


CASE_IDENT = "CASE table_name WHEN 'customers' THEN 'name' WHEN 'items' THEN 'item_name' WHEN 'orders' THEN 'order_id' END"
CASE_OWN = "CASE table_name WHEN 'customers' THEN 'customer_id' WHEN 'items' THEN 'item_id' END"
RECORDS = f"""
r AS (SELECT p.pair_id, p.question, replace(lower(trim(p.question)), '_', ' ') AS q, q.table_name, q.select_cols AS s, q.order_spec, coalesce(q.conds, []) AS cs, {CASE_IDENT} AS ident, {CASE_OWN} AS own
 FROM pairs p JOIN query_records q ON p.sql_group = q.sql WHERE q.query_kind IS NULL AND q.select_cols IS NOT NULL AND q.table_name IS NOT NULL),
i AS (SELECT *, list_transform(cs, lambda c: c.col) AS cols, list_transform(list_filter(cs, lambda c: c.op = '='), lambda c: c.col) AS eq,
 list_transform(list_filter(cs, lambda c: c.op IN ('=', 'IN')), lambda c: c.col) AS fixed,
 array_to_string(flatten(list_transform(list_filter(cs, lambda c: c.col IN ('customer_id', 'item_id', 'order_id')), lambda c: list_filter(list_concat([c.val], coalesce(c.vals, [])), lambda x: x IS NOT NULL))), '|') AS ids FROM r),
a1 AS (SELECT *, CASE WHEN ids <> '' THEN regexp_replace(q, '\\b(?:ids?|numbers?|no\\.?)\\s*#?\\s*(' || ids || ')\\b', ' \\1', 'g') ELSE q END AS x1 FROM i),
a2 AS (SELECT *, CASE WHEN table_name = 'orders' THEN regexp_replace(x1, {_s(U.OTHER_ID)}, ' ', 'g') ELSE x1 END AS x2 FROM a1),
a AS (SELECT *, CASE WHEN list_contains(fixed, ident) THEN regexp_replace(x2, {_s(U.NAMING)}, ' ', 'g') ELSE x2 END AS asked FROM a2),
w AS (SELECT *, regexp_matches(asked, {_s(U.STAR)}) AS star, CASE table_name {' '.join(f"WHEN '{t}' THEN regexp_matches(asked, {_s(c)})" for t, c in U.NAMED.items())} END AS named,
 CASE WHEN list_contains(fixed, ident) THEN '*' WHEN regexp_matches(asked, {_s(U.WHICH)}) THEN ident WHEN regexp_matches(asked, {_s(U.PLURAL)}) THEN '*' WHEN regexp_matches(asked, {_s(U.LOOK_UP)}) THEN '*' ELSE ident END AS shown FROM a)"""


@query(f"WITH {RECORDS} SELECT pair_id FROM w WHERE s IN ('*', ident) AND NOT list_contains(eq, s) AND NOT star AND NOT named")
def ambiguous_projections(spark: SparkSession, d: str) -> DataFrame:
    """Pairs whose question leaves open whether rows or the identifying column are shown."""
    p = flat_pairs(spark, d)
    return p.where(U.ambiguous(worded(p))).select("pair_id")


@query(f"WITH {RECORDS} SELECT pair_id, shown FROM w WHERE question IS NOT NULL")
def default_projections(spark: SparkSession, d: str) -> DataFrame:
    p = flat_pairs(spark, d)
    return p.where("question is not null").select("pair_id", U.default_projection(worded(p)).alias("shown"))


BROKEN = f"""CASE WHEN question IS NULL THEN NULL
 WHEN len(cols) = 1 AND eq = cols AND s = cols[1] THEN CASE WHEN NOT regexp_matches(q, {_s(U.EXISTS)}) THEN 'L1' END
 WHEN len(cols) > 0 AND order_spec IS NULL AND regexp_matches(q, {_s(U.EXISTS_FIRST)}) AND NOT star AND s = ident THEN NULL
 WHEN len(cols) > 0 AND order_spec IS NULL AND regexp_matches(q, {_s(U.EXISTS_FIRST)}) AND NOT star AND s = '*' THEN 'L14'
 WHEN s IN ('*', ident) AND NOT star AND NOT named AND s <> shown THEN 'L2'
 WHEN s = own AND NOT regexp_matches(asked, {_s(U.ID_WORD)}) THEN 'L3'
 WHEN table_name = 'orders' AND len(cols) > 0 AND len(list_filter(cols, lambda c: c NOT IN ('customer_id', 'item_id'))) = 0 AND (s = '*' OR list_contains(cols, s)) AND NOT regexp_matches(q, {_s(U.ORDERING)}) THEN 'L4' END"""


@query(f"WITH {RECORDS} SELECT pair_id, {BROKEN} AS reason FROM w WHERE {BROKEN} IS NOT NULL")
def wording_rule_breaks(spark: SparkSession, d: str) -> DataFrame:
    """The first rule that each pair of a flat statement breaks."""
    p = flat_pairs(spark, d)
    return p.select("pair_id", U.broken_rule(worded(p)).alias("reason")).where("reason is not null")


@query(f"""
WITH {RECORDS}, f AS (SELECT unnest(list_filter([
 CASE WHEN (list_contains(cols, 'stock') OR s = 'stock') AND strpos(lower(question), 'order') > 0 AND NOT regexp_matches(lower(question), 'stock|left|remain') THEN 'stock in words of orders' END,
 CASE WHEN (list_contains(cols, 'quantity') OR s = 'quantity') AND strpos(lower(question), 'stock') > 0 THEN 'quantity in words of stock' END,
 CASE WHEN list_contains(cols, s) AND NOT regexp_matches(lower(question), 'is there|exist|confirm|verify|check') THEN 'no words of existence' END], lambda x: x IS NOT NULL)) AS reason FROM i WHERE question IS NOT NULL)
SELECT reason, count(*) AS n_rows FROM f GROUP BY 1""")
def soft_flag_counts(spark: SparkSession, d: str) -> DataFrame:
    p = flat_pairs(spark, d).where("question is not null")
    return p.select(F.explode(U.soft_flags(worded(p))).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n_rows"))


@query(f"""
WITH {RECORDS}, b AS (SELECT pair_id, {BROKEN} AS reason FROM w), j AS (SELECT b.reason, p.sql = p.sql_group AS em FROM b JOIN pairs p USING (pair_id)),
l AS (SELECT 'all' AS subset, em FROM j UNION ALL SELECT 'rule consistent', em FROM j WHERE reason IS NULL),
g AS (SELECT subset, count(*) AS n, count(*) FILTER (WHERE em) AS hits FROM l GROUP BY 1)
SELECT subset, n, hits, round(hits / n, 6) AS rate, {WILSON} FROM g""")
def rule_consistent_rates(spark: SparkSession, d: str) -> DataFrame:
    """Exact match over all pairs and over those whose wording breaks no rule."""
    p = flat_pairs(spark, d)
    j = p.select((F.col("sql") == F.col("sql_group")).alias("em"), U.broken_rule(worded(p)).isNull().alias("ok"))
    subset = F.when(F.col("ok"), F.array(F.lit("all"), F.lit("rule consistent"))).otherwise(F.array(F.lit("all")))
    return E.rates(j.select("em", F.explode(subset).alias("subset")), ["subset"], "em")


@query(f"""
WITH b AS (SELECT p.sql = p.sql_group AS em, p.split, p.persona, split_part(p.eval_slot, ':', 1) AS slot, q.table_name, q.struct_combo, q.row_limit, q.order_spec, q.select_cols, q.conn, coalesce(q.conds, []) AS cs, coalesce(q.inner_conds, []) AS ic
 FROM pairs p JOIN query_records q ON p.sql_group = q.sql WHERE q.query_kind IS NULL AND q.select_cols IS NOT NULL AND q.table_name IS NOT NULL),
e AS (SELECT *, list_transform(cs, lambda c: c.op) AS ops, list_filter(list_concat(cs, ic), lambda c: c.col = 'order_date') AS dc FROM b),
l AS (SELECT 'split' AS dimension, split AS value, em FROM e UNION ALL SELECT 'persona', persona, em FROM e UNION ALL SELECT 'eval_slot', slot, em FROM e UNION ALL SELECT 'table', table_name, em FROM e
 UNION ALL SELECT 'struct_combo', struct_combo::VARCHAR, em FROM e
 UNION ALL SELECT 'conds', len(ops)::VARCHAR || coalesce(' ' || conn, '') || CASE WHEN list_contains(ops, 'IN') THEN ' +IN' ELSE '' END || CASE WHEN list_contains(ops, 'LIKE') THEN ' +LIKE' ELSE '' END, em FROM e
 UNION ALL SELECT 'order', CASE WHEN order_spec IS NULL THEN '-' ELSE 'ORDER BY' || CASE WHEN row_limit IS NULL THEN '' WHEN row_limit = 1 THEN ' + LIMIT 1' ELSE ' + LIMIT n' END END, em FROM e
 UNION ALL SELECT 'date_usage', CASE WHEN len(dc) > 0 OR select_cols = 'order_date' OR coalesce(order_spec.col = 'order_date', FALSE) THEN 'date' ELSE 'no_date' END, em FROM e
 UNION ALL SELECT 'date_op', dc[1].op, em FROM e),
g AS (SELECT dimension, value, count(*) AS n, count(*) FILTER (WHERE em) AS hits FROM l WHERE value IS NOT NULL GROUP BY 1, 2)
SELECT dimension, value, n, hits, round(hits / n, 6) AS rate, {WILSON} FROM g""")
def evaluation_breakdowns(spark: SparkSession, d: str) -> DataFrame:
    """Exact match by split, persona, slot, table, hold-out, conditions, order and use of dates."""
    p = flat_pairs(spark, d)
    used, op = E.date_usage(p["conds"], p["inner_conds"], p["select_cols"], p["order_spec"])
    dims = {
        "split": p["split"], "persona": p["persona"], "eval_slot": F.split_part("eval_slot", F.lit(":"), F.lit(1)), "table": p["table_name"], "struct_combo": p["struct_combo"],
        "conds": E.condition_label(p["conds"], p["conn"]), "order": E.order_label(p["order_spec"], p["row_limit"]), "date_usage": used, "date_op": op,
    }
    wide = p.select((F.col("sql") == F.col("sql_group")).alias("em"), *[c.alias(f"d_{k}") for k, c in dims.items()]).toDF("em", *dims)
    return E.rates_by_dimensions(wide, list(dims), "em")


@query()
def multi_answer_rates(spark: SparkSession, d: str) -> DataFrame:
    """Exact matches, and with them those that only take * for the identifying column where the question leaves it open."""
    from querymill.dialect.catalog import SHOP

    p = flat_pairs(spark, d).where("sql is not null")
    s = E.score_statements(p.select("pair_id", "sql_group", "sql", U.ambiguous(worded(p)).alias("open")), "sql_group", "sql", SHOP, ambiguous=F.col("open"))
    return s.agg(F.count(F.lit(1)).alias("n"), F.count_if("em").alias("n_em"), F.count_if("em_multi").alias("n_em_multi"), F.count_if("in_dialect").alias("n_in_dialect"))


@query("""
SELECT pair_id, lower(trim(question)) AS question, coalesce(nullif(trim(sql_group), ''), sql) AS sql_group FROM pairs WHERE question IS NOT NULL""")
def normal_pairs(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pairs").where("question is not null")
    return Q.normal_pair(p).select("pair_id", "question", "sql_group")


@query("""
SELECT split, shape, count(*) AS n FROM (SELECT p.split, CASE WHEN q.struct_combo IS NOT NULL THEN 'combo ' || q.struct_combo WHEN q.holdout_tier IS NOT NULL THEN 'held ' || q.holdout_tier
 ELSE coalesce(q.table_name, '-') || ' ' || coalesce(q.conn, '-') || ' ' || CASE WHEN len(list_filter(coalesce(q.conds, []), lambda c: c.op = 'IN')) > 0 THEN 'in' ELSE '-' END || ' ' || CASE WHEN len(list_filter(coalesce(q.conds, []), lambda c: c.op = 'LIKE')) > 0 THEN 'like' ELSE '-' END || ' '
 || CASE WHEN q.order_spec IS NULL THEN '-' WHEN q.row_limit IS NULL THEN 'sort' WHEN q.row_limit = 1 THEN '1' ELSE 'n' END END AS shape
 FROM pairs p JOIN query_records q ON p.sql_group = q.sql WHERE p.split IS NOT NULL) GROUP BY 1, 2""")
def shape_keys(spark: SparkSession, d: str) -> DataFrame:
    """Pairs by split and the shape that a varied sample takes turns over."""
    q = table(spark, d, "query_records")
    q = q.select(F.col("sql").alias("sql_group"), Q.shape_key(q).alias("shape"))
    return table(spark, d, "pairs").where("split is not null").join(q, "sql_group").groupBy("split", "shape").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT persona, count(*) FILTER (WHERE split = 'train') AS n_train, count(*) FILTER (WHERE split IN ('validation', 'test')) AS n_evaluation, count(*) FILTER (WHERE split = 'train') > 0 AND count(*) FILTER (WHERE split IN ('validation', 'test')) > 0 AS shared
FROM pairs WHERE persona IS NOT NULL GROUP BY 1""")
def persona_splits(spark: SparkSession, d: str) -> DataFrame:
    return Q.split_overlap(table(spark, d, "pairs").where("persona is not null"), "persona")


@query(f"""
WITH {RECORDS}, b AS (SELECT pair_id, {BROKEN} AS reason FROM w),
s AS (SELECT pair_id, 'set:' || eval_set AS part, eval_set IS NOT NULL AS inn FROM pairs UNION ALL SELECT pair_id, 'slot:' || eval_slot, eval_slot IS NOT NULL FROM pairs WHERE split IN ('validation', 'test'))
SELECT part, count(*) AS n_rows, count(*) FILTER (WHERE pair_id NOT IN (SELECT pair_id FROM b WHERE reason IS NOT NULL)) AS n_kept FROM s WHERE inn GROUP BY 1""")
def assembled_sets(spark: SparkSession, d: str) -> DataFrame:
    """Evaluation sets put together by source, without pairs whose wording breaks a rule."""
    p = flat_pairs(spark, d)
    bad = p.where(U.broken_rule(worded(p)).isNotNull()).select("pair_id")
    all_ = table(spark, d, "pairs")
    sets = {"set": all_.where("eval_set is not null").select("pair_id", F.col("eval_set").alias("name")), "slot": all_.where("eval_slot is not null and split in ('validation', 'test')").select("pair_id", F.col("eval_slot").alias("name"))}
    return Q.assembled(sets, "pair_id", bad).groupBy("part").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if("kept").alias("n_kept"))


@query(f"""
WITH e AS (SELECT sql_group AS role, pair_id, CASE WHEN regexp_matches(lower(trim(question)), {_s(R.CONTEXTUAL)}) THEN 'contextual' WHEN regexp_matches(lower(trim(question)), {_s(R.CONVERSATIONAL)}) THEN 'conversational' ELSE 'common' END AS style FROM pairs WHERE question IS NOT NULL AND sql_group IS NOT NULL),
b AS (SELECT role, style, arg_min(pair_id, md5('42:' || pair_id)) AS pair_id, CASE style WHEN 'common' THEN 0.7 WHEN 'conversational' THEN 0.2 ELSE 0.1 END AS w FROM e GROUP BY 1, 2),
c AS (SELECT *, sum(w) OVER (PARTITION BY role ORDER BY style) AS up, sum(w) OVER (PARTITION BY role) AS total, ('0x' || substr(md5('42:style:' || role), 1, 8))::BIGINT / 4294967296.0 AS u FROM b)
SELECT role AS sql_group, arg_min(pair_id, up) AS pair_id, arg_min(style, up) AS style FROM c WHERE up > u * total GROUP BY 1""")
def styled_choice(spark: SparkSession, d: str) -> DataFrame:
    """One question for each statement: a style by its share first, then a question of it."""
    p = table(spark, d, "pairs").where("question is not null and sql_group is not null").select("sql_group", "pair_id", R.style_of(F.col("question")).alias("style"))
    return R.styled_picks(p, "sql_group", "pair_id", "style")


@query("""
SELECT a.split AS a, b.split AS b, count(DISTINCT a.sql) AS n_shared FROM (VALUES ('train', 'validation'), ('train', 'test'), ('test', 'validation')) v(x, y)
JOIN pairs a ON a.split = v.x JOIN pairs b ON b.split = v.y AND a.sql = b.sql GROUP BY 1, 2""")
def split_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Statements that two splits share, for every two splits."""
    return Q.shared_keys(table(spark, d, "pairs"), "split", F.col("sql"))


@query()
def split_leaks_by_identity(spark: SparkSession, d: str) -> DataFrame:
    """As split_leaks, by the canonical key of the statement."""
    from querymill.functions.sqlkey import sql_key

    return Q.shared_keys(table(spark, d, "pairs"), "split", sql_key(F.col("sql")))


@query("SELECT pair_id, persona, platform FROM pairs")
def kept_columns(spark: SparkSession, d: str) -> DataFrame:
    """A keep-list: columns that are absent are passed over."""
    return Q.keep(table(spark, d, "pairs"), ["pair_id", "persona", "platform", "writer"])


@query("SELECT doc_id, len(text) AS n FROM documents WHERE len(text) <= 500")
def short_documents(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return Q.within_length(docs, F.length("text"), 500).select("doc_id", F.length("text").alias("n"))


@query("SELECT least(count(*), 20) AS n FROM customers")
def plain_preview(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a plain preview: any twenty."""
    return Q.preview(table(spark, d, "customers")).agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH l AS (SELECT query_id, unnest(coalesce(conds, [])) AS c FROM query_records), v AS (SELECT query_id, c.col AS col, replace(c.val, '%', '') AS v FROM l WHERE c.val IS NOT NULL),
p AS (SELECT pair_id, lower(question) AS q, query_id FROM pairs JOIN query_records ON pairs.sql_group = query_records.sql WHERE question IS NOT NULL)
SELECT pair_id, col, v AS value, strpos(q, lower(v)) AS place FROM p JOIN v USING (query_id)""")
def literal_places(spark: SparkSession, d: str) -> DataFrame:
    """Where each literal of a statement first stands in its question; 0 for a missing one."""
    q = table(spark, d, "query_records").select(F.col("sql").alias("sql_group"), "conds")
    p = table(spark, d, "pairs").where("question is not null").join(q, "sql_group")
    return p.select("pair_id", F.explode(Q.literal_places(F.col("question"), F.col("conds"))).alias("x")).select("pair_id", "x.col", "x.value", "x.place")


@query(r"""
WITH p AS (SELECT pair_id, lower(question) AS q, regexp_extract(sql_group, '(?:item_name|name) = ''([^'']*)''', 1) AS n FROM pairs WHERE question IS NOT NULL AND regexp_matches(sql_group, '(item_name|[^_]name) = '''))
SELECT pair_id, replace(q, n, 'value') AS masked FROM p WHERE n <> ''""")
def masked_names(spark: SparkSession, d: str) -> DataFrame:
    """Names of a statement taken out of its question, so that their words are no cues."""
    p = table(spark, d, "pairs").where("question is not null").withColumn("n", F.regexp_extract("sql_group", r"(?:item_name|name) = '([^']*)'", 1))
    p = p.where("n <> '' and sql_group rlike \"(item_name|[^_]name) = '\"")
    return p.select("pair_id", Q.without_names(F.col("question"), F.array("n")).alias("masked"))


@query("SELECT event_type, round(sum(value * user_id) / nullif(sum(CASE WHEN value IS NOT NULL THEN user_id END), 0), 4) AS weighted_mean FROM events GROUP BY 1")
def weighted_means(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.groupBy("event_type").agg(F.round(E.weighted_mean(F.col("value"), F.col("user_id")), 4).alias("weighted_mean"))


@query(f"SELECT {'''nullif(regexp_replace(lower(regexp_replace(family, '^[\\s_-]+|[\\s_-]+$', '', 'g')), '[\\s_-]+', '_', 'g'), '')'''} AS family, count(*) AS n FROM pairs GROUP BY 1".replace("\\\\", "\\"))
def label_counts(spark: SparkSession, d: str) -> DataFrame:
    """Records per family under one spelling of its label."""
    return table(spark, d, "pairs").groupBy(label_key(F.col("family")).alias("family")).agg(F.count(F.lit(1)).alias("n"))
