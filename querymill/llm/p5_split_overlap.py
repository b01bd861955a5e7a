"""Same or near-same records across splits (problem 5).

Every record is hashed to keys: its words in order, its sorted fields, its query in canonical form. One join of the
evaluation keys with the training keys gives the exact overlaps; the close questions come from the near-duplicate
operator, which compares texts of different sides only. A hot key on one side only finds no partner and costs a scan of its
rows; on both sides, adaptive execution splits its rows over tasks. The report makes no pairs: it marks evaluation records by
semi-joins with the different keys of the training side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querymill.functions.sqlkey import sql_key
from querymill.functions.labels import label_key
from querymill.functions.text import hash_pair
from querymill.llm.p2_near_duplicates import NearDupParams, close_bags, close_records, with_nodes
from querymill.llm.questions import question_table
from querymill.session import materialize, spread

TRAIN, EVAL = ("train",), ("validation", "test")


def query_text(df: DataFrame) -> Column:
    """The query of a record: sql_group unless null or blank, else orig_sql, else sql."""
    group = F.when(F.trim(F.regexp_replace("sql_group", r"\s+", " ")) != "", F.col("sql_group"))
    return F.coalesce(group, F.col("orig_sql"), F.col("sql"))


def query_key(df: DataFrame) -> Column:
    """Canonical key of a record's query; a blank statement is none."""
    key = sql_key(query_text(df))
    return F.when(key != "", key)


def sides(df: DataFrame) -> DataFrame:
    """Records of the train or an evaluation split, with on_train; other splits, and null, are left out."""
    return df.where(F.col("split").isin(*TRAIN, *EVAL)).withColumn("on_train", F.col("split").isin(*TRAIN))


def sided_tables(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(questions, queries) of the records on both sides, with on_train; queries: id, on_train, q1, q2."""
    rec = sides(df)
    table = question_table(rec, "pair_id", "question", ["on_train"])
    rec = spread(rec.select("pair_id", "on_train", "sql_group", "orig_sql", "sql"))
    q = rec.select(F.col("pair_id").alias("id"), "on_train", query_key(rec).alias("key"))
    q1, q2 = hash_pair(F.col("key"))
    return table, materialize(q.select("id", "on_train", q1.alias("q1"), q2.alias("q2")), "sided-queries")


def sided_keys(table: DataFrame, queries: DataFrame) -> DataFrame:
    """(kind, k1, k2, id, on_train): each record under its question, its fields and its query."""
    rows = [
        table.select(F.lit(kind).alias("kind"), F.col(f"{c}1").alias("k1"), F.col(f"{c}2").alias("k2"), "id", "on_train")
        for kind, c in (("question", "s"), ("fields", "f"))
    ]
    keys = rows[0].unionByName(rows[1]).unionByName(queries.select(F.lit("query").alias("kind"), F.col("q1").alias("k1"), F.col("q2").alias("k2"), "id", "on_train"))
    return keys.where("k1 is not null")


def exact_overlaps(table: DataFrame, queries: DataFrame) -> DataFrame:
    """(t_id, e_id, kind): a training and an evaluation record that share a question or a query."""
    keys = sided_keys(table, queries)
    train = keys.where("on_train").select("kind", "k1", "k2", F.col("id").alias("t_id"))
    held = keys.where("not on_train").select("kind", "k1", "k2", F.col("id").alias("e_id"))
    return train.join(held, ["kind", "k1", "k2"]).select("t_id", "e_id", "kind")


def overlaps(df: DataFrame, p: NearDupParams = NearDupParams()) -> DataFrame:
    """(t_id, e_id, kind) over question, fields, query and close; a pair may come out once per kind."""
    table, queries = sided_tables(df)
    near = close_records(table, p, first="on_train")
    return exact_overlaps(table, queries).unionByName(near.select("t_id", "e_id", F.lit("close").alias("kind")))


def overlapping_records(df: DataFrame, p: NearDupParams = NearDupParams()) -> DataFrame:
    """(id, kind): evaluation records that overlap the train split, once per kind, without making pairs."""
    table, queries = sided_tables(df)
    keys = sided_keys(table, queries)
    shared = keys.where("on_train").select("kind", "k1", "k2").distinct()
    exact = keys.where("not on_train").join(shared, ["kind", "k1", "k2"], "left_semi").select("id", "kind")
    table = with_nodes(table)
    bags = close_bags(table, p, F.when(F.col("on_train"), F.lit(1)).otherwise(F.lit(2))).select(F.col("xb").alias("node")).distinct()
    held = table.where("not on_train").select("id", "node", *WRITTEN)
    near = held.join(bags, "node", "left_semi").select("id")
    # other orders of the same words: the training side has a question of this bag that is written otherwise
    named = lambda t: t.select("node", F.struct(F.col("f1").isNotNull().alias("fielded"), F.coalesce("f1", "s1").alias("k1"), F.coalesce("f2", "s2").alias("k2")).alias("c"), *[c for c in t.columns if c == "id"])
    train = named(table.where("on_train").select("node", *WRITTEN)).groupBy("node").agg(F.min("c").alias("lo"), F.max("c").alias("hi"))
    turned = named(held).join(train, "node").where("lo <> c or hi <> c").select("id")
    return exact.unionByName(near.unionByName(turned).select("id", F.lit("close").alias("kind"))).distinct()


WRITTEN = ["s1", "s2", "f1", "f2"]


def overlap_pairs(df: DataFrame, p: NearDupParams = NearDupParams()) -> DataFrame:
    """(id_a, id_b), id_a < id_b, once for each overlapping pair. Records without question can still share a query."""
    found = overlaps(df, p)
    return found.select(F.least("t_id", "e_id").alias("id_a"), F.greatest("t_id", "e_id").alias("id_b")).distinct()


def overlap_report(df: DataFrame, p: NearDupParams = NearDupParams()) -> DataFrame:
    """Per evaluation split and source: records that overlap the train split, by kind. A null source is a row of its own."""
    hit = overlapping_records(df, p).withColumnRenamed("id", "pair_id")
    rec = df.where(F.col("split").isin(*EVAL)).select("pair_id", "split", label_key(F.col("source")).alias("source"))
    flags = hit.groupBy("pair_id").agg(*[F.max(F.col("kind").isin(*kinds)).alias(name) for name, kinds in (("same_question", ("question", "fields")), ("close_question", ("close",)), ("same_query", ("query",)))])
    count = lambda c: F.count_if(F.coalesce(F.col(c), F.lit(False)))
    return rec.join(flags, "pair_id", "left").groupBy("split", "source").agg(
        F.count(F.lit(1)).alias("n_records"),
        F.count_if(F.col("same_question").isNotNull()).alias("n_overlapping"),
        *[count(c).alias(f"n_{c}") for c in ("same_question", "close_question", "same_query")],
    )
