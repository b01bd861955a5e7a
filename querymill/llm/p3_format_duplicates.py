"""Duplicates hidden by formatting (problem 3).

Characters (NFKC), case, white space, punctuation and the order of labelled fields are canonicalised in the JVM and
hashed to 128 bits. Copies are counted by partial aggregation before the shuffle, so a group of any size arrives as
one row per map task. A third hash, of a different function of the text, is the collision check and part of every key, of
word sequences and of fields: two texts that agree in 128 bits but not in the check stay apart, lose no copy, and are reported.

One word sequence can be written with fields in several ways (`a: b c | d: e`, `a: b | c d: e`). All its readings are then tied
through it, and records with any of these fields belong together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querymill.llm.questions import question_table
from querymill.operators.components import connected_components
from querymill.session import materialize

SEQ = ["s1", "s2", "chk"]
READ = ["f1", "f2", "fchk"]


def readings(table: DataFrame) -> DataFrame:
    """One row per word sequence and reading of its fields (null where a copy has none): n (copies), first_id."""
    return table.groupBy(*SEQ, *READ).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))


def _node(cols: list[str]):
    return F.xxhash64(*cols)


def tied_readings(read: DataFrame) -> DataFrame | None:
    """(reading, tied): the smallest reading among those tied through word sequences with several; None when no sequence has."""
    fielded = read.where("f1 is not null").select(*SEQ, _node(READ).alias("reading"))
    several = fielded.groupBy(*SEQ).agg(F.min("reading").alias("lo"), F.max("reading").alias("hi")).where("lo <> hi").select(*SEQ, "lo")
    edges = materialize(fielded.join(several, SEQ).where("reading <> lo").select("reading", "lo"), "readings")
    if edges.isEmpty():
        return None
    return connected_components(edges, "reading", "lo").select(F.col("node").alias("reading"), F.col("component").alias("tied"))


def collapse(table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(groups, keys). groups: keep_id, n_copies, n_orders (distinct word orders), collided (another group has the same 128
    bits). keys: the hashes of a word sequence -> keep_id, for groups of two records or more."""
    read = materialize(readings(table), "sequences")
    per = read.groupBy(*SEQ).agg(F.sum("n").alias("n"), F.min("first_id").alias("first_id"), F.max(F.when(F.col("f1").isNotNull(), F.struct(*READ))).alias("f"))
    fielded = F.col("f").isNotNull()
    key = [F.coalesce(F.col(f"f.{f}"), F.col(s)).alias(g) for g, f, s in zip(("g1", "g2", "g3"), READ, SEQ)]
    labelled = per.select(*SEQ, "n", "first_id", fielded.alias("fielded"), *key)
    tied = tied_readings(read)
    if tied is not None:  # all readings of a set take the name of its smallest one
        named = labelled.withColumn("reading", F.when(F.col("fielded"), _node(["g1", "g2", "g3"]))).join(tied, "reading", "left")
        take = lambda g: F.when(F.col("tied").isNotNull(), F.col("tied")).otherwise(F.col(g)).alias(g)
        labelled = named.select(*SEQ, "n", "first_id", "fielded", *[take(g) for g in ("g1", "g2", "g3")])
    by = ["g1", "g2", "g3", "fielded"]
    groups = materialize(labelled.groupBy(*by).agg(F.min("first_id").alias("keep_id"), F.sum("n").alias("n_copies"), F.count(F.lit(1)).alias("n_orders")), "groups")
    keys = labelled.join(groups.where("n_copies > 1").select(*by, "keep_id"), by).select(*SEQ, "keep_id")
    return groups, keys


def table_of(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Hashes of the records that have a question; chk and fchk are independent of the two hashes of the sequence and the fields."""
    return question_table(df, id_col, text_col, bags=False, check=True)


def collapsed(df: DataFrame, id_col: str = "pair_id", text_col: str = "question") -> DataFrame:
    """One row per question: keep_id (smallest id), n_copies. Records without question are left out; empty table: no rows."""
    groups, _ = collapse(table_of(df, id_col, text_col))
    shared = groups.groupBy("g1", "g2", "fielded").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    return groups.join(shared, ["g1", "g2", "fielded"], "left").select("keep_id", "n_copies", "n_orders", F.col("k").isNotNull().alias("collided"))


def duplicates(df: DataFrame, id_col: str = "pair_id", text_col: str = "question") -> DataFrame:
    """(keep_id, dup_id) for each record whose question equals that of a record with a smaller id."""
    table = table_of(df, id_col, text_col)
    _, keys = collapse(table)
    hit = table.select(*SEQ, "id").join(keys, SEQ)
    return hit.where("id <> keep_id").select("keep_id", F.col("id").alias("dup_id"))
