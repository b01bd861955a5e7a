"""Constraint checks and profiles of tables. Each is one aggregation, or one join on the checked key."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def key_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per column: smallest and largest value (as text), distinct values, rows, nulls, and whether it is unique.

    The table is read once; distinct values are counted by one expanded aggregation. An empty table gives 0 counts.
    """
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("v"), F.col(c).cast("double").alias("x")) for c in columns])).alias("s")).select("s.*")
    per = long.groupBy("column_name", "v").agg(F.count(F.lit(1)).alias("n"), F.max("x").alias("x"))
    return per.groupBy("column_name").agg(
        F.min("x").alias("min_value"), F.max("x").alias("max_value"), F.count("v").alias("n_distinct"), F.sum("n").alias("n_rows"),
        F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("n"))), F.lit(0)).alias("n_null"),
        (F.max(F.when(F.col("v").isNotNull(), F.col("n"))) == 1).alias("is_unique"),
    )


def orphans(child: DataFrame, fk: str, parent: DataFrame, pk: str) -> DataFrame:
    """Keys of child without parent, with their rows; pre-aggregated, so a hot key is one row. Null keys are no orphans."""
    keys = child.where(F.col(fk).isNotNull()).groupBy(F.col(fk).alias("missing_key")).agg(F.count(F.lit(1)).alias("n_rows"))
    return keys.join(parent.select(F.col(pk).alias("missing_key")), "missing_key", "left_anti")


def childless(parent: DataFrame, pk: str, child: DataFrame, fk: str) -> DataFrame:
    """Parents without a child."""
    return parent.select(F.col(pk).alias("parent_key")).join(child.select(F.col(fk).alias("parent_key")).distinct(), "parent_key", "left_anti")


def key_overlap(a: DataFrame, ka: str, b: DataFrame, kb: str) -> DataFrame:
    """Number of keys that two tables share."""
    return a.select(F.col(ka).alias("k")).distinct().join(b.select(F.col(kb).alias("k")).distinct(), "k").agg(F.count(F.lit(1)).alias("n_shared"))


def rule_violations(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """(rule, n_rows): rows for which a rule's condition of violation holds; all rules in one pass. Null counts as no violation."""
    counts = df.agg(*[F.count_if(c).alias(f"r{i}") for i, c in enumerate(rules.values())])
    pairs = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"r{i}").alias("n_rows")) for i, n in enumerate(rules)])
    return counts.select(F.explode(pairs).alias("s")).select("s.*")


def domain_histogram(df: DataFrame, column: str, domain: DataFrame, floor: int) -> DataFrame:
    """Values of column against an expected domain (column `value`): rows, whether expected, and whether rows reach floor."""
    seen = df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n_rows"))
    wanted = domain.select("value", F.lit(True).alias("expected"))
    n = F.coalesce("n_rows", F.lit(0))
    return seen.join(wanted, "value", "full").select("value", n.alias("n_rows"), F.coalesce("expected", F.lit(False)).alias("expected"), (n >= floor).alias("reaches_floor"))


def query_space(df: DataFrame, columns: Sequence[str], banned: DataFrame, n_projections: int) -> DataFrame:
    """Equality queries per column: distinct values that are not banned x projections. banned: (column_name, value)."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns])).alias("s")).select("s.*")
    free = long.where("value is not null").distinct().join(banned, ["column_name", "value"], "left_anti")
    return free.groupBy("column_name").agg(F.count(F.lit(1)).alias("n_values"), (F.count(F.lit(1)) * n_projections).alias("n_queries"))


def content_hash(df: DataFrame) -> DataFrame:
    """An order-independent 128-bit hash of all rows with their number: equal tables have equal results.

    Nulls and their columns count (a row's columns are tagged by name); repeated rows count by number, through the sum.
    """
    tagged = [F.struct(F.lit(c), F.col(f"`{c}`").cast("string")) for c in sorted(df.columns)]
    h = df.select(F.xxhash64(*tagged).alias("a"), F.xxhash64(F.lit("b"), *tagged).alias("b"))
    total = lambda c: F.pmod(F.sum(F.col(c).cast("decimal(38,0)")), F.lit(2**62).cast("decimal(38,0)")).cast("long")
    return h.agg(F.count(F.lit(1)).alias("n_rows"), total("a").alias("hash_a"), total("b").alias("hash_b"))


def ordered_digest(df: DataFrame, key: str, columns: Sequence[str], chunk: int = 1000) -> DataFrame:
    """A SHA-256 over row digests in key order, by chunks of keys: (n_rows, digest). For dimension tables with integer keys."""
    row = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns]), 256)
    rows = df.select(F.col(key).alias("k"), F.floor(F.col(key) / chunk).alias("c"), row.alias("h"))
    chunks = rows.groupBy("c").agg(F.count(F.lit(1)).alias("n"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "h"))), lambda x: x["h"]), ""), 256).alias("h"))
    return chunks.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c", "h"))), lambda x: x["h"]), ""), 256).alias("digest"))


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)
