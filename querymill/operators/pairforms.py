"""Small operators on (question, statement) records: normal forms, keep-lists, shapes, shared keys, sets put together."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normal_pair(df: DataFrame) -> DataFrame:
    """df with question trimmed and in small letters, and sql_group falling back to sql where it is null or blank."""
    group = F.when(F.trim("sql_group") != "", F.trim("sql_group"))
    return df.withColumns({"question": F.lower(F.trim("question")), "sql_group": F.coalesce(group, F.col("sql"))})


def shape_key(q: DataFrame) -> Column:
    """Shape of a record for varied samples: its hold-out combination or tier, else table, connector, lists, patterns and order."""
    has = lambda op: F.exists(F.coalesce(q["conds"], F.array()), lambda c: c["op"] == op)
    order = F.when(q["order_spec"].isNull(), "-").when(q["row_limit"].isNull(), "sort").when(q["row_limit"] == 1, "1").otherwise("n")
    plain = F.concat_ws(" ", F.coalesce(q["table_name"], F.lit("-")), F.coalesce(q["conn"], F.lit("-")), F.when(has("IN"), "in").otherwise("-"), F.when(has("LIKE"), "like").otherwise("-"), order)
    return F.when(q["struct_combo"].isNotNull(), F.concat(F.lit("combo "), q["struct_combo"].cast("string"))).when(q["holdout_tier"].isNotNull(), F.concat(F.lit("held "), q["holdout_tier"])).otherwise(plain)


def split_overlap(df: DataFrame, column: str) -> DataFrame:
    """Per value of column the rows in train and in evaluation, and whether both have it."""
    train, held = F.count_if(F.coalesce(F.col("split") == "train", F.lit(False))), F.count_if(F.coalesce(F.col("split").isin("validation", "test"), F.lit(False)))
    return df.groupBy(column).agg(train.alias("n_train"), held.alias("n_evaluation")).withColumn("shared", (F.col("n_train") > 0) & (F.col("n_evaluation") > 0))


def shared_keys(df: DataFrame, part: str, key: Column) -> DataFrame:
    """(a, b, n_shared): keys that two parts share, a pair of parts a row; parts that share none are left out. One aggregation by
    key, whatever the number of rows of a key. Null keys and parts count nowhere."""
    per = df.select(F.col(part).alias("p"), key.alias("k")).where("p is not null and k is not null").groupBy("k").agg(F.array_sort(F.collect_set("p")).alias("ps"))
    two = F.flatten(F.transform("ps", lambda x, i: F.transform(F.slice("ps", i + 2, F.size("ps")), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    counts = per.where(F.size("ps") > 1).select(F.explode(two).alias("s")).groupBy("s.a", "s.b").agg(F.count(F.lit(1)).alias("n_shared"))
    lead = F.col("b") == "train"  # train first
    return counts.select(F.when(lead, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(lead, F.col("a")).otherwise(F.col("b")).alias("b"), "n_shared")


def assembled(sets: Mapping[str, DataFrame], key: str, bad: DataFrame) -> DataFrame:
    """(part, key, kept): rows of several tables (key, name) under 'table:name', kept unless their key is bad."""
    out = None
    for kind, df in sets.items():
        one = df.select(F.concat(F.lit(f"{kind}:"), "name").alias("part"), key)
        out = one if out is None else out.unionByName(one)
    return out.join(bad.select(key, F.lit(True).alias("__bad")).distinct(), key, "left").select("part", key, F.col("__bad").isNull().alias("kept"))


def keep(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*[c for c in columns if c in df.columns])


def within_length(df: DataFrame, length: Column, most: int) -> DataFrame:
    """Rows whose length is known and at most `most`."""
    return df.where(length <= most)


def preview(df: DataFrame, n: int = 20) -> DataFrame:
    return df.limit(n)


def literal_places(question: Column, conds: Column) -> Column:
    """Array of (col, value, place): the first place (from 1) of every single literal in the question, 0 where it is missing."""
    single = F.filter(F.coalesce(conds, F.array()), lambda c: c["val"].isNotNull())
    bare = lambda c: F.replace(c["val"], F.lit("%"), F.lit(""))
    return F.transform(single, lambda c: F.struct(c["col"].alias("col"), bare(c).alias("value"), F.instr(F.lower(question), F.lower(bare(c))).cast("long").alias("place")))


def without_names(question: Column, names: Column, mark: str = "value") -> Column:
    """The question in small letters with every name replaced by a neutral word; null and empty names replace nothing."""
    given = F.filter(names, lambda n: F.coalesce(n != "", F.lit(False)))
    return F.aggregate(given, F.lower(question), lambda acc, n: F.replace(acc, n, F.lit(mark)))

