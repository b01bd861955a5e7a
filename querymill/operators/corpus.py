"""Quality operators on (question, statement) records: normal forms, checks, duplicates, conflicts, reuse, contamination."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Number words that stand in place of digits ("one" is everyday wording and no number word), and wordings that
# replace a literal by another one.
NUMBER_WORDS = [
    "zero", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen",
    "nineteen", "twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety", "hundred",
]
SWAPPED_WORDS = ["computer", "shoes", "sold out", "sofa"]
SPACE = r"[ \t\r\n\f]+"


def normalise(text: Column, lower: bool = True, punctuation: bool = True) -> Column:
    """Duplicate key: punctuation off, white space to single blanks, trimmed, optionally lower case."""
    t = F.lower(text) if lower else text
    t = F.regexp_replace(t, r"[^\p{L}\p{N}_ \t\r\n\f]", "") if punctuation else t
    return F.trim(F.regexp_replace(t, SPACE, " "))


def word_literal(text: Column, literal: Column) -> Column:
    """Whole-word occurrence of a literal, with a plural or possessive ending allowed."""
    quoted = F.regexp_replace(F.lower(literal), r"([^\p{L}\p{N} ])", r"\\$1")
    return F.regexp_like(F.lower(text), F.concat(F.lit(r"(?<![\p{L}\p{N}_])"), quoted, F.lit(r"(?:'s|s|es)?(?![\p{L}\p{N}_])")))


def isolated_number(text: Column, literal: Column) -> Column:
    """A number that is not part of a longer one; a sentence's full stop may follow."""
    quoted = F.regexp_replace(literal, r"\.", r"\\.")
    return F.regexp_like(text, F.concat(F.lit(r"(?<!\d)(?<!\d\.)"), quoted, F.lit(r"(?!\d)(?!\.\d)")))


def quoted_literals(sql: Column) -> Column:
    """Text literals of a statement."""
    return F.regexp_extract_all(sql, F.lit("'([^']*)'"), F.lit(1))


def numerals(text: Column) -> Column:
    """Distinct numbers of a text as DOUBLE, quoted dates aside; 20, 20.00 and $20 are one."""
    plain = F.regexp_replace(text, r"\d{4}-\d{2}-\d{2}", " ")
    return F.array_distinct(F.transform(F.regexp_extract_all(plain, F.lit(r"(?<![A-Za-z0-9_.])(\d+(?:\.\d+)?)(?![A-Za-z0-9_])"), F.lit(1)), lambda x: x.cast("double")))


def missing_numerals(question: Column, sql: Column) -> Column:
    """Numbers of the statement that its question lacks; 0 and 1 are often worded and do not count."""
    wanted = numerals(F.regexp_replace(sql, r"LIMIT \d+$", " "))
    return F.filter(F.array_except(wanted, numerals(question)), lambda x: ~x.isin(0.0, 1.0))


def check_reasons(question: Column, sql: Column) -> Column:
    """Hard faults of a question for its statement, as an array: empty when it passes."""
    words = F.split(F.lower(question), r"[^a-z]+")
    literals = F.filter(quoted_literals(sql), lambda x: ~x.rlike("^%|%$|^\\d{4}-"))
    swapped = [question.rlike(rf"\b{w}\b") & ~F.contains(F.lower(sql), F.lit(f"'{w}'")) for w in SWAPPED_WORDS]
    faults = [
        F.when(question != F.lower(question), "not lower case"),
        F.when(F.exists(literals, lambda x: ~F.contains(F.lower(question), x)), "literal missing"),
        F.when(F.arrays_overlap(words, F.array(*[F.lit(w) for w in NUMBER_WORDS])), "number word"),
        F.when(question.rlike("[a-z]_[a-z]"), "column name"),
        F.when(reduce(lambda a, b: a | b, swapped), "synonym"),
    ]
    return F.array_compact(F.array(*faults))


def skeleton(question: Column, sql: Column) -> Column:
    """The question with each literal of its statement replaced by <V>."""
    literals = F.concat(F.transform(quoted_literals(sql), lambda x: F.lower(x)), F.regexp_extract_all(sql, F.lit(r"(\d+(?:\.\d+)?)"), F.lit(1)))
    ordered = F.array_sort(literals, lambda a, b: F.length(b) - F.length(a))
    masked = F.aggregate(F.filter(ordered, lambda x: x != ""), F.lower(question), lambda acc, x: F.replace(acc, x, F.lit("<V>")))
    return normalise(F.replace(masked, F.lit("<V>"), F.lit("_V_")))


def repeats_within_group(df: DataFrame, group: str, text: str, order: str) -> DataFrame:
    """Rows whose normalised text came before in their group; the first stays out. Via the group's first id, not a window."""
    keyed = df.withColumn("norm", normalise(F.col(text)))
    first = keyed.where("norm is not null").groupBy(group, "norm").agg(F.min(order).alias("first_pos"), F.count(F.lit(1)).alias("k")).where("k > 1")
    return keyed.join(first.drop("k"), [group, "norm"]).where(F.col(order) > F.col("first_pos")).select(group, order, "norm", "first_pos")


def label_conflicts(df: DataFrame, text: Column, label: Column) -> DataFrame:
    """(norm, n_labels, n_rows): normalised texts with more than one label."""
    per = df.select(text.alias("norm"), label.alias("label")).where("norm is not null and norm <> '' and label is not null").groupBy("norm", "label").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("norm").agg(F.count(F.lit(1)).alias("n_labels"), F.sum("n").alias("n_rows")).where("n_labels > 1")


def drop_conflicts(df: DataFrame, text: Column, label: Column) -> DataFrame:
    """df without any row of a text that has several labels: both sides go."""
    bad = label_conflicts(df, text, label).select("norm")
    return df.withColumn("norm", text).join(bad, "norm", "left_anti")


def template_reuse(df: DataFrame, shape: Sequence[str], key: str, skeleton_col: str) -> DataFrame:
    """Per shape: questions, and the share whose skeleton was first seen under another key. Rows are counted by skeleton and
    key first, so nothing is joined back to them."""
    per = df.groupBy(*shape, skeleton_col, key).agg(F.count(F.lit(1)).alias("__n"))
    first = per.groupBy(*shape, skeleton_col).agg(F.sum("__n").alias("__all"), F.min_by("__n", key).alias("__own"))
    return first.groupBy(*shape).agg(F.sum("__all").alias("n_questions"), F.round(1 - F.sum("__own") / F.sum("__all"), 4).alias("reuse"))


def contamination(df: DataFrame, key: Column, banned: DataFrame) -> DataFrame:
    """Rows whose key is banned (banned: one column, key)."""
    return df.withColumn("key", key).join(banned.select("key").distinct(), "key", "left_semi")


def without(df: DataFrame, key: Column, banned: DataFrame) -> DataFrame:
    """Rows whose key is not banned; rows without key stay."""
    return df.withColumn("key", key).join(banned.select("key").where("key is not null").distinct(), "key", "left_anti")


def envelope_checks(requests: DataFrame, responses: DataFrame, n_texts: int) -> DataFrame:
    """Requests (id, sql) against responses (id, sql, questions): what is wrong with each, null where nothing is."""
    got = responses.select(F.col("id").alias("rid"), F.col("sql").alias("rsql"), "questions")
    joined = requests.join(got, F.col("id") == F.col("rid"), "full")
    distinct = F.size(F.array_distinct(F.filter("questions", lambda q: F.trim(q) != "")))
    why = (
        F.when(F.col("id").isNull(), "not requested").when(F.col("rid").isNull(), "missing")
        .when(~F.col("sql").eqNullSafe(F.col("rsql")), "statement changed").when(distinct != n_texts, "wrong number of texts")
    )
    return joined.select(F.coalesce("id", "rid").alias("id"), why.alias("problem"))


def pass_rates(df: DataFrame, by: Sequence[str], reasons: str) -> DataFrame:
    """Share of rows without reasons, per group."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.avg((F.size(reasons) == 0).cast("int")), 4).alias("pass_rate"))


def reason_histogram(df: DataFrame, reasons: str) -> DataFrame:
    return df.select(F.explode(reasons).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n_rows"))


def nearest_rank(df: DataFrame, column: str, shares: Sequence[float]) -> DataFrame:
    """Minimum, mean, maximum and nearest-rank percentiles (the element at floor(n x share)); by value counts, so no global sort of rows."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count(F.lit(1)).alias("k"))
    upto = counts.withColumn("upto", F.sum("k").over(Window.partitionBy(F.lit(1)).orderBy("v"))).withColumn("n", F.sum("k").over(Window.partitionBy(F.lit(1))))
    at = [F.min(F.when(F.col("upto") > F.floor(F.col("n") * s), F.col("v"))).alias(f"p{round(s * 100)}") for s in shares]
    return upto.agg(F.min("v").alias("min_value"), F.round(F.sum(F.col("v") * F.col("k")) / F.sum("k"), 4).alias("mean_value"), F.max("v").alias("max_value"), *at)
