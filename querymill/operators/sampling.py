"""Deterministic sampling, quotas and batches. Order is by md5(seed:key), which other engines can reproduce."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from querymill.operators.ranking import hash_rank, ordered_rank


def seeded(seed: int | str, *keys: str | Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys]))


def stratified_quotas(df: DataFrame, strata: Sequence[str], n: int) -> DataFrame:
    """Quota per stratum: half-even rounding of its share of n, the difference dealt one by one to the largest strata."""
    counts = df.groupBy(*strata).agg(F.count(F.lit(1)).alias("n_rows"))
    every = Window.partitionBy()
    share = F.bround(F.col("n_rows") * n / F.sum("n_rows").over(every)).cast("long")
    rank = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("n_rows"), *strata))
    based = counts.withColumn("base", share).withColumn("rank", rank).withColumn("rest", F.lit(n) - F.sum("base").over(every))
    step = F.when(F.col("rank") <= F.abs("rest"), F.signum("rest")).otherwise(0).cast("long")
    return based.select(*strata, "n_rows", F.greatest(F.least(F.col("base") + step, F.col("n_rows")), F.lit(0)).cast("long").alias("quota"))


def stratified_sample(df: DataFrame, strata: Sequence[str], key: str, n: int, seed: int = 42) -> DataFrame:
    """The rows of each stratum with the smallest seeded hash, as many as its quota. Null strata are strata."""
    q = stratified_quotas(df, strata, n).select(*[F.col(c).alias(f"__{c}") for c in strata], "quota")
    cond = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in strata]
    ranked = hash_rank(df.join(q, cond).select(*df.columns, "quota"), strata, seeded(seed, key), [key], "__r", F.col("quota"))
    return ranked.where("__r <= quota").select(*df.columns)


def round_robin(df: DataFrame, shape: Sequence[str], key: str, n: int, seed: int = 42) -> DataFrame:
    """One row of each shape per turn until n rows are picked: (columns, turn)."""
    return hash_rank(df, shape, seeded(seed, key), [key], "turn", F.lit(n)).orderBy("turn", *shape, key).limit(n)


def group_split(df: DataFrame, group: str, key: str, share: float, seed: int = 42) -> DataFrame:
    """Whole groups to validation: floor(groups x share), at least one, by seeded hash of the group. Adds `part`."""
    groups = df.select(F.col(group).alias("__g")).distinct().withColumn("__h", seeded(seed, "__g"))
    total = groups.agg(F.greatest(F.floor(F.count(F.lit(1)) * share), F.lit(1)).alias("__k"))
    cut = hash_rank(groups, [], F.col("__h"), ["__g"], "__n")
    chosen = cut.where(F.col("__n") <= total.scalar()).select("__g", F.lit(True).alias("__v"))
    part = F.when(F.col("__v"), "validation").otherwise("train")
    return df.join(chosen, F.col(group) == F.col("__g"), "left").select(*df.columns, part.alias("part"))


def group_split_hashed(df: DataFrame, group: str, share: float, seed: int = 42) -> DataFrame:
    """As group_split without any order over all groups: a group is in validation when its hash, as a fraction, is below share."""
    fraction = F.conv(F.substring(seeded(seed, group), 1, 8), 16, 10).cast("long") / F.lit(2**32)
    return df.withColumn("part", F.when(fraction < share, "validation").otherwise("train"))


def batches(df: DataFrame, order: Sequence[str], size: int, within: Sequence[str] = ()) -> DataFrame:
    """Consecutive batches of fixed size: adds batch_no, from 0, within the given columns."""
    return ordered_rank(df, within, order, "__r").withColumn("batch_no", F.floor((F.col("__r") - 1) / size).cast("long")).drop("__r")


def first_of_cell(df: DataFrame, cell: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """Up to n rows of each cell, by order; for review. Null values are cells of their own."""
    return ordered_rank(df, cell, order, "__r", F.lit(n)).where(F.col("__r") <= n).drop("__r")


def repeat_by_weight(df: DataFrame, weight: Column) -> DataFrame:
    """Each row as many times as its whole weight says (none for 0, less or null): adds copy_no from 1."""
    return df.withColumn("__w", F.coalesce(weight.cast("int"), F.lit(0))).where("__w > 0").withColumn("copy_no", F.explode(F.sequence(F.lit(1), "__w"))).drop("__w")


def weighted_without_replacement(df: DataFrame, weight: Column, n: int, key: str, seed: int = 42) -> DataFrame:
    """n rows with chances by weight: the smallest of -ln(u) / weight, u from the seeded hash. Weights of 0 or null never win."""
    u = (F.conv(F.substring(seeded(seed, key), 1, 12), 16, 10).cast("double") + 1) / F.lit(float(2**48 + 1))
    return df.withColumn("__e", -F.log(u) / weight).where(weight > 0).orderBy("__e", key).limit(n).drop("__e")


def last_wins(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key, by partial aggregation (no group is gathered)."""
    rest = [c for c in df.columns if c not in key]
    row = F.max_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*key).agg(row.alias("__s")).select(*key, *[F.col(f"__s.{c}").alias(c) for c in rest])


def first_wins(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in key]
    row = F.min_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*key).agg(row.alias("__s")).select(*key, *[F.col(f"__s.{c}").alias(c) for c in rest])


def product(a: DataFrame, b: DataFrame, block: int = 1_000) -> DataFrame:
    """Every row of a with every row of b (the operator's result itself), in blocks: b is parted into blocks of about `block` rows,
    and a row of a goes to every block. Columns must differ. An empty side gives an empty result."""
    n = max(1, -(-b.count() // block))
    keys = F.pmod(F.xxhash64(*b.columns), F.lit(n)).cast("int") if b.columns else F.lit(0)
    blocks = b.select(keys.alias("__b"), F.struct(*b.columns).alias("__s")).groupBy("__b").agg(F.collect_list("__s").alias("__s"))
    each = a.withColumn("__b", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return each.join(blocks, "__b").select(*a.columns, F.explode("__s").alias("__s")).select(*a.columns, *[F.col(f"__s.{c}").alias(c) for c in b.columns])
