"""Exact positions and running totals within groups of any size, without one task per group.

Rows of a group are cut by the top bits of their random key into buckets; bucket totals (bounded by groups x buckets)
give each bucket its offset, and a window runs within (group, bucket) only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from querymill.session import materialize


def random_key(seed: int | str, *cols: str | Column) -> Column:
    """A reproducible random LONG for a row from its identifying columns."""
    return F.xxhash64(F.lit(f"key:{seed}"), *cols)


def _placed(keyed: DataFrame, group: Sequence[str], bucket: str, order: Sequence[str | Column], out: str, limit: Column | None) -> DataFrame:
    """keyed with out: the running sum of __v by (bucket, order) within the group."""
    counts = keyed.groupBy(*group, bucket).agg(F.sum("__v").alias("__n"))
    before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *[F.col(c).alias(f"__g{i}") for i, c in enumerate(group)], F.col(bucket).alias("__ob"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off")
    )
    cond = F.col(bucket) == F.col("__ob")
    for i, c in enumerate(group):
        cond = cond & F.col(c).eqNullSafe(F.col(f"__g{i}"))
    placed = keyed.join(offsets, cond)
    if limit is not None:
        placed = placed.where(F.col("__off") < limit)
    inside = Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return placed.withColumn(out, (F.sum("__v").over(inside) + F.col("__off")).cast("long"))


def running_total(
    df: DataFrame, group: Sequence[str], key: Column, tie: Sequence[str], value: Column | None = None, out: str = "rank", limit: Column | None = None, bits: int = 10, bucket: Column | None = None
) -> DataFrame:
    """df with `out`, the sum of value over the rows of the group up to this one by (key, tie); value 1 gives the rank.

    key is a LONG spread evenly, or anything of which bucket, a LONG, is a part that sorts first; tie makes the order total.
    limit, a column of df that is the same within a group, or a literal, drops buckets that begin at or beyond it before
    anything is sorted (rows beyond it in the last bucket stay).
    Null group values form a group of their own; null values count 0. An empty table gives an empty result.
    """
    value = F.lit(1) if value is None else F.coalesce(value, F.lit(0))
    keyed = df.withColumn("__k", key).withColumn("__b", F.shiftright(F.col("__k"), 64 - bits) if bucket is None else bucket)
    return _placed(keyed.withColumn("__v", value.cast("long")), group, "__b", ["__k", *tie], out, limit).select(*df.columns, out)


def rank_in_group(df: DataFrame, group: Sequence[str], key: Column, tie: Sequence[str], out: str = "rank", limit: Column | None = None) -> DataFrame:
    """df with `out`, 1.. within each group by (key, tie)."""
    return running_total(df, group, key, tie, None, out, limit)


def hash_rank(df: DataFrame, group: Sequence[str], digest: Column, tie: Sequence[str], out: str = "rank", limit: Column | None = None) -> DataFrame:
    """df with `out`, 1.. within each group by (digest, tie), where digest is a hexadecimal hash; its first digits are the bucket."""
    return running_total(df, group, digest, tie, None, out, limit, bucket=F.conv(F.substring(digest, 1, 3), 16, 10).cast("long"))


def ordered_rank(df: DataFrame, group: Sequence[str], order: Sequence[str | Column], out: str = "rank", limit: Column | None = None) -> DataFrame:
    """df with `out`, 1.. within each group by any total order. Rows are dealt to tasks by ranges of (group, order), so that a
    large group lies in many of them; each task ranks its range, and the counts of the ranges before it are added.

    The dealt rows are written to the shared folder first: ranges are sampled, and must be the same for counting and ranking.
    """
    dealt = materialize(df.repartitionByRange(*group, *order).withColumn("__b", F.spark_partition_id()).withColumn("__v", F.lit(1).cast("long")), "ranged")
    return _placed(dealt, group, "__b", order, out, limit).select(*df.columns, out)


def largest_remainder(weights: Sequence[float], total: int, floors: Sequence[int] | None = None, caps: Sequence[int] | None = None) -> list[int]:
    """Integers that sum to total (as far as caps allow), in proportion to weights, each within its floor and cap.

    A floor above its cap is cut to the cap. What a capped entry cannot take goes to the others by weight, then to any
    entry with room. Ties of remainders go to the earlier entry.
    """
    n = len(weights)
    caps = [total] * n if caps is None else [min(int(c), total) for c in caps]
    floors = [0] * n if floors is None else [min(int(f), c) for f, c in zip(floors, caps)]
    out = list(floors)
    if sum(out) > total:  # floors alone are too much: scale them
        return largest_remainder(floors, total, None, caps)
    fixed: set[int] = set()
    while True:
        free = [i for i in range(n) if i not in fixed]
        left = total - sum(out[i] for i in fixed)
        w = sum(weights[i] for i in free)
        if not free or left <= 0:
            break
        ideal = {i: (left * weights[i] / w if w > 0 else 0.0) for i in free}
        low = [i for i in free if ideal[i] < floors[i]]
        high = [i for i in free if ideal[i] > caps[i]]
        bound = high or low
        if not bound:
            base = {i: int(ideal[i] + 1e-9) for i in free}
            rest = left - sum(base.values())
            for i in sorted(free, key=lambda i: (-(ideal[i] - base[i]), i)):
                step = 1 if rest > 0 and base[i] < caps[i] and weights[i] > 0 else 0
                out[i], rest = base[i] + step, rest - step
            break
        for i in bound:
            out[i] = caps[i] if i in high else floors[i]
            fixed.add(i)
    spare = total - sum(out)
    for i in sorted(range(n), key=lambda i: (-weights[i], i)):
        step = max(0, min(spare, caps[i] - out[i]))
        out[i], spare = out[i] + step, spare - step
    return out
