"""Splits that keep related records together (problem 1).

Records are tied by their query and by contrast group within a round. Ties form a graph of query and contrast nodes
(never of records), whose components give every record its set. Sets of the same size and label profile are one
bundle; the driver sees bundles only, solves a min-cost flow for their shares of each split, and members of a bundle
are dealt by the rank of a hash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querymill.functions.labels import label_key
from querymill.llm.flow import Bundle, allocate
from querymill.llm.p5_split_overlap import query_key
from querymill.operators.components import connected_components
from querymill.operators.ranking import random_key, rank_in_group, running_total
from querymill.session import materialize, spread


@dataclass(frozen=True)
class SplitParams:
    """max_bundles bounds what the driver holds: the bundles with the most rows. Sets of the others are dealt in random order
    by running totals of their rows, and the flow makes up for what that leaves."""

    seed: int = 42
    max_bundles: int = 20_000


def related_records(df: DataFrame) -> DataFrame:
    """(id, fam, old, label): label is the same for records of one related set. old is a hash of the earlier split.

    A record without query and contrast group is a set of its own. A null round ties with a null round.
    """
    df = spread(df.select("pair_id", "family", "split", "sql_group", "orig_sql", "sql", "contrast_group", "round"))
    rec = df.select(
        F.col("pair_id").alias("id"),
        F.translate(F.coalesce(label_key(F.col("family")), F.lit("")), "|:", "__").alias("fam"),
        F.when(F.col("split").isNotNull(), F.xxhash64("split")).alias("old"),
        query_key(df).alias("key"),
        F.when(F.col("contrast_group").isNotNull(), F.xxhash64(F.lit("contrast"), "contrast_group", F.coalesce("round", F.lit("\x01")))).alias("c"),
    )
    rec = rec.select("id", "fam", "old", "c", F.when(F.col("key").isNotNull(), F.xxhash64(F.lit("query"), "key")).alias("q"))
    rec = materialize(rec, "tied")
    comp = connected_components(rec.where("q is not null and c is not null").select("q", "c"), "q", "c")
    own = F.coalesce("q", "c", F.xxhash64(F.lit("alone"), "id"))
    return rec.withColumn("node", own).join(comp, "node", "left").select("id", "fam", "old", F.coalesce("component", "node").alias("label"))


def related_sets(rec: DataFrame) -> DataFrame:
    """One row per set: label, root_id, size, profile ('family:rows|...'), mixed (earlier splits differ)."""
    parts = rec.groupBy("label", "fam").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("lo_id"), F.min("old").alias("lo"), F.max("old").alias("hi"))
    profile = F.array_join(F.array_sort(F.collect_list(F.concat("fam", F.lit(":"), "n"))), "|")
    return parts.groupBy("label").agg(
        F.min("lo_id").alias("root_id"), F.sum("n").alias("size"), profile.alias("profile"), F.coalesce(F.min("lo") != F.max("hi"), F.lit(False)).alias("mixed")
    )


def _profile(text: str) -> dict[str, int]:
    return {f: int(n) for f, _, n in (x.rpartition(":") for x in text.split("|"))}


def dealt_sets(sets: DataFrame, names: list[tuple[str, float]], p: SplitParams = SplitParams()) -> DataFrame:
    """(label, root_id, split, mixed) for every set of related_sets. names: splits and their shares."""
    spark = sets.sparkSession
    shares = [s / (sum(s for _, s in names) or 1.0) for _, s in names]
    bundled = materialize(sets.groupBy("profile").agg(F.count(F.lit(1)).alias("m"), F.sum("size").alias("n_rows")), "bundles")
    first = bundled.orderBy(F.desc("n_rows"), "profile").limit(p.max_bundles)
    held = first.collect()
    dealt, taken = None, {}
    if bundled.count() > len(held):
        top = spark.createDataFrame([(r["profile"],) for r in held], "profile string")
        rest = materialize(sets.join(top, "profile", "left_anti"), "other-sets")
        total = rest.agg(F.sum("size")).first()[0]
        placed = running_total(rest, [], random_key(f"{p.seed}:rest", "root_id"), ["root_id"], F.col("size"), "upto")
        at = (F.col("upto") - F.col("size") / 2) / total
        ends, up = [], 0.0
        for (name, _), share in zip(names[:-1], shares):
            up += share
            ends.append((name, up))
        split = F.lit(names[-1][0])
        for name, end in reversed(ends):
            split = F.when(at < end, F.lit(name)).otherwise(split)
        dealt = materialize(placed.select("label", "root_id", split.alias("split"), "mixed", "profile"), "other-dealt")
        part = dealt.select("split", F.explode(F.split("profile", r"\|")).alias("x"))
        per = part.groupBy("split", F.expr("substring_index(x, ':', 1)").alias("f")).agg(F.sum(F.substring_index("x", ":", -1).cast("long")).alias("n"))
        order = {name: j for j, (name, _) in enumerate(names)}
        taken = {(r["f"], order[r["split"]]): r["n"] for r in per.collect()}  # labels x splits
        dealt = dealt.drop("profile")
    bundles = [Bundle(r["profile"], r["m"], _profile(r["profile"])) for r in held]
    plan = allocate(bundles, shares, taken) if bundles else {}
    rows = []
    for key, take in plan.items():
        at_ = 0
        for (name, _), n in zip(names, take):
            if n:
                rows.append((key, at_, at_ + n, name))
            at_ += n
    ranges = spark.createDataFrame(rows, "profile string, lo long, hi long, split string")
    ranked = rank_in_group(sets, ["profile"], random_key(p.seed, "root_id"), ["root_id"])
    by_plan = ranked.join(ranges, "profile").where("rank > lo and rank <= hi").select("label", "root_id", "split", "mixed")
    return by_plan if dealt is None else by_plan.unionByName(dealt)


def assign_splits(df: DataFrame, targets: DataFrame, p: SplitParams = SplitParams()) -> DataFrame:
    """(pair_id, root_id, family, split, mixed) for every record: its set's root, new split, and whether the set's earlier splits differ.

    targets: (split, target_share); shares are scaled to 1. An empty table gives an empty result.
    """
    names = [(r["split"], float(r["target_share"])) for r in targets.orderBy("split").collect()]
    rec = materialize(related_records(df), "related")
    dealt = dealt_sets(materialize(related_sets(rec), "sets"), names, p)
    return rec.join(dealt, "label").select(F.col("id").alias("pair_id"), "root_id", F.col("fam").alias("family"), "split", "mixed")


def parted_sets(df: DataFrame, targets: DataFrame, p: SplitParams = SplitParams()) -> DataFrame:
    """(root_id, pair_id): every record of a set that the earlier splits tear apart, and that the new one reunites."""
    return assign_splits(df, targets, p).where("mixed").select("root_id", "pair_id")


def split_report(df: DataFrame, targets: DataFrame, p: SplitParams = SplitParams()) -> DataFrame:
    """Rows and shares per family and split against the targets; '' is the family of records without one."""
    got = assign_splits(df, targets, p).groupBy("family", "split").agg(F.count(F.lit(1)).alias("n_rows"))
    total = got.groupBy("family").agg(F.sum("n_rows").alias("family_rows"))
    share = F.round(F.col("n_rows") / F.col("family_rows"), 6)
    return got.join(total, "family").join(targets, "split").select("family", "split", "n_rows", share.alias("share"), "target_share")
