"""Mixing sources to target weights (problem 7).

Each source contributes whole passes over its documents and one part of a pass, chosen by exact running totals in random
order, up to its target or its cap of passes. The items of a source, in random order, form blocks; a splitting tree
hands the blocks to output shards: each node draws, by a multivariate hypergeometric law, how many blocks of every
source its left half gets, so every shard's mixture is exact in total and random in detail. Blocks of a shard are
disjoint ranges of the permuted sequence, and are shuffled within the shard.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from querymill.functions.labels import label_key
from querymill.llm.tokens import VOCABULARY, with_token_counts
from querymill.operators.ranking import random_key, rank_in_group, running_total
from querymill.session import materialize


#: Blocks numpy can draw from exactly in one hypergeometric draw.
MOST_BLOCKS = 500_000_000


@dataclass(frozen=True)
class MixParams:
    """block_items grows where a corpus would have more than MOST_BLOCKS blocks; the driver splits the tree down to
    driver_leaves nodes, tasks split the rest."""

    seed: int = 42
    block_items: int = 16
    shard_tokens: int = 2_000_000
    driver_leaves: int = 1_024
    path: str = VOCABULARY


def split_node(at: int, n: int, counts: np.ndarray, seed: int) -> list[tuple[int, int, np.ndarray]]:
    """The two halves of a tree node (first shard, shards, blocks by source). The draw depends on the node only."""
    half, total = n // 2, int(counts.sum())
    rng = np.random.default_rng([seed, at, n])
    left = rng.multivariate_hypergeometric(counts, round(total * half / n), method="marginals") if total else counts
    return [(at, half, left), (at + half, n - half, counts - left)]


def tree_nodes(at: int, n: int, counts: np.ndarray, seed: int, leaves: int) -> list[tuple[int, int, np.ndarray]]:
    """Nodes, in order of shards, that part a node into at least `leaves` nodes, or into its shards where these are fewer."""
    level = [(at, n, np.asarray(counts, np.int64))]
    while len(level) < leaves and any(m > 1 for _, m, _ in level):
        level = [x for node in level for x in (split_node(*node, seed) if node[1] > 1 else [node])]
    return level


def splitting_tree(blocks: list[int], shards: int, seed: int) -> np.ndarray:
    """shards x sources: blocks of each source for each shard; columns sum to blocks, shard sizes differ by at most one a level."""
    return np.array([counts for _, _, counts in tree_nodes(0, shards, np.asarray(blocks, np.int64), seed, shards)], np.int64)


def shard_ranges(spark, sources: list[str], blocks: list[int], shards: int, p: MixParams) -> DataFrame:
    """(source, lo, hi, shard): the blocks lo..hi-1 of a source go to the shard; shards take their ranges in order.

    The driver holds at most 2 x driver_leaves nodes; each of them is split further in a task.
    """
    first = np.zeros(len(sources), np.int64)
    rows = []
    for at, n, counts in tree_nodes(0, shards, np.asarray(blocks, np.int64), p.seed, p.driver_leaves):
        rows.append((at, n, counts.tolist(), first.tolist()))
        first = first + counts
    nodes = spark.createDataFrame(rows, "at long, n long, counts array<long>, first array<long>")

    def run(batches):
        for batch in batches:
            out = []
            for at, n, counts, begin in zip(batch["at"], batch["n"], batch["counts"], batch["first"]):
                begin = np.array(begin, np.int64)
                for shard, _, got in tree_nodes(int(at), int(n), np.array(counts, np.int64), p.seed, int(n)):
                    out += [(s, int(lo), int(lo + k), shard) for s, lo, k in zip(sources, begin, got) if k]
                    begin = begin + got
            yield pd.DataFrame(out, columns=["source", "lo", "hi", "shard"])

    return nodes.repartition(min(len(rows), 64)).mapInPandas(run, "source string, lo long, hi long, shard long")


def _sized(docs: DataFrame, p: MixParams) -> DataFrame:
    return materialize(with_token_counts(docs.select("doc_id", label_key(F.col("source")).alias("skey"), "text"), "text", ["doc_id", "skey"], p.path), "sized-sources")


def _plan(sized: DataFrame, targets: DataFrame) -> tuple[DataFrame, int]:
    """Per source of the targets: size, target and contributed tokens, whole passes, the rest. Also the size of all documents."""
    keyed = targets.withColumn("skey", label_key(F.col("source")))
    per = sized.groupBy("skey").agg(F.sum("n_tokens").alias("size"), F.count(F.lit(1)).alias("n_docs"))
    all_tokens = int(sized.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0])
    goal = F.col("target_share") * F.lit(all_tokens)
    size = F.coalesce("size", F.lit(0))
    return (
        keyed.join(per, "skey", "left")
        .select("source", "skey", "target_share", "max_repeats", size.alias("size"), F.coalesce("n_docs", F.lit(0)).alias("n_docs"), goal.alias("target_tokens"))
        .withColumn("short", F.col("max_repeats") * F.col("size") < F.col("target_tokens"))
        .withColumn("give", F.least(F.col("target_tokens"), (F.col("max_repeats") * F.col("size")).cast("double")))
        .withColumn("passes", F.when(F.col("size") > 0, F.floor(F.col("give") / F.col("size"))).otherwise(F.lit(0)).cast("long"))
        .withColumn("rest", F.col("give") - F.col("passes") * F.col("size")),
        all_tokens,
    )


def _items(sized: DataFrame, plan: DataFrame, p: MixParams) -> DataFrame:
    """(source, doc_id, n_tokens, copy): every pass of every document that the plan takes."""
    docs = sized.join(plan.select("skey", "source", "passes", "rest"), "skey")
    whole = docs.where("passes > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("passes").cast("int"))))
    part = running_total(docs.where("rest > 0"), ["skey"], random_key(f"{p.seed}:part", "doc_id"), ["doc_id"], F.col("n_tokens"), "upto", limit=F.col("rest"))
    taken = part.where(F.col("upto") - F.col("n_tokens") / 2 <= F.col("rest")).withColumn("copy", F.col("passes").cast("int") + 1)
    cols = ["source", "doc_id", "n_tokens", "copy"]
    return whole.select(*cols).unionByName(taken.select(*cols))


def mix_sources(docs: DataFrame, targets: DataFrame, p: MixParams = MixParams()) -> DataFrame:
    """(shard, position, source, doc_id, copy, n_tokens): the mixed corpus. Documents of other or no source are left out.

    A document can come at most max_repeats times. An empty table gives an empty result.
    """
    sized = _sized(docs, p)
    dealt = mixed_items(sized, materialize(_plan(sized, targets)[0], "mix-plan"), p)
    place = Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(f"{p.seed}:place"), "doc_id", "copy"), "doc_id", "copy")
    return dealt.select("shard", F.row_number().over(place).alias("position"), "source", "doc_id", "copy", "n_tokens")


def mixed_items(sized: DataFrame, plan: DataFrame, p: MixParams) -> DataFrame:
    """(source, doc_id, n_tokens, copy, shard): every item the plan takes, dealt to its shard by the splitting tree."""
    items = materialize(_items(sized, plan, p), "mix-items")
    counts = {r["source"]: (r["n"], r["t"]) for r in items.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("t")).collect()}
    sources = sorted(counts)
    n_items = sum(n for n, _ in counts.values())
    block = max(p.block_items, -(-n_items // MOST_BLOCKS))
    blocks = [-(-counts[s][0] // block) for s in sources]
    shards = max(1, round(sum(t for _, t in counts.values()) / p.shard_tokens))
    ranges = shard_ranges(sized.sparkSession, sources, blocks, shards, p)
    owner = ranges.select("source", "shard", F.explode(F.sequence("lo", F.col("hi") - 1)).alias("block"))
    ranked = rank_in_group(items, ["source"], random_key(f"{p.seed}:order", "doc_id", "copy"), ["doc_id", "copy"])
    return ranked.withColumn("block", F.floor((F.col("rank") - 1) / block)).join(owner, ["source", "block"]).select("source", "doc_id", "n_tokens", "copy", "shard")


def mix_report(docs: DataFrame, targets: DataFrame, p: MixParams = MixParams()) -> DataFrame:
    """Per source of the targets: sizes, repeats, the share reached (of the target total), and whether it stays short."""
    sized = _sized(docs, p)
    plan, total = _plan(sized, targets)
    plan = materialize(plan, "mix-plan")
    got = mixed_items(sized, plan, p).groupBy("source").agg(F.sum("n_tokens").alias("mixed_tokens"), F.max("copy").alias("most_copies"))
    mixed = F.coalesce("mixed_tokens", F.lit(0))
    return plan.join(got, "source", "left").select(
        "source", "target_share", "max_repeats", F.col("size").alias("source_tokens"), mixed.alias("mixed_tokens"),
        F.coalesce("most_copies", F.lit(0)).cast("long").alias("most_copies"),
        F.when(F.lit(total) > 0, F.round(mixed / F.lit(max(total, 1)), 6)).alias("reached_share"),
        F.round(mixed / F.sum(mixed).over(Window.partitionBy()), 6).alias("share_of_mix"), "short",
    )


def short_sources(docs: DataFrame, targets: DataFrame, p: MixParams = MixParams()) -> DataFrame:
    """(source): sources whose tokens in the mixed corpus stay below their share, although taken as often as allowed.

    The tokens are counted over the dealt shards; a source that misses its share by part of a document only is checked against
    what its passes could give.
    """
    sized = _sized(docs, p)
    plan, _ = _plan(sized, targets)
    plan = materialize(plan, "mix-plan")
    got = mixed_items(sized, plan, p).groupBy("source").agg(F.sum("n_tokens").alias("mixed_tokens"))
    below = F.coalesce("mixed_tokens", F.lit(0)) < F.col("target_tokens")
    return plan.join(got, "source", "left").where(below & F.col("short")).select("source")
