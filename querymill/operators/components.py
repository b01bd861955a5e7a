"""Connected components over an edge table by alternating large-star and small-star rounds.

Every round is two aggregations and two joins on the node, so no node's neighbours are gathered anywhere; a round's
edges are written to the shared folder, which keeps the plan short and survives the loss of executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from querymill.session import discard, materialize


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m"))
    return (
        both.join(low, "u")
        .where("v > u")
        .select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        .where("u <> v")
        .distinct()
    )


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    linked = down.join(low, "u")
    return (
        linked.select(F.col("v").alias("u"), F.col("m").alias("v"))
        .unionByName(low.select("u", F.col("m").alias("v")))
        .where("u <> v")
        .distinct()
    )


def _written(e: DataFrame) -> tuple[DataFrame, tuple]:
    """e as a table, and numbers that tell it from any other edge table; they are taken while it is written."""
    seen = Observation()
    marks = [F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.sum(F.xxhash64("v", "u").cast("decimal(20,0)")).alias("s")]
    out = materialize(e.observe(seen, *marks), "cc")
    return out, tuple(seen.get.values())


def connected_components(edges: DataFrame, src: str = "u", dst: str = "v", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of an edge; component is the smallest node of the connected set.

    Null ends and loops are dropped (a loop's node then appears only if another edge has it). Repeated edges and both
    directions are allowed. An empty edge table gives an empty result.
    """
    cols = [F.col(src).cast("long").alias("u"), F.col(dst).cast("long").alias("v")]
    e = materialize(edges.select(*cols).where("u is not null and v is not null and u <> v").distinct(), "cc")
    before = None
    for _ in range(max_rounds):
        last = e
        e, after = _written(_small_star(_large_star(last)))
        discard(last)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components not settled after {max_rounds} rounds")
    members = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return members.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
