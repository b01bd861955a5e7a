"""Bounded shortest paths over an edge table: a few rounds of join and minimum, nothing gathered per node."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from querymill.session import discard, materialize


def nearest_sources(edges: DataFrame, sources: DataFrame, max_distance: int) -> DataFrame:
    """(node, distance, source): the best source of each node within max_distance.

    edges: (src, dst), undirected. sources: (node, source, weight): smaller distance wins, then larger weight, then the
    smaller source. Nodes out of reach are left out.
    """
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst").distinct()
    rank = F.struct(F.col("distance"), (-F.col("weight")).alias("w"), F.col("source"))
    best = lambda df: df.groupBy("node").agg(F.min(rank).alias("r")).select("node", F.col("r.distance").alias("distance"), (-F.col("r.w")).alias("weight"), F.col("r.source").alias("source"))
    state = materialize(best(sources.select("node", "source", F.col("weight").cast("long"), F.lit(0).alias("distance"))), "paths")
    for step in range(max_distance):
        frontier = state.where(F.col("distance") == step)
        reached = frontier.join(both, frontier["node"] == both["src"]).select(F.col("dst").alias("node"), (F.col("distance") + 1).alias("distance"), "weight", "source")
        last, state = state, materialize(best(state.unionByName(reached)), "paths")
        discard(last)
    return state.select("node", "distance", "source")


def anchored_reach(edges: DataFrame, anchors: DataFrame, radius: DataFrame) -> DataFrame:
    """(grp, node, distance): nodes within each group's own radius of one of its anchors. anchors: (grp, node); radius: (grp, r)."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    state = materialize(anchors.select("grp", "node").distinct().withColumn("distance", F.lit(0)), "reach")
    most = radius.agg(F.max("r")).first()[0] or 0
    for step in range(most):
        frontier = state.where(F.col("distance") == step).join(radius.where(F.col("r") > step), "grp")
        reached = frontier.join(both, frontier["node"] == both["src"]).select("grp", F.col("dst").alias("node"), F.lit(step + 1).alias("distance"))
        last, state = state, materialize(state.unionByName(reached).groupBy("grp", "node").agg(F.min("distance").alias("distance")), "reach")
        discard(last)
    return state


def clear_winners(reach: DataFrame) -> DataFrame:
    """(node, grp, distance): the group nearest to each node; nodes with two groups at the smallest distance are dropped."""
    w = Window.partitionBy("node")
    nearest = reach.withColumn("d", F.min("distance").over(w)).where("distance = d")
    return nearest.groupBy("node").agg(F.count(F.lit(1)).alias("k"), F.min("grp").alias("grp"), F.min("distance").alias("distance")).where("k = 1").select("node", "grp", "distance")


def path_similarity(distance):
    return 1 / (distance + 1)
