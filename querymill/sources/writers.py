"""Sinks. A folder is written once; replacing is always explicit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querymill.operators.corpus import label_conflicts, normalise


def write_json(df: DataFrame, path: str, replace: bool = False) -> None:
    df.write.mode("overwrite" if replace else "errorifexists").json(path)


def write_csv(df: DataFrame, path: str, replace: bool = False) -> None:
    df.write.mode("overwrite" if replace else "errorifexists").option("header", True).csv(path)


def write_frozen(df: DataFrame, path: str) -> None:
    """Parquet that must not exist yet."""
    df.write.mode("errorifexists").parquet(path)


def upsert_sets(combined: DataFrame, new: DataFrame, set_col: str = "set", drop: Sequence[str] = ()) -> DataFrame:
    """combined with the sets of new replaced or added, and those of drop left out. Rows without set stay."""
    gone = new.select(set_col).distinct()
    kept = combined.where(~F.coalesce(F.col(set_col).isin(list(drop)), F.lit(False))).join(gone, set_col, "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def promote(training: DataFrame, pairs: DataFrame, by: Sequence[str] = ("round", "platform")) -> DataFrame:
    """training with the validated pairs in place of those of the same round and platform; texts that would then have two
    labels are left out of the new ones."""
    kept = training.join(pairs.select(*by).distinct(), list(by), "left_anti")
    both = kept.unionByName(pairs, allowMissingColumns=True)
    bad = label_conflicts(both, normalise(F.col("question")), F.col("sql_group")).select(F.col("norm").alias("__norm"))
    fresh = pairs.withColumn("__norm", normalise(F.col("question"))).join(bad, "__norm", "left_anti").drop("__norm")
    return kept.unionByName(fresh, allowMissingColumns=True)
