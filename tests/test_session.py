"""What materialized tables leave on disk."""

from __future__ import annotations

import time
from pathlib import Path

from pyspark.sql import functions as F

from querymill.session import materialize


def _shuffle_files(spark) -> set[str]:
    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {str(f) for d in dirs for f in Path(d.getPath()).rglob("shuffle_*.data")}


def test_shuffles_of_a_materialized_table_are_removed(spark):
    """They stayed until the driver collected garbage, and problem 2 held the rows of its buckets on disk to the end."""
    before, setting = _shuffle_files(spark), spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    out = materialize(spark.range(10_000).select("id", F.xxhash64("id").alias("h")).repartition(4, "h"), "kept")
    until = time.time() + 20
    while (left := _shuffle_files(spark) - before) and time.time() < until:
        time.sleep(0.2)
    assert not left
    assert out.count() == out.distinct().count() == 10_000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == setting
