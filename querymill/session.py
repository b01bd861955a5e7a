"""Session defaults and the shared scratch folder used to cut lineage."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[*]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session with the settings the operators expect; a cluster sets its own."""
    base = {
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    spark = SparkSession.builder.master(master).config(map=base | conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only in a local session without one (tests) a folder of this machine is set; elsewhere that is an error, as executors of other
    machines could not read it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError(f"spark.checkpoint.dir is not set: {master} needs a folder that all executors share")
        base = getattr(spark, "_querymill_dir", None)
        if base is None:
            base = os.path.join(tempfile.gettempdir(), f"querymill-{uuid.uuid4().hex}")
            spark._querymill_dir = base
            atexit.register(shutil.rmtree, base, ignore_errors=True)
    return base


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of queries that run in this block go when their query ends, not when the driver happens to collect garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage is cut, loss of an executor costs nothing,
    and the next plan gets true sizes. A fresh folder each time, so that no result of another run is reused.
    Nothing reads the shuffles behind it again, so they are removed."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/querymill/{name}-{uuid.uuid4().hex}"
    with shuffles_removed(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._querymill_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a materialized table that nothing reads any more; other tables are left alone."""
    path = getattr(df, "_querymill_path", None)
    if path:
        jvm = df.sparkSession._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def spread(df: DataFrame, small: int = 512 << 20) -> DataFrame:
    """Rows dealt to all cores when a small table lies in fewer files than there are cores; any other table as it is.

    For costly work per row: a file is often one row group, which only one task can read.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    files = len(df.inputFiles())
    if not 0 < files < cores:
        return df
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return df.repartition(cores) if int(str(size)) <= small else df
