"""Reading tables, keeping lineage short and spreading small scans."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table `name` of a folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df in at least as many partitions as there are cores; only small scans (a file or two) are moved for it."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def checkpointed(df: DataFrame, eager: bool = True) -> DataFrame:
    """df read back from the shared checkpoint folder, so that its lineage ends there and outlives lost executors.

    The folder is the session's spark.checkpoint.dir, which all executors share. Where none is set, a session on one
    machine (tests, a bench) gets a temporary one; on a cluster that is an error, as a machine's own folder is lost with
    the machine.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if folder is None:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="studflow-")
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager)


@contextmanager
def passing_shuffles(spark: SparkSession) -> Iterator[None]:
    """What is made and run within leaves no shuffle files behind; it must be read back from a checkpoint."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)
