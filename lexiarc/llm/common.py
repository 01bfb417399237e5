"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One table of the test-data layout."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the cluster's shared checkpoint folder and read it back.

    The folder is the session's ``spark.checkpoint.dir``.  A temporary folder is
    used only where that is unset and all runs on this machine, as in tests.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise RuntimeError("a cluster needs spark.checkpoint.dir: a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="lexiarc-"))
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores if it comes in fewer partitions than there are.

    That is the case for small inputs only - at most one split of a file for each
    core - so the shuffle is bounded; larger ones stay as they are read.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df
