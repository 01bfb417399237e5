"""Snapshots of tables as parquet: append, upsert, and an atomic switch to a new version."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write to the shared checkpoint folder of the session and read back.

    A temporary folder is used only where none is set and all runs on this machine.
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


class Store:
    """Tables below one folder; a pointer file names the current version of each.

    A new version is written beside the old one and becomes current by replacing
    the pointer, so a reader sees one or the other, and a plan never overwrites
    what it reads.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _hadoop(self, path: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _pointer(self, table: str) -> str:
        return f"{self.folder}/{table}/current.json"

    def version(self, table: str) -> str | None:
        fs, path = self._hadoop(self._pointer(table))
        if not fs.exists(path):
            return None
        lines = self.spark.read.text(self._pointer(table)).collect()
        return json.loads("".join(r[0] for r in lines))["version"]

    def read(self, table: str, schema: T.StructType | None = None) -> DataFrame:
        version = self.version(table)
        if version is None:
            if schema is None:
                raise FileNotFoundError(f"{table} has no version in {self.folder}")
            return self.spark.createDataFrame([], schema)
        return self.spark.read.parquet(f"{self.folder}/{table}/{version}")

    def replace(self, table: str, df: DataFrame) -> None:
        """Make ``df`` the current version."""
        version = f"v-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.folder}/{table}/{version}")
        fs, draft = self._hadoop(f"{self.folder}/{table}/.{version}.json")
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps({"version": version}), "utf-8"))
        out.close()
        # one move over the old pointer: readers see the old version or the new one
        gateway, hadoop = self.spark.sparkContext._gateway, self.spark._jvm.org.apache.hadoop.fs
        rename = getattr(hadoop, "Options$Rename")
        how = gateway.new_array(rename, 1)
        how[0] = rename.OVERWRITE
        _, path = self._hadoop(self._pointer(table))
        hadoop.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(draft, path, how)

    def vacuum(self, table: str) -> int:
        """Remove all versions but the current one, and say how many; nobody may read an older one any more."""
        current, removed = self.version(table), 0
        fs, folder = self._hadoop(f"{self.folder}/{table}")
        for status in fs.listStatus(folder):
            name = status.getPath().getName()
            if name.startswith("v-") and name != current:
                fs.delete(status.getPath(), True)
                removed += 1
        return removed

    def append(self, table: str, df: DataFrame) -> None:
        """Add rows to the current version, or begin one."""
        version = self.version(table)
        if version is None:
            self.replace(table, df)
        else:
            df.write.mode("append").parquet(f"{self.folder}/{table}/{version}")
