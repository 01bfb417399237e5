"""Streams into the store: new files, log rows without repetitions, the latest state of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.upserts import last_write
from ..schemas import TABLES
from ..sources.files import pages_of
from ..store import Store


def file_stream(spark: SparkSession, folder: str, per_trigger: int = 1000) -> DataFrame:
    """Text and word-processor files as they arrive, one page each; their suffix may be in either case."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("maxFilesPerTrigger", per_trigger).option("pathGlobFilter", "*.{[tT][xX][tT],[mM][dD],[mM][aA][rR][kK][dD][oO][wW][nN],[dD][oO][cC][xX]}").load(folder)
    return pages_of(files)


def table_stream(spark: SparkSession, name: str, folder: str, per_trigger: int = 100) -> DataFrame:
    """Parquet files of one of the tables as they arrive."""
    return spark.readStream.schema(TABLES[name]).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def log_once(log: DataFrame, late: str = "1 hour") -> DataFrame:
    """Log rows without second deliveries that come within ``late``."""
    timed = log.withColumn("at", F.col("created_at").cast("timestamp")).withWatermark("at", late)
    return timed.dropDuplicatesWithinWatermark(["id"]).drop("at")


def counts_by_window(log: DataFrame, width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Rows per level and window of time; windows close when they are ``late`` past."""
    timed = log.withColumn("at", F.col("created_at").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", width), "level").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "level", "n")


def upsert_stream(stream: DataFrame, store: Store, table: str, key: list[str], order: list[str], checkpoint: str) -> StreamingQuery:
    """Keep the last row of each key in a table of the store, batch by batch.

    A batch that is repeated after a failure gives the same version again: the
    last write of each key wins, whoever writes it.
    """

    def write(batch: DataFrame, _: int) -> None:
        old = store.read(table, batch.schema)
        store.replace(table, last_write(old.unionByName(batch), key, order))

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
