"""Namespaced key-value memory over rows (namespace, key, value, embedding, times)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from .upserts import delete_prefix, last_write


def put(memory: DataFrame, items: DataFrame) -> DataFrame:
    """Memory with ``items`` written: the last write of a key wins, its creation time stays."""
    return last_write(memory.unionByName(items), ["namespace", "key"], ["updated_at", "seq"], first="created_at")


def below(prefix: str, separator: str = "/") -> Column:
    """Namespaces that are the prefix or lie below it."""
    return (F.col("namespace") == prefix) | F.startswith("namespace", F.lit(prefix + separator))


def mget(memory: DataFrame, spark: SparkSession, namespace: str, keys: list[str]) -> DataFrame:
    """``pos``, ``key`` and ``value`` for the keys asked, in their order, NULL where there is none."""
    asked = spark.createDataFrame(list(enumerate(keys)), "pos int, key string")
    return asked.join(memory.where(F.col("namespace") == namespace).select("key", "value"), "key", "left").select("pos", "key", "value")


def namespaces(memory: DataFrame, prefix: str | None = None) -> DataFrame:
    out = memory.where(below(prefix)) if prefix else memory
    return out.select("namespace").distinct()


def page_of(memory: DataFrame, namespace: str, offset: int, limit: int) -> DataFrame:
    """Items of a namespace by recency, one page of them."""
    return memory.where(F.col("namespace") == namespace).orderBy(F.desc_nulls_last("updated_at"), "key").offset(offset).limit(limit)


def nearest(memory: DataFrame, namespace: str, query: list[float], limit: int) -> DataFrame:
    """Items of a namespace by similarity of their vector."""
    score = V.cosine(F.col("embedding"), V.literal(query))
    return memory.where(F.col("namespace") == namespace).withColumn("similarity", score).where("similarity is not null").orderBy(F.desc("similarity"), "key").limit(limit)


def stats(memory: DataFrame) -> DataFrame:
    return memory.agg(F.count(F.lit(1)).alias("items"), F.count("embedding").alias("with_embedding"), F.count_distinct("namespace").alias("namespaces"))


def text_of(value: Column) -> Column:
    """The text to embed a value by: content, text, summary, or the first 1000 characters of the value."""
    return F.coalesce(*(F.get_json_object(value, f"$.{k}") for k in ("content", "text", "summary")), F.left(value, F.lit(1000)))


__all__ = ["below", "delete_prefix", "mget", "namespaces", "nearest", "page_of", "put", "stats", "text_of"]
