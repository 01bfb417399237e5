"""Append-only stage log of documents: latest states, statistics, filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def latest(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by ``order``, NULLs first, ties to the last column named."""
    by = [F.desc_nulls_last(c) for c in order]
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*by))).where("__n = 1").drop("__n")


def incomplete(catalog: DataFrame, state: DataFrame) -> DataFrame:
    """Rows at a document's latest time whose status isn't a finished one, with the document's name."""
    newest = state.groupBy("document_id").agg(F.max("updated_at").alias("updated_at"))
    open_rows = state.where(F.col("status").isin("in_progress", "failed", "retrying", "paused"))
    rows = open_rows.join(newest, ["document_id", "updated_at"], "left_semi").select("document_id", "stage", "status", F.col("id").alias("state_id"))
    return rows.join(catalog.select(F.col("id").alias("document_id"), "file_name"), "document_id")


def filtered_log(log: DataFrame, limit: int, **equal: str | int | None) -> DataFrame:
    """Log rows with the values given (None: any), newest first."""
    for name, value in equal.items():
        if value is not None:
            log = log.where(F.col(name) == value)
    return log.orderBy(F.desc_nulls_last("created_at"), F.desc("id")).limit(limit)


def pivot_counts(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    """One row: the number of rows with each value, and of all."""
    return df.agg(F.count(F.lit(1)).alias("total"), *(F.count_if(F.col(column) == v).alias(v) for v in values))


def safe_item(item: Column) -> Column:
    """The number of a last item, NULL if it is none."""
    return item.try_cast("int")


def progress(done: Column, total: Column) -> Column:
    """Percent done, one decimal, 0 where nothing is to do."""
    return F.round(F.coalesce(F.try_divide(done.cast("double"), total.cast("double")), F.lit(0.0)) * 100, 1)


def stage_timings(state: DataFrame) -> DataFrame:
    """First and last time of each stage and the seconds between."""
    out = state.groupBy("stage").agg(F.min("updated_at").alias("first_at"), F.max("updated_at").alias("last_at"))
    return out.withColumn("seconds", F.expr("timestampdiff(SECOND, first_at, last_at)"))
