"""Changes of a table by key, as new versions of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def overwrite(old: DataFrame, new: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Rows of both; ``columns`` are taken from ``new`` where it has the key, the rest stays."""
    rest = [c for c in old.columns if c not in key and c not in columns]
    o = old.select(*key, *(F.col(c).alias(f"o_{c}") for c in [*columns, *rest]), F.lit(True).alias("__old"))
    n = new.select(*key, *(F.col(c).alias(f"n_{c}") for c in columns), F.lit(True).alias("__new"))
    both = o.join(n, key, "full_outer")
    return both.select(*key, *(F.when(F.col("__new"), F.col(f"n_{c}")).otherwise(F.col(f"o_{c}")).alias(c) for c in columns), *(F.col(f"o_{c}").alias(c) for c in rest))


def add_frequencies(old: DataFrame, new: DataFrame, key: list[str], amount: str, text: str) -> DataFrame:
    """Amounts of both added; the text of ``new`` where it has one, else of ``old``.

    One aggregation over the union, combined on the map side: a missing amount
    adds nothing, several rows of a key in ``new`` add up.
    """
    rows = old.select(*key, amount, text, F.lit(0).alias("seq")).unionByName(new.select(*key, amount, text, F.lit(1).alias("seq")))
    pick = F.max(F.when(F.col(text).isNotNull(), F.struct("seq", text)))
    return rows.groupBy(*key).agg(F.sum(F.coalesce(amount, F.lit(0)).cast("long")).alias(amount), pick[text].alias(text))


def last_write(rows: DataFrame, key: list[str], order: list[str], first: str | None = None) -> DataFrame:
    """The last row of each key; ``first`` is a time of which the earliest is kept."""
    window = Window.partitionBy(*key)
    out = rows.withColumn("__n", F.row_number().over(window.orderBy(*(F.desc_nulls_last(c) for c in order))))
    if first:
        out = out.withColumn(first, F.min(first).over(window))
    return out.where("__n = 1").drop("__n")


def update(rows: DataFrame, changes: DataFrame, key: list[str], column: str, also: dict[str, Column] | None = None) -> DataFrame:
    """``column`` from ``changes`` where they have the key; ``also`` sets further columns there."""
    c = changes.select(*key, F.col(column).alias("__value"), F.lit(True).alias("__hit"))
    out = rows.join(c, key, "left")
    for name, value in {column: F.col("__value"), **(also or {})}.items():
        out = out.withColumn(name, F.when(F.col("__hit"), value).otherwise(F.col(name)))
    return out.drop("__value", "__hit")


def delete_prefix(rows: DataFrame, column: str, prefix: str, separator: str = "/") -> DataFrame:
    """Rows outside of a namespace: neither the prefix itself nor below it."""
    return rows.where(~((F.col(column) == prefix) | F.startswith(F.col(column), F.lit(prefix + separator))))


def review_import(terms: DataFrame, review: DataFrame, translation: str, approve: bool = True) -> DataFrame:
    """Terms with the reviewer's corrections; reviewed rows are approved.

    Blank corrections keep the translation; unknown ids change nothing.
    """
    r = review.select(F.col("term_id").alias("id"), F.nullif(F.trim("correction"), F.lit("")).alias("__new"), F.lit(True).alias("__seen"))
    out = terms.join(r, "id", "left").withColumn(translation, F.coalesce("__new", translation))
    if approve:
        out = out.withColumn("approved", F.coalesce(F.col("__seen"), F.col("approved")))
    return out.drop("__new", "__seen")
