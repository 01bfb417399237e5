"""Problem 4: records that are identical but for formatting.

A record is reduced to the letters, marks and digits of its fields in lower
case; the fields are ordered, so exchanged fields meet.  The canonical form is
hashed to 128 bits and copies are counted per hash with map-side combining, so
a group of any size reaches a reducer as a few partial rows of fixed size.  Each
group also carries the least and the greatest value of a further hash; where they
differ, two forms share the 128 bits and the group is split by the forms themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SIGNS = r"[^\p{L}\p{M}\p{N}]+"


def canonical(text: Column) -> Column:
    """Letters, marks and digits of a text in lower case; NULL stays NULL."""
    return F.regexp_replace(F.lower(text.cast("string")), _SIGNS, "")


def canonical_record(fields: list[str]) -> Column:
    """The fields' canonical forms in order, joined; NULL differs from empty."""
    # a NUL can't be part of a canonical form, so the joint is unambiguous
    parts = F.array(*(F.coalesce(F.concat(F.lit("="), canonical(F.col(c))), F.lit("-")) for c in fields))
    return F.array_join(F.sort_array(parts), "\u0000")


def hash128(text: Column) -> list[Column]:
    """128 bits in two independent 64-bit halves."""
    return [F.xxhash64(text).alias("__h1"), F.xxhash64(F.lit(0x5EED), F.reverse(text)).alias("__h2")]


def keyed(df: DataFrame, scope: list[str], fields: list[str]) -> DataFrame:
    """``df`` with the canonical form and its hash in ``__form``, ``__h1``, ``__h2``."""
    taken = [*scope, *fields, "__form", "__h1", "__h2"]
    rest = [c for c in df.columns if c not in taken]
    with_form = df.select(*(F.col(f"`{c}`") for c in [*dict.fromkeys([*scope, *fields]), *rest]), canonical_record(fields).alias("__form"))
    return with_form.select("*", *hash128(F.col("__form")))


def collapse(df: DataFrame, record: str, scope: list[str], fields: list[str]) -> DataFrame:
    """One record per group of format copies, with its number of copies: ``scope``, ``record``, ``copies``.

    ``scope`` are columns that must be equal as stored (NULL equals NULL),
    ``fields`` those compared by canonical form, in any order.  The record kept
    is that of the least id, a number; ``copies`` counts all rows.  A NULL field equals
    only a NULL field; a field of signs only equals an empty one.  ``kept_rows`` gives the records whole.
    """
    rows = keyed(df.select(*dict.fromkeys([record, *scope, *fields])), scope, fields).withColumn("__check", F.xxhash64(F.lit(0xC0DE), "__form"))
    counted = [F.min(record).alias("__kept"), F.count(F.lit(1)).alias("copies")]
    by_hash = rows.groupBy(*scope, "__h1", "__h2").agg(*counted, F.min("__check").alias("low"), F.max("__check").alias("high"))
    out = [*scope, F.col("__kept").alias(record), "copies"]
    broken = by_hash.where("low <> high").select(*(F.col(c).alias(f"__s_{c}") for c in scope), F.col("__h1").alias("__b1"), F.col("__h2").alias("__b2"))
    same = (F.col("__h1") == F.col("__b1")) & (F.col("__h2") == F.col("__b2"))
    for c in scope:
        same = same & F.col(c).eqNullSafe(F.col(f"__s_{c}"))
    split = rows.join(broken, same, "left_semi").groupBy(*scope, "__form").agg(*counted)
    return by_hash.where("low = high").select(*out).unionByName(split.select(*out))


def kept_rows(df: DataFrame, collapsed: DataFrame, record: str) -> DataFrame:
    """The rows of ``df`` that ``collapse`` kept, once each, with their ``copies``."""
    return df.dropDuplicates([record]).drop("copies").join(collapsed.select(record, "copies"), record)


def copy_pairs(df: DataFrame, record: str, scope: list[str], fields: list[str]) -> DataFrame:
    """All pairs ``id_a < id_b`` of records in one group of format copies.

    Rows are counted per hash first; only those of hashes with two rows or more
    are shuffled for the pairs, and the canonical forms themselves are compared,
    so a hash shared by different forms makes no pair.  Adaptive execution
    splits a hot key on either side of the join.
    """
    rows = keyed(df.select(*dict.fromkeys([record, *scope, *fields])), scope, fields)
    members = rows.select(F.col(record).cast("long").alias("id"), F.xxhash64(*scope, F.lit(0)).alias("__s") if scope else F.lit(0).alias("__s"), *scope, "__form", "__h1", "__h2").where("id is not null").distinct()
    several = members.groupBy("__s", "__h1", "__h2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    held = members.join(several, ["__s", "__h1", "__h2"], "left_semi")
    left = held.alias("a")
    right = held.alias("b")
    on = (F.col("a.__h1") == F.col("b.__h1")) & (F.col("a.__h2") == F.col("b.__h2")) & (F.col("a.__s") == F.col("b.__s")) & (F.col("a.__form") == F.col("b.__form")) & (F.col("a.id") < F.col("b.id"))
    for c in scope:
        on = on & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    return left.join(right, on).select(F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b")).distinct()
