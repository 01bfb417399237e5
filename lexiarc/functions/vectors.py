"""Column builders for vectors; all in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """NULL for vectors of different lengths and for zero vectors."""
    scaled = F.get(F.transform(F.array(norm(a) * norm(b)), lambda n: F.when(n > 0, dot(a, b) / n)), 0)
    return F.when(F.size(a) == F.size(b), scaled)


def unit(a: Column) -> Column:
    """The vector scaled to length 1; NULL for a zero vector."""
    # the norm is worked out once, outside of the loop over the entries
    return F.get(F.transform(F.array(norm(a)), lambda n: F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n))), 0)


def literal(values: list[float]) -> Column:
    return F.array(*(F.lit(float(v)) for v in values))
