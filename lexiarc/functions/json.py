"""Column builders for JSON texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TERMS = "array<struct<term:string,translation:string,category:string,context:string,confidence:double>>"


def value(json: Column, path: str, default: str | None = None) -> Column:
    """A scalar of a JSON text as string; broken texts have none."""
    out = F.get_json_object(json, path)
    return F.coalesce(out, F.lit(default)) if default is not None else out


def merged(json: Column, additions: Column) -> Column:
    """A flat JSON object with the entries of a map added; these win."""
    old = F.coalesce(F.from_json(F.coalesce(json, F.lit("{}")), "map<string,string>"), F.from_json(F.lit("{}"), "map<string,string>"))
    kept = F.map_filter(old, lambda k, v: ~F.array_contains(F.map_keys(additions), k))
    return F.map_concat(kept, additions)


def reply_terms(reply: Column, block: Column, limit: int = 50) -> Column:
    """Terms of a model's reply: the whole reply, else its bracketed part; entries without a term are dropped."""
    strict = F.from_json(reply, TERMS)
    lenient = F.from_json(block, TERMS)
    items = F.coalesce(strict, lenient, F.array().cast(TERMS))
    kept = F.filter(items, lambda t: t["term"].isNotNull())
    full = F.transform(kept, lambda t: F.struct(t["term"].alias("term"), F.coalesce(t["translation"], F.lit("")).alias("translation"), F.coalesce(t["category"], F.lit("unknown")).alias("category"), F.coalesce(t["context"], F.lit("")).alias("context"), F.coalesce(t["confidence"], F.lit(0.5)).alias("confidence")))
    return F.slice(full, 1, limit)
