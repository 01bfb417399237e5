"""Search over terms: BM25, vectors, both; suggestions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..functions import vectors as V


def postings(rows: DataFrame, record: str, texts: list[str]) -> DataFrame:
    """Inverted index: ``id``, ``token``, ``tf`` and the record's length ``dl``."""
    words = F.concat(*(T.words(F.lower(F.coalesce(F.col(c), F.lit("")))) for c in texts))
    tokens = rows.select(F.col(record).alias("id"), words.alias("tokens")).withColumn("dl", F.size("tokens"))
    return tokens.select("id", "dl", F.explode("tokens").alias("token")).groupBy("id", "dl", "token").agg(F.count(F.lit(1)).alias("tf"))


def bm25(rows: DataFrame, record: str, texts: list[str], query: str, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """``id`` and ``score`` of the records that have a word of the query.

    All records are read once; those with a query word are the only ones scored.
    The length statistics cover every record, empty ones included.
    """
    words = F.concat(*(T.words(F.lower(F.coalesce(F.col(c), F.lit("")))) for c in texts))
    tokens = rows.select(F.col(record).alias("id"), words.alias("tokens")).withColumn("dl", F.size("tokens"))
    asked = F.array_distinct(T.words(F.lower(F.lit(query))))
    statistics = tokens.agg(F.struct(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("mean"))).scalar()
    n_docs, mean_length = statistics["n"], statistics["mean"]
    hits = tokens.where(F.arrays_overlap("tokens", asked)).select("id", "dl", "tokens", F.explode(F.array_intersect("tokens", asked)).alias("token"))
    hits = hits.select("id", "dl", "token", F.size(F.filter("tokens", lambda t: t == F.col("token"))).alias("tf"))
    # one row a query word: bounded by the query
    df = hits.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log10((n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    weight = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / mean_length))
    return hits.join(F.broadcast(df), "token").groupBy("id").agg(F.sum(weight).alias("score"))


def top(scored: DataFrame, score: str, limit: int) -> DataFrame:
    """The best ``limit`` rows; ties go to the smaller id."""
    return scored.orderBy(F.desc(score), "id").limit(limit)


def semantic(rows: DataFrame, record: str, vector: str, query: list[float]) -> DataFrame:
    """``id`` and ``similarity`` of all records with a comparable vector."""
    score = V.cosine(F.col(vector), V.literal(query))
    return rows.select(F.col(record).alias("id"), score.alias("similarity")).where("similarity is not null")


def hybrid(text_scores: DataFrame, vector_scores: DataFrame, limit: int = 20, weight: float = 0.5) -> DataFrame:
    """Both rankings, each cut at twice the limit and scaled by its best, added by weight.

    Negative similarities count as 0, so that scaling keeps the order.
    """
    # the best of each is taken over the few rows that are left of a ranking
    few = Window.partitionBy(F.lit(0))
    t = top(text_scores, "score", 2 * limit)
    v = top(vector_scores, "similarity", 2 * limit)
    both = t.join(v, "id", "full_outer").withColumn("best_t", F.max("score").over(few)).withColumn("best_v", F.max("similarity").over(few))
    best_t, best_v = F.col("best_t"), F.col("best_v")
    by_text = F.coalesce(F.try_divide(F.coalesce("score", F.lit(0.0)), best_t), F.lit(0.0))
    by_vector = F.coalesce(F.try_divide(F.greatest(F.coalesce("similarity", F.lit(0.0)), F.lit(0.0)), F.greatest(best_v, F.lit(0.0))), F.lit(0.0))
    return top(both.select("id", (weight * by_text + (1 - weight) * by_vector).alias("combined_score"), F.col("score").alias("fts_score"), F.col("similarity").alias("semantic_score")), "combined_score", limit)


def similar(rows: DataFrame, record: str, vector: str, query: list[float], top_k: int = 10, threshold: float = 0.5) -> DataFrame:
    """The ``top_k`` most similar records, of these the ones above the threshold."""
    return top(semantic(rows, record, vector, query), "similarity", top_k).where(F.col("similarity") >= threshold)


def suggestions(near: DataFrame, terms: DataFrame, record: str, translation: str, approved: Column, limit: int = 5) -> DataFrame:
    """Translations of similar approved terms with their best similarity."""
    known = terms.where(approved & F.col(translation).isNotNull() & (F.col(translation) != "")).select(F.col(record).alias("id"), F.col(translation).alias("translation"))
    return near.join(known, "id").groupBy("translation").agg(F.max("similarity").alias("similarity")).orderBy(F.desc("similarity"), "translation").limit(limit)
