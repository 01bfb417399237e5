"""The queries of this subpackage and, where SQL can state them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cut_texts, format_duplicates, leaked_items, packing, pieces, scan_noise, sentence_pairs, similar_vectors, term_counts, tokens, uniform_text
from .common import read


# ---- problem 1 --------------------------------------------------------------------------------
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_noise.page_noise(read(spark, sf_dir, "pages"), "id", "document_id", "original_content", "ocr_model")
    return found.withColumnRenamed("page", "page_id")


def p1_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan_noise.readable_pages(read(spark, sf_dir, "pages"), "id", "document_id", "original_content", "ocr_model")
    return out.withColumnRenamed("page", "page_id")


# ---- problem 2 --------------------------------------------------------------------------------
def _all_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = (("term", "terminology"), ("page", "pages"))
    parts = [similar_vectors.vectors(read(spark, sf_dir, table), "id", "embedding", kind) for kind, table in kinds]
    return parts[0].unionByName(parts[1])


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = similar_vectors.neighbours(_all_vectors(spark, sf_dir), 5, min_cosine=0.92)
    return similar_vectors.mutual_pairs(found).withColumnRenamed("kind", "record_kind")


#: Without a least cosine the neighbours have cosines near 0.6, so more cells are asked and more books tell them apart.
NEAREST = similar_vectors.Options(probe_scale=0.85, books=8, shortlist=150, shortlist_share=0.2)


def p2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of every record whose id is divisible by 20, among all records."""
    out = similar_vectors.neighbours(_all_vectors(spark, sf_dir), 5, queries=F.col("id") % 20 == 0, options=NEAREST)
    return out.select(F.col("kind").alias("record_kind"), "id", "other", F.round("cosine", 6).alias("cosine"))


# ---- problem 3 --------------------------------------------------------------------------------
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = (("term", "terminology", "term"), ("page", "pages", "original_content"))
    parts = [uniform_text.deviating(read(spark, sf_dir, table), "id", text).select(F.lit(kind).alias("record_kind"), F.col("record").alias("record_id")) for kind, table, text in kinds]
    return parts[0].unionByName(parts[1])


def p3_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The deviating records' texts in the uniform form."""
    parts = [uniform_text.uniform_text(read(spark, sf_dir, table), "id", text).select(F.lit(kind).alias("record_kind"), F.col("record").alias("record_id"), "plain_text") for kind, table, text in (("term", "terminology", "term"), ("page", "pages", "original_content"))]
    return parts[0].unionByName(parts[1])


# ---- problem 4 --------------------------------------------------------------------------------
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_duplicates.copy_pairs(read(spark, sf_dir, "terminology"), "id", ["document_id"], ["term", "translation_en"])


def p4_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = format_duplicates.collapse(read(spark, sf_dir, "terminology"), "id", ["document_id"], ["term", "translation_en"])
    return out.select(F.col("id").cast("long"), F.col("document_id").cast("long"), "copies")


# ---- problem 5 --------------------------------------------------------------------------------
def _term_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = read(spark, sf_dir, "terminology")
    counts = term_counts.value_counts(terms, "term", "document_id", F.col("frequency"))
    all_records = terms.agg(F.count_distinct("document_id")).scalar()
    return term_counts.mark_values(counts, all_records)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _term_marks(spark, sf_dir).where("mark is not null").select(F.col("value").alias("term"), "mark")


def p5_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _term_marks(spark, sf_dir).select(F.col("value").alias("term"), F.col("occurrences").alias("total_frequency"), F.col("rows").alias("n_rows"), F.col("records").alias("n_documents"), "mark")


def p5_page_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = term_counts.token_counts(read(spark, sf_dir, "pages"), "original_content", "id")
    return counts.select(F.col("value").alias("token"), "occurrences", F.col("records").alias("n_pages"))


# ---- problem 6 --------------------------------------------------------------------------------
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = sentence_pairs.sentence_pairs(read(spark, sf_dir, "pages"), "id", "original_content", {"ar": "ar_content", "en": "en_content", "fr": "fr_content"})
    return pairs.withColumnRenamed("record", "page_id")


# ---- problem 7 --------------------------------------------------------------------------------
_TRANSLATIONS = ("en_content", "ar_content")


def _cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    collections = read(spark, sf_dir, "doc_catalog").select(F.col("id").alias("document_id"), F.split_part("relative_path", F.lit("/"), F.lit(1)).alias("collection"))
    parts = [cut_texts.cut_texts(pages, "id", field, "original_content", "document_id", collections).withColumn("field_name", F.lit(field)) for field in _TRANSLATIONS]
    return parts[0].unionByName(parts[1])


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cut(spark, sf_dir).where("cut").select(F.col("record").alias("page_id"), "field_name")


def p7_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per collection and field: texts, cut texts and their share."""
    n, cut = F.count(F.lit(1)), F.count_if("cut")
    return _cut(spark, sf_dir).groupBy("collection", "field_name").agg(n.alias("n_texts"), cut.alias("n_cut"), F.round(cut / n, 6).alias("share_cut"))


# ---- problem 8 --------------------------------------------------------------------------------
def _limits(spark: SparkSession, sf_dir: str, purpose: str) -> list[tuple[int, int, int]]:
    """The sizes of one purpose: a table of eight rows."""
    rows = read(spark, sf_dir, "size_limits").where((F.col("purpose") == purpose) & (F.col("max_tokens") > 0)).orderBy("limit_id").collect()
    return [(r["limit_id"], r["max_tokens"], r["overlap_tokens"] or 0) for r in rows]


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """limit_id, doc_id, part_no, n_tokens, container."""
    sizes = tokens.token_counts(read(spark, sf_dir, "documents"), "doc_id", "text")
    packed = packing.pack(sizes, "record", "n_tokens", [(i, size) for i, size, _ in _limits(spark, sf_dir, "pack")])
    return packed.select("limit_id", F.col("record").alias("doc_id"), "part_no", "n_tokens", "container")


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per limit: containers, tokens and the share of their space that is used."""
    limits = read(spark, sf_dir, "size_limits").select("limit_id", "max_tokens")
    used = p8_containers(spark, sf_dir).groupBy("limit_id", "container").agg(F.sum("n_tokens").alias("n")).groupBy("limit_id").agg(F.count(F.lit(1)).alias("n_containers"), F.sum("n").alias("n_tokens"), F.max("n").alias("largest"))
    return used.join(limits, "limit_id").select("limit_id", "n_containers", "n_tokens", "largest", F.round(F.col("n_tokens") / F.col("n_containers") / F.col("max_tokens"), 6).alias("fill"))


# ---- problem 9 --------------------------------------------------------------------------------
def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_items.leaks(read(spark, sf_dir, "documents"), "doc_id", "text", read(spark, sf_dir, "eval_items"), "item_id", "text")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir).where("run >= 15").select(F.col("record").alias("doc_id"), F.col("item").alias("item_id"))


def p9_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per item: documents with a passage of it, the longest run found, and documents that only paraphrase it."""
    verbatim = F.col("run") >= 15
    found = _leaks(spark, sf_dir).groupBy("item").agg(F.count(F.when(verbatim, 1)).alias("n_documents"), F.max(F.when(verbatim, F.col("run"))).alias("longest_run"), F.count(F.when(~verbatim, 1)).alias("n_paraphrases"))
    items = read(spark, sf_dir, "eval_items").select("item_id", "task", "lang")
    return items.join(found, items["item_id"] == found["item"], "left").select("item_id", "task", "lang", F.coalesce("n_documents", F.lit(0)).alias("n_documents"), F.coalesce("longest_run", F.lit(0)).alias("longest_run"), F.coalesce("n_paraphrases", F.lit(0)).alias("n_paraphrases"))


# ---- problem 10 -------------------------------------------------------------------------------
def p10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = pieces.split_texts(read(spark, sf_dir, "documents"), "doc_id", "text", _limits(spark, sf_dir, "cut"))
    return cut.withColumnRenamed("record", "doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p1_found, p1_paragraphs, p2_found, p2_neighbours, p3_found, p3_texts, p4_found, p4_collapsed, p5_found, p5_counts, p5_page_tokens, p6_found, p7_found, p7_rates, p8_containers, p8_fill, p9_found, p9_items, p10_pieces)}

_P4_FORM = r"""(SELECT id, document_id, list_sort([
    coalesce('=' || regexp_replace(lower(term), '[^\p{L}\p{M}\p{N}]+', '', 'g'), '-'),
    coalesce('=' || regexp_replace(lower(translation_en), '[^\p{L}\p{M}\p{N}]+', '', 'g'), '-')]) AS form
  FROM terminology)"""

_P5_COUNTS = """(SELECT term, CAST(sum(coalesce(frequency, 1)) AS BIGINT) AS total_frequency, count(*) AS n_rows,
    count(DISTINCT document_id) AS n_documents,
    CASE WHEN count(DISTINCT document_id) >= 5 AND count(DISTINCT document_id) >= 0.03 * (SELECT count(DISTINCT document_id) FROM terminology) THEN 'common'
         WHEN sum(coalesce(frequency, 1)) <= 2 THEN 'rare' END AS mark
  FROM terminology WHERE term IS NOT NULL GROUP BY term)"""

ORACLE_SQL: dict[str, str] = {
    "p4_found": f"""WITH f AS {_P4_FORM}
SELECT DISTINCT CAST(a.id AS BIGINT) AS id_a, CAST(b.id AS BIGINT) AS id_b FROM f a JOIN f b
  ON a.document_id IS NOT DISTINCT FROM b.document_id AND a.form = b.form AND a.id < b.id""",
    "p4_collapsed": f"""SELECT CAST(min(id) AS BIGINT) AS id, CAST(document_id AS BIGINT) AS document_id, count(*) AS copies
FROM {_P4_FORM} GROUP BY document_id, form""",
    "p5_found": f"SELECT term, mark FROM {_P5_COUNTS} WHERE mark IS NOT NULL",
    "p5_counts": f"SELECT * FROM {_P5_COUNTS}",
    "p5_page_tokens": r"""SELECT token, count(*) AS occurrences, count(DISTINCT id) AS n_pages
FROM (SELECT id, unnest(regexp_extract_all(lower(original_content), '[\p{L}\p{M}\p{N}]+')) AS token FROM pages) GROUP BY token""",
}
