"""The core queries, each with the SQL that states the same for another engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .functions import json as J
from .functions import text as T
from .functions import vectors as V
from .operators import clusters, context, glossary, memory, search, state, styles, tables, terms, tools, upserts
from .store import spread

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def pages_once(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Pages without second deliveries, which are equal in every column."""
    return read(spark, sf_dir, "pages").select("id", *columns).dropDuplicates(["id"])


def big(name: str) -> Column:
    return F.col(name).cast("long").alias(name)


# ---- SQL shared by several oracles ----
_PAGES = "(SELECT DISTINCT ON (id) * FROM pages)"
_WS = r"[\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_WORD = r"[\p{L}\p{N}_](?:[\p{L}\p{N}_\x{600}-\x{6FF}]*[\p{L}\p{N}_])?"
_STOP = "[" + ",".join(f"'{w}'" for w in T.STOP_WORDS) + "]"


def _sql_norm(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(regexp_replace(lower({x}), '[#*_`\[\](){{}}|]', ' ', 'g'), 'https?://[^\s]+', ' ', 'g'), '{_WS}+', ' ', 'g'))"


def _sql_tokens(x: str) -> str:
    return rf"list_filter(regexp_extract_all({_sql_norm(x)}, '{_WORD}'), lambda w: length(w) >= 3 AND NOT list_contains({_STOP}, w) AND NOT regexp_matches(w, '^\p{{Nd}}+$'))"


def _sql_strip(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '^{_WS}+', ''), '{_WS}+$', '')"


def _sql_cos(a: str, b: str) -> str:
    return f"list_cosine_similarity({a}::DOUBLE[], {b}::DOUBLE[])"


# ================================ scans and filters ================================
@query("SELECT id, full_path, status FROM doc_catalog WHERE id = 7")
def scan_point_lookup(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "doc_catalog").where("id = 7").select("id", "full_path", "status")


@query(f"SELECT document_id, page_number, CAST(id AS BIGINT) AS id, row_number() OVER (PARTITION BY document_id ORDER BY page_number, id) AS pos FROM {_PAGES}")
def scan_ordered(spark: SparkSession, d: str) -> DataFrame:
    order = Window.partitionBy("document_id").orderBy("page_number", "id")
    return pages_once(spark, d, "document_id", "page_number").select("document_id", "page_number", big("id"), F.row_number().over(order).alias("pos"))


@query("SELECT id, file_name, coalesce(total_pages, 0) AS total_pages FROM doc_catalog WHERE status = 'pending'")
def filter_eq(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "doc_catalog").where("status = 'pending'").select("id", "file_name", F.coalesce("total_pages", F.lit(0)).alias("total_pages"))


@query("SELECT id, document_id, stage, status FROM (SELECT DISTINCT ON (id) * FROM processing_state) WHERE status IN ('in_progress', 'failed', 'retrying', 'paused')")
def filter_in(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "processing_state").select("id", "document_id", "stage", "status").where(F.col("status").isin("in_progress", "failed", "retrying", "paused"))
    return rows.dropDuplicates(["id"])


@query("SELECT count(*) FILTER (original_content IS NULL) AS no_content, count(*) FILTER (embedding IS NULL) AS no_embedding, count(*) FILTER (ocr_model IS NULL AND ocr_confidence IS NULL) AS no_model, count(*) FILTER (coalesce(ar_content, en_content, fr_content) IS NOT NULL) AS translated FROM pages")
def null_filters(spark: SparkSession, d: str) -> DataFrame:
    n = F.count_if
    return read(spark, d, "pages").agg(
        n(F.col("original_content").isNull()).alias("no_content"), n(F.col("embedding").isNull()).alias("no_embedding"),
        n(F.col("ocr_model").isNull() & F.col("ocr_confidence").isNull()).alias("no_model"), n(F.coalesce("ar_content", "en_content", "fr_content").isNotNull()).alias("translated"),
    )


@query("SELECT id, run_id, stage, level, message, created_at FROM (SELECT DISTINCT * FROM processing_log) WHERE level = 'ERROR' ORDER BY created_at DESC NULLS LAST, id DESC LIMIT 50")
def log_filter_topn(spark: SparkSession, d: str) -> DataFrame:
    log = read(spark, d, "processing_log").select("id", "run_id", "document_id", "stage", "level", "message", "created_at")
    return state.filtered_log(log.where("level = 'ERROR'").distinct(), 50, level="ERROR", run_id=None, stage=None).drop("document_id")


@query("SELECT id, document_id, coalesce(status, 'pending') AS status, coalesce(items_completed, 0) AS items_completed, coalesce(retry_count, 0) AS retry_count, coalesce(json_extract_string(metadata, '$.pages'), json_extract_string(metadata, '$.attempt'), '') AS meta FROM (SELECT DISTINCT ON (id) * FROM processing_state)")
def checkpoint_projection(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "processing_state").dropDuplicates(["id"])
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    meta = F.coalesce(J.value(F.col("metadata"), "$.pages"), J.value(F.col("metadata"), "$.attempt"), F.lit(""))
    return rows.select("id", "document_id", F.coalesce("status", F.lit("pending")).alias("status"), zero("items_completed"), zero("retry_count"), meta.alias("meta"))


@query("SELECT id, TRY_CAST(last_successful_item AS INTEGER) AS item FROM (SELECT DISTINCT ON (id) * FROM processing_state) WHERE last_successful_item IS NOT NULL")
def try_cast_item(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "processing_state").where("last_successful_item is not null").dropDuplicates(["id"])
    return rows.select("id", state.safe_item(F.col("last_successful_item")).alias("item"))


@query("SELECT id, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS shown FROM (SELECT DISTINCT ON (id) * FROM processing_log)")
def time_display(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "processing_log").dropDuplicates(["id"]).select("id", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("shown"))


@query("SELECT id, term, document_id FROM terminology WHERE approved")
def approved_only(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "terminology").where("approved").select("id", "term", "document_id")


@query(f"SELECT CAST(id AS BIGINT) AS id FROM {_PAGES} WHERE coalesce(ar_content, en_content, fr_content) IS NOT NULL")
def translated_pages(spark: SparkSession, d: str) -> DataFrame:
    return pages_once(spark, d, "ar_content", "en_content", "fr_content").where(F.coalesce("ar_content", "en_content", "fr_content").isNotNull()).select(big("id"))


@query(f"SELECT id, md5(coalesce(nullif(en_content, ''), nullif(ar_content, ''), nullif(fr_content, ''))) AS translation FROM {_PAGES}")
def first_translation(spark: SparkSession, d: str) -> DataFrame:
    return pages_once(spark, d, "ar_content", "en_content", "fr_content").select("id", F.md5(context.first_translation()).alias("translation"))


@query(f"SELECT id, document_id, page_number FROM {_PAGES} WHERE coalesce(original_content, '') <> '' AND coalesce(nullif(en_content, ''), nullif(ar_content, ''), nullif(fr_content, '')) IS NULL")
def pending_pages(spark: SparkSession, d: str) -> DataFrame:
    rows = pages_once(spark, d, "document_id", "page_number", "original_content", "ar_content", "en_content", "fr_content")
    return rows.where((F.coalesce("original_content", F.lit("")) != "") & context.first_translation().isNull()).select("id", "document_id", "page_number")


@query("SELECT id, document_id FROM terminology WHERE embedding IS NULL")
def terms_without_embedding(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "terminology").where("embedding is null").select("id", "document_id")


@query("SELECT document_id, term, coalesce(frequency, 0) AS frequency, translation_ar, translation_en, translation_fr, coalesce(approved, false) AS approved FROM terminology WHERE coalesce(nullif(translation_ar, ''), nullif(translation_en, ''), nullif(translation_fr, '')) IS NOT NULL")
def document_glossary(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "terminology").where(F.coalesce(*(F.nullif(F.col(f"translation_{x}"), F.lit("")) for x in ("ar", "en", "fr"))).isNotNull())
    return rows.select("document_id", "term", F.coalesce("frequency", F.lit(0)).alias("frequency"), "translation_ar", "translation_en", "translation_fr", F.coalesce("approved", F.lit(False)).alias("approved"))


@query("SELECT id, lang, translation FROM (SELECT id, unnest(['ar', 'en', 'fr']) AS lang, unnest([translation_ar, translation_en, translation_fr]) AS translation FROM terminology) WHERE translation IS NOT NULL")
def unpivot_translations(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "terminology").select("id", F.col("translation_ar").alias("ar"), F.col("translation_en").alias("en"), F.col("translation_fr").alias("fr"))
    return rows.unpivot("id", ["ar", "en", "fr"], "lang", "translation").where("translation is not null")


# ================================ files ================================
_EXT = r"lower(regexp_extract(full_path, '(\.[^./]+)$', 1))"
_STEM = r"regexp_replace(regexp_extract(full_path, '([^/]*)$', 1), '(.)\.[^.]*$', '\1')"
_KIND = f"CASE {_EXT} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in T.FILE_KINDS.items()) + " END"
_MEDIA = f"CASE {_EXT} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in T.MEDIA_TYPES.items()) + " END"


@query(f"SELECT id, {_MEDIA} AS media_type FROM doc_catalog WHERE {_KIND} IS NOT NULL")
def supported_file_filter(spark: SparkSession, d: str) -> DataFrame:
    ext = T.suffix(F.col("full_path"))
    return read(spark, d, "doc_catalog").where(ext.isin(list(T.FILE_KINDS))).select("id", T.lookup(ext, T.MEDIA_TYPES).alias("media_type"))


@query(f"SELECT id, CASE WHEN {_KIND} IN ('markdown', 'text') THEN 'text' WHEN {_KIND} IN ('docx', 'doc') THEN 'docx' WHEN {_KIND} = 'pdf' THEN 'pages' ELSE 'unsupported' END AS route FROM doc_catalog")
def route_by_extension(spark: SparkSession, d: str) -> DataFrame:
    kind = T.lookup(T.suffix(F.col("full_path")), T.FILE_KINDS)
    route = F.when(kind.isin("markdown", "text"), "text").when(kind.isin("docx", "doc"), "docx").when(kind == "pdf", "pages").otherwise("unsupported")
    return read(spark, d, "doc_catalog").select("id", route.alias("route"))


@query(rf"""SELECT doc_id, CAST(CASE CAST(doc_id % 3 AS INTEGER) WHEN 0 THEN greatest(1, len(regexp_extract_all(text, '[^\s\x{{0B}}\x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]+')) // 500)
  WHEN 1 THEN greatest(1, (length(text) - length(replace(text, chr(10), ''))) // 50) ELSE 1 END AS INTEGER) AS pages FROM documents WHERE text IS NOT NULL""")
def page_estimate(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("doc_id") % 3 == 0, "docx").when(F.col("doc_id") % 3 == 1, "markdown").otherwise("other")
    return read(spark, d, "documents").where("text is not null").select("doc_id", T.page_estimate(F.col("text"), kind, F.lit(None).cast("int")).alias("pages"))


@query(rf"""SELECT document_id, avg(CASE WHEN length({_sql_strip("coalesce(original_content, '')")}) > 50 THEN 1.0 ELSE 0.0 END) >= 0.5 AS native FROM (
  SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY page_number, id) AS n FROM {_PAGES}) WHERE n <= 3 GROUP BY document_id""")
def native_text_classifier(spark: SparkSession, d: str) -> DataFrame:
    order = Window.partitionBy("document_id").orderBy("page_number", "id")
    sample = pages_once(spark, d, "document_id", "page_number", "original_content").withColumn("n", F.row_number().over(order)).where("n <= 3")
    long = F.when(F.length(T.strip(F.coalesce("original_content", F.lit("")))) > 50, 1.0).otherwise(0.0)
    return sample.groupBy("document_id").agg((F.avg(long) >= 0.5).alias("native"))


@query(f"SELECT id, {_EXT} AS suffix, {_STEM} AS stem, split_part(relative_path, '/', 1) AS collection FROM doc_catalog")
def path_parts(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "doc_catalog").select("id", T.suffix(F.col("full_path")).alias("suffix"), T.stem(F.col("full_path")).alias("stem"), F.split_part("relative_path", F.lit("/"), F.lit(1)).alias("collection"))


@query(rf"SELECT id, regexp_replace({_STEM}, '[^\p{{L}}\p{{N}}._\- ]', '_', 'g') AS safe FROM doc_catalog")
def sanitize_filename(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "doc_catalog").select("id", T.safe_filename(T.stem(F.col("full_path"))).alias("safe"))


# ================================ changes of tables ================================
@query(f"""WITH o AS (SELECT * FROM {_PAGES}), n AS (SELECT document_id, page_number + 1 AS page_number, 'new-model' AS ocr_model, CAST(0.5 AS FLOAT) AS ocr_confidence FROM {_PAGES} WHERE ocr_model = 'ocr-small-v1')
SELECT coalesce(o.document_id, n.document_id) AS document_id, coalesce(o.page_number, n.page_number) AS page_number,
  CASE WHEN n.document_id IS NOT NULL THEN n.ocr_model ELSE o.ocr_model END AS ocr_model, round(CAST(CASE WHEN n.document_id IS NOT NULL THEN n.ocr_confidence ELSE o.ocr_confidence END AS DOUBLE), 5) AS ocr_confidence, md5(o.en_content) AS en_hash
FROM o FULL JOIN n ON o.document_id = n.document_id AND o.page_number = n.page_number""")
def upsert_overwrite(spark: SparkSession, d: str) -> DataFrame:
    old = pages_once(spark, d, "document_id", "page_number", "ocr_model", "ocr_confidence", "en_content").drop("id")
    new = old.where("ocr_model = 'ocr-small-v1'").select("document_id", (F.col("page_number") + 1).alias("page_number"), F.lit("new-model").alias("ocr_model"), F.lit(0.5).cast("float").alias("ocr_confidence"))
    out = upserts.overwrite(old, new, ["document_id", "page_number"], ["ocr_model", "ocr_confidence"])
    return out.select("document_id", "page_number", "ocr_model", F.round(F.col("ocr_confidence").cast("double"), 5).alias("ocr_confidence"), F.md5("en_content").alias("en_hash"))


@query("""WITH u AS (SELECT document_id, term, frequency, context, 0 AS seq FROM terminology UNION ALL SELECT document_id, term, 1, CASE WHEN id % 2 = 0 THEN 'seen again' END, 1 FROM terminology WHERE approved)
SELECT document_id, term, CAST(sum(coalesce(frequency, 0)) AS BIGINT) AS frequency, coalesce(max(context) FILTER (seq = 1), max(context) FILTER (seq = 0)) AS context FROM u GROUP BY document_id, term""")
def upsert_additive(spark: SparkSession, d: str) -> DataFrame:
    old = read(spark, d, "terminology").select("document_id", "term", "frequency", "context", "id", "approved")
    new = old.where("approved").select("document_id", "term", F.lit(1).alias("frequency"), F.when(F.col("id") % 2 == 0, "seen again").alias("context"))
    return upserts.add_frequencies(old.drop("id", "approved"), new, ["document_id", "term"], "frequency", "context")


_MEMORY = f"""(SELECT 'documents/' || document_id || '/pages' AS namespace, 'page_' || page_number AS key, md5(original_content) AS value, created_at, created_at AS updated_at, id AS seq FROM {_PAGES}
  UNION ALL SELECT 'documents/' || document_id || '/pages', 'page_' || page_number, 'revised', created_at + INTERVAL 1 DAY, created_at + INTERVAL 1 DAY, id + 10000000 FROM {_PAGES} WHERE page_number % 2 = 0)"""


def _memory(spark: SparkSession, d: str) -> DataFrame:
    pages = pages_once(spark, d, "document_id", "page_number", "original_content", "created_at")
    key = [F.concat(F.lit("documents/"), "document_id", F.lit("/pages")).alias("namespace"), F.concat(F.lit("page_"), "page_number").alias("key")]
    first = pages.select(*key, F.md5("original_content").alias("value"), "created_at", F.col("created_at").alias("updated_at"), F.col("id").cast("long").alias("seq"))
    later = F.col("created_at") + F.expr("INTERVAL '1' DAY")
    second = pages.where("page_number % 2 = 0").select(*key, F.lit("revised").alias("value"), later.alias("created_at"), later.alias("updated_at"), (F.col("id").cast("long") + 10000000).alias("seq"))
    return memory.put(first, second)


_LATEST_MEMORY = f"(SELECT * FROM (SELECT *, min(created_at) OVER (PARTITION BY namespace, key) AS first_at, row_number() OVER (PARTITION BY namespace, key ORDER BY updated_at DESC NULLS LAST, seq DESC NULLS LAST) AS n FROM {_MEMORY}) WHERE n = 1)"


@query(f"SELECT namespace, key, value, first_at AS created_at, updated_at FROM {_LATEST_MEMORY}")
def kv_last_write_wins(spark: SparkSession, d: str) -> DataFrame:
    return _memory(spark, d).select("namespace", "key", "value", "created_at", "updated_at")


@query("SELECT id, CASE WHEN id % 5 = 0 THEN upper(term) ELSE translation_fr END AS translation_fr FROM terminology")
def update_by_key(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "terminology").select("id", "term", "translation_fr")
    changes = rows.where("id % 5 = 0").select("id", F.upper("term").alias("translation_fr"))
    return upserts.update(rows, changes, ["id"], "translation_fr").select("id", "translation_fr")


@query("SELECT id, CASE WHEN frequency >= 50 THEN true ELSE approved END AS approved FROM terminology")
def update_flag(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "terminology").select("id", F.when(F.col("frequency") >= 50, True).otherwise(F.col("approved")).alias("approved"))


@query(f"SELECT namespace, key FROM {_LATEST_MEMORY} WHERE NOT (namespace = 'documents/1' OR starts_with(namespace, 'documents/1/'))")
def delete_by_prefix(spark: SparkSession, d: str) -> DataFrame:
    return upserts.delete_prefix(_memory(spark, d), "namespace", "documents/1").select("namespace", "key")


@query("SELECT id AS term_id, term AS original_term_ar, coalesce(frequency, 0) AS frequency, coalesce(translation_en, '') AS auto_translation_en, '' AS corrected_translation_en FROM terminology")
def review_export(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "terminology").select(F.col("id").alias("term_id"), F.col("term").alias("original_term_ar"), F.coalesce("frequency", F.lit(0)).alias("frequency"), F.coalesce("translation_en", F.lit("")).alias("auto_translation_en"), F.lit("").alias("corrected_translation_en"))


_REVIEW = "(SELECT id AS term_id, CASE WHEN id % 3 = 0 THEN ' fixed ' || id || ' ' WHEN id % 3 = 1 THEN '  ' END AS correction FROM terminology WHERE id % 2 = 0 UNION ALL SELECT -1, 'nobody')"


def _review(spark: SparkSession, d: str) -> DataFrame:
    some = read(spark, d, "terminology").where("id % 2 = 0").select(F.col("id").alias("term_id"), F.when(F.col("id") % 3 == 0, F.concat(F.lit(" fixed "), "id", F.lit(" "))).when(F.col("id") % 3 == 1, "  ").alias("correction"))
    return some.unionAll(spark.createDataFrame([(-1, "nobody")], "term_id int, correction string"))


@query(f"SELECT t.id, coalesce(nullif(trim(r.correction), ''), t.translation_en) AS translation_en, CASE WHEN r.term_id IS NOT NULL THEN true ELSE t.approved END AS approved FROM terminology t LEFT JOIN {_REVIEW} r ON t.id = r.term_id")
def review_import(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "terminology").select("id", "translation_en", "approved")
    return upserts.review_import(rows, _review(spark, d), "translation_en").select("id", "translation_en", "approved")


@query(f"SELECT count(*) AS approved, count(*) FILTER (nullif(trim(correction), '') IS NOT NULL) AS updated FROM {_REVIEW} r JOIN terminology t ON t.id = r.term_id")
def review_import_counts(spark: SparkSession, d: str) -> DataFrame:
    known = _review(spark, d).join(read(spark, d, "terminology").select(F.col("id").alias("term_id")), "term_id")
    return known.agg(F.count(F.lit(1)).alias("approved"), F.count_if(F.nullif(F.trim("correction"), F.lit("")).isNotNull()).alias("updated"))


@query("""WITH r AS (SELECT term, min(translation_en) AS reply FROM terminology WHERE translation_en IS NOT NULL GROUP BY term)
SELECT t.id, coalesce(t.translation_en, r.reply) AS translation_en FROM terminology t LEFT JOIN r ON t.term = r.term""")
def apply_translations(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "terminology").select("id", "term", "translation_en")
    replies = rows.where("translation_en is not null").groupBy("term").agg(F.min("translation_en").alias("reply"))
    return rows.join(replies, "term", "left").select("id", F.coalesce("translation_en", "reply").alias("translation_en"))


# ================================ joins ================================
@query("SELECT p.document_id, count(*) AS n_pages FROM pages p WHERE NOT EXISTS (SELECT 1 FROM doc_catalog c WHERE c.id = p.document_id AND c.status <> 'failed') GROUP BY p.document_id")
def join_left_anti_catalog(spark: SparkSession, d: str) -> DataFrame:
    known = read(spark, d, "doc_catalog").where("status <> 'failed'").select(F.col("id").alias("document_id"))
    return read(spark, d, "pages").select("document_id").join(known, "document_id", "left_anti").groupBy("document_id").agg(F.count(F.lit(1)).alias("n_pages"))


@query("""SELECT s.document_id, s.stage, s.status, s.id AS state_id, c.file_name FROM doc_catalog c JOIN (SELECT DISTINCT ON (id) * FROM processing_state) s ON s.document_id = c.id
WHERE s.status IN ('in_progress', 'failed', 'retrying', 'paused') AND s.updated_at = (SELECT max(updated_at) FROM processing_state x WHERE x.document_id = c.id)""")
def incomplete_documents(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "processing_state").select("id", "document_id", "stage", "status", "updated_at").distinct()
    return state.incomplete(read(spark, d, "doc_catalog"), rows).select("document_id", "stage", "status", "state_id", "file_name")


_LATEST_DOC = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY updated_at DESC NULLS LAST, id DESC NULLS LAST) AS n FROM processing_state) WHERE n = 1)"


@query(f"SELECT c.id, coalesce(s.stage, 'scan') AS stage, coalesce(s.status, 'pending') AS status, round(coalesce(CAST(s.items_completed AS DOUBLE) / nullif(s.items_total, 0), 0) * 100, 1) AS percent FROM doc_catalog c LEFT JOIN {_LATEST_DOC} s ON s.document_id = c.id")
def status_left_join_latest(spark: SparkSession, d: str) -> DataFrame:
    newest = state.latest(read(spark, d, "processing_state"), ["document_id"], ["updated_at", "id"]).select("document_id", "stage", F.col("status").alias("now"), "items_completed", "items_total")
    docs = read(spark, d, "doc_catalog").select("id").join(newest, F.col("id") == F.col("document_id"), "left")
    return docs.select("id", F.coalesce("stage", F.lit("scan")).alias("stage"), F.coalesce("now", F.lit("pending")).alias("status"), state.progress(F.col("items_completed"), F.col("items_total")).alias("percent"))


@query("SELECT DISTINCT id, document_id, stage FROM processing_state WHERE (document_id, updated_at) IN (SELECT document_id, max(updated_at) FROM processing_state GROUP BY document_id)")
def join_left_semi_latest(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "processing_state").select("id", "document_id", "stage", "updated_at")
    newest = rows.groupBy("document_id").agg(F.max("updated_at").alias("updated_at"))
    return rows.join(newest, ["document_id", "updated_at"], "left_semi").select("id", "document_id", "stage").distinct()


@query("SELECT id, document_id, translation_en, translation_fr FROM terminology WHERE term = 'tide audit'")
def lookup_term(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "terminology").where("term = 'tide audit'").select("id", "document_id", "translation_en", "translation_fr")


@query(f"""WITH want AS (SELECT id AS document_id, unnest(range(greatest(coalesce(total_pages, 0), 0))) AS page_number FROM doc_catalog)
SELECT w.document_id, CAST(w.page_number AS INTEGER) AS page_number FROM want w LEFT JOIN (SELECT DISTINCT document_id, page_number FROM pages WHERE coalesce(original_content, '') <> '') p ON p.document_id = w.document_id AND p.page_number = w.page_number WHERE p.document_id IS NULL""")
def resume_missing_pages(spark: SparkSession, d: str) -> DataFrame:
    total = F.coalesce("total_pages", F.lit(0))
    want = read(spark, d, "doc_catalog").where(total > 0).select(F.col("id").alias("document_id"), F.explode(F.sequence(F.lit(0), total - 1)).alias("page_number"))
    have = read(spark, d, "pages").where(F.coalesce("original_content", F.lit("")) != "").select("document_id", "page_number")
    return want.join(have, ["document_id", "page_number"], "left_anti")


@query("""WITH p AS (SELECT DISTINCT document_id, page_number FROM pages)
SELECT a.document_id, a.page_number, coalesce(string_agg(CAST(b.page_number AS VARCHAR), ',' ORDER BY b.page_number), '') AS near FROM p a LEFT JOIN p b
ON a.document_id = b.document_id AND b.page_number BETWEEN a.page_number - 3 AND a.page_number + 3 AND b.page_number <> a.page_number GROUP BY a.document_id, a.page_number""")
def range_join_neighbors(spark: SparkSession, d: str) -> DataFrame:
    near = context.neighbours(read(spark, d, "pages"))
    return near.select("document_id", "page_number", F.array_join(F.col("near").cast("array<string>"), ",").alias("near"))


_TRANSLATED = f"(SELECT document_id, page_number, min({_sql_strip('coalesce(nullif(en_content, chr(0)), ar_content, fr_content)')}) AS t FROM (SELECT document_id, page_number, nullif(en_content, '') AS en_content, nullif(ar_content, '') AS ar_content, nullif(fr_content, '') AS fr_content FROM pages) GROUP BY document_id, page_number)"


def _translated(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "pages").select("document_id", "page_number", context.first_translation().alias("translation"))
    return rows.groupBy("document_id", "page_number").agg(F.min(T.strip(F.col("translation"))).alias("translation"))


_ENDING_SQL = "right(last_value(t IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY page_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 200)"


@query(f"SELECT document_id, page_number, md5({_ENDING_SQL}) AS ending FROM {_TRANSLATED}")
def asof_previous_page(spark: SparkSession, d: str) -> DataFrame:
    return context.previous_context(_translated(spark, d)).select("document_id", "page_number", F.md5("previous_ending").alias("ending"))


_SUMMARY_SQL = f"""WITH t AS (SELECT document_id, page_number, t, sum(CASE WHEN t IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY document_id ORDER BY page_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS k FROM {_TRANSLATED}),
c AS (SELECT document_id, page_number AS n, t, row_number() OVER (PARTITION BY document_id ORDER BY page_number) AS k FROM {_TRANSLATED} WHERE t IS NOT NULL),
j AS (SELECT t.document_id, t.page_number, a.n AS an, left(a.t, 250) || CASE WHEN length(a.t) > 250 THEN '...' ELSE '' END AS one, b.n AS bn, b.t AS bt
  FROM t LEFT JOIN c a ON a.document_id = t.document_id AND a.k = t.k LEFT JOIN c b ON b.document_id = t.document_id AND b.k = t.k - 1)
SELECT document_id, page_number, md5(CASE WHEN an IS NOT NULL THEN '[Page ' || (an + 1) || ']: ' || one || CASE WHEN bn IS NOT NULL AND 500 - length(one) > 0 THEN chr(10) || '[Page ' || (bn + 1) || ']: ' || left(bt, least(500 - length(one), 250)) || CASE WHEN length(bt) > 250 THEN '...' ELSE '' END ELSE '' END END) AS summary FROM j"""


@query(_SUMMARY_SQL)
def context_summary(spark: SparkSession, d: str) -> DataFrame:
    return context.previous_context(_translated(spark, d)).select("document_id", "page_number", F.md5("previous_summary").alias("summary"))


@query(f"""SELECT a.document_id AS scope, CAST(a.id AS BIGINT) AS id_a, CAST(b.id AS BIGINT) AS id_b, round({_sql_cos('a.embedding', 'b.embedding')}, 6) AS similarity FROM terminology a JOIN terminology b
ON a.document_id = b.document_id AND a.id < b.id AND len(a.embedding) = 64 AND len(b.embedding) = 64 WHERE {_sql_cos('a.embedding', 'b.embedding')} >= 0.8""")
def pairwise_similarity(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "terminology").where(F.size("embedding") == 64)
    return clusters.similar_pairs(rows, "id", "document_id", "embedding", 0.8).withColumn("similarity", F.round("similarity", 6))


@query("SELECT DISTINCT c.id FROM doc_catalog c, (SELECT unnest(['md', 'pdf', 'docx']) AS format) f WHERE NOT EXISTS (SELECT 1 FROM doc_catalog x WHERE x.id = c.id AND x.status = 'completed' AND (f.format <> 'pdf' OR x.total_pages > 0))")
def cross_join_missing_exports(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "doc_catalog")
    # three formats, fixed: an array instead of a join
    wanted = docs.select("id", F.explode(F.array(F.lit("md"), F.lit("pdf"), F.lit("docx"))).alias("format"))
    files = docs.where("status = 'completed'").select("id", "total_pages", F.explode(F.array(F.lit("md"), F.lit("pdf"), F.lit("docx"))).alias("format")).where("format <> 'pdf' or total_pages > 0")
    return wanted.join(files, ["id", "format"], "left_anti").select("id").distinct()


# ================================ aggregates ================================
@query("SELECT status, count(*) AS n FROM doc_catalog GROUP BY status")
def status_counts(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "doc_catalog").groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT (SELECT count(*) FROM doc_catalog) AS documents, (SELECT coalesce(sum(total_pages), 0)::BIGINT FROM doc_catalog) AS total_pages, (SELECT count(DISTINCT id) FROM pages WHERE original_content IS NOT NULL) AS pages,
(SELECT count(DISTINCT id) FROM pages WHERE coalesce(ar_content, en_content, fr_content) IS NOT NULL) AS translated, (SELECT count(*) FROM terminology) AS terms, (SELECT count(*) FROM terminology WHERE approved) AS approved,
(SELECT count(DISTINCT id) FROM processing_log WHERE level = 'ERROR') AS errors""")
def processing_stats(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "doc_catalog").agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum("total_pages"), F.lit(0)).alias("total_pages"))
    is_translated = F.coalesce("ar_content", "en_content", "fr_content").isNotNull()
    # a page delivered twice is one: its two marks are combined per id before they are counted
    pages = read(spark, d, "pages").groupBy("id").agg(F.max(F.col("original_content").isNotNull()).alias("e"), F.max(is_translated).alias("t"))
    pages = pages.agg(F.struct(F.count_if("e").alias("pages"), F.count_if("t").alias("translated"))).scalar()
    rows = read(spark, d, "terminology").agg(F.struct(F.count(F.lit(1)).alias("terms"), F.count_if("approved").alias("approved"))).scalar()
    errors = read(spark, d, "processing_log").where("level = 'ERROR'").agg(F.count_distinct("id")).scalar()
    return docs.select("documents", "total_pages", pages["pages"].alias("pages"), pages["translated"].alias("translated"), rows["terms"].alias("terms"), rows["approved"].alias("approved"), errors.alias("errors"))


@query("SELECT id, round(coalesce(CAST(items_completed AS DOUBLE) / nullif(items_total, 0), 0) * 100, 1) AS percent FROM (SELECT DISTINCT ON (id) * FROM processing_state)")
def processing_ratios(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "processing_state").select("id", "items_completed", "items_total").dropDuplicates(["id"])
    return rows.select("id", state.progress(F.col("items_completed"), F.col("items_total")).alias("percent"))


@query("SELECT count(*) AS total, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'in_progress') AS in_progress, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'failed') AS failed, (SELECT count(DISTINCT id) FROM pages) AS total_pages FROM doc_catalog")
def statistics_pivot(spark: SparkSession, d: str) -> DataFrame:
    counts = state.pivot_counts(read(spark, d, "doc_catalog"), "status", ["completed", "in_progress", "pending", "failed"])
    return counts.withColumn("total_pages", read(spark, d, "pages").agg(F.count_distinct("id")).scalar())


@query(f"SELECT DISTINCT namespace FROM {_MEMORY} WHERE namespace = 'documents' OR starts_with(namespace, 'documents/')")
def distinct_namespaces(spark: SparkSession, d: str) -> DataFrame:
    return memory.namespaces(_memory(spark, d), "documents")


@query(f"SELECT namespace, key FROM {_LATEST_MEMORY} WHERE starts_with(key, 'page_1')")
def like_prefix(spark: SparkSession, d: str) -> DataFrame:
    return _memory(spark, d).where(F.startswith("key", F.lit("page_1"))).select("namespace", "key")


@query("SELECT count(*) AS items, count(embedding) AS with_embedding, count(DISTINCT 'documents/' || document_id) AS namespaces FROM terminology")
def memory_stats(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "terminology").select(F.concat(F.lit("documents/"), "document_id").alias("namespace"), "embedding")
    return memory.stats(rows)


@query("SELECT document_id, count(*) AS total, count(embedding) AS embedded, round(CAST(count(embedding) AS DOUBLE) / count(*), 6) AS coverage FROM terminology GROUP BY document_id")
def embedding_coverage(spark: SparkSession, d: str) -> DataFrame:
    n, e = F.count(F.lit(1)), F.count("embedding")
    return read(spark, d, "terminology").groupBy("document_id").agg(n.alias("total"), e.alias("embedded"), F.round(F.coalesce(F.try_divide(e, n), F.lit(0.0)), 6).alias("coverage"))


_SPANS = "(SELECT doc_id, coalesce(lang, '?') AS font, CAST(n_chars % 5 AS INTEGER) + 10 AS size, source AS color, n_chars AS weight, CAST(doc_id % 50 AS INTEGER) AS page FROM documents)"


def _spans(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", F.coalesce("lang", F.lit("?")).alias("font"), ((F.col("n_chars") % 5).cast("int") + 10).alias("size"), F.col("source").alias("color"), F.col("n_chars").alias("weight"), (F.col("doc_id") % 50).cast("int").alias("page"))


@query(f"SELECT font, weight FROM (SELECT font, CAST(sum(weight) AS BIGINT) AS weight, min(doc_id) AS seen FROM {_SPANS} GROUP BY font) ORDER BY weight DESC, seen LIMIT 1")
def weighted_mode(spark: SparkSession, d: str) -> DataFrame:
    return styles.weighted_mode(_spans(spark, d), [], "font", "weight", "doc_id")


@query(f"SELECT page, font, size, color, weight FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY weight DESC NULLS LAST, seen) AS n FROM (SELECT page, font, size, color, CAST(sum(weight) AS BIGINT) AS weight, min(doc_id) AS seen FROM {_SPANS} GROUP BY ALL)) WHERE n = 1")
def weighted_mode_per_group(spark: SparkSession, d: str) -> DataFrame:
    return styles.weighted_mode(_spans(spark, d), ["page"], ["font", "size", "color"], "weight", "doc_id")


@query(f"SELECT font, string_agg(color, ',' ORDER BY n) AS palette FROM (SELECT font, color, row_number() OVER (PARTITION BY font ORDER BY weight DESC, seen) AS n FROM (SELECT font, color, sum(weight) AS weight, min(doc_id) AS seen FROM {_SPANS} GROUP BY ALL)) WHERE n <= 5 GROUP BY font")
def topk_array_agg(spark: SparkSession, d: str) -> DataFrame:
    return styles.top_values(_spans(spark, d), ["font"], "color", "weight", "doc_id").select("font", F.array_join("palette", ",").alias("palette"))


@query(f"SELECT doc_id, font, size FROM (SELECT *, row_number() OVER (PARTITION BY font, size, weight > 1000 ORDER BY doc_id) AS n FROM {_SPANS}) WHERE n = 1")
def dedup_first(spark: SparkSession, d: str) -> DataFrame:
    return glossary.first_of(_spans(spark, d), [F.col("font"), F.col("size"), F.col("weight") > 1000], [F.col("doc_id")]).select("doc_id", "font", "size")


@query(f"SELECT id, term FROM (SELECT id, term, row_number() OVER (PARTITION BY lower({_sql_strip('term')}) ORDER BY id) AS n FROM terminology) WHERE n = 1")
def dedup_case_insensitive(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "terminology").select("id", "term")
    return glossary.first_of(rows, [F.lower(T.strip(F.col("term")))], [F.col("id")])


@query(f"SELECT document_id, md5(string_agg(original_content, chr(10) ORDER BY page_number, original_content)) AS text, count(*) AS pages FROM {_PAGES} WHERE original_content IS NOT NULL GROUP BY document_id")
def concat_pages(spark: SparkSession, d: str) -> DataFrame:
    rows = pages_once(spark, d, "document_id", "page_number", "original_content").where("original_content is not null")
    whole = terms.concat_pages(rows, "document_id", "page_number", "original_content")
    return whole.select("document_id", F.md5("text").alias("text")).join(rows.groupBy("document_id").agg(F.count(F.lit(1)).alias("pages")), "document_id")


@query("SELECT lang, count(*) AS documents, CAST(sum(length(text)) AS BIGINT) // 4 AS tokens_in, CAST(floor(CAST(sum(length(text)) AS BIGINT) // 4 * CASE WHEN lang = 'ar' THEN 1.2 ELSE 1.0 END) AS BIGINT) AS tokens_out FROM documents WHERE lang IS NOT NULL AND text IS NOT NULL GROUP BY lang")
def token_estimate(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "documents").where("lang is not null and text is not null")
    sums = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("documents"), F.floor(F.sum(F.length("text")) / 4).alias("tokens_in"))
    factor = F.when(F.col("lang") == "ar", 1.2).otherwise(1.0)
    return sums.select("lang", "documents", "tokens_in", F.floor(F.col("tokens_in") * factor).alias("tokens_out"))


@query("SELECT stage, count(*) AS requests, count(*) FILTER (status = 'failed') AS failures, round(CAST(count(*) FILTER (status = 'failed') AS DOUBLE) / count(*), 6) AS fallback_rate FROM (SELECT DISTINCT ON (id) * FROM processing_state) GROUP BY stage")
def fallback_rate(spark: SparkSession, d: str) -> DataFrame:
    n, bad = F.count(F.lit(1)), F.count_if(F.col("status") == "failed")
    rows = read(spark, d, "processing_state").select("id", "stage", "status").dropDuplicates(["id"])
    return rows.groupBy("stage").agg(n.alias("requests"), bad.alias("failures"), F.round(F.coalesce(F.try_divide(bad, n), F.lit(0.0)), 6).alias("fallback_rate"))


@query(f"""SELECT c.id, coalesce(p.extracted, 0) AS extracted, coalesce(p.translated, 0) AS translated, coalesce(t.terms, 0) AS terms, coalesce(s.stage, 'scan') AS stage, coalesce(json_extract_string(s.metadata, '$.awaiting_review'), 'false') = 'true' AS awaiting_review
FROM doc_catalog c LEFT JOIN (SELECT document_id, count(*) FILTER (original_content IS NOT NULL) AS extracted, count(*) FILTER (coalesce(ar_content, en_content, fr_content) IS NOT NULL) AS translated FROM {_PAGES} GROUP BY document_id) p ON p.document_id = c.id
LEFT JOIN (SELECT document_id, count(*) AS terms FROM terminology GROUP BY document_id) t ON t.document_id = c.id LEFT JOIN {_LATEST_DOC} s ON s.document_id = c.id""")
def pipeline_status(spark: SparkSession, d: str) -> DataFrame:
    pages = pages_once(spark, d, "document_id", "original_content", "ar_content", "en_content", "fr_content")
    p = pages.groupBy("document_id").agg(F.count_if(F.col("original_content").isNotNull()).alias("extracted"), F.count_if(F.coalesce("ar_content", "en_content", "fr_content").isNotNull()).alias("translated"))
    t = read(spark, d, "terminology").groupBy("document_id").agg(F.count(F.lit(1)).alias("terms"))
    s = state.latest(read(spark, d, "processing_state"), ["document_id"], ["updated_at", "id"]).select("document_id", "stage", "metadata")
    docs = read(spark, d, "doc_catalog").select(F.col("id").alias("document_id"))
    out = docs.join(p, "document_id", "left").join(t, "document_id", "left").join(s, "document_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select(F.col("document_id").alias("id"), zero("extracted"), zero("translated"), zero("terms"), F.coalesce("stage", F.lit("scan")).alias("stage"), (J.value(F.col("metadata"), "$.awaiting_review", "false") == "true").alias("awaiting_review"))


@query("SELECT stage, count(DISTINCT id) AS errors, coalesce(string_agg(DISTINCT message, ' | ' ORDER BY message), '') AS messages FROM processing_log WHERE level = 'ERROR' GROUP BY stage")
def error_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "processing_log").where("level = 'ERROR'")
    return rows.groupBy("stage").agg(F.count_distinct("id").alias("errors"), F.array_join(F.array_sort(F.collect_set("message")), " | ").alias("messages"))


@query("SELECT stage, min(updated_at) AS first_at, max(updated_at) AS last_at, CAST(floor((epoch_us(max(updated_at)) - epoch_us(min(updated_at))) / 1000000) AS BIGINT) AS seconds FROM processing_state GROUP BY stage")
def stage_timings(spark: SparkSession, d: str) -> DataFrame:
    return state.stage_timings(read(spark, d, "processing_state"))


@query(f"""SELECT c.id, coalesce(p.n, 0) AS pages, CASE WHEN coalesce(p.n, 0) = 0 THEN 'No en translations found' END AS error FROM doc_catalog c LEFT JOIN (SELECT document_id, count(*) AS n FROM {_PAGES} WHERE coalesce(en_content, '') <> '' GROUP BY document_id) p ON p.document_id = c.id""")
def export_status(spark: SparkSession, d: str) -> DataFrame:
    p = pages_once(spark, d, "document_id", "en_content").where(F.coalesce("en_content", F.lit("")) != "").groupBy("document_id").agg(F.count(F.lit(1)).alias("n"))
    out = read(spark, d, "doc_catalog").select("id").join(p, F.col("id") == F.col("document_id"), "left")
    n = F.coalesce("n", F.lit(0))
    return out.select("id", n.alias("pages"), F.when(n == 0, "No en translations found").alias("error"))


# ================================ latest, order, pages of results ================================
@query("SELECT document_id, stage, status, id FROM (SELECT *, row_number() OVER (PARTITION BY document_id, stage ORDER BY updated_at DESC NULLS LAST, id DESC NULLS LAST) AS n FROM processing_state) WHERE n = 1")
def latest_per_stage(spark: SparkSession, d: str) -> DataFrame:
    return state.latest(read(spark, d, "processing_state"), ["document_id", "stage"], ["updated_at", "id"]).select("document_id", "stage", "status", "id")


@query(f"SELECT document_id, stage, status, id FROM {_LATEST_DOC}")
def latest_per_document(spark: SparkSession, d: str) -> DataFrame:
    return state.latest(read(spark, d, "processing_state"), ["document_id"], ["updated_at", "id"]).select("document_id", "stage", "status", "id")


@query("SELECT id, document_id, CAST((row_number() OVER (PARTITION BY document_id ORDER BY id) - 1) // 50 AS INTEGER) AS batch FROM terminology WHERE coalesce(translation_en, '') = ''")
def batching(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "terminology").where(F.coalesce("translation_en", F.lit("")) == "").select("id", "document_id")
    return terms.batches(rows, ["document_id"], ["id"], 50)


@query("SELECT document_id, term, row_number() OVER (PARTITION BY document_id ORDER BY frequency DESC NULLS LAST, term) AS rank FROM terminology")
def terms_by_frequency(spark: SparkSession, d: str) -> DataFrame:
    order = Window.partitionBy("document_id").orderBy(F.desc_nulls_last("frequency"), "term")
    return read(spark, d, "terminology").select("document_id", "term", F.row_number().over(order).alias("rank"))


@query("SELECT id, level FROM (SELECT DISTINCT id, level, created_at FROM processing_log) ORDER BY created_at DESC NULLS LAST, id LIMIT 20 OFFSET 40")
def paginate(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "processing_log").select("id", "level", "created_at").distinct()
    return rows.orderBy(F.desc_nulls_last("created_at"), "id").offset(40).limit(20).select("id", "level")


@query("SELECT document_id, term, n FROM (SELECT document_id, term, row_number() OVER (PARTITION BY document_id ORDER BY coalesce(approved, false) DESC, frequency DESC NULLS LAST, term) AS n FROM terminology WHERE coalesce(translation_en, '') <> '') WHERE n <= 50")
def glossary_ranked(spark: SparkSession, d: str) -> DataFrame:
    order = Window.partitionBy("document_id").orderBy(F.desc(F.coalesce("approved", F.lit(False))), F.desc_nulls_last("frequency"), "term")
    rows = read(spark, d, "terminology").where(F.coalesce("translation_en", F.lit("")) != "")
    return rows.select("document_id", "term", F.row_number().over(order).alias("n")).where("n <= 50")


@query("SELECT id, CASE status WHEN 'in_progress' THEN 0 ELSE 1 END AS place FROM doc_catalog WHERE status IN ('in_progress', 'pending')")
def work_queue_order(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "doc_catalog").where(F.col("status").isin("in_progress", "pending"))
    return rows.select("id", F.when(F.col("status") == "in_progress", 0).otherwise(1).alias("place")).orderBy("place", "id")


# ================================ sets ================================
@query("SELECT document_id FROM terminology UNION SELECT document_id FROM pages")
def set_union(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "terminology").select("document_id").union(read(spark, d, "pages").select("document_id")).distinct()


@query("SELECT id, 'in_progress' AS queue FROM doc_catalog WHERE status = 'in_progress' UNION ALL SELECT id, 'pending' FROM doc_catalog WHERE status = 'pending'")
def union_all(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "doc_catalog")
    part = lambda s: docs.where(F.col("status") == s).select("id", F.lit(s).alias("queue"))
    return part("in_progress").unionByName(part("pending"))


@query("SELECT id AS document_id FROM doc_catalog EXCEPT SELECT document_id FROM processing_log WHERE level = 'ERROR'")
def set_except(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "doc_catalog").select(F.col("id").alias("document_id")).subtract(read(spark, d, "processing_log").where("level = 'ERROR'").select("document_id"))


@query("SELECT term FROM terminology INTERSECT SELECT translation_en FROM terminology")
def set_intersect(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "terminology")
    return rows.select("term").intersect(rows.select("translation_en"))


# ================================ text ================================
_DOCS = "(SELECT doc_id, text FROM documents WHERE text IS NOT NULL)"


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return spread(read(spark, d, "documents").where("text is not null").select("doc_id", "text"))


@query(f"SELECT doc_id, md5({_sql_norm('text')}) AS normal FROM {_DOCS}")
def normalize_text(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.md5(T.normalize(F.col("text"))).alias("normal"))


@query(f"SELECT doc_id, len(t) AS n, md5(array_to_string(t, ' ')) AS tokens FROM (SELECT doc_id, {_sql_tokens('text')} AS t FROM {_DOCS})")
def tokenize(spark: SparkSession, d: str) -> DataFrame:
    rows = _docs(spark, d).select("doc_id", T.tokens(T.normalize(F.col("text"))).alias("t"))
    return rows.select("doc_id", F.size("t").cast("long").alias("n"), F.md5(F.array_join("t", " ")).alias("tokens"))


_SQL_IS_TERM = rf"length(w) >= 3 AND NOT list_contains({_STOP}, w) AND NOT regexp_matches(w, '^\p{{Nd}}+$') AND length(regexp_replace(w, '[^\p{{L}}]', '', 'g')) / length(w) >= 0.7"
_FREQ1 = f"(SELECT doc_id AS document_id, w AS term, count(*) AS frequency FROM (SELECT doc_id, unnest({_sql_tokens('text')}) AS w FROM {_DOCS}) GROUP BY doc_id, w)"


@query(f"SELECT DISTINCT term FROM {_FREQ1} f WHERE {_SQL_IS_TERM.replace('(w', '(term').replace(', w)', ', term)')}")
def valid_terms(spark: SparkSession, d: str) -> DataFrame:
    words = _docs(spark, d).select(F.explode(F.array_distinct(T.tokens(T.normalize(F.col("text"))))).alias("term"))
    return words.distinct().where(T.is_term(F.col("term")))


@query(f"SELECT * FROM {_FREQ1}")
def term_freq_unigram(spark: SparkSession, d: str) -> DataFrame:
    return terms.term_frequencies(_docs(spark, d), "doc_id", "text", (1,)).select("document_id", "term", "frequency")


_GRAMS = f"""(SELECT doc_id AS document_id, g.n AS n, g.term AS term, count(*) AS frequency, min(g.pos) AS first_pos FROM (
  SELECT doc_id, unnest(flatten(list_transform([1, 2, 3, 4], lambda n: list_transform(range(greatest(len(t) - n + 1, 0)), lambda i: {{'n': n, 'pos': i, 'term': array_to_string(t[i + 1 : i + n], ' ')}})))) AS g
  FROM (SELECT doc_id, {_sql_tokens('text')} AS t FROM {_DOCS})) GROUP BY doc_id, g.n, g.term)"""


@query(f"SELECT document_id, term, CAST(n AS INTEGER) AS n, frequency FROM {_GRAMS} WHERE n > 1 AND frequency >= 3")
def term_freq_ngram(spark: SparkSession, d: str) -> DataFrame:
    return terms.term_frequencies(_docs(spark, d), "doc_id", "text", (2, 3, 4)).where("frequency >= 3").select("document_id", "term", "n", "frequency")


@query(f"""SELECT document_id, term, CAST(n AS INTEGER) AS n, frequency, rank FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY frequency DESC, n, first_pos, term) AS rank FROM {_GRAMS}
WHERE frequency >= 3 AND len(list_filter(string_split(term, ' '), lambda w: NOT ({_SQL_IS_TERM}))) = 0) WHERE rank <= 500""")
def extract_terms(spark: SparkSession, d: str) -> DataFrame:
    return terms.extract_terms(_docs(spark, d), "doc_id", "text")


@query(f"""WITH e AS ({ORACLE_SQL["extract_terms"]}), s AS (SELECT e.document_id, e.term, t, string_split(t, e.term) AS parts FROM e JOIN (SELECT doc_id, {_sql_norm('text')} AS t FROM documents WHERE text IS NOT NULL) d ON d.doc_id = e.document_id),
o AS (SELECT *, unnest(range(1, least(len(parts) - 1, 3) + 1)) AS i FROM s WHERE len(parts) > 1),
p AS (SELECT *, CAST(list_sum(list_transform(parts[1:i], lambda x: length(x))) + (i - 1) * length(term) AS BIGINT) AS begin_at FROM o)
SELECT document_id, term, CASE WHEN begin_at > 50 THEN '...' ELSE '' END || trim(substr(t, greatest(begin_at - 50, 0) + 1, least(begin_at + length(term) + 50, length(t)) - greatest(begin_at - 50, 0))) || CASE WHEN begin_at + length(term) + 50 < length(t) THEN '...' ELSE '' END AS context FROM p""")
def term_contexts(spark: SparkSession, d: str) -> DataFrame:
    found = terms.extract_terms(_docs(spark, d), "doc_id", "text")
    texts = _docs(spark, d).select(F.col("doc_id").alias("document_id"), T.normalize(F.col("text")).alias("t"))
    return found.join(texts, "document_id").select("document_id", "term", F.explode(terms.contexts(F.col("t"), F.col("term"))).alias("context"))


@query(rf"SELECT doc_id, len(regexp_extract_all(text, '[^\s\x{{0B}}\x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]+')) AS words FROM {_DOCS}")
def word_count(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", T.word_count(F.col("text")).cast("long").alias("words"))


_QUALITY = rf"""(SELECT id, t, CASE WHEN {_sql_strip('t')} = '' THEN 0.0 ELSE round(greatest(0.0, least(1.0, 1.0
  - CASE WHEN length(t) / w < 2 OR length(t) / w > 15 THEN 0.2 ELSE 0.0 END
  - CASE WHEN s / length(t) > 0.3 THEN 0.3 WHEN s / length(t) > 0.2 THEN 0.1 ELSE 0.0 END
  - CASE WHEN r / length(t) > 0.1 THEN 0.3 WHEN r / length(t) > 0.05 THEN 0.15 ELSE 0.0 END)), 6) END AS score FROM (
  SELECT id, t, nullif(len(regexp_extract_all(t, '[^\s\x{{0B}}\x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]+')), 0) AS w,
    len(regexp_extract_all(t, '[^\p{{L}}\p{{N}}\s\x{{0B}}\x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]')) AS s,
    len(list_filter(range(length(t) - 2), lambda i: c[i + 1] = c[i + 2] AND c[i + 2] = c[i + 3])) AS r FROM (
    SELECT id, original_content AS t, regexp_extract_all(original_content, '(?s).') AS c FROM {_PAGES} WHERE original_content IS NOT NULL)))"""


@query(f"SELECT id, CAST(score AS DOUBLE) AS score, CASE WHEN score >= 0.85 THEN 'excellent' WHEN score >= 0.7 THEN 'good' WHEN score >= 0.5 THEN 'fair' ELSE 'poor' END AS quality FROM {_QUALITY}")
def text_quality(spark: SparkSession, d: str) -> DataFrame:
    rows = pages_once(spark, d, "original_content").where("original_content is not null").select("id", T.quality_score(F.col("original_content")).alias("score"))
    return rows.select("id", "score", T.quality_label(F.col("score")).alias("quality"))


def _sql_occurrences(part: str) -> str:
    return f"(length(t) - length(replace(t, '{part}', ''))) / {len(part)}"


_SQL_ARTIFACTS = " + ".join(_sql_occurrences(a) for a in ("???", "###", "...", "   "))


@query(rf"""SELECT id, CASE WHEN c IS NULL THEN CASE WHEN coalesce({_sql_strip('t')}, '') = '' THEN 'poor' WHEN {_SQL_ARTIFACTS} > length(t) * 0.1 THEN 'poor' WHEN {_SQL_ARTIFACTS} > length(t) * 0.05 THEN 'fair' ELSE 'good' END
  WHEN c >= 0.95 THEN 'excellent' WHEN c >= 0.8 THEN 'good' WHEN c >= 0.6 THEN 'fair' ELSE 'poor' END AS quality FROM (SELECT id, original_content AS t, CAST(ocr_confidence AS DOUBLE) AS c FROM {_PAGES})""")
def confidence_quality(spark: SparkSession, d: str) -> DataFrame:
    return pages_once(spark, d, "original_content", "ocr_confidence").select("id", T.confidence_label(F.col("ocr_confidence"), F.col("original_content")).alias("quality"))


@query(r"""SELECT document_id, sum(len(regexp_extract_all(original_content, '[\x{590}-\x{6FF}]'))) / nullif(sum(length(original_content)), 0) > 0.3 AS rtl FROM (
  SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY page_number, id) AS n FROM (SELECT DISTINCT ON (id) * FROM pages)) WHERE n <= 3 AND original_content <> '' GROUP BY document_id""")
def rtl_detection(spark: SparkSession, d: str) -> DataFrame:
    order = Window.partitionBy("document_id").orderBy("page_number", "id")
    rows = pages_once(spark, d, "document_id", "page_number", "original_content").withColumn("n", F.row_number().over(order)).where("n <= 3 and original_content <> ''")
    share = F.sum(F.regexp_count("original_content", F.lit(r"[\x{590}-\x{6FF}]"))) / F.sum(F.length("original_content"))
    return rows.groupBy("document_id").agg((share > 0.3).alias("rtl"))


_HEADER_CASE = "CASE " + " ".join(f"WHEN contains(lower({{x}}), '{h}') THEN '{lang}'" for h, lang in glossary.HEADERS) + " END"


@query(r"""SELECT doc_id, coalesce(""" + _HEADER_CASE.replace("{x}", "text") + r""", CASE WHEN a > (a + l + h) * 0.5 THEN 'ar' WHEN h > (a + l + h) * 0.5 THEN 'he' WHEN l > (a + l + h) * 0.5 THEN 'en' END) AS detected FROM (
  SELECT doc_id, text, len(regexp_extract_all(text, '[\x{600}-\x{6FF}]')) AS a, len(regexp_extract_all(text, '[a-zA-Z]')) AS l, len(regexp_extract_all(text, '[\x{590}-\x{5FF}]')) AS h FROM documents WHERE text IS NOT NULL)""")
def detect_language(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.coalesce(glossary.header_language(F.col("text")), T.script_language(F.col("text"))).alias("detected"))


def _sql_confidence(x: str) -> str:
    signs = [(r"(?m)^[^\n:]+:\s*[^\n]+$", 0.2), (r"(?m)^[^\n\-]+\s*[-–—]\s*[^\n]+$", 0.2), (r"(?m)^\d+[.)]\s*[^\n]+[:–-]\s*[^\n]+", 0.15)]
    counted = "".join(f" + CASE WHEN len(regexp_extract_all({x}, '{p}')) >= 5 THEN {w} ELSE 0.0 END" for p, w in signs)
    header = _HEADER_CASE.replace("{x}", x)
    table = r"\|.*\|.*\|"
    return f"round(least(1.0, CASE WHEN {header} IS NOT NULL THEN 0.5 ELSE 0.0 END + CASE WHEN regexp_matches({x}, '{table}') THEN 0.2 ELSE 0.0 END{counted}), 6)"


@query(f"SELECT doc_id, CAST({_sql_confidence('text')} AS DOUBLE) AS confidence, {_HEADER_CASE.replace('{x}', 'text')} AS lang FROM {_DOCS}")
def glossary_confidence(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", glossary.confidence(F.col("text")).alias("confidence"), glossary.header_language(F.col("text")).alias("lang"))


def _sql_pairs(pattern: str) -> str:
    return rf"""SELECT doc_id, trim(regexp_replace(term, '[\n\t\r]', ' ', 'g')) AS term, trim(definition) AS definition FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{pattern}', 1)) AS term, unnest(regexp_extract_all(text, '{pattern}', 2)) AS definition FROM {_DOCS})
WHERE length(trim(regexp_replace(term, '[\n\t\r]', ' ', 'g'))) BETWEEN 1 AND 149 AND NOT starts_with(trim(regexp_replace(term, '[\n\t\r]', ' ', 'g')), '#')"""


@query(_sql_pairs(glossary.COLON))
def glossary_colon_pairs(spark: SparkSession, d: str) -> DataFrame:
    return glossary.colon_pairs(_docs(spark, d), ["doc_id"], "text").drop("pos")


@query(_sql_pairs(glossary.DASH))
def glossary_dash_pairs(spark: SparkSession, d: str) -> DataFrame:
    return glossary.dash_pairs(_docs(spark, d), ["doc_id"], "text").drop("pos")


#: The tables of the documents have no head; this one makes them tables of terms.
_TABLE_HEAD = "\n\n| Term | Meaning |\n| --- | --- |\n| "
_HEADED = f"(SELECT doc_id, replace(text, chr(10) || chr(10) || '| ', '{_TABLE_HEAD}') AS text FROM documents WHERE text IS NOT NULL)"


def _sql_table(docs: str) -> str:
    """Entries of tables: blocks of rows, of which one below a separator counts once a head row came since the last table that ended."""
    return rf"""(WITH l AS (SELECT doc_id, i, {_sql_strip('x')} AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, unnest(range(len(string_split(text, chr(10))))) AS i FROM {docs})),
c AS (SELECT *, starts_with(line, '|') AND ends_with(line, '|') AS is_row, list_transform(string_split(line, '|')[2:-2], lambda x: {_sql_strip('x')}) AS cells FROM l),
p AS (SELECT *, is_row AND len(cells) > 0 AND len(list_filter(cells, lambda x: NOT regexp_matches(x, '^[-:]+$'))) = 0 AS bar FROM c),
g AS (SELECT *, sum(CASE WHEN is_row THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS block FROM p),
f AS (SELECT *, is_row AND sum(CASE WHEN bar THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, block ORDER BY i) > 0 AS below FROM g),
r AS (SELECT *, sum(CASE WHEN NOT is_row AND before THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS tables FROM (SELECT *, coalesce(lag(below) OVER (PARTITION BY doc_id ORDER BY i), false) AS before FROM f)),
h AS (SELECT *, sum(CASE WHEN is_row AND NOT bar AND NOT below THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, tables ORDER BY i) > 0 AS headed FROM r)
SELECT doc_id, i AS pos, cells[1] AS term, cells[2] AS definition FROM h WHERE is_row AND NOT bar AND below AND headed AND len(cells) >= 2 AND cells[1] <> '' AND cells[2] <> '' AND length(cells[1]) < 200)"""


@query(f"SELECT doc_id, CAST(pos AS INTEGER) AS pos, term, definition FROM {_sql_table(_HEADED)}")
def glossary_table_entries(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d).select("doc_id", F.replace("text", F.lit("\n\n| "), F.lit(_TABLE_HEAD)).alias("text"))
    return glossary.table_pairs(docs, ["doc_id"], "text")


def _sql_placed(pattern: str, docs: str) -> str:
    return rf"""(SELECT doc_id, pos, trim(regexp_replace(term, '[\n\t\r]', ' ', 'g')) AS term, trim(definition) AS definition FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{pattern}', 1)) AS term, unnest(regexp_extract_all(text, '{pattern}', 2)) AS definition, unnest(range(len(regexp_extract_all(text, '{pattern}', 1)))) AS pos FROM {docs})
WHERE length(trim(regexp_replace(term, '[\n\t\r]', ' ', 'g'))) BETWEEN 1 AND 149 AND NOT starts_with(trim(regexp_replace(term, '[\n\t\r]', ' ', 'g')), '#'))"""


_SURE = f"(SELECT * FROM {_DOCS} WHERE {_sql_confidence('text')} >= 0.7)"


@query(f"""WITH e AS (SELECT 0 AS m, * FROM {_sql_table(_SURE)} UNION ALL SELECT 1, * FROM {_sql_placed(glossary.COLON, _SURE)} UNION ALL SELECT 2, * FROM {_sql_placed(glossary.DASH, _SURE)}),
f AS (SELECT * FROM e QUALIFY m = min(m) OVER (PARTITION BY doc_id)),
o AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY doc_id, lower({_sql_strip('term')}) ORDER BY pos) = 1)
SELECT doc_id AS document_id, term, 100 AS frequency, definition AS translation_en, 'From glossary page 1' AS context, true AS approved FROM o""")
def glossary_save(spark: SparkSession, d: str) -> DataFrame:
    """Entries of glossary documents, the first of each term of a document."""
    pages = _docs(spark, d).select(F.col("doc_id").alias("document_id"), F.lit(0).alias("page_number"), F.col("doc_id").alias("id"), F.col("text").alias("original_content"))
    return glossary.saved(pages, "translation_en")


@query("SELECT doc_id, list_max(list_transform(string_split(text, chr(10) || chr(10)), lambda p: length(p))) AS longest FROM documents WHERE text IS NOT NULL")
def chunk_longest_paragraph(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.array_max(F.transform(F.split("text", "\n\n"), lambda p: F.length(p))).cast("long").alias("longest"))


@query(f"""WITH RECURSIVE p AS (SELECT doc_id, text, string_split(text, chr(10) || chr(10)) AS ps FROM {_DOCS}),
s(doc_id, i, open, done) AS (SELECT doc_id, 0, '', NULL::VARCHAR FROM p UNION ALL
  SELECT s.doc_id, i + 1, CASE WHEN length(open) + length(ps[i + 1]) + 2 <= 4000 THEN open ELSE '' END || ps[i + 1] || chr(10) || chr(10),
    CASE WHEN length(open) + length(ps[i + 1]) + 2 > 4000 AND {_sql_strip('open')} <> '' THEN {_sql_strip('open')} END FROM s JOIN p ON p.doc_id = s.doc_id WHERE i < len(ps)),
c AS (SELECT doc_id, i, done AS chunk FROM s WHERE done IS NOT NULL UNION ALL SELECT s.doc_id, i + 1, {_sql_strip('open')} FROM s JOIN p ON p.doc_id = s.doc_id WHERE i = len(ps) AND {_sql_strip('open')} <> ''),
w AS (SELECT * FROM c UNION ALL SELECT doc_id, 0, left(text, 4000) FROM p WHERE doc_id NOT IN (SELECT doc_id FROM c))
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS chunk_no, chunk FROM w""")
def chunk_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.posexplode(terms.chunks(F.col("text"))).alias("chunk_no", "chunk"))


# ---- fixtures that the tables don't have: the same rows in both engines ----
def _values(rows: list[tuple]) -> str:
    quote = lambda x: "NULL" if x is None else str(x) if isinstance(x, (int, float)) else "'" + str(x).replace("'", "''") + "'"
    return "(VALUES " + ", ".join("(" + ", ".join(quote(x) for x in r) + ")" for r in rows) + ")"


_BULLETS = [(1, "• one\n  ●two\n- three"), (2, "text\n    ◦ deep"), (3, "plain"), (4, "▪")]


@query(rf"""SELECT id, string_agg(CASE WHEN regexp_matches(l, '^[ \t]*[•●○▪▫◦].+$') THEN regexp_extract(l, '^([ \t]*)', 1) || '- ' || trim(regexp_extract(l, '^[ \t]*[•●○▪▫◦](.+)$', 1)) ELSE l END, chr(10) ORDER BY i) AS text
FROM (SELECT id, unnest(string_split(t, chr(10))) AS l, unnest(range(len(string_split(t, chr(10))))) AS i FROM {_values(_BULLETS)} v(id, t)) GROUP BY id""")
def normalize_bullets(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame(_BULLETS, "id int, t string").select("id", T.bullets_to_dashes(F.col("t")).alias("text"))


_LINKS = [(1, "see [a](#x) and [b]()"), (2, "[c](http://d)"), (3, "none")]


@query(rf"SELECT id, regexp_replace(t, '\[([^\]]+)\]\((?:#[^)]*|\s*)\)', '\1', 'g') AS text FROM {_values(_LINKS)} v(id, t)")
def sanitize_links(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame(_LINKS, "id int, t string").select("id", T.plain_links(F.col("t")).alias("text"))


_REPLIES = [(1, '```json\n[{"term": "a", "confidence": 0.9}]\n```'), (2, 'Here: [{"term": "b"}] done'), (3, '{"term": "c"}'), (4, "nothing"), (5, '[{"no": 1}, {"term": "d", "category": "x"}]')]
_FENCE = "CASE WHEN starts_with(trim(t), '```') AND len(string_split(trim(t), chr(10))) > 2 THEN array_to_string(string_split(trim(t), chr(10))[2:-2], chr(10)) ELSE trim(t) END"


@query(f"SELECT id, {_FENCE} AS body FROM {_values(_REPLIES)} v(id, t)")
def strip_code_fence(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame(_REPLIES, "id int, t string").select("id", T.without_fence(F.col("t")).alias("body"))


@query(rf"SELECT id, regexp_extract(t, '(?s)\[.*\]', 0) AS block FROM {_values(_REPLIES)} v(id, t)")
def extract_json_block(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame(_REPLIES, "id int, t string").select("id", T.json_block(F.col("t")).alias("block"))


@query("SELECT * FROM (VALUES (1, 'a', 'unknown', 0.9::DOUBLE), (2, 'b', 'unknown', 0.5::DOUBLE), (5, 'd', 'x', 0.5::DOUBLE)) v(id, term, category, confidence)")
def llm_json_parse(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame(_REPLIES, "id int, t string").where("id <> 3").select("id", T.without_fence(F.col("t")).alias("body"))
    return rows.select("id", F.inline(J.reply_terms(F.col("body"), T.json_block(F.col("body"))))).select("id", "term", "category", "confidence")


@query("SELECT DISTINCT CAST(doc_id % 256 * 65536 + n_chars % 65536 AS BIGINT) AS color, '#' || lower(lpad(to_hex(CAST(doc_id % 256 * 65536 + n_chars % 65536 AS BIGINT)), 6, '0')) AS hex FROM documents")
def color_hex(spark: SparkSession, d: str) -> DataFrame:
    color = F.col("doc_id") % 256 * 65536 + F.col("n_chars") % 65536
    return read(spark, d, "documents").select(color.alias("color"), T.color_hex(color).alias("hex")).distinct()


_FONTS = [(1, "Arial", "ar"), (2, "Georgia", "ar"), (3, None, "he"), (4, "My Mono", "en"), (5, "PT sans-serif", "zh"), (6, "Arial", "th"), (7, "David", "he")]


@query(f"SELECT v.id, x.font FROM {_values(_FONTS)} v(id, f, l) JOIN (VALUES (1, 'Arial'), (2, 'Traditional Arabic'), (3, 'Tahoma'), (4, 'Courier New'), (5, 'SimSun'), (6, 'Arial'), (7, 'David')) x(id, font) ON x.id = v.id")
def font_fallback(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame(_FONTS, "id int, f string, l string").select("id", styles.fallback_font(F.col("f"), F.col("l")).alias("font"))


@query("SELECT DISTINCT coalesce(a.lang, '?') AS source, t AS target, coalesce(a.lang IN ('ar', 'he', 'fa', 'ur', 'yi', 'ps', 'sd'), false) AND t <> 'ar' AS reverse FROM documents a, (SELECT unnest(['ar', 'en', 'fr']) AS t)")
def direction_change(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "documents").select(F.coalesce("lang", F.lit("?")).alias("source"), F.explode(F.array(F.lit("ar"), F.lit("en"), F.lit("fr"))).alias("target")).distinct()
    return rows.select("source", "target", T.direction_changes(F.col("source"), F.col("target")).alias("reverse"))


@query(f"SELECT doc_id FROM {_SPANS} WHERE size > 13 OR (color LIKE 's%' AND weight < 200)")
def heading_candidates(spark: SparkSession, d: str) -> DataFrame:
    return _spans(spark, d).where(styles.is_heading(F.col("size") + 1, F.startswith("color", F.lit("s")), F.col("weight"))).select("doc_id")


_LABEL = "CASE WHEN score >= 0.85 THEN 'excellent' WHEN score >= 0.7 THEN 'good' WHEN score >= 0.5 THEN 'fair' ELSE 'poor' END"


@query(f"""SELECT id, CASE WHEN a IN ('excellent', 'good') THEN 'native' WHEN b = 'poor' AND c <> 'poor' THEN 'fallback' ELSE 'primary' END AS source,
CASE WHEN a IN ('excellent', 'good') THEN a WHEN b = 'poor' AND c <> 'poor' THEN c ELSE b END AS quality FROM (
  SELECT p.id, CASE WHEN ocr_model = 'native-text' THEN n.label END AS a, coalesce(CASE WHEN ocr_confidence IS NULL THEN 'poor' WHEN ocr_confidence::DOUBLE >= 0.95 THEN 'excellent' WHEN ocr_confidence::DOUBLE >= 0.8 THEN 'good' WHEN ocr_confidence::DOUBLE >= 0.6 THEN 'fair' END, 'poor') AS b, coalesce(n.label, 'poor') AS c
  FROM {_PAGES} p LEFT JOIN (SELECT id, {_LABEL} AS label FROM {_QUALITY}) n ON n.id = p.id)""")
def ocr_cascade_best(spark: SparkSession, d: str) -> DataFrame:
    """Which of three attempts at a page is taken; the page's text stands for what the second recognition reads."""
    pages = pages_once(spark, d, "original_content", "ocr_confidence", "ocr_model")
    label = T.quality_label(T.quality_score(F.col("original_content")))
    native = F.when(F.col("ocr_model") == "native-text", F.when(F.col("original_content").isNotNull(), label))
    primary = F.when(F.col("ocr_confidence").isNotNull(), T.confidence_label(F.col("ocr_confidence"), F.lit("")))
    rows = pages.select("id", native.alias("a"), primary.alias("b"), F.when(F.col("original_content").isNotNull(), label).alias("c"))
    return rows.select("id", T.recognition_choice(F.col("a"), F.col("b"), F.col("c")).alias("t")).select("id", "t.source", "t.quality")


@query(f"""WITH b AS (SELECT document_id, page_number, {_ENDING_SQL} AS ending FROM {_TRANSLATED}), u AS ({_SUMMARY_SQL.replace('md5', '')}),
src AS (SELECT document_id, page_number, min(original_content) AS source FROM pages WHERE original_content IS NOT NULL GROUP BY document_id, page_number),
g AS (SELECT document_id, string_agg('  - ' || term || ' → ' || translation_en, chr(10) ORDER BY n) AS terms FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY coalesce(approved, false) DESC, frequency DESC NULLS LAST, term) AS n FROM terminology WHERE coalesce(translation_en, '') <> '') WHERE n <= 30 GROUP BY document_id)
SELECT src.document_id, src.page_number, concat_ws(chr(10), 'Render this Arabic page in English.', 'Leave the markdown as it stands. A technical term that isn''t in the list of terms stays as it is.', chr(10) || '# About the page',
  'Document: ' || c.file_name, 'Page ' || (src.page_number + 1) || ' of ' || coalesce(c.total_pages, 0), chr(10) || 'What came before:' || chr(10) || u.summary, chr(10) || 'The page before ends with:' || chr(10) || '...' || b.ending,
  chr(10) || 'Terms and how to render them:' || chr(10) || g.terms, chr(10) || '# Text' || chr(10) || src.source, chr(10) || '# The text in English, and nothing else:') AS prompt
FROM src JOIN b ON b.document_id = src.document_id AND b.page_number = src.page_number JOIN u ON u.document_id = src.document_id AND u.page_number = src.page_number JOIN doc_catalog c ON c.id = src.document_id LEFT JOIN g ON g.document_id = src.document_id""")
def build_prompt(spark: SparkSession, d: str) -> DataFrame:
    pages = _translated(spark, d)
    before = context.previous_context(pages)
    source = read(spark, d, "pages").where("original_content is not null").groupBy("document_id", "page_number").agg(F.min("original_content").alias("source"))
    order = Window.partitionBy("document_id").orderBy(F.desc(F.coalesce("approved", F.lit(False))), F.desc_nulls_last("frequency"), "term")
    terms_of = read(spark, d, "terminology").where(F.coalesce("translation_en", F.lit("")) != "").withColumn("n", F.row_number().over(order)).where("n <= 30")
    entries = terms_of.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("n", "term", F.col("translation_en").alias("translation")))).alias("g"))
    docs = read(spark, d, "doc_catalog").select(F.col("id").alias("document_id"), "file_name", F.coalesce("total_pages", F.lit(0)).alias("total_pages"))
    rows = source.join(before, ["document_id", "page_number"]).join(docs, "document_id").join(entries, "document_id", "left")
    text = context.prompt(F.col("file_name"), F.col("page_number"), F.col("total_pages"), F.col("previous_summary"), F.col("previous_ending"), F.col("g"), F.col("source"), "Arabic", "English")
    return rows.select("document_id", "page_number", text.alias("prompt"))


# ================================ tables and markdown ================================
_HTML = [(1, "<table><thead><tr><th>A</th><th>B</th></tr></thead><tbody><tr><td>1</td><td>2</td></tr></tbody></table>"), (2, "<TABLE><tr><th>x</th></tr><tr><td><b>y</b></td></tr></TABLE>"), (3, "<table><tr><td>p</td><td>q</td></tr><tr><td>r</td></tr></table>"), (4, "no table"), (5, "<table><tr><th>a|b</th></tr><tr><td>c</td></tr></table>")]


@query("SELECT * FROM (VALUES (1, '| A | B |' || chr(10) || '| --- | --- |' || chr(10) || '| 1 | 2 |'), (2, '| x |' || chr(10) || '| --- |' || chr(10) || '| y |'), (3, '| p | q |' || chr(10) || '| --- | --- |' || chr(10) || '| r |  |'), (4, NULL), (5, '| a\\|b |' || chr(10) || '| --- |' || chr(10) || '| c |')) v(id, markdown)")
def table_to_markdown(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame(_HTML, "id int, html string").select("id", tables.table_rows(F.col("html")).alias("t"))
    return rows.select("id", tables.as_markdown(F.col("t.headers"), F.col("t.rows")).alias("markdown"))


_CELLS = "list_filter(string_split(line, '|'), lambda x: trim(x) <> '')"


@query(rf"SELECT doc_id, array_to_string(list_reverse({_CELLS}), '|') AS reversed FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM {_DOCS}) WHERE starts_with(line, '|')")
def table_reverse_columns(spark: SparkSession, d: str) -> DataFrame:
    lines = _docs(spark, d).select("doc_id", F.explode(F.split("text", "\n")).alias("line")).where(F.startswith("line", F.lit("|")))
    cells = F.filter(F.split("line", r"\|"), lambda x: F.trim(x) != "")
    return lines.select("doc_id", F.array_join(tables.reversed_columns(cells), "|").alias("reversed"))


@query(rf"SELECT doc_id, array_to_string(list_concat({_CELLS}, list_transform(range(greatest(4 - len({_CELLS}), 0)), lambda i: '')), '|') AS padded FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM {_DOCS}) WHERE starts_with(line, '|')")
def table_pad_rows(spark: SparkSession, d: str) -> DataFrame:
    lines = _docs(spark, d).select("doc_id", F.explode(F.split("text", "\n")).alias("line")).where(F.startswith("line", F.lit("|")))
    cells = F.filter(F.split("line", r"\|"), lambda x: F.trim(x) != "")
    return lines.select("doc_id", F.array_join(tables.padded(cells, F.lit(4)), "|").alias("padded"))


@query(rf"""SELECT doc_id, md5(string_agg(CASE WHEN regexp_matches(s, '^\|.*\|$') AND length(s) > 1 THEN '|' || array_to_string(list_reverse(string_split(s, '|')[2:-2]), '|') || '|' ELSE l END, chr(10) ORDER BY i)) AS text
FROM (SELECT *, {_sql_strip('l')} AS s FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, unnest(range(len(string_split(text, chr(10))))) AS i FROM {_DOCS})) GROUP BY doc_id""")
def reverse_md_tables(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.md5(T.reversed_table_rows(F.col("text"))).alias("text"))


_EN = f"(SELECT p.document_id, c.file_name, p.page_number, p.en_content FROM (SELECT DISTINCT document_id, page_number, en_content FROM {_PAGES} WHERE coalesce(en_content, '') <> '') p JOIN doc_catalog c ON c.id = p.document_id)"


def _english(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "doc_catalog").select(F.col("id").alias("document_id"), "file_name")
    return pages_once(spark, d, "document_id", "page_number", "en_content").where(F.coalesce("en_content", F.lit("")) != "").drop("id").join(docs, "document_id")


@query(f"""SELECT document_id, md5('# ' || file_name || chr(10) || chr(10) || '**Source:** ' || file_name || chr(10) || '**Language:** EN' || chr(10) || '**Total Pages:** ' || count(*) || chr(10) || chr(10) || '---' || chr(10) || chr(10)
|| string_agg('## Page ' || (page_number + 1) || chr(10) || chr(10) || en_content || chr(10) || chr(10) || '---' || chr(10), chr(10) ORDER BY page_number, en_content)) AS body FROM {_EN} GROUP BY document_id, file_name""")
def markdown_combined(spark: SparkSession, d: str) -> DataFrame:
    page = F.concat(F.lit("## Page "), F.col("page_number") + 1, F.lit("\n\n"), "en_content", F.lit("\n\n---\n"))
    parts = F.array_sort(F.collect_list(F.struct("page_number", "en_content", page.alias("md"))))
    rows = _english(spark, d).groupBy("document_id", "file_name").agg(parts.alias("p"))
    head = F.concat(F.lit("# "), "file_name", F.lit("\n\n**Source:** "), "file_name", F.lit("\n**Language:** EN\n**Total Pages:** "), F.size("p"), F.lit("\n\n---\n\n"))
    return rows.select("document_id", F.md5(F.concat(head, F.array_join(F.transform("p", lambda x: x["md"]), "\n"))).alias("body"))


@query(f"SELECT document_id, md5(string_agg(en_content || chr(10), chr(10) ORDER BY page_number, en_content)) AS body FROM {_EN} GROUP BY document_id")
def markdown_clean(spark: SparkSession, d: str) -> DataFrame:
    rows = _english(spark, d).groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("page_number", "en_content"))).alias("p"))
    return rows.select("document_id", F.md5(F.array_join(F.transform("p", lambda x: F.concat(x["en_content"], F.lit("\n"))), "\n")).alias("body"))


@query(f"SELECT DISTINCT document_id, printf('page_%03d_en.md', page_number + 1) AS file_name FROM {_EN}")
def page_filenames(spark: SparkSession, d: str) -> DataFrame:
    return _english(spark, d).select("document_id", F.format_string("page_%03d_en.md", F.col("page_number") + 1).alias("file_name")).distinct()


# ================================ JSON and maps ================================
@query("SELECT id, file_name, coalesce(total_pages, 0) AS total_pages FROM doc_catalog")
def json_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    packed = read(spark, d, "doc_catalog").select("id", F.to_json(F.struct("file_name", F.coalesce("total_pages", F.lit(0)).alias("total_pages"))).alias("j"))
    return packed.select("id", J.value(F.col("j"), "$.file_name").alias("file_name"), J.value(F.col("j"), "$.total_pages").cast("int").alias("total_pages"))


@query("SELECT id, json_extract_string(styling_metadata, '$.body_font') AS font, coalesce(json_extract_string(styling_metadata, '$.is_rtl'), 'false') AS rtl FROM doc_catalog")
def json_extract(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "doc_catalog").select("id", J.value(F.col("styling_metadata"), "$.body_font").alias("font"), J.value(F.col("styling_metadata"), "$.is_rtl", "false").alias("rtl"))


@query("""SELECT id, 'false' AS awaiting, json_extract_string(metadata, '$.mode') AS mode, stage, CASE WHEN metadata IS NULL THEN 2 ELSE len(list_distinct(list_concat(json_keys(metadata), ['awaiting_review', 'stage']))) END AS entries
FROM (SELECT DISTINCT ON (id) * FROM processing_state)""")
def json_merge(spark: SparkSession, d: str) -> DataFrame:
    """Added entries win over stored ones (awaiting_review), the others stay (mode)."""
    rows = read(spark, d, "processing_state").select("id", "metadata", "stage").dropDuplicates(["id"])
    m = J.merged(F.col("metadata"), F.create_map(F.lit("awaiting_review"), F.lit("false"), F.lit("stage"), F.col("stage")))
    return rows.select("id", m["awaiting_review"].alias("awaiting"), m["mode"].alias("mode"), m["stage"].alias("stage"), F.size(m).cast("long").alias("entries"))


@query("""SELECT id, left(coalesce(json_extract_string(v, '$.content'), json_extract_string(v, '$.text'), json_extract_string(v, '$.summary'), left(v, 1000)), 60) AS text FROM (SELECT id, CASE id % 4 WHEN 0 THEN '{"content": "c' || id || '", "text": "t"}' WHEN 1 THEN '{"text": "t' || id || '"}' WHEN 2 THEN '{"summary": "s"}' ELSE '{"other": 1}' END AS v FROM doc_catalog)""")
def value_to_text(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("id")
    v = F.when(i % 4 == 0, F.concat(F.lit('{"content": "c'), i, F.lit('", "text": "t"}'))).when(i % 4 == 1, F.concat(F.lit('{"text": "t'), i, F.lit('"}'))).when(i % 4 == 2, F.lit('{"summary": "s"}')).otherwise(F.lit('{"other": 1}'))
    return read(spark, d, "doc_catalog").select("id", F.left(memory.text_of(v), F.lit(60)).alias("text"))


@query("SELECT document_id, term, translation FROM (SELECT document_id, term, max_by(translation_en, id) AS translation FROM terminology WHERE coalesce(translation_en, '') <> '' GROUP BY document_id, term)")
def term_glossary(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "terminology").where(F.coalesce("translation_en", F.lit("")) != "")
    once = rows.groupBy("document_id", "term").agg(F.max_by("translation_en", "id").alias("translation"))
    return once


@query(f"SELECT CAST(k.pos AS INTEGER) AS pos, k.key AS key, m.value AS value FROM (SELECT unnest(range(4)) AS pos, unnest(['page_2', 'page_0', 'page_999', 'page_1']) AS key) k LEFT JOIN {_LATEST_MEMORY} m ON m.namespace = 'documents/1/pages' AND m.key = k.key")
def kv_mget(spark: SparkSession, d: str) -> DataFrame:
    return memory.mget(_memory(spark, d), spark, "documents/1/pages", ["page_2", "page_0", "page_999", "page_1"])


# ================================ vectors and search ================================
#: The query vector of these queries: unit steps, so that no row is needed to make it.
_Q = [((i * 37) % 64 - 31.5) / 32 for i in range(64)]
_QSQL = "[" + ", ".join(repr(x) for x in _Q) + "]"
_SEM = f"(SELECT id, {_sql_cos('embedding', _QSQL)} AS similarity FROM terminology WHERE len(embedding) = 64 AND list_sum(list_transform(embedding, lambda x: x * x)) > 0)"


@query(f"SELECT CAST(id AS BIGINT) AS id, round(similarity, 6) AS similarity FROM {_SEM} ORDER BY similarity DESC, id LIMIT 20")
def semantic_topk(spark: SparkSession, d: str) -> DataFrame:
    return search.top(search.semantic(read(spark, d, "terminology"), "id", "embedding", _Q), "similarity", 20).select(big("id"), F.round("similarity", 6).alias("similarity"))


@query(f"SELECT CAST(id AS BIGINT) AS id, round({_sql_cos('embedding', _QSQL)}, 6) AS similarity FROM terminology WHERE document_id = 1 AND len(embedding) = 64 AND list_sum(list_transform(embedding, lambda x: x * x)) > 0 ORDER BY {_sql_cos('embedding', _QSQL)} DESC, id LIMIT 10")
def memory_semantic_search(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "terminology").select(F.concat(F.lit("documents/"), "document_id").alias("namespace"), F.col("id").cast("long").alias("key"), "embedding")
    return memory.nearest(rows, "documents/1", _Q, 10).select(F.col("key").alias("id"), F.round("similarity", 6).alias("similarity"))


@query(f"SELECT CAST(id AS BIGINT) AS id, round(similarity, 6) AS similarity FROM (SELECT * FROM {_SEM} ORDER BY similarity DESC, id LIMIT 10) WHERE similarity >= 0.3")
def similar_terms_threshold(spark: SparkSession, d: str) -> DataFrame:
    return search.similar(read(spark, d, "terminology"), "id", "embedding", _Q, 10, 0.3).select(big("id"), F.round("similarity", 6).alias("similarity"))


@query(f"SELECT translation, similarity FROM (SELECT t.translation_en AS translation, round(max(s.similarity), 6) AS similarity FROM (SELECT * FROM {_SEM} ORDER BY similarity DESC, id LIMIT 20) s JOIN terminology t ON t.id = s.id WHERE s.similarity >= 0.2 AND t.approved AND coalesce(t.translation_en, '') <> '' GROUP BY 1) ORDER BY similarity DESC, translation LIMIT 5")
def suggest_translations(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "terminology")
    near = search.similar(rows, "id", "embedding", _Q, 20, 0.2)
    return search.suggestions(near, rows, "id", "translation_en", F.col("approved")).select("translation", F.round("similarity", 6).alias("similarity"))


@query("SELECT id, round(list_sum(list_transform(u, lambda x: x * x)), 6) AS length, round(u[1], 6) AS first, round(u[-1], 6) AS last, round(list_sum(u), 5) AS total FROM (SELECT id, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda y: y * y)))) AS u FROM terminology WHERE embedding IS NOT NULL AND list_sum(list_transform(embedding::DOUBLE[], lambda y: y * y)) > 0)")
def l2_normalize(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "terminology").where("embedding is not null").select("id", V.unit(F.col("embedding")).alias("u")).where("u is not null")
    return rows.select("id", F.round(V.dot(F.col("u"), F.col("u")), 6).alias("length"), F.round(F.get("u", 0), 6).alias("first"), F.round(F.element_at("u", -1), 6).alias("last"), F.round(F.aggregate("u", F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


_BM25 = rf"""(WITH tok AS (SELECT id, list_concat(regexp_extract_all(lower(coalesce(term, '')), '{_WORD}'), regexp_extract_all(lower(coalesce(context, '')), '{_WORD}')) AS ws FROM terminology),
n AS (SELECT count(*) AS n, avg(len(ws)) AS avgdl FROM tok), q AS (SELECT DISTINCT unnest(['tide', 'audit', 'المد']) AS w),
tf AS (SELECT t.id, len(t.ws) AS dl, q.w, len(list_filter(t.ws, lambda x: x = q.w)) AS tf FROM tok t, q WHERE list_contains(t.ws, q.w)), df AS (SELECT w, count(*) AS df FROM tf GROUP BY w)
SELECT tf.id, sum(log10((n.n - df.df + 0.5) / (df.df + 0.5) + 1) * tf.tf * 2.2 / (tf.tf + 1.2 * (0.25 + 0.75 * tf.dl / n.avgdl))) AS score FROM tf JOIN df ON df.w = tf.w, n GROUP BY tf.id)"""


@query(f"SELECT CAST(id AS BIGINT) AS id, round(score, 6) AS score FROM {_BM25} ORDER BY round(score, 9) DESC, id LIMIT 20")
def bm25_search(spark: SparkSession, d: str) -> DataFrame:
    scores = search.bm25(read(spark, d, "terminology"), "id", ["term", "context"], "tide audit المد").withColumn("score", F.round("score", 9))
    return search.top(scores, "score", 20).select(big("id"), F.round("score", 6).alias("score"))


@query(f"""WITH f AS (SELECT id, round(score, 9) AS score FROM {_BM25} ORDER BY 2 DESC, id LIMIT 40), s AS (SELECT id, similarity FROM {_SEM} ORDER BY similarity DESC, id LIMIT 40)
SELECT CAST(id AS BIGINT) AS id, round(c, 6) AS combined_score FROM (SELECT coalesce(f.id, s.id) AS id, 0.5 * coalesce(f.score, 0) / (SELECT max(score) FROM f) + 0.5 * greatest(coalesce(s.similarity, 0), 0) / (SELECT max(similarity) FROM s) AS c FROM f FULL JOIN s ON f.id = s.id) ORDER BY c DESC, id LIMIT 20""")
def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "terminology")
    scores = search.bm25(rows, "id", ["term", "context"], "tide audit المد").withColumn("score", F.round("score", 9))
    both = search.hybrid(scores, search.semantic(rows, "id", "embedding", _Q))
    return both.select(big("id"), F.round("combined_score", 6).alias("combined_score"))


_CLUSTERS = f"""(WITH RECURSIVE pr AS ({ORACLE_SQL["pairwise_similarity"]}), m AS (SELECT scope, id, row_number() OVER (PARTITION BY scope ORDER BY id) AS k FROM (SELECT scope, id_a AS id FROM pr UNION SELECT scope, id_b FROM pr)),
w AS (SELECT m.scope, m.k, m.id, coalesce(n.before, []) AS before FROM m LEFT JOIN (SELECT scope, id_b AS id, list(id_a) AS before FROM pr GROUP BY scope, id_b) n ON n.scope = m.scope AND n.id = m.id),
s(scope, k, id, seed, seeds) AS (SELECT scope, k, id, id, [id] FROM w WHERE k = 1 UNION ALL
  SELECT scope, k, id, coalesce(taken, id), CASE WHEN taken IS NULL THEN list_append(seeds, id) ELSE seeds END FROM (SELECT w.scope, w.k, w.id, s.seeds, list_min(list_filter(w.before, lambda y: list_contains(s.seeds, y))) AS taken FROM s JOIN w ON w.scope = s.scope AND w.k = s.k + 1))
SELECT t.document_id AS scope, CAST(t.id AS BIGINT) AS id, coalesce(s.seed, CAST(t.id AS BIGINT)) AS seed FROM (SELECT DISTINCT document_id, id FROM terminology WHERE len(embedding) = 64) t LEFT JOIN s ON s.scope = t.document_id AND s.id = t.id)"""


def _clusters(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "terminology").where(F.size("embedding") == 64)
    return clusters.greedy_clusters(rows, "id", "document_id", "embedding", 0.8)


@query(f"SELECT * FROM {_CLUSTERS}")
def cluster_terms(spark: SparkSession, d: str) -> DataFrame:
    return _clusters(spark, d)


@query(f"SELECT scope, seed, size, CAST(row_number() OVER (PARTITION BY scope ORDER BY size DESC, seed) AS INTEGER) AS rank FROM (SELECT scope, seed, count(*) AS size FROM {_CLUSTERS} GROUP BY scope, seed) WHERE size > 1")
def clusters_by_size(spark: SparkSession, d: str) -> DataFrame:
    return clusters.by_size(_clusters(spark, d))


_TABLE_NAMES = ["doc_catalog", "pages", "processing_log", "processing_state", "terminology"]


@query(f"SELECT table_name, column_name, CAST(ordinal_position AS INTEGER) AS position FROM information_schema.columns WHERE table_name IN ({', '.join(repr(n) for n in _TABLE_NAMES)})")
def table_columns(spark: SparkSession, d: str) -> DataFrame:
    """The columns of the tables, from their schemas."""
    rows = [(name, column, i) for name in _TABLE_NAMES for i, column in enumerate(read(spark, d, name).columns, start=1)]
    return spark.createDataFrame(rows, "table_name string, column_name string, position int")


@query(f"""SELECT CAST(id AS BIGINT) AS id, term, translation_en AS translation FROM terminology t JOIN (SELECT id AS i, round(score, 9) AS score FROM {_BM25} ORDER BY 2 DESC, id LIMIT 10) f ON f.i = t.id""")
def search_tool(spark: SparkSession, d: str) -> DataFrame:
    """The search by words as a tool gives it."""
    found = tools.SearchTools(read(spark, d, "terminology")).search_terms("tide audit المد", "words", 10)
    return found.select(big("id"), "term", "translation")
