"""The stages of a document collection, from files to exported translations.

Each stage reads tables of a store, works on what isn't done yet - found by
anti-joins, never by memory - and makes a new version; so a run that was broken
off continues, and a run after a finished one changes nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..operators import context, glossary, terms, upserts
from ..schemas import TABLES, language_column
from ..sources import files, sinks
from ..store import Store, cut_lineage
from .providers import EchoModel, HashEmbedder, TextModel, answers, answers_in_order, embeddings

#: From which confidence a page is one of a glossary, and how many terms are translated at once.
GLOSSARY_CONFIDENCE, TERM_BATCH = 0.7, 50


@dataclass(frozen=True)
class Settings:
    """What a run does; values can come from a YAML file with ``${NAME}`` for environment variables."""

    input_dir: str = "."
    output_dir: str = "./out"
    source_lang: str = "ar"
    target_lang: str = "en"
    min_frequency: int = 3
    max_terms: int = 200
    formats: tuple[str, ...] = ("md",)
    clean: bool = False
    review: bool = False
    run_id: str = field(default_factory=lambda: uuid.uuid4().hex)

    @staticmethod
    def from_yaml(path: str) -> "Settings":
        import os
        import re

        import yaml

        with open(path, encoding="utf-8") as f:
            text = re.sub(r"\$\{(\w+)\}", lambda m: os.environ.get(m[1], ""), f.read())
        raw = yaml.safe_load(text) or {}
        known = {k: tuple(v) if isinstance(v, list) else v for k, v in raw.items() if k in Settings.__dataclass_fields__}
        return Settings(**known)


class Pipeline:
    """Stages over one store."""

    def __init__(self, spark: SparkSession, store: Store, settings: Settings, model: Callable[[], TextModel] = EchoModel, progress: Callable[[str, int], None] | None = None, readers: dict[str, Callable[[], files.PageReader]] | None = None, fallback: Callable[[], TextModel] | None = None) -> None:
        language_column("content", settings.target_lang)
        if unknown := [k for k in settings.formats if k not in sinks.WRITERS]:
            raise ValueError(f"no writer for files of the kinds {unknown}")
        self.readers, self.fallback = readers, fallback
        self.spark, self.store, self.settings, self.model, self.progress = spark, store, settings, model, progress

    def _table(self, name: str) -> DataFrame:
        return self.store.read(name, TABLES[name])

    def _log(self, stage: str, results: DataFrame, status: str | None = None) -> None:
        """What a stage did: a row of state and of log for each document.

        ``results`` have ``document_id``, ``n`` items of which ``failed`` failed, and an ``error`` of one
        of them; a document with a failure failed.  ``status`` is what the catalog says
        from now on of those that didn't.
        """
        now = F.current_timestamp().cast("timestamp_ntz")
        failed = F.col("failed") > 0
        done = results.select(F.col("document_id").cast("int").alias("document_id"), F.lit(self.settings.run_id).alias("run_id"), F.lit(stage).alias("stage"), "n", "failed", "error").withColumn("status", F.when(failed, "failed").otherwise("completed"))
        done = cut_lineage(done)  # a row a document
        whole = lambda rows, name: rows.select(*(F.col(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in TABLES[name]))
        states = done.select("run_id", "document_id", "stage", "status", F.col("n").cast("int").alias("items_total"), (F.col("n") - F.col("failed")).cast("int").alias("items_completed"), F.col("error").alias("error_message"), now.alias("updated_at"))
        self.store.append("processing_state", whole(states, "processing_state"))
        message = F.when(failed, F.concat("failed", F.lit(" of "), "n", F.lit(" failed: "), F.coalesce("error", F.lit("")))).otherwise(F.concat(F.lit("done: "), F.col("n")))
        last = self._table("processing_log").agg(F.coalesce(F.max("id"), F.lit(-1))).first()[0]
        lines = files.with_ids(done.withColumn("k", F.col("document_id")), last, "k").select("id", "run_id", "document_id", "stage", F.when(failed, "ERROR").otherwise("INFO").alias("level"), message.alias("message"), now.alias("created_at"))
        self.store.append("processing_log", whole(lines, "processing_log"))
        catalog = self._table("doc_catalog")
        told = done.select(F.col("document_id").alias("id"), F.when(failed, "failed").otherwise(F.lit(status)).alias("__status")).where("__status is not null")
        marked = catalog.join(told, "id", "left")
        changed = F.col("__status").isNotNull() & ~F.col("status").eqNullSafe(F.col("__status"))
        marked = marked.withColumn("updated_at", F.when(changed, now).otherwise(F.col("updated_at"))).withColumn("status", F.coalesce("__status", "status"))
        self.store.replace("doc_catalog", marked.select(*catalog.columns))
        if self.progress:
            self.progress(stage, done.count())

    def scan(self) -> None:
        """Files that aren't catalogued yet."""
        catalog = self._table("doc_catalog")
        new = files.new_files(files.scan(self.spark, self.settings.input_dir), catalog)
        last = catalog.agg(F.coalesce(F.max("id"), F.lit(-1))).first()[0]
        now = F.current_timestamp().cast("timestamp_ntz")
        rows = files.with_ids(new, last).select("id", "file_name", "full_path", "relative_path", "file_type", F.lit(1).alias("total_pages"), F.lit("pending").alias("status"), F.lit(None).cast("string").alias("styling_metadata"), now.alias("created_at"), now.alias("updated_at"))
        self.store.replace("doc_catalog", catalog.unionByName(rows))

    def extract(self) -> None:
        """Pages of catalogued documents that have none."""
        pages, catalog = self._table("pages"), self._table("doc_catalog")
        todo = catalog.join(pages.select(F.col("document_id").alias("id")), "id", "left_anti").select(F.col("id").alias("document_id"), "full_path")
        read = files.read_pages(self.spark, self.settings.input_dir, readers=self.readers).join(todo, "full_path")
        read = cut_lineage(read)  # a reader's work is done once
        last = pages.agg(F.coalesce(F.max("id"), F.lit(-1))).first()[0]
        keyed = read.where("error is null").withColumn("k", F.concat_ws("\u0000", "full_path", F.format_string("%09d", "page_number")))
        rows = files.with_ids(keyed, last, "k").select("id", "document_id", "page_number", F.col("content").alias("original_content"), F.col("confidence").cast("float").alias("ocr_confidence"), "ocr_model", F.current_timestamp().cast("timestamp_ntz").alias("created_at"))
        for f in TABLES["pages"]:
            if f.name not in rows.columns:
                rows = rows.withColumn(f.name, F.lit(None).cast(f.dataType))
        self.store.replace("pages", pages.unionByName(rows))
        counts = read.groupBy("document_id").agg(F.count_if(F.col("error").isNull()).cast("int").alias("__n"))
        numbered = catalog.join(counts.withColumnRenamed("document_id", "id"), "id", "left").withColumn("total_pages", F.coalesce("__n", "total_pages"))
        self.store.replace("doc_catalog", numbered.select(*catalog.columns))
        self._log("ocr", _results(read), "in_progress")

    def terminology(self) -> None:
        """Terms of documents that have none, from their glossary pages and by frequency, with vectors and translations."""
        known, pages, column = self._table("terminology"), self._table("pages"), language_column("translation", self.settings.target_lang)
        todo = pages.join(known.select("document_id").distinct(), "document_id", "left_anti").where(~T.is_blank(F.col("original_content")))
        docs = terms.concat_pages(todo, "document_id", "page_number", "original_content")
        found = terms.extract_terms(docs, "document_id", "text", self.settings.min_frequency, self.settings.max_terms).select("document_id", "term", F.col("frequency").cast("int").alias("frequency"))
        # a glossary's own entries come first and are approved; a term that is among them isn't taken again
        listed = glossary.saved(todo, column, GLOSSARY_CONFIDENCE)
        name = F.lower(T.strip(F.col("term"))).alias("name")
        others = found.withColumn("name", name).join(listed.select("document_id", name), ["document_id", "name"], "left_anti").drop("name")
        both = listed.unionByName(others.withColumn("approved", F.lit(not self.settings.review)), allowMissingColumns=True)
        last = known.agg(F.coalesce(F.max("id"), F.lit(-1))).first()[0]
        keyed = both.withColumn("k", F.concat_ws("\u0000", "document_id", "term"))
        rows = files.with_ids(keyed, last, "k").select("id", *both.columns)
        vectors = embeddings(rows, "id", "term", HashEmbedder).select(F.col("key").cast("int").alias("id"), "embedding")
        rows = rows.join(vectors, "id", "left")
        for f in TABLES["terminology"]:
            if f.name not in rows.columns:
                rows = rows.withColumn(f.name, F.lit(None).cast(f.dataType))
        self.store.replace("terminology", known.unionByName(rows.select(*known.columns)))
        self._log("terminology_extract", docs.select("document_id", F.lit(1).alias("n"), F.lit(0).alias("failed"), F.lit(None).cast("string").alias("error")))
        self._translate_terms()

    def _translate_terms(self) -> None:
        """Translations of terms that have none, asked in batches of a document; a batch that fails is asked again by the next run."""
        column = language_column("translation", self.settings.target_lang)
        known = self._table("terminology")
        rows = known.where(T.is_blank(F.coalesce(column, F.lit(""))))
        place = F.row_number().over(Window.partitionBy("document_id").orderBy("id")) - 1
        asked = rows.select("id", "document_id", "term", "context").withColumn("batch", F.floor(place / TERM_BATCH))
        line = F.concat(F.lit('- Term: "'), F.col("term"), F.lit('"'), F.coalesce(F.concat(F.lit('\n  Context: "'), F.col("context"), F.lit('"')), F.lit("")))
        lists = asked.groupBy("document_id", "batch").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", line.alias("line")))), lambda x: x["line"]), "\n").alias("terms"))
        key = F.concat_ws(":", "document_id", "batch")
        prompts = lists.select(key.alias("key"), context.terms_prompt(F.col("terms"), self.settings.target_lang).alias("prompt"))
        replies = cut_lineage(answers(prompts, "key", "prompt", self.model, self.fallback, batch=1))
        told = replies.where("error is null").select("key", F.explode(F.from_json(F.regexp_extract("reply", r"(?s)\{.*\}", 0), "map<string,string>")).alias("term", "__new"))
        told = asked.select("id", "term", key.alias("key")).join(told, ["key", "term"]).where(~T.is_blank(F.col("__new"))).select("id", "__new")
        changed = known.join(told, "id", "left").withColumn(column, F.coalesce("__new", column))
        self.store.replace("terminology", changed.select(*known.columns))
        self._log("terminology_translate", _results(replies.withColumn("document_id", F.split_part("key", F.lit(":"), F.lit(1)).cast("int"))))

    def _term_lists(self) -> DataFrame:
        """``document_id`` and ``glossary``: its translated terms for a prompt, approved and frequent ones first."""
        column = language_column("translation", self.settings.target_lang)
        order = Window.partitionBy("document_id").orderBy(F.desc(F.coalesce("approved", F.lit(False))), F.desc_nulls_last("frequency"), "term", "id")
        rows = self._table("terminology").where(~T.is_blank(F.coalesce(column, F.lit("")))).withColumn("n", F.row_number().over(order)).where("n <= 30")
        listed = F.array_sort(F.collect_list(F.struct("n", "term", F.col(column).alias("translation"))))
        return rows.groupBy("document_id").agg(F.transform(listed, lambda x: F.struct(x["term"].alias("term"), x["translation"].alias("translation"))).alias("glossary"))

    def translate(self) -> None:
        """Pages without a translation.  Documents run in parallel, the pages of one in order; a page's prompt has the translations before it."""
        column = language_column("content", self.settings.target_lang)
        pages = self._table("pages")
        is_open = ~T.is_blank(F.coalesce("original_content", F.lit(""))) & T.is_blank(F.coalesce(column, F.lit("")))
        todo = pages.where(is_open).select("document_id").distinct()
        titles = self._table("doc_catalog").select(F.col("id").alias("document_id"), "file_name", "total_pages")
        rows = pages.join(todo, "document_id", "left_semi").join(titles, "document_id", "left").join(self._term_lists(), "document_id", "left")
        head = context.prompt_head(F.coalesce("file_name", F.lit("")), F.col("page_number"), F.coalesce("total_pages", F.lit(0)), self.settings.source_lang, self.settings.target_lang)
        tail = context.prompt_tail(F.col("glossary"), F.col("original_content"), self.settings.target_lang)
        asked = rows.select("document_id", "page_number", "id", head.alias("head"), tail.alias("tail"), F.col(column).alias("translation"), is_open.alias("open"))
        replies = cut_lineage(answers_in_order(asked, self.model, self.fallback))
        told = replies.where("error is null").select("id", F.col("reply").alias("__new"))
        changed = pages.join(told, "id", "left").withColumn(column, F.coalesce("__new", column))
        self.store.replace("pages", changed.select(*pages.columns))
        self._log("page_translate", _results(replies.join(rows.where(is_open).select("id", "document_id"), "id")))

    def export(self) -> None:
        """Translated documents as files."""
        column = language_column("content", self.settings.target_lang)
        names = self._table("doc_catalog").select(F.col("id").alias("document_id"), "file_name")
        pages = self._table("pages").join(names, "document_id")
        bodies = sinks.markdown_body(pages, "document_id", "file_name", "page_number", column, self.settings.target_lang, self.settings.clean)
        # documents of one name, from different folders or of different kinds, get their ids into their files' names
        name = sinks.file_names(F.col("file_name"), self.settings.target_lang, "")
        twins = names.groupBy(name.alias("name")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("name", F.lit(True).alias("twin"))
        bodies = bodies.withColumn("name", name).join(twins, "name", "left").withColumn("number", F.when(F.col("twin"), F.col("document_id")))
        for kind in self.settings.formats:
            named = bodies.withColumn("file", sinks.file_names(F.col("file_name"), self.settings.target_lang, f".{kind}", F.col("number")))
            sinks.write_files(named, "file", "body", self.settings.output_dir, kind, self.settings.target_lang in T.RTL_TABLES)
        # a document is done when no page waits for its translation
        waiting = F.count_if(~T.is_blank(F.coalesce("original_content", F.lit(""))) & T.is_blank(F.coalesce(column, F.lit(""))))
        whole = pages.groupBy("document_id").agg(waiting.alias("w")).where("w = 0").select("document_id")
        done = bodies.join(whole, "document_id", "left_semi").select("document_id", F.lit(len(self.settings.formats)).alias("n"), F.lit(0).alias("failed"), F.lit(None).cast("string").alias("error"))
        self._log("export", done, "completed")

    def export_terms(self, path: str) -> None:
        """The terms as a list for review."""
        sinks.review_list(self._table("terminology"), path, self.settings.source_lang, self.settings.target_lang)

    def import_terms(self, path: str) -> None:
        """The corrections of a reviewed list; its terms are approved."""
        known = self._table("terminology")
        review = files.review_csv(self.spark, path, self.settings.target_lang)
        changed = upserts.review_import(known, review, language_column("translation", self.settings.target_lang))
        self.store.replace("terminology", changed.select(*known.columns))

    def run(self) -> None:
        """All stages; with ``review`` it ends after the terms, for their approval."""
        self.scan()
        self.extract()
        self.terminology()
        if not self.settings.review:
            self.translate()
            self.export()


def _results(items: DataFrame) -> DataFrame:
    """Per document: items, failed ones, and the error of one of them."""
    return items.groupBy("document_id").agg(F.count(F.lit(1)).alias("n"), F.count("error").alias("failed"), F.min("error").alias("error"))
