"""Files as a catalog and as pages: scan, incremental scan, text and word-processor files."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from typing import Protocol
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..schemas import TABLES

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
PAGES = "full_path string, page_number int, content string, confidence double, ocr_model string, error string"


def scan(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """Supported files below a folder: path, name, relative path, kind, media type, size, time.

    Contents aren't read: only the listing columns of the source are used.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder).select("path", "length", "modificationTime")
    path = F.regexp_replace("path", r"^file:/*", "/")
    base = folder.removeprefix("file:").rstrip("/") + "/"
    ext = T.suffix(F.col("path"))
    return files.where(ext.isin(list(T.FILE_KINDS))).select(
        path.alias("full_path"), F.regexp_extract("path", r"([^/]*)$", 1).alias("file_name"),
        F.when(F.startswith(path, F.lit(base)), F.substr(path, F.lit(len(base) + 1))).otherwise(path).alias("relative_path"),
        T.lookup(ext, T.FILE_KINDS).alias("file_type"), T.lookup(ext, T.MEDIA_TYPES).alias("media_type"), F.col("length").alias("size"), F.col("modificationTime").alias("modified_at"),
    )


def new_files(files: DataFrame, catalog: DataFrame) -> DataFrame:
    """Files whose path the catalog doesn't have."""
    return files.join(catalog.select("full_path"), "full_path", "left_anti")


def with_ids(new: DataFrame, last_id: int, key: str = "full_path") -> DataFrame:
    """Rows with ids from ``last_id + 1`` on, in key order, without one task seeing all rows.

    Rows are numbered within hash buckets; the buckets' sizes, a table of fixed
    length, give each its offset.
    """
    buckets = 1024
    rows = new.withColumn("__b", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    sizes = rows.groupBy("__b").agg(F.count(F.lit(1)).alias("n"))
    # at most 1024 rows
    starts = sizes.withColumn("start", F.sum("n").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1))).select("__b", F.coalesce("start", F.lit(0)).alias("start"))
    number = F.row_number().over(Window.partitionBy("__b").orderBy(key))
    return rows.join(F.broadcast(starts), "__b").withColumn("id", (F.lit(last_id) + F.col("start") + number).cast("int")).drop("__b", "start")


def _decoded(content: Column) -> tuple[Column, Column]:
    """Text of bytes and the confidence in it: UTF-8, else Latin-1."""
    utf8 = F.is_valid_utf8(content.cast("string"))
    return F.when(utf8, F.decode(content, "UTF-8")).otherwise(F.decode(content, "ISO-8859-1")), F.when(utf8, 1.0).otherwise(0.9)


def text_pages(files: DataFrame) -> DataFrame:
    """Page 0 of text files given as (path, content): the whole file."""
    text, confidence = _decoded(F.col("content"))
    return files.select(F.regexp_replace("path", r"^file:/*", "/").alias("full_path"), F.lit(0).alias("page_number"), text.alias("content"), confidence.alias("confidence"), F.lit("text").alias("ocr_model"), F.lit(None).cast("string").alias("error"))


def docx_markdown(raw: bytes) -> str:
    """A word-processor file as markdown: headings, lists, paragraphs and tables in order."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    blocks = []
    for element in body if body is not None else ():
        if element.tag == f"{_W}p":
            if text := _paragraph(element):
                blocks.append(text)
        elif element.tag == f"{_W}tbl":
            rows = [[" ".join(filter(None, map(_text, cell.iter(f"{_W}p")))) for cell in row.findall(f"{_W}tc")] for row in element.findall(f"{_W}tr")]
            if rows:
                width = max(map(len, rows))
                lines = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in rows]
                blocks.append("\n".join([lines[0], "| " + " | ".join(["---"] * width) + " |", *lines[1:]]))
    return "\n\n".join(blocks)


def _text(paragraph: ElementTree.Element) -> str:
    parts = ["\t" if x.tag == f"{_W}tab" else "\n" if x.tag == f"{_W}br" else x.text or "" for x in paragraph.iter() if x.tag in (f"{_W}t", f"{_W}tab", f"{_W}br")]
    return "".join(parts).strip()


def _paragraph(paragraph: ElementTree.Element) -> str:
    text = _text(paragraph)
    style = paragraph.find(f"{_W}pPr/{_W}pStyle")
    name = (style.get(f"{_W}val") or "") if style is not None else ""
    if not text:
        return ""
    if name.startswith("Heading") and (level := "".join(c for c in name if c.isdigit())):
        return "#" * min(int(level), 6) + " " + text
    return {"Title": "# ", "Subtitle": "## "}.get(name, "- " if "List" in name else "") + text


def docx_pages(files: DataFrame) -> DataFrame:
    """Page 0 of word-processor files given as (path, content); broken files have an error instead."""

    def pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for path, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    out.append((path, 0, docx_markdown(raw), 1.0, "docx", None))
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, TypeError) as broken:
                    out.append((path, 0, "", 0.0, "docx", str(broken)))
            yield _page_batch(out)

    return files.select(F.regexp_replace("path", r"^file:/*", "/").alias("full_path"), "content").mapInArrow(pages, PAGES)


class PageReader(Protocol):
    """Reads files of one kind, for instance by a library for PDF or a remote recognition; made once per task."""

    name: str

    def pages(self, path: str, raw: bytes) -> list[tuple[str, float | None]]:
        """Text and confidence of each page, in order; raises what it can't read."""
        ...


def pages_by(files: DataFrame, make: Callable[[], PageReader]) -> DataFrame:
    """Pages of files given as (path, content) by a reader; a file it can't read has an error instead."""

    def pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = make()
        for batch in batches:
            for path, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    out = [(path, i, text, confidence, reader.name, None) for i, (text, confidence) in enumerate(reader.pages(path, raw))]
                except Exception as broken:  # noqa: BLE001 - whatever a library raises
                    out = [(path, 0, "", 0.0, reader.name, f"{type(broken).__name__}: {broken}")]
                yield _page_batch(out)

    return files.select(F.regexp_replace("path", r"^file:/*", "/").alias("full_path"), "content").mapInArrow(pages, PAGES)


def _page_batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in PAGES.split(", ")]
    kinds = [pa.string(), pa.int32(), pa.string(), pa.float64(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def read_pages(spark: SparkSession, folder: str, recursive: bool = True, readers: dict[str, Callable[[], PageReader]] | None = None) -> DataFrame:
    """Pages of all supported files below a folder.

    Text and word-processor files are read here; ``readers`` has readers of other kinds
    (``pdf``, ``doc``), or for these two in their place.  A file of a kind without a reader has
    an error.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder).select("path", "content")
    return pages_of(files, readers)


def pages_of(files: DataFrame, readers: dict[str, Callable[[], PageReader]] | None = None) -> DataFrame:
    """``read_pages`` of files given as (path, content)."""
    readers = readers or {}
    kind = T.lookup(T.suffix(F.col("path")), T.FILE_KINDS)
    own = lambda *kinds: files.where(kind.isin([k for k in kinds if k not in readers]))
    out = text_pages(own("markdown", "text")).unionByName(docx_pages(own("docx")))
    for name, make in readers.items():
        out = out.unionByName(pages_by(files.where(kind == name), make))
    rest = files.where(kind.isNotNull() & ~kind.isin("markdown", "text", "docx", *readers))
    nothing = rest.select(F.regexp_replace("path", r"^file:/*", "/").alias("full_path"), F.lit(0).alias("page_number"), F.lit("").alias("content"), F.lit(0.0).alias("confidence"), F.lit(None).cast("string").alias("ocr_model"), F.concat(F.lit("no reader for "), kind).alias("error"))
    return out.unionByName(nothing)


def review_csv(spark: SparkSession, path: str, target: str = "en") -> DataFrame:
    """A reviewed list of terms: ``term_id`` and ``correction``."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return rows.select(F.col("term_id").try_cast("int").alias("term_id"), F.col(f"corrected_translation_{target}").alias("correction")).where("term_id is not null")


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    """A log of JSON lines by the schema of the log table."""
    return spark.read.schema(TABLES["processing_log"]).json(path)
