"""Glossary pages: how sure a page is one, and its entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T

# Headings of glossaries and their languages, in the order in which they are tried.
HEADERS = [
    *((h, "ar") for h in ("المصطلحات", "قائمة المصطلحات", "مسرد المصطلحات", "المصطلحات والتعريفات", "التعريفات", "المفردات", "الكلمات المفتاحية")),
    *((h, "en") for h in ("glossary", "terminology", "terms and definitions", "definitions", "key terms", "vocabulary", "list of terms", "abbreviations", "acronyms")),
    *((h, "fr") for h in ("glossaire", "terminologie", "termes et définitions", "définitions", "lexique", "vocabulaire")),
    *((h, "de") for h in ("glossar", "terminologie", "begriffe", "definitionen")),
    *((h, "es") for h in ("glosario", "terminología", "definiciones")),
    *((h, "he") for h in ("מילון מונחים", "מונחים", "הגדרות")),
    *((h, "fa") for h in ("واژه‌نامه", "اصطلاحات")),
]

# The patterns of entries on a line, and below the signs of a glossary page with their weights.
COLON = r"(?m)^([^\n:]{2,100}):\s*(.{10,})$"
DASH = r"(?m)^([^\n\-–—]{2,100})\s*[-–—]\s*(.{10,})$"


def header_language(text: Column) -> Column:
    """Language of the first heading in list order that the text has."""

    def first(lower: Column) -> Column:
        out = F.lit(None).cast("string")
        for header, lang in reversed(HEADERS):
            out = F.when(F.contains(lower, F.lit(header)), lang).otherwise(out)
        return out

    return T.let(F.lower(text), first)


def confidence(text: Column) -> Column:
    """Sum of the signs of a glossary page, at most 1, rounded to 6."""
    count = lambda p: F.regexp_count(text, F.lit(p))
    score = (
        F.when(header_language(text).isNotNull(), 0.5).otherwise(0.0)
        + F.when(text.rlike(r"\|.*\|.*\|"), 0.2).otherwise(0.0)
        + F.when(count(r"(?md)^[^\n:]+:\s*[^\n]+$") >= 5, 0.2).otherwise(0.0)
        + F.when(count(r"(?md)^[^\n\-]+\s*[-–—]\s*[^\n]+$") >= 5, 0.2).otherwise(0.0)
        + F.when(count(r"(?md)^\d+[.)]\s*[^\n]+[:–-]\s*[^\n]+") >= 5, 0.15).otherwise(0.0)
    )
    return F.round(F.least(F.lit(1.0), score), 6)


def _pairs(pages: DataFrame, key: list[str], text: str, pattern: str) -> DataFrame:
    p = "(?d)" + pattern
    both = F.arrays_zip(F.regexp_extract_all(F.col(text), F.lit(p), F.lit(1)).alias("term"), F.regexp_extract_all(F.col(text), F.lit(p), F.lit(2)).alias("definition"))
    rows = pages.select(*key, F.posexplode(both).alias("pos", "e"))
    return rows.select(*key, "pos", F.trim(F.regexp_replace("e.term", r"[\n\t\r]", " ")).alias("term"), F.trim("e.definition").alias("definition"))


def colon_pairs(pages: DataFrame, key: list[str], text: str) -> DataFrame:
    """``term: definition`` lines; no headings, terms under 150 characters."""
    return _pairs(pages, key, text, COLON).where((F.length("term") < 150) & (F.length("term") > 0) & ~F.startswith("term", F.lit("#")))


def dash_pairs(pages: DataFrame, key: list[str], text: str) -> DataFrame:
    """``term - definition`` lines; no headings, terms under 150 characters."""
    return _pairs(pages, key, text, DASH).where((F.length("term") < 150) & (F.length("term") > 0) & ~F.startswith("term", F.lit("#")))


def table_pairs(pages: DataFrame, key: list[str], text: str) -> DataFrame:
    """First and second cell of the rows below a table's separator.

    A table needs a row above its separator.  Lines are scanned once, by windows:
    a line that is no row ends the table above it if that has a separator.
    """
    lines = pages.select(*key, F.posexplode(F.split(F.col(text), "\n")).alias("pos", "line")).withColumn("line", T.strip(F.col("line")))
    cells = F.transform(F.slice(F.split("line", r"\|"), 2, F.greatest(F.size(F.split("line", r"\|")) - 2, F.lit(0))), lambda c: T.strip(c))
    row = F.col("line").rlike(r"^\|") & F.col("line").rlike(r"\|$")
    lines = lines.withColumn("row", row).withColumn("cells", F.when(row, cells).otherwise(F.array().cast("array<string>")))
    lines = lines.withColumn("separator", row & (F.size("cells") > 0) & F.forall("cells", lambda c: c.rlike(r"^[-:]+$")))
    # a state lasts from one reset to the next; only a line after a separator resets, so tables without one run together
    order = Window.partitionBy(*key).orderBy("pos")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    last_other = F.max(F.when(~F.col("row"), F.col("pos"))).over(so_far)
    last_separator = F.max(F.when(F.col("separator"), F.col("pos"))).over(so_far)
    lines = lines.withColumn("found", last_separator.isNotNull() & (last_separator > F.coalesce(last_other, F.lit(-1))))
    # a head row anywhere since the last reset opens the table
    lines = lines.withColumn("reset", F.when(~F.col("row") & F.lag("found", 1, False).over(order), F.col("pos")))
    head = F.col("row") & ~F.col("separator") & ~F.col("found")
    last_head = F.max(F.when(head, F.col("pos"))).over(so_far)
    last_reset = F.max("reset").over(so_far)
    lines = lines.withColumn("open", last_head.isNotNull() & (last_head > F.coalesce(last_reset, F.lit(-1))))
    rows = lines.where("row and not separator and found and open").where(F.size("cells") >= 2)
    rows = rows.select(*key, "pos", F.get("cells", 0).alias("term"), F.get("cells", 1).alias("definition"))
    return rows.where("term <> '' and definition <> ''").where(F.length("term") < 200)


def entries(pages: DataFrame, key: list[str], text: str) -> DataFrame:
    """Entries of each page by the first method that finds any: table, colon, dash."""
    methods = [f(pages, key, text).withColumn("method", F.lit(i)) for i, f in enumerate((table_pairs, colon_pairs, dash_pairs))]
    rows = methods[0].unionByName(methods[1]).unionByName(methods[2])
    first = F.min("method").over(Window.partitionBy(*key))
    return rows.withColumn("first", first).where("method = first").drop("first")


def first_of(rows: DataFrame, key: list[Column], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__n = 1").drop("__n")


def saved(pages: DataFrame, column: str, least: float = 0.7) -> DataFrame:
    """Entries of the pages that are sure enough to be a glossary's, as rows of the terminology table.

    ``pages`` have ``document_id``, ``page_number``, ``id`` and ``original_content``.
    Of the entries of a document that are equal but for case the first is kept, in
    the order of its pages; its definition is the translation in ``column``.
    """
    sure = pages.where(confidence(F.col("original_content")) >= least)
    rows = entries(sure, ["document_id", "page_number", "id"], "original_content")
    once = first_of(rows, [F.col("document_id"), F.lower(T.strip(F.col("term")))], [F.col("page_number"), F.col("id"), F.col("pos")])
    page = F.concat(F.lit("From glossary page "), F.col("page_number") + 1)
    return once.select("document_id", "term", F.lit(100).alias("frequency"), F.col("definition").alias(column), page.alias("context"), F.lit(True).alias("approved"))
