"""Documents as files: markdown, word-processor files, review lists."""

from __future__ import annotations

import io
import os
import re
import uuid
import zipfile
from collections.abc import Callable, Iterator
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..functions import text as T


def markdown_body(pages: DataFrame, document: str, name: str, number: str, content: str, lang: str, clean: bool = False) -> DataFrame:
    """One markdown text per document, its pages in order; ``clean`` leaves out all furniture."""
    text = F.concat(F.col(content), F.lit("\n")) if clean else F.concat(F.lit("## Page "), F.col(number) + 1, F.lit("\n\n"), F.col(content), F.lit("\n\n---\n"))
    rows = pages.where(F.coalesce(F.col(content), F.lit("")) != "").groupBy(document, name).agg(F.array_sort(F.collect_list(F.struct(F.col(number).alias("n"), text.alias("t")))).alias("p"))
    head = F.lit("") if clean else F.concat(F.lit("# "), F.col(name), F.lit("\n\n**Source:** "), F.col(name), F.lit(f"\n**Language:** {lang.upper()}\n**Total Pages:** "), F.size("p"), F.lit("\n\n---\n\n"))
    return rows.select(document, name, F.concat(head, F.array_join(F.transform("p", lambda x: x["t"]), "\n")).alias("body"))


def file_names(name: Column, lang: str, suffix: str, number: Column | None = None) -> Column:
    """The name of a document's file; ``number`` tells documents of one name apart."""
    told = F.lit("") if number is None else F.coalesce(F.concat(F.lit("_"), number), F.lit(""))
    return F.concat(T.safe_filename(T.stem(name)), told, F.lit(f"_{lang}{suffix}"))


# ---- word-processor files --------------------------------------------------------------------
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
_TYPES = f'{_HEAD}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>'
_RELS = f'{_HEAD}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>'


def _runs(text: str) -> str:
    """Bold, italic and code spans as runs."""
    out = []
    for part in re.split(r"(\*\*[^*]+\*\*|\*[^*]+\*|`[^`]+`)", text):
        style, body = "", part
        if part.startswith("**") and len(part) > 4:
            style, body = "<w:b/>", part[2:-2]
        elif part.startswith("*") and len(part) > 2:
            style, body = "<w:i/>", part[1:-1]
        elif part.startswith("`") and len(part) > 2:
            style, body = '<w:rFonts w:ascii="Courier New" w:hAnsi="Courier New"/>', part[1:-1]
        if body:
            out.append(f'<w:r>{f"<w:rPr>{style}</w:rPr>" if style else ""}<w:t xml:space="preserve">{escape(body)}</w:t></w:r>')
    return "".join(out)


def _block(text: str, style: str, rtl: bool) -> str:
    side = '<w:bidi/><w:jc w:val="right"/>' if rtl else ""
    named = f'<w:pStyle w:val="{style}"/>' if style else ""
    return f"<w:p><w:pPr>{named}{side}</w:pPr>{_runs(text)}</w:p>"


def docx_bytes(markdown: str, rtl: bool = False) -> bytes:
    """Markdown as a word-processor file: headings, lists, quotes, tables, paragraphs."""
    body: list[str] = []
    rows: list[list[str]] = []

    def close_table() -> None:
        if rows:
            width = max(map(len, rows))
            cells = lambda r: "".join(f"<w:tc>{_block(c, '', rtl)}</w:tc>" for c in r + [""] * (width - len(r)))
            body.append(f"<w:tbl><w:tblPr>{'<w:bidiVisual/>' if rtl else ''}</w:tblPr>{''.join(f'<w:tr>{cells(r)}</w:tr>' for r in rows)}</w:tbl>")
            rows.clear()

    for line in markdown.split("\n"):
        text = line.strip()
        if text.startswith("|") and text.endswith("|") and len(text) > 1:
            cells = [c.strip() for c in text[1:-1].split("|")]
            if not all(re.fullmatch(r":?-+:?", c) for c in cells):
                rows.append(cells)
            continue
        close_table()
        if not text or text == "---":
            continue
        if m := re.match(r"(#{1,6})\s+(.*)", text):
            body.append(_block(m[2], f"Heading{len(m[1])}", rtl))
        elif m := re.match(r"[-*]\s+(.*)", text):
            body.append(_block(m[1], "ListBullet", rtl))
        elif m := re.match(r"\d+[.)]\s+(.*)", text):
            body.append(_block(m[1], "ListNumber", rtl))
        elif text.startswith(">"):
            body.append(_block(text[1:].strip(), "Quote", rtl))
        else:
            body.append(_block(text, "", rtl))
    close_table()
    document = f'{_HEAD}<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{"".join(body)}</w:body></w:document>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", _TYPES)
        z.writestr("_rels/.rels", _RELS)
        z.writestr("word/document.xml", document)
    return out.getvalue()


#: How a document's markdown becomes the bytes of a file of a kind.
WRITERS: dict[str, Callable[[str, bool], bytes]] = {"md": lambda body, rtl: body.encode("utf-8"), "docx": lambda body, rtl: docx_bytes(body, rtl)}


def write_files(bodies: DataFrame, file_name: str, body: str, folder: str, kind: str = "md", rtl: bool = False, writer: Callable[[str, bool], bytes] | None = None) -> None:
    """One file per row in a folder that all executors share: a path or the address of a file system.

    A file is written beside its place and then moved there, so a repeated task
    leaves a whole file.  A kind without a writer is an error.
    """
    make = writer or WRITERS.get(kind)
    if make is None:
        raise ValueError(f"no writer for files of the kind {kind}")

    def write(rows: Iterator[Row]) -> None:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), os.path.abspath(folder))
        system.create_dir(base)
        for row in rows:
            draft = f"{base}/.{row[0]}.{uuid.uuid4().hex}"
            with system.open_output_stream(draft) as out:
                out.write(make(row[1], rtl))
            system.move(draft, f"{base}/{row[0]}")

    bodies.select(file_name, body).foreachPartition(write)


def review_list(terms: DataFrame, path: str, source: str, target: str) -> None:
    """A list of terms for review, with a header and an empty column for corrections."""
    rows = terms.select(F.col("id").alias("term_id"), F.col("term").alias(f"original_term_{source}"), F.coalesce("frequency", F.lit(0)).alias("frequency"), F.coalesce(f"translation_{target}", F.lit("")).alias(f"auto_translation_{target}"), F.lit("").alias(f"corrected_translation_{target}"))
    rows.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
