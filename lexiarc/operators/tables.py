"""Tables in HTML as rows and as markdown."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_LIST = T.ArrayType(T.StringType())
_ROWS = T.StructType([T.StructField("headers", _LIST), T.StructField("rows", T.ArrayType(_LIST))])


class _Cells(HTMLParser):
    """Rows of the first table: (in a head section, has head cells, cells)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[tuple[bool, bool, list[str]]] = []
        self.head = self.done = self.inside = False
        self.cell: list[str] | None = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "table":
            self.inside = True
        elif not self.inside or self.done:
            return
        elif tag == "thead":
            self.head = True
        elif tag == "tr":
            self.rows.append((self.head, False, []))
        elif tag in ("td", "th") and self.rows:
            self.close()
            if tag == "th":
                head, _, cells = self.rows[-1]
                self.rows[-1] = (head, True, cells)
            self.cell = []

    def handle_endtag(self, tag: str) -> None:
        if tag in ("td", "th", "tr"):
            self.close()
        elif tag == "thead":
            self.head = False
        elif tag == "table":
            self.close()
            self.done = True

    def handle_data(self, data: str) -> None:
        if self.cell is not None and data.strip():
            self.cell.append(data.strip())

    def close(self) -> None:  # noqa: A003
        if self.cell is not None and self.rows:
            self.rows[-1][2].append("".join(self.cell))
        self.cell = None


def parse_table(html: str | None) -> dict | None:
    """Headers and rows of the first table: a head section, else the first row with head cells, else the first row."""
    parser = _Cells()
    parser.feed(html or "")
    rows = [r for r in parser.rows if r[2]]
    if not parser.inside or not rows:
        return None
    at = next((i for i, r in enumerate(rows) if r[0]), next((i for i, r in enumerate(rows) if r[1]), 0))
    headers = rows[at][2]
    body = [r[2] + [""] * (len(headers) - len(r[2])) for i, r in enumerate(rows) if i != at and not r[0]]
    return {"headers": headers, "rows": body}


@F.pandas_udf(_ROWS)
def table_rows(html: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Headers and rows of a table; both NULL where there is no table."""
    for batch in html:
        parsed = [parse_table(x) or {"headers": None, "rows": None} for x in batch]
        yield pd.DataFrame({"headers": [p["headers"] for p in parsed], "rows": [p["rows"] for p in parsed]})


def reversed_columns(row: Column) -> Column:
    return F.reverse(row)


def padded(row: Column, width: Column) -> Column:
    """A row with empty cells up to the width."""
    return F.concat(row, F.array_repeat(F.lit(""), F.greatest(width - F.size(row), F.lit(0))))


def as_markdown(headers: Column, rows: Column, reverse: bool = False) -> Column:
    """A markdown table; a pipe in a cell is escaped, NULL headers give NULL."""
    turn = F.reverse if reverse else (lambda x: x)
    line = lambda cells: F.concat(F.lit("| "), F.array_join(turn(F.transform(cells, lambda c: F.replace(c, F.lit("|"), F.lit("\\|")))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.transform(headers, lambda _: F.lit("---")), " | "), F.lit(" |"))
    return F.when(headers.isNotNull(), F.array_join(F.concat(F.array(line(headers), rule), F.transform(rows, line)), "\n"))
