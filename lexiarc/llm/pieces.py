"""Problem 10: oversized texts in pieces under a limit, cut at natural boundaries.

A text becomes a tree: sections by heading level, then blocks (paragraphs, runs
of list items or table rows), lines, sentences, words and at last characters.
From the bottom up, neighbouring subtrees of one parent are merged as long as
they fit; only a node that doesn't fit itself is descended into.  Each piece but
the first begins with the last ``overlap_tokens`` tokens of the piece before it,
or up to three more where a character would be divided.

A text is one row, handled in one task by a pass that is linear in its length;
texts are independent, so nothing is shuffled.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spread
from .tokens import encoding, stretches, tokenizer_path

_HEADING = re.compile(r"(#{1,6})[ \t]+\S|<h([1-6])[ >]", re.I)
_ITEM = re.compile(r"[ \t]*(?:[-*•‣▪]|\d{1,3}[.)]|\|)[ \t]?")
_SENTENCE = re.compile(r"(?<=[.!?؟。؛;])[\"'»”)\]]*\s+")
_SPACE = re.compile(r"\s+")

#: Kinds of boundaries, from the strongest; a word is divided only where it alone exceeds the limit.
LEVELS = ("section",) * 6 + ("block", "line", "sentence", "word", "character")

_PIECES = "record long, limit_id int, piece_no int, start int, end int, shared int, n_tokens int, boundary string, piece string"


def _lines(text: str) -> Iterator[tuple[int, int]]:
    start = 0
    while start < len(text):
        end = text.find("\n", start) + 1 or len(text)
        yield start, end
        start = end


def boundaries(text: str) -> list[list[int]]:
    """Where nodes of the levels above sentences begin, in rising order: headings of level 1 to 6, blocks, lines."""
    headings: list[list[int]] = [[] for _ in range(6)]
    blocks, lines = [], []
    blank, kind = True, ""
    for start, end in _lines(text):
        line = text[start:end]
        if not line.strip():
            blank = True
            continue
        lines.append(start)
        if m := _HEADING.match(line):
            headings[(len(m[1]) if m[1] else int(m[2])) - 1].append(start)
            kind = "heading"
        else:
            now = "item" if _ITEM.match(line) else "text"
            # a heading stays with what follows it
            if kind != "heading" and (blank or now != kind):
                blocks.append(start)
            kind = now
        blank = False
    return [*headings, blocks, lines]


class _Tokens:
    """A text's tokens: where each ends, and where the text can be cut between characters."""

    def __init__(self, enc, text: str) -> None:
        self.ids = [enc.encode_ordinary(part) for part in stretches(text)]
        self.n = sum(map(len, self.ids))

    def __len__(self) -> int:
        return self.n

    def locate(self, enc) -> None:
        """Positions of the tokens; not needed for texts that are small enough."""
        pieces = [p for ids in self.ids for p in enc.decode_tokens_bytes(ids)]
        sizes = np.fromiter(map(len, pieces), "int64", self.n)
        raw = np.frombuffer(b"".join(pieces), "uint8")
        leads = (raw & 0xC0) != 0x80
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        self.clean = leads[starts].tolist()
        self.ends = np.cumsum(leads)[starts + sizes - 1].tolist()
        # tokens that are a space and the beginning of a word: the text is split there whatever stands before
        after = raw[np.minimum(starts + 1, len(raw) - 1)]
        self.words = np.flatnonzero((raw[starts] == 32) & (sizes > 1) & (after > 32)).tolist()

    def before(self, position: int) -> int:
        """Tokens that end at a character position or before it."""
        return bisect_right(self.ends, position)

    def position(self, token: int) -> int:
        return self.ends[token - 1] if token else 0

    def count(self, enc, text: str, first: int, last: int) -> int:
        """Tokens of the text between two token edges when it is encoded by itself.

        Between the first and the last word that a space begins they are the
        known ones; only what stands outside of these is encoded again.
        """
        i, j = bisect_left(self.words, first), bisect_left(self.words, last) - 1
        start, end = self.position(first), self.position(last)
        if i >= j:
            return sum(len(enc.encode_ordinary(part)) for part in stretches(text[start:end]))
        head, tail = self.words[i], self.words[j]
        return len(enc.encode_ordinary(text[start : self.position(head)])) + tail - head + len(enc.encode_ordinary(text[self.position(tail) : end]))


def _merged(parts: list[tuple[int, int, int]], room: int) -> list[tuple[int, int, int]]:
    out = [parts[0]]
    for first, last, level in parts[1:]:
        if last - out[-1][0] <= room:
            out[-1] = (out[-1][0], last, level)
        else:
            out.append((first, last, level))
    return out


class _Levels:
    """Where nodes of each level begin; found when a level is first asked for."""

    def __init__(self, text: str) -> None:
        self.text, self.known = text, boundaries(text)

    def __getitem__(self, level: int) -> list[int]:
        while level >= len(self.known):
            finer = _SENTENCE if len(self.known) == 8 else _SPACE
            self.known.append([m.end() for m in finer.finditer(self.text)])
        return self.known[level]


def tree_pieces(tokens: _Tokens, levels: _Levels, room: int) -> list[tuple[int, int, int]]:
    """Token spans of at most ``room`` tokens, together the whole text, each with the level of the node after it."""

    def split(first: int, last: int, level: int, after: int) -> list[tuple[int, int, int]]:
        if last - first <= room:
            return [(first, last, after)]
        start, end = tokens.position(first), tokens.position(last)
        for i in range(level, 10):
            marks = levels[i]
            inside = marks[bisect_right(marks, start) : bisect_left(marks, end)]
            # a token that begins with the white space before a node belongs to the node
            edges = sorted({t for t in map(tokens.before, inside) if first < t < last and tokens.clean[t]})
            if edges:
                nodes = zip([first, *edges], [*edges, last], [i] * len(edges) + [after])
                return _merged([part for a, b, name in nodes for part in split(a, b, i + 1, name)], room)
        out = []
        while first < last:
            cut = min(last, first + room)
            while first + 1 < cut < last and not tokens.clean[cut]:
                cut -= 1
            out.append((first, cut, after if cut == last else 10))
            first = cut
        return out

    return split(0, len(tokens), 0, -1)


def split_texts(df: DataFrame, record: str, text: str, limits: list[tuple[int, int, int]], path: str | None = None) -> DataFrame:
    """Pieces of the texts that exceed a limit, for every limit.

    ``limits`` are (limit_id, max_tokens, overlap_tokens), the overlap below the
    limit by 8 at least.  Result: ``record``, ``limit_id``, ``piece_no`` from 0,
    the character span ``start`` to ``end`` in the text, ``shared`` (characters
    that the piece shares with the one before), ``n_tokens``, the kind of
    ``boundary`` the piece ends at and the ``piece`` itself.  Texts within the
    limit, NULL and empty ones have no pieces; rows without an id are left out;
    a row delivered twice is cut twice.  The pieces without what they share join
    to the text.
    """
    where = tokenizer_path(path)
    if any(not 0 <= overlap <= limit - 8 for _, limit, overlap in limits):
        raise ValueError("an overlap must be smaller than its limit by 8 tokens")

    def cut_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(where)
        for batch in batches:
            rows: list[tuple] = []
            for key, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows.extend((key, *piece) for piece in pieces_of(enc, body, limits))
                if len(rows) > 1000:
                    yield _batch(rows)
                    rows = []
            yield _batch(rows)

    rows = df.select(F.col(record).cast("long").alias("record"), F.col(text).alias("text")).where(F.col("record").isNotNull() & (F.length("text") > 0))
    return spread(rows).mapInArrow(cut_batches, _PIECES)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in _PIECES.split(", ")]
    kinds = [pa.int64(), *[pa.int32()] * 6, pa.string(), pa.string()]
    columns = zip(*rows) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names)


def pieces_of(enc, text: str, limits: list[tuple[int, int, int]]) -> Iterator[tuple]:
    """(limit_id, piece_no, start, end, shared, n_tokens, boundary, piece) of one text."""
    tokens = _Tokens(enc, text)
    if all(len(tokens) <= limit for _, limit, _ in limits):
        return
    tokens.locate(enc)
    levels = _Levels(text)
    for limit_id, limit, overlap in limits:
        if len(tokens) <= limit:
            continue
        # three tokens for whole characters, and one for what is counted anew at a piece's edges
        room = limit - overlap - 4 if overlap else limit - 1
        for number, (first, last, level) in enumerate(tree_pieces(tokens, levels, room)):
            begin = max(0, first - overlap)
            while begin and not tokens.clean[begin]:
                begin -= 1
            start, end = tokens.position(begin), tokens.position(last)
            size = tokens.count(enc, text, begin, last)
            yield limit_id, number, start, end, tokens.position(first) - start, size, "end" if level < 0 else LEVELS[level], text[start:end]
