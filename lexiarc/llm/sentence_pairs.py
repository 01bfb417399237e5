"""Problem 6: sentences of two texts that are translations of one another.

A page and its translation are aligned in one task, without any shuffle:

1. Sentences of the two sides that share numbers, names (by their code in Latin
   or Arabic letters) or words of a bilingual lexicon get a score; what is shared
   counts the more the fewer sentences have it.
2. Pairs that are each other's best, by a margin, are anchors.  The heaviest
   increasing subsequence of the anchors is the chain.
3. Between neighbouring anchors of the chain a dynamic programme aligns the rest:
   one to one, two to one, one to two, or left out.
4. A sentence that is still alone joins a neighbour's partner that holds it too
   (merged sentences), or an unpaired counterpart anywhere (moved sentences).

The lexicon is learned from all pages: sentences that shared numbers and names
pair beyond doubt are taken as parallel, and words are associated by how often
they meet there.  The words of these sentences are written once; each word is
counted, then the pairs that by those counts can be associated.  The lexicon is a
model of bounded size and is broadcast.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut_lineage, spread
from .transliterate import code_text

_SPLIT = re.compile(r"(?<=[.!?؟])\s+")
_BREAK = re.compile(r"(?<=[^\W\d_])[-=¬­‐][ \t]*\r?\n[ \t]*(?=[^\W\d_])")
_TOKEN = re.compile(r"[^\W\d_]+|\d{1,3}(?:[,٬   ]\d{3})+(?!\d)|\d+(?:[.٫]\d+)?")
_DIGITS = dict(zip("٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹٫", "01234567890123456789."))
_EASTERN = re.compile(r"[\u0660-\u0669\u06f0-\u06f9\u066b]")
_ODD = re.compile(r"[̀-ͯЀ-ԯ​-‏⁠ﬀ-ﻼ＀-￯­]")
_GROUPING = re.compile(r"[,٬   ]")


#: Frequent words of each language; what two languages have tells them not apart.
Known = dict[str, frozenset[str]]


def _frequent_words(pages: DataFrame, each: int = 200) -> Known:
    """The ``each`` most frequent words of the translations into each language that no other one has among its own."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter[str]] = defaultdict(Counter)
        for batch in batches:
            for lang, target in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen[lang].update(target.lower().split())
            if sum(map(len, seen.values())) > 300_000:
                yield from counted(seen)
                seen.clear()
        yield from counted(seen)

    def counted(seen: dict[str, Counter[str]]) -> Iterator[pa.RecordBatch]:
        for lang, own in seen.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own), pa.string()), pa.array(list(own), pa.string()), pa.array(list(own.values()), pa.int64())], ["lang", "word", "n"])

    words = pages.select("lang", "target").mapInArrow(count, "lang string, word string, n long").where(F.rlike("word", F.lit(r"^[\p{L}\p{M}]+$")))
    counts = words.groupBy("lang", "word").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    found: dict[str, set[str]] = defaultdict(set)
    for r in counts.withColumn("place", place).where(F.col("place") <= each).collect():
        found[r["lang"]].add(r["word"])
    return {lang: frozenset(own - set().union(*(w for other, w in found.items() if other != lang))) for lang, own in found.items()}


def language(text: str, known: Known) -> str:
    """The language of whose frequent words a text has most; ``other`` without any."""
    words = text.lower().split()
    best, name = max(((sum(map(own.__contains__, words)), name) for name, own in known.items()), default=(0, "other"))
    return name if best else "other"


@dataclass(frozen=True)
class Options:
    """Tunables.  ``lexicon`` bounds the entries of the lexicon; those of the most frequent pairs are kept."""

    lexicon: int = 50_000
    least_together: int = 4
    least_association: float = 0.15
    least_lift: float = 3.0
    strong: float = 3.0
    contained: float = 0.35
    merged: float = 0.5


def sentences(text: str) -> list[str]:
    """The sentences of a text: each ends with a mark before white space, or with the text."""
    return [s for s in _SPLIT.split(text.strip()) if s]


def _cleaned(text: str) -> list[str]:
    """The sentences of a text as they are read: digits and letters in one form, words joined over line ends."""
    for c in set(_EASTERN.findall(text)):
        text = text.replace(c, _DIGITS[c])
    odd = _ODD.search(text) is not None
    if odd:  # what can't be seen doesn't keep a mark from ending its sentence
        for c in set(text):
            if unicodedata.category(c) == "Cf":
                text = text.replace(c, "")
    parts = sentences(text)
    if odd:
        parts = [unicodedata.normalize("NFKC", s) for s in parts]
    return [_BREAK.sub("", s) if "\n" in s else s for s in parts] if "\n" in text else parts


class Reader(dict):
    """Tokens to (number, word, codes of the name it may be), each worked out once.

    Arabic letters have no case: there any word that isn't common can be a name.
    Without common words (NULL) every word in capitals or Arabic letters can.
    """

    def __init__(self, common: set[str] | None = None) -> None:
        self.common = common

    def __missing__(self, token: str) -> tuple[str | None, str | None, tuple[str, ...]]:
        if token[0].isdigit():
            out = (_GROUPING.sub("", token), None, ())
        elif len(token) < 2:
            out = (None, None, ())
        else:
            low, codes = token.lower(), []
            if len(token) > 2 and (token[0] != low[0] or token[0] >= "\u0600") and (self.common is None or low not in self.common):
                codes.append(code_text(low))
                if token[0] == "و" and len(token) > 4:
                    codes.append(code_text(low[1:]))
            out = (None, low, tuple(codes))
        if len(self) < 500_000:
            self[token] = out
        return out


class Side:
    """One text: per sentence its numbers, possible names and words."""

    def __init__(self, text: str, reader: Reader) -> None:
        parts = _cleaned(text)
        self.n = len(parts)
        self.numbers: list[set[str]] = []
        self.names: list[set[str]] = []
        self.words: list[set[str]] = []
        for s in parts:
            numbers, names, words = set(), set(), set()
            for number, word, codes in map(reader.__getitem__, set(_TOKEN.findall(s))):
                if word is not None:
                    words.add(word)
                    if codes:
                        names.update(codes)
                elif number is not None:
                    numbers.add(number)
            self.numbers.append(numbers)
            self.names.append(names)
            self.words.append(words)


def _index(rows: list[set[str]]) -> dict[str, list[int]]:
    out: dict[str, list[int]] = defaultdict(list)
    for i, row in enumerate(rows):
        for x in row:
            out[x].append(i)
    return out


def _scores(a: Side, b: Side, lexicon: dict[str, list[tuple[str, float]]]) -> tuple[list[dict[int, float]], list[float], list[float]]:
    """Scores of sentence pairs that share something, and what each sentence could reach."""
    score: list[dict[int, float]] = [defaultdict(float) for _ in range(a.n)]
    reach_a, reach_b = [0.0] * a.n, [0.0] * b.n
    for mine, other, weight in ((a.numbers, b.numbers, 3.0), (a.names, b.names, 3.0)):
        left, right = _index(mine), _index(other)
        names = mine is a.names
        for x, rows in left.items():
            cols = right.get(x)
            if cols:
                w = weight / max(len(rows), len(cols))
                for i in rows:
                    reach_a[i] += w
                    for j in cols:
                        score[i][j] += w
                for j in cols:
                    reach_b[j] += w
            elif not names:
                for i in rows:
                    reach_a[i] += weight / 2 / len(rows)
            elif x.isascii():
                for i in rows:
                    reach_a[i] += 0.5
        for x, cols in right.items():
            if x not in left:
                for j in cols:
                    reach_b[j] += 0.5 if names else weight / 2 / len(cols)
    if lexicon:
        left, right = _index(a.words), _index(b.words)
        for x, rows in left.items():
            entries = lexicon.get(x)
            if not entries:
                continue
            # a word counts once for a sentence, by its closest counterpart there
            seen: dict[int, float] = {}
            for y, assoc in entries:
                cols = right.get(y)
                if cols:
                    w = assoc / max(len(rows), len(cols)) ** 0.5
                    for j in cols:
                        if w > seen.get(j, 0.0):
                            seen[j] = w
            for i in rows:
                row = score[i]
                for j, w in seen.items():
                    row[j] += w
            w = max(seen.values(), default=0.0) or entries[0][1] / len(rows) ** 0.5
            for i in rows:
                reach_a[i] += w
        for y, cols in right.items():
            entries = lexicon.get(y)
            if entries:
                w = entries[0][1] / len(cols) ** 0.5
                for j in cols:
                    reach_b[j] += w
    return score, reach_a, reach_b


def _anchors(score: list[dict[int, float]], m: int, least: float) -> list[tuple[int, int, float]]:
    """Pairs that are each other's best by a margin."""
    best_of_b, second_of_b = [(0.0, -1)] * m, [0.0] * m
    for i, row in enumerate(score):
        for j, s in row.items():
            if s > best_of_b[j][0]:
                second_of_b[j] = best_of_b[j][0]
                best_of_b[j] = (s, i)
            elif s > second_of_b[j]:
                second_of_b[j] = s
    out = []
    for i, row in enumerate(score):
        if row:
            top = sorted(row.items(), key=lambda x: -x[1])[:2]
            j, s = top[0]
            second = max(top[1][1] if len(top) > 1 else 0.0, second_of_b[j])
            if best_of_b[j][1] == i and s >= least and s >= 1.3 * second:
                out.append((i, j, s))
    return out


def _chain(anchors: list[tuple[int, int, float]]) -> list[tuple[int, int]]:
    """The heaviest subsequence of anchors that increases on both sides."""
    n = len(anchors)
    if all(anchors[k][1] < anchors[k + 1][1] for k in range(n - 1)):
        return [(i, j) for i, j, _ in anchors]
    places = sorted(j for _, j, _ in anchors)
    best = [(0.0, -1)] * (n + 1)  # heaviest chain that ends up to a place, as a tree of prefixes
    back = [-1] * n
    for k, (_, j, s) in enumerate(anchors):
        at = bisect_left(places, j)
        before, p = (0.0, -1), at
        while p:
            before, p = max(before, best[p], key=lambda x: x[0]), p & (p - 1)
        back[k], now, p = before[1], (before[0] + s, k), at + 1
        while p <= n:
            if now[0] > best[p][0]:
                best[p] = now
            p += p & -p
    top, p = (0.0, -1), n
    while p:
        top, p = max(top, best[p], key=lambda x: x[0]), p & (p - 1)
    out, k = [], top[1]
    while k >= 0:
        out.append(anchors[k][:2])
        k = back[k]
    return out[::-1]


#: Cells of a gap that are aligned at once; a larger gap is divided at its best pair.
GAP = 40_000


def _gap(i0: int, i1: int, j0: int, j1: int, alike, near: list[dict[int, float]], pairs: set[tuple[int, int]]) -> None:
    """Align sentences i0..i1-1 with j0..j1-1 by dynamic programming; ``near`` has the sentences that share anything with one."""
    if i0 >= i1 or j0 >= j1:
        return
    if i1 - i0 == 1 and j1 - j0 == 1:
        if alike(i0, j0) > 0:
            pairs.add((i0, j0))
        return
    n, m = i1 - i0, j1 - j0
    if n * m > GAP:
        stretches = [(i0, i1, j0, j1)]
        while stretches:
            a0, a1, b0, b1 = stretches.pop()
            if (a1 - a0) * (b1 - b0) <= GAP:
                _gap(a0, a1, b0, b1, alike, near, pairs)
            else:
                _, i, j = max(((alike(i, j), i, j) for i in range(a0, a1) for j in near[i] if b0 <= j < b1), default=(0.0, -1, -1))
                if i >= 0 and alike(i, j) > 0:
                    pairs.add((i, j))
                    stretches += [(a0, i, b0, j), (i + 1, a1, j + 1, b1)]
        return
    value = [[0.0] * (m + 1) for _ in range(n + 1)]
    step = [[0] * (m + 1) for _ in range(n + 1)]
    one = [[alike(i0 + x, j0 + y) for y in range(m)] for x in range(n)]
    for x in range(n + 1):
        for y in range(m + 1):
            if not x and not y:
                continue
            best, how = (value[x - 1][y], 1) if x else (-1.0, 0)
            if y and value[x][y - 1] > best:
                best, how = value[x][y - 1], 2
            if x and y:
                v = one[x - 1][y - 1]
                if v > 0 and value[x - 1][y - 1] + v > best:
                    best, how = value[x - 1][y - 1] + v, 3
                if x > 1 and v > 0 and one[x - 2][y - 1] > 0 and value[x - 2][y - 1] + 0.9 * (v + one[x - 2][y - 1]) > best:
                    best, how = value[x - 2][y - 1] + 0.9 * (v + one[x - 2][y - 1]), 4
                if y > 1 and v > 0 and one[x - 1][y - 2] > 0 and value[x - 1][y - 2] + 0.9 * (v + one[x - 1][y - 2]) > best:
                    best, how = value[x - 1][y - 2] + 0.9 * (v + one[x - 1][y - 2]), 5
            value[x][y], step[x][y] = best, how
    x, y = n, m
    while x or y:
        how = step[x][y]
        if how == 1:
            x -= 1
        elif how == 2:
            y -= 1
        else:
            pairs.add((i0 + x - 1, j0 + y - 1))
            if how == 4:
                pairs.add((i0 + x - 2, j0 + y - 1))
            if how == 5:
                pairs.add((i0 + x - 1, j0 + y - 2))
            x, y = x - (2 if how == 4 else 1), y - (2 if how == 5 else 1)


def align(a: Side, b: Side, lexicon: dict[str, list[tuple[str, float]]], options: Options) -> list[tuple[int, int]]:
    """Pairs of sentence numbers that render one another."""
    if not a.n or not b.n:
        return []
    score, reach_a, reach_b = _scores(a, b, lexicon)

    def alike(i: int, j: int) -> float:
        s = score[i].get(j, 0.0)
        if s < 1.0:
            return 0.0
        c = s / max(1.0, min(reach_a[i], reach_b[j]))
        if a.numbers[i] and b.numbers[j] and a.numbers[i].isdisjoint(b.numbers[j]) and a.names[i].isdisjoint(b.names[j]):
            c *= 0.6  # the same words about other numbers
        return c if c >= options.contained else 0.0

    anchors = [x for x in _anchors(score, b.n, 1.2) if alike(x[0], x[1]) >= 0.5]
    chain = _chain(anchors)
    pairs: set[tuple[int, int]] = set(chain)
    i0 = j0 = 0
    for i, j in [*chain, (a.n, b.n)]:
        _gap(i0, i, j0, j, alike, score, pairs)
        i0, j0 = i + 1, j + 1
    with_i, with_j = defaultdict(list), defaultdict(list)
    for i, j in pairs:
        with_i[i].append(j)
        with_j[j].append(i)
    # moved: unpaired on both sides, each other's best among the unpaired
    free_i = [i for i in range(a.n) if i not in with_i]
    free_j = {j for j in range(b.n) if j not in with_j}
    moved = sorted(((alike(i, j) * min(s, 6.0), i, j) for i in free_i for j, s in score[i].items() if j in free_j and s >= 0.8 and alike(i, j) >= options.merged), reverse=True)
    for _, i, j in moved:
        if i not in with_i and j not in with_j:
            pairs.add((i, j))
            with_i[i].append(j)
            with_j[j].append(i)
    # merged: a partner of a neighbour holds the sentence as well, better than the neighbour's own share explains
    for i in range(a.n):
        if i not in with_i:
            near = {j for k in (i - 1, i + 1) for j in with_i.get(k, ())}
            best = max(((score[i].get(j, 0.0) / max(0.6, reach_a[i]), j) for j in near if score[i].get(j, 0.0) >= 0.8), default=(0.0, -1))
            if best[0] >= options.merged:
                pairs.add((i, best[1]))
    for j in range(b.n):
        if j not in with_j:
            near = {i for k in (j - 1, j + 1) for i in with_j.get(k, ())}
            best = max(((score[i].get(j, 0.0) / max(0.6, reach_b[j]), i) for i in near if score[i].get(j, 0.0) >= 0.8), default=(0.0, -1))
            if best[0] >= options.merged:
                pairs.add((best[1], j))
    return sorted(pairs)


# ---- the lexicon -----------------------------------------------------------------------------
Lexicon = dict[str, list[tuple[str, float]]]


class _Tokens(dict):
    """Token to a number; by it the number of its word and those of up to two marks (a number, or codes of a name), -1 for none."""

    def __init__(self) -> None:
        self.reader = Reader()
        self.words: dict[str, int] = {}
        self.seen: dict[str, int] = {}
        self.word: list[int] = []
        self.marks: list[tuple[int, int]] = []

    def __missing__(self, token: str) -> int:
        number, word, codes = self.reader[token]
        shared = [self.seen.setdefault(x, len(self.seen)) for x in (codes if number is None else ["#" + number])]
        self.word.append(-1 if word is None else self.words.setdefault(word, len(self.words)))
        self.marks.append((*shared, -1, -1)[:2])
        self[token] = out = len(self)
        return out


def _distinct(keys: np.ndarray) -> np.ndarray:
    """In order; ``np.unique`` without what makes it slow here."""
    keys = np.sort(keys)
    return keys[np.append(True, keys[1:] != keys[:-1])[: len(keys)]]


def _bounds(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)]).astype("int64")


def _crossed(at_a: np.ndarray, n_a: np.ndarray, at_b: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All pairs of an element of a stretch of one list and one of the stretch of the other, and the number of the stretches."""
    n = n_a * n_b
    of = np.repeat(np.arange(len(n)), n)
    k, each = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n), n_b[of]
    row = k // each
    return at_a[of] + row, at_b[of] + k - row * each, of


def _tops(group: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which rows are the best of their group, and the score of the next best there."""
    order = np.lexsort((-score, group))
    g, s = np.append(group[order], -1), np.append(score[order], 0.0)
    at = np.flatnonzero(np.append(True, g[1:-1] != g[:-2]))
    top, second = np.zeros(len(group), bool), np.zeros(len(group))
    top[order[at]] = True
    second[order[at]] = np.where(g[at + 1] == g[at], s[at + 1], 0.0)
    return top, second


def _parallel(texts: list[tuple[str, str]], tokens: _Tokens, least: float) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """The sentences that pair beyond doubt: the number of their texts and, for either side, their words' numbers and how many each has.

    It is ``_anchors`` of ``_scores`` without a lexicon, for many texts at once.
    """
    read = []
    for side in (0, 1):
        last, parts, found, counts = None, [], [], []
        for row in texts:
            if row[side] != last:
                last, parts = row[side], [_TOKEN.findall(s) for s in _cleaned(row[side])]
            found += parts
            counts.append(len(parts))
        sizes = np.fromiter(map(len, found), "int64", len(found))
        flat = np.fromiter(map(tokens.__getitem__, chain.from_iterable(found)), "int64", sizes.sum())
        read.append((flat, np.repeat(np.arange(len(found)), sizes), np.repeat(np.arange(len(texts)), counts)))
    word, marks = np.array(tokens.word, "int64"), np.array(tokens.marks, "int64").reshape(-1, 2)
    words, stretches = [], []
    for flat, sentence, text in read:
        own = word[flat]
        keys = _distinct((sentence[own >= 0] << 32) | own[own >= 0])
        words.append((keys & 0xFFFFFFFF, _bounds(np.bincount(keys >> 32, minlength=len(text)))))
        pair = marks[flat]
        at, k = np.nonzero(pair >= 0)
        keys = _distinct((sentence[at] << 32) | pair[at, k])
        of = keys >> 32
        shared = (text[of] << 32) | (keys & 0xFFFFFFFF)
        order = np.argsort(shared, kind="stable")
        stretches.append((of[order], *np.unique(shared[order], return_index=True, return_counts=True)))
    (of_a, keys_a, at_a, n_a), (of_b, keys_b, at_b, n_b) = stretches
    _, a, b = np.intersect1d(keys_a, keys_b, assume_unique=True, return_indices=True)
    i, j, of = _crossed(at_a[a], n_a[a], at_b[b], n_b[b])
    width = np.int64(max(1, len(read[1][2])))
    keys, which = np.unique(of_a[i] * width + of_b[j], return_inverse=True)
    score = np.bincount(which, (3.0 / np.maximum(n_a[a], n_b[b]))[of], len(keys))
    i, j = keys // width, keys % width
    (top_i, next_i), (top_j, next_j) = _tops(i, score), _tops(j, score)
    sure = top_i & top_j & (score >= least) & (score >= 1.3 * np.maximum(next_i, next_j))
    out = []
    for rows, (flat, bounds) in zip((i[sure], j[sure]), words):
        sizes = np.diff(bounds)[rows]
        out.append((flat[np.repeat(bounds[rows] - _bounds(sizes)[:-1], sizes) + np.arange(sizes.sum())], sizes))
    return read[0][2][i[sure]], out


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Keys in order and the sums of their counts."""
    keys, counts = (np.concatenate(x) for x in zip(*parts))
    keys, which = np.unique(keys, return_inverse=True)
    return keys, np.bincount(which, counts, len(keys)).astype("int64")


def _batch(schema: pa.Schema, **columns: list) -> pa.RecordBatch:
    """A batch of the schema; columns that aren't given are NULL."""
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns.get(f.name, [None] * n), f.type) for f in schema], schema=schema)


_SEEN = pa.schema([("pair", pa.string()), ("side", pa.int32()), ("word", pa.string()), ("n", pa.int64()), ("words", pa.list_(pa.string())), ("a", pa.binary()), ("n_a", pa.binary()), ("b", pa.binary()), ("n_b", pa.binary())])
_MET = pa.schema([("pair", pa.string()), ("part", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
#: Characters of texts, and different pairs of words, that a task holds at once.
_CHARACTERS, _HELD = 1_500_000, 3_000_000


def _parallel_words(pages: DataFrame, known: Known, options: Options) -> DataFrame:
    """The words of sentences that pair beyond doubt, by pair of languages, many sentences a row; and rows with the counts of each word of a side."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, int], dict[str, int]] = defaultdict(lambda: defaultdict(int))
        tokens = _Tokens()
        for batch in batches:
            rows, size, last, own = [], 0, None, ""
            names = batch.column(1).to_pylist()
            for k, (lang, source, target) in enumerate(zip(names, batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                if source != last:
                    last, own = source, language(source, known)
                rows.append((own, lang, source, target))
                size += len(source) + len(target)
                if size > _CHARACTERS or k == len(names) - 1:
                    yield from several(rows, tokens, counts)
                    rows, size = [], 0
            if len(tokens) > 500_000:
                tokens = _Tokens()
        for (pair, side), own in counts.items():
            yield _batch(_SEEN, pair=[pair] * len(own), side=[side] * len(own), word=list(own), n=list(own.values()))

    def several(rows: list[tuple[str, str, str, str]], tokens: _Tokens, counts: dict) -> Iterator[pa.RecordBatch]:
        # both directions of a pair of languages are one
        pairs = defaultdict(list)
        for own, lang, source, target in rows:
            pairs[f"{own}-{lang}" if own < lang else f"{lang}-{own}"].append((source, target) if own < lang else (target, source))
        for pair, texts in pairs.items():
            of, sides = _parallel(texts, tokens, options.strong)
            if not len(of):
                continue
            names = list(tokens.words)
            used, where = np.unique(np.concatenate([flat for flat, _ in sides]), return_inverse=True)
            words = [names[x] for x in used.tolist()]
            counts[pair, 1][""] += len(of)
            a, b = np.split(where.astype("int32"), [len(sides[0][0])])
            for side, flat in enumerate((a, b)):
                own, n = counts[pair, side], np.bincount(flat, minlength=len(words))
                for x in np.flatnonzero(n).tolist():
                    own[words[x]] += int(n[x])
            yield _batch(_SEEN, pair=[pair], words=[words], a=[a.tobytes()], n_a=[sides[0][1].astype("int32").tobytes()], b=[b.tobytes()], n_b=[sides[1][1].astype("int32").tobytes()])

    kind = "pair string, side int, word string, n long, words array<string>, a binary, n_a binary, b binary, n_b binary"
    return cut_lineage(pages.mapInArrow(read, kind))


def _associated(seen: DataFrame, alone: dict[tuple[str, int], dict[str, int]], options: Options) -> DataFrame:
    """``pair``, ``a``, ``b``, ``n``, ``association`` of words that are associated, counted over all sentences."""
    able = {}
    for pair in {p for p, _ in alone}:
        # a pair of words meets at most as often as either occurs
        most = alone[pair, 1].get("", 0) / options.least_lift
        able[pair] = [[w for w in sorted(alone.get((pair, side), {})) if w and alone[pair, side][w] <= most] for side in (0, 1)]
    parts = max(16, 2 * seen.rdd.getNumPartitions())
    held = seen.sparkSession.sparkContext.broadcast((able, {k: np.array([alone[k[0], k[1]][w] for w in able[k[0]][k[1]]], "int64") for k in alone}, {p: alone[p, 1].get("", 0) for p in able}))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        able, often, _ = held.value
        numbers = {pair: [{w: k for k, w in enumerate(words)} for words in sides] for pair, sides in able.items()}
        together: dict[str, list[tuple[np.ndarray, np.ndarray]]] = defaultdict(list)
        for batch in batches:
            for row in batch.to_pylist():
                pair = row["pair"]
                if not all(numbers.get(pair, ())):
                    continue
                sides = []
                for own, flat, sizes in zip(numbers[pair], (row["a"], row["b"]), (row["n_a"], row["n_b"])):
                    sizes = np.frombuffer(sizes, "int32")
                    ids = np.array([own.get(w, -1) for w in row["words"]], "int64")[np.frombuffer(flat, "int32")]
                    sizes = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[ids >= 0], minlength=len(sizes))
                    sides.append((ids[ids >= 0], _bounds(sizes)[:-1], sizes))
                (a, at_a, n_a), (b, at_b, n_b) = sides
                i, j, _ = _crossed(at_a, n_a, at_b, n_b)
                x, y = a[i], b[j]
                of_x, of_y = often[pair, 0][x], often[pair, 1][y]
                keep = 2 * np.minimum(of_x, of_y) >= options.least_association * (of_x + of_y)
                keys, counts = np.unique((x[keep] << 32) | y[keep], return_counts=True)
                held_now = together[pair]
                held_now.append((keys, counts))
                if sum(len(k) for k, _ in held_now) > _HELD:
                    held_now[:] = [_summed(held_now)]
                    if len(held_now[0][0]) > _HELD // 2:
                        yield from divided(pair, *held_now.pop(), len(able[pair][0]))
        for pair, found in together.items():
            if found:
                yield from divided(pair, *_summed(found), len(able[pair][0]))

    def divided(pair: str, keys: np.ndarray, counts: np.ndarray, n: int) -> Iterator[pa.RecordBatch]:
        cuts = np.searchsorted(keys, (np.arange(1, parts) * n // parts) << 32)
        for part, (k, c) in enumerate(zip(np.split(keys, cuts), np.split(counts.astype("int32"), cuts))):
            if len(k):
                yield _batch(_MET, pair=[pair], part=[part], keys=[k.tobytes()], counts=[c.tobytes()])

    def judge(table: pa.Table) -> pa.Table:
        able, often, totals = held.value
        pair = table["pair"][0].as_py()
        keys, n = _summed([(np.frombuffer(k.as_py(), "int64"), np.frombuffer(c.as_py(), "int32")) for k, c in zip(table["keys"], table["counts"])])
        x, y = keys >> 32, keys & 0xFFFFFFFF
        of_x, of_y = often[pair, 0][x], often[pair, 1][y]
        association = 2 * n / (of_x + of_y)
        keep = (n >= options.least_together) & (association >= options.least_association) & (n * totals[pair] >= options.least_lift * of_x * of_y)
        rows = [(able[pair][0][u], able[pair][1][v], w, z) for u, v, w, z in zip(*(c[keep].tolist() for c in (x, y, n, association)))]
        rows = [r for r in rows if code_text(r[0]) != code_text(r[1])]
        a, b, n, s = zip(*rows) if rows else ((),) * 4
        return pa.table({"pair": pa.array([pair] * len(rows), pa.string()), "a": pa.array(a, pa.string()), "b": pa.array(b, pa.string()), "n": pa.array(n, pa.int64()), "association": pa.array(s, pa.float64())})

    met = seen.where("words is not null").select("pair", "words", "a", "n_a", "b", "n_b").mapInArrow(meet, "pair string, part int, keys binary, counts binary")
    return met.groupBy("pair", "part").applyInArrow(judge, "pair string, a string, b string, n long, association double")


def _learned(pages: DataFrame, known: Known, options: Options) -> tuple[dict[tuple[str, str], Lexicon], dict[str, set[str]]]:
    """Associated words by pair of languages, and the common words of each language."""
    seen = _parallel_words(pages, known, options)
    alone: dict[tuple[str, int], dict[str, int]] = defaultdict(dict)
    counts = seen.where("word is not null").groupBy("pair", "side", "word").agg(F.sum("n").alias("n")).where((F.col("n") >= options.least_together) | (F.col("word") == ""))
    for pair, side, word, n in zip(*(c.to_pylist() for c in counts.toArrow().columns)):
        alone[pair, side][word] = n
    found: dict[tuple[str, str], dict[str, dict[str, float]]] = defaultdict(lambda: defaultdict(dict))
    if alone:
        best = _associated(seen, alone, options).orderBy(F.desc("n"), "pair", "a", "b").limit(options.lexicon)
        for pair, x, y, _, association in zip(*(c.to_pylist() for c in best.toArrow().columns)):
            first, _, second = pair.partition("-")
            found[first, second][x][y] = association
            found[second, first][y][x] = association
    common: dict[str, set[str]] = defaultdict(set)
    for (pair, side), own in alone.items():
        least = max(options.least_together, alone[pair, 1].get("", 0) * 0.0015)
        common[pair.split("-")[side]].update(word for word, n in own.items() if word and n >= least)
    return {pair: {w: sorted(x.items(), key=lambda v: -v[1])[:8] for w, x in words.items()} for pair, words in found.items()}, dict(common)


def sentence_pairs(df: DataFrame, record: str, source: str, targets: dict[str, str], options: Options = Options()) -> DataFrame:
    """``record``, ``lang``, ``src_no``, ``tgt_no`` of sentences that render one another.

    ``targets`` maps languages to the columns with the translations.  NULL and
    blank texts have no pairs; rows without an id are left out; a page delivered
    twice counts once; one page with two different texts is aligned for each.
    Without pages there are no rows, and without pages to learn from the lexicon
    is empty and numbers and names decide.
    """
    blank = F.lit(r"\S")
    each = F.explode(F.array(*(F.struct(F.lit(lang).alias("lang"), F.col(column).alias("target")) for lang, column in targets.items())))
    rows = df.select(F.col(record).cast("long").alias("record"), F.col(source).alias("source"), each.alias("t")).select("record", "t.lang", "source", "t.target")
    rows = rows.where(F.col("record").isNotNull() & F.rlike("source", blank) & F.rlike("target", blank))
    rows = spread(rows)
    known = _frequent_words(rows)
    held = df.sparkSession.sparkContext.broadcast((*_learned(rows, known, options), known))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, common, known = held.value
        readers: dict[str, Reader] = defaultdict(Reader)
        readers |= {lang: Reader(words) for lang, words in common.items()}
        for batch in batches:
            ids, langs, left, right = [], [], [], []
            last, own, a = None, "", None
            for key, lang, source, target in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if source != last:
                    last, own = source, language(source, known)
                    a = Side(source, readers[own])
                for i, j in align(a, Side(target, readers[lang]), lexicon.get((own, lang), {}), options):
                    ids.append(key)
                    langs.append(lang)
                    left.append(i)
                    right.append(j)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(langs, pa.string()), pa.array(left, pa.int32()), pa.array(right, pa.int32())], ["record", "lang", "src_no", "tgt_no"])

    return rows.mapInArrow(pairs, "record long, lang string, src_no int, tgt_no int").distinct()
