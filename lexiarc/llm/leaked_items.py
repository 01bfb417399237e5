"""Problem 9: evaluation texts inside a corpus, by latent semantic retrieval.

1. Words are hashed to ``features`` columns; their document frequencies are
   counted over the whole corpus and give the inverse document frequencies.  The
   same pass writes the columns of all words once.
2. A randomised singular value decomposition of the TF-IDF passages, of all
   documents and items, is computed in two distributed passes over these columns:
   every task adds its part of A'(A X) for a random, then for an orthonormal X,
   and the parts are summed per block of columns.
   Columns that no item has tell no items apart: they have no weight in what follows.
3. Every passage of every document - a new one begins every ``step`` words - asks
   for all passages of the items with at least ``cosine`` in the latent space.  An
   index of cells over the items' passages leaves out, by a bound on the angle,
   only cells that can't have one.  These are the candidates; nothing else is.
4. Candidates are checked on their words: the longest run of consecutive words
   they share, the longest common subsequence, which also shows paraphrases, and
   the share of the item's answers - its numbers and names - that the passage has.
   A pair that passes is measured over the passage's edges: its run is the longest
   of the whole document, and the other two are those of the passage or, where
   they are more, of the words of the document that lie along the item at that run.

A passage is twice the step long, so a run of at most a step of words lies within
one passage of either side.  Documents are read twice and never shuffled; what
is shuffled are sums of fixed size and the candidates that passed.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, spread
from .similar_vectors import kmeans

_WORD = re.compile(r"[^\W_]+")
_BLOCK = 1024


@dataclass(frozen=True)
class Options:
    """Tunables.

    The decomposition is fitted on all passages of all documents and items; those of
    documents don't overlap there.  ``cosine`` is the least of a candidate.  ``block_words`` bounds the items' words that
    are held at once; items with more are searched in several passes.
    """

    features: int = 8192
    rank: int = 48
    step: int = 16
    item_step: int = 12
    cosine: float = 0.65
    run: int = 15
    paraphrase_cosine: float = 0.75
    paraphrase_answers: float = 0.25
    paraphrase_lcs: float = 0.5
    block_words: int = 4_000_000

    @property
    def width(self) -> int:
        """Words of a passage: two steps."""
        return 2 * self.step


def words(text: str) -> list[str]:
    """Maximal runs of letters and digits, without case."""
    return _WORD.findall(text.lower())


class _Columns(dict):
    """Word to column; a word's column is a hash of its bytes."""

    def __init__(self, features: int) -> None:
        self.features = features

    def __missing__(self, word: str) -> int:
        column = zlib.crc32(word.encode("utf-8", "surrogatepass")) % self.features
        if len(self) < 2_000_000:
            self[word] = column
        return column


def _starts(n: int, width: int, step: int) -> np.ndarray:
    """Where passages of a text of n words begin; the last one reaches its end."""
    if n <= width:
        return np.zeros(min(n, 1), "int64")
    return np.unique(np.append(np.arange(0, n - width + 1, step), n - width))


def _columns_of(passages: DataFrame, options: Options) -> np.ndarray:
    """Whether any of the passages has a column."""

    def used(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(options.features, bool)
        for batch in batches:
            for flat in batch.column(0).to_pylist():
                seen[np.frombuffer(flat, _kind(options))] = True
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(seen), pa.int64())], ["column"])

    out = np.zeros(options.features, bool)
    out[[r["column"] for r in passages.mapInArrow(used, "column long").distinct().collect()]] = True
    return out


#: Characters of texts whose words are held at once.
_CHARACTERS = 1_000_000


def _chunks(texts: list[str]) -> Iterator[list[list[str]]]:
    """The words of each text, some texts at a time."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size > _CHARACTERS or i == len(texts) - 1:
            yield [words(t) for t in texts[start : i + 1]]
            start, size = i + 1, 0


def _counted(docs: DataFrame, options: Options) -> tuple[np.ndarray, int, DataFrame]:
    """Documents per column, their number, and all passages: ``words``, ``sizes``, the columns of many passages in a row and how many each has.

    A new passage begins where the last one ends; the last one of a document can be shorter.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns, seen = _Columns(options.features), np.zeros(options.features + 1, "int64")
        for batch in batches:
            for tokens in _chunks(batch.column(0).to_pylist()):
                n = np.fromiter(map(len, tokens), "int64", len(tokens))
                n, of = n[n > 0], int(n.sum())
                if not of:
                    continue
                flat = np.fromiter(map(columns.__getitem__, chain.from_iterable(tokens)), "int64", of)
                keys = np.sort(np.repeat(np.arange(len(n)), n) * options.features + flat)
                keys = keys[np.append(True, keys[1:] != keys[:-1])]
                seen[:-1] += np.bincount(keys % options.features, minlength=options.features)
                seen[-1] += len(n)
                passages = -(-n // options.width)
                sizes = np.full(passages.sum(), options.width, "int64")
                sizes[np.cumsum(passages) - 1] = n - (passages - 1) * options.width
                yield _counts([], [], [(flat, sizes)], options)
        used = np.flatnonzero(seen)
        yield _counts(used, seen[used], [], options)

    out = cut_lineage(docs.select("text").mapInArrow(count, "column long, n long, words binary, sizes binary"))
    sums = out.where("column is not null").groupBy("column").agg(F.sum("n").alias("n")).toPandas()
    seen = np.zeros(options.features + 1, "int64")
    seen[sums["column"].to_numpy("int64")] = sums["n"].to_numpy("int64")
    return seen[:-1], int(seen[-1]), out.where("words is not null").select("words", "sizes")


def _counts(column: np.ndarray | list, n: np.ndarray | list, passages: list[tuple[np.ndarray, np.ndarray]], options: Options) -> pa.RecordBatch:
    rest, own = [None] * len(passages), [None] * len(column)
    columns = [pa.array([*column, *rest], pa.int64()), pa.array([*n, *rest], pa.int64())]
    columns += [pa.array(own + list(x), pa.binary()) for x in zip(*(_packed(*p, options) for p in passages))] or [pa.array(own, pa.binary())] * 2
    return pa.RecordBatch.from_arrays(columns, ["column", "n", "words", "sizes"])


def _packed(flat: np.ndarray, sizes: np.ndarray, options: Options) -> tuple[bytes, bytes]:
    return flat.astype(_kind(options)).tobytes(), sizes.astype("int32").tobytes()


def _kind(options: Options) -> str:
    """The type that holds a column."""
    return "uint16" if options.features <= 1 << 16 else "int32"


def _item_passages(items: DataFrame, options: Options) -> DataFrame:
    """``words``, ``sizes`` as columns, of all passages of all items."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = _Columns(options.features)
        for batch in batches:
            for tokens in _chunks(batch.column(1).to_pylist()):
                coded = [np.array([columns[w] for w in t], "int64") for t in tokens]
                parts = [t[s : s + options.width] for t in coded for s in _starts(len(t), options.width, options.item_step)]
                if parts:
                    flat, sizes = _packed(np.concatenate(parts), np.array([len(p) for p in parts]), options)
                    yield pa.RecordBatch.from_arrays([pa.array([flat], pa.binary()), pa.array([sizes], pa.binary())], ["words", "sizes"])

    return items.mapInArrow(cut, "words binary, sizes binary")


def _gram_product(flat: np.ndarray, sizes: np.ndarray, weights: np.ndarray, scaled: np.ndarray, out: np.ndarray) -> None:
    """Add to ``out`` A'(A x) of passages of length 1, given as the columns of all and how many each has.

    ``scaled`` is x times the weights; ``out`` is yet to be multiplied by them.
    """
    bounds = np.cumsum(sizes) - sizes
    squares = np.add.reduceat(weights[flat] ** 2, bounds)
    y = np.add.reduceat(scaled[flat], bounds, axis=0) / np.maximum(squares, 1e-18)[:, None]
    order = np.argsort(flat, kind="stable")
    column = flat[order]
    first = np.flatnonzero(np.append(True, column[1:] != column[:-1]))
    out[column[first]] += np.add.reduceat(y[np.repeat(np.arange(len(sizes)), sizes)[order]], first, axis=0)


def _distributed_product(passages: DataFrame, weights: np.ndarray, x: np.ndarray, options: Options) -> tuple[np.ndarray, int]:
    """A'(A x) and the number of passages: parts of fixed size per task, summed by block of columns."""
    held = passages.sparkSession.sparkContext.broadcast((weights, x))
    width = x.shape[1]

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, basis = held.value
        scaled = basis * w[:, None]
        out, n = np.zeros_like(basis), 0
        for batch in batches:
            for flat, sizes in zip(*(c.to_pylist() for c in batch.columns)):
                flat, sizes = np.frombuffer(flat, _kind(options)), np.frombuffer(sizes, "int32")
                bounds = np.append(0, np.cumsum(sizes, dtype="int64"))
                for i in range(0, len(sizes), 1500):
                    part = sizes[i : i + 1500]
                    _gram_product(flat[bounds[i] : bounds[i + len(part)]], part, w, scaled, out)
                n += len(sizes)
        out *= w[:, None]
        starts = range(0, options.features, _BLOCK)
        yield pa.RecordBatch.from_arrays([pa.array(starts, pa.int64()), pa.array([out[i : i + _BLOCK].tobytes() for i in starts]), pa.array([n] * len(starts))], ["block", "sums", "n"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(b.as_py(), "float32").astype("float64") for b in table["sums"])
        return pa.table({"block": table["block"].slice(0, 1), "sums": pa.array([total.astype("float32").tobytes()], pa.binary()), "n": pa.array([sum(table["n"].to_pylist())])})

    kind = "block long, sums binary, n long"
    out, n = np.zeros_like(x), 0
    for r in passages.mapInArrow(part, kind).groupBy("block").applyInArrow(add, kind).collect():
        out[r["block"] : r["block"] + _BLOCK] = np.frombuffer(bytes(r["sums"]), "float32").reshape(-1, width)
        n = r["n"]
    return out, n


def latent_space(passages: DataFrame, own: DataFrame, weights: np.ndarray, options: Options, seed: int = 1) -> np.ndarray:
    """Columns by ``rank``: right singular vectors of the TF-IDF passages.

    The items' passages weigh as much as the corpus's, so that the space spans what is searched for.
    """
    x = np.random.default_rng(seed).standard_normal((options.features, options.rank + 16)).astype("float32")
    for _ in range(2):
        q, _ = np.linalg.qr(x)
        q = q.astype("float32")
        x, n = _distributed_product(passages, weights, q, options)
        mine, n_own = _distributed_product(own, weights, q, options)
        x += np.float32(max(1.0, n / max(1, n_own))) * mine
    # x = A'A q, so q'x is the Gram matrix in the found space
    values, vectors = np.linalg.eigh((q.T @ x + x.T @ q) / 2)
    return (q @ vectors[:, np.argsort(-values)[: options.rank]]).astype("float32")


def _longest_run(a: list[int], b: list[int]) -> tuple[int, int, int]:
    """Longest run of consecutive equal elements, and where it begins in either list; the first of several."""
    best, before = (0, 0, 0), {}
    where = defaultdict(list)
    for j, y in enumerate(b):
        where[y].append(j)
    for i, x in enumerate(a):
        now = {j: before.get(j - 1, 0) + 1 for j in where.get(x, ())}
        for j, n in now.items():
            if n > best[0]:
                best = n, i - n + 1, j - n + 1
        before = now
    return best


def _common_subsequence(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, on the bits of integers."""
    masks: dict[int, int] = defaultdict(int)
    for i, x in enumerate(a):
        masks[x] |= 1 << i
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        hit = row & masks.get(y, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


class _Hashes(dict):
    """Word to a hash of its bytes that is the same in every process."""

    def __missing__(self, word: str) -> int:
        code = zlib.crc32(word.encode("utf-8", "surrogatepass"))
        if len(self) < 2_000_000:
            self[word] = code
        return code


class _Items:
    """The passages of a block of items, in cells of the latent space."""

    def __init__(self, keys: list[int], texts: list[str], scaled: np.ndarray, options: Options) -> None:
        self.keys = keys
        self.codes = _Hashes()
        self.words = [words(t) for t in texts]
        starts = [(j, s) for j, t in enumerate(self.words) for s in _starts(len(t), options.width, options.item_step)]
        coded = [np.array([self.codes[w] for w in t], "int64") for t in self.words]
        vectors = [scaled[coded[j][s : s + options.width] % options.features].sum(0) for j, s in starts]
        vectors = _rows_to_unit(np.array(vectors, "float32").reshape(-1, scaled.shape[1]))
        owner = np.array([j for j, _ in starts], "int64")
        # cells of passages: which one a text's passage can be near to is told by its angle to the centre
        self.centers = _rows_to_unit(kmeans(vectors, round(len(vectors) ** 0.5), 6, 3)) if len(vectors) else vectors
        near = np.argmax(vectors @ self.centers.T, axis=1) if len(vectors) else owner
        self.cells = [(vectors[near == c], owner[near == c]) for c in range(len(self.centers))]
        self.radii = np.array([_angles(v @ c).max() if len(v) else -np.inf for (v, _), c in zip(self.cells, self.centers)])
        # the items' words, each row filled up with what no passage has
        self.sizes = np.array([len(c) for c in coded], "int64")
        self.table = np.full((len(coded), int(self.sizes.max(initial=1))), -2, "int64")
        for j, c in enumerate(coded):
            self.table[j, : len(c)] = c
        answers = [{w for w in t if any(c.isdigit() for c in w)} | {w.lower() for w in re.findall(r"(?<=[^\W\d_]\s)[A-ZÀ-Þ][^\W\d_]+", text)} for t, text in zip(self.words, texts)]
        self.answers = answers

    def near(self, passages: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(passage, item, cosine) of all pairs with a passage of the item that reaches the least cosine; the best one."""
        none = np.zeros(0, "int64")
        found = [(none, none, np.zeros(0, "float32"))]
        reach = _angles(passages @ self.centers.T) <= self.radii[None, :] + np.arccos(least) + 1e-3
        for c in np.flatnonzero(reach.any(axis=0)):
            vectors, owner = self.cells[c]
            at = np.flatnonzero(reach[:, c])
            cosines = passages[at] @ vectors.T
            row, col = np.nonzero(cosines >= least)
            found.append((at[row], owner[col], cosines[row, col]))
        row, item, cosine = (np.concatenate(v) for v in zip(*found))
        order = np.lexsort((-cosine, item, row))
        row, item, cosine = row[order], item[order], cosine[order]
        first = np.append(True, (row[1:] != row[:-1]) | (item[1:] != item[:-1])) if len(row) else np.zeros(0, bool)
        return row[first], item[first], cosine[first]


def _angles(cosines: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosines, -1, 1))


def _rows_to_unit(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt((x**2).sum(1, keepdims=True))
    return x / np.maximum(norm, 1e-9)


def _runs_of_pairs(passages: np.ndarray, items: np.ndarray) -> np.ndarray:
    """For each pair of rows the longest run of consecutive equal entries."""
    now, best = np.zeros(items.shape, "int16"), np.zeros(items.shape, "int16")
    for i in range(passages.shape[1]):
        before, now = now, np.zeros(items.shape, "int16")
        now[:, 1:] = before[:, :-1]
        now += 1
        now *= items == passages[:, i, None]
        np.maximum(best, now, out=best)
    return best.max(axis=1, initial=0)


def search_texts(keys: list[int], texts: list[str], items: _Items, scaled: np.ndarray, options: Options) -> list[tuple]:
    """(doc, item, cosine, run, lcs, answers) of each candidate pair that passes: its best passage, measured over its edges.

    ``scaled`` are the latent vectors of columns times their weights.
    """
    codes = items.codes
    tokens = [words(t) for t in texts]
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in tokens])])
    if not bounds[-1] or not len(items.centers):
        return []
    flat = np.fromiter(map(codes.__getitem__, chain.from_iterable(tokens)), "int64", bounds[-1])
    # a passage is a step of words and the next one; each step is summed once
    sizes = np.diff(bounds)
    steps = -(-sizes // options.step)
    of_step = np.repeat(np.arange(len(sizes)), steps)
    nth = np.arange(len(of_step)) - np.repeat(np.cumsum(steps) - steps, steps)
    sums = np.add.reduceat(scaled[flat % options.features], bounds[of_step] + nth * options.step, axis=0)
    two = np.zeros(len(of_step), bool)
    two[:-1] = of_step[:-1] == of_step[1:]
    sums[:-1] += np.where(two[:-1, None], sums[1:], 0)
    chosen = np.flatnonzero(two | (nth == 0))  # the last step alone only in a text of one
    owner, first = of_step[chosen], nth[chosen] * options.step
    passages = _rows_to_unit(sums[chosen])
    passing: dict[tuple[int, int], tuple] = {}
    for i in range(0, len(passages), 1024):
        row, item, cosine = items.near(passages[i : i + 1024], options.cosine)
        size = max(1, 400_000 // (items.table.shape[1] * options.width))
        for k in range(0, len(row), size):
            p, j, c = row[k : k + size] + i, item[k : k + size], cosine[k : k + size]
            places = first[p, None] + np.arange(options.width)
            inside = places < sizes[owner[p], None]
            window = np.where(inside, flat[np.where(inside, bounds[owner[p], None] + places, 0)], -1)
            for run, *pair in zip(_runs_of_pairs(window, items.table[j]).tolist(), p.tolist(), j.tolist(), c.tolist()):
                _judge(run, *pair, int(owner[pair[0]]), int(first[pair[0]]), tokens, items, passing, options)
    out = []
    for (d, j), (_, lcs, c, share) in passing.items():
        item, answers = items.words[j], items.answers[j]
        run, at, of = _longest_run(tokens[d], item)
        along = tokens[d][max(0, at - of) : at - of + len(item)]
        share = max(share, len(answers.intersection(along)) / len(answers) if answers else 0.0)
        out.append((keys[d], items.keys[j], float(c), run, max(lcs, _common_subsequence(along, item)), float(share)))
    return out


def _judge(run: int, p: int, j: int, cosine: float, d: int, a: int, tokens: list[list[str]], items: _Items, passing: dict[tuple[int, int], tuple], options: Options) -> None:
    """Keep a candidate that has the run, or that is likely a paraphrase: cosine, answers and common subsequence."""
    verbatim = run >= options.run
    if not verbatim and cosine < options.paraphrase_cosine:
        return
    passage, answers = tokens[d][a : a + options.width], items.answers[j]
    share = len(answers.intersection(passage)) / len(answers) if answers else 0.0
    if not verbatim and share < options.paraphrase_answers:
        return
    lcs = _common_subsequence(passage, items.words[j])
    if verbatim or lcs >= options.paraphrase_lcs * len(passage):
        passing[d, j] = max((run, lcs, cosine, share), passing.get((d, j), (-1,)))


def leaks(docs: DataFrame, record: str, text: str, items: DataFrame, item: str, item_text: str, options: Options = Options()) -> DataFrame:
    """Documents and the items they hold: ``record``, ``item``, ``cosine``, ``run``, ``lcs``, ``answers``.

    One row per candidate pair of a document and an item: pairs with a run of
    ``options.run`` words, and likely paraphrases, with the figures of the best
    passage; ``run`` is the longest of the whole document.  NULL and empty texts on either side give none, nor do rows without
    an id; rows delivered twice count once; an item shorter than the run can only
    be found as a paraphrase.
    """
    if options.step < options.run - 1:
        raise ValueError("a passage must hold a whole run wherever it begins")
    spark = docs.sparkSession
    rows = docs.select(F.col(record).cast("long").alias("record"), F.col(text).alias("text")).where(F.col("record").isNotNull() & (F.length("text") > 0))
    rows = spread(rows)
    asked = items.select(F.col(item).cast("long").alias("item"), F.col(item_text).alias("text")).where(F.col("item").isNotNull() & (F.length("text") > 0)).groupBy("item").agg(F.min("text").alias("text"))
    asked = cut_lineage(asked)
    n_words = asked.agg(F.sum(F.size(F.split("text", " ")))).first()[0] or 0
    frequency, n_docs, passages = _counted(rows, options)
    weights = np.log((1 + n_docs) / (1 + frequency)).astype("float32") + np.float32(1)
    own = _item_passages(asked, options)
    # words that no item has tell no items apart, and are left out where a passage is compared with them
    scaled = latent_space(passages, own, weights, options) * (weights * _columns_of(own, options))[:, None]
    blocks, out = 1 + n_words // options.block_words, None
    for b in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("item", F.lit(31)), F.lit(blocks)) == b).orderBy("item").collect()
        held = spark.sparkContext.broadcast(([r["item"] for r in block], [r["text"] for r in block], scaled))

        def search(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            # made in the task: hashes of words differ from process to process
            item_keys, item_texts, vectors = held.value
            prepared = _Items(item_keys, item_texts, vectors, options)
            for batch in batches:
                keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                start = size = 0
                for i, t in enumerate(texts):
                    size += len(t)
                    if size > 300_000 or i == len(texts) - 1:
                        yield _found_batch(search_texts(keys[start : i + 1], texts[start : i + 1], prepared, vectors, options))
                        start, size = i + 1, 0

        part = rows.mapInArrow(search, "record long, item long, cosine double, run int, lcs int, answers double")
        out = part if out is None else out.unionByName(part)
    best = F.max(F.struct("run", "lcs", "cosine", "answers")).alias("b")
    return out.groupBy("record", "item").agg(best).select("record", "item", "b.cosine", "b.run", "b.lcs", "b.answers")


def _found_batch(rows: list[tuple]) -> pa.RecordBatch:
    names = ["record", "item", "cosine", "run", "lcs", "answers"]
    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.float64()]
    columns = list(zip(*rows)) if rows else [()] * 6
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names)
