"""Problem 2: the k most similar vectors of every vector, by additive quantisation.

Training (driver, on a bounded sample): codebooks of full-dimensional residual
centroids.  The first has as many centroids as the collection asks for, the
others a fixed number; these are then fitted again together, by least squares over
the sums that the beam search chose, so that a book corrects the others.

Encoding (executors): beam search.  A vector keeps its ``beam`` best partial
sums through all codebooks; the best one gives its codes and the norm of its
reconstruction is stored.  The first codebook's centroids are the cells of an
inverted index: a vector is stored in its own cell and asks the nearest cells.

Search (executors, one group per cell): a query scores the vectors of a cell by
adding table entries - its products with all centroids - at their codes and
divides by the stored norms.  The best candidates of a cell are scored again with
the exact vectors.  Every vector travels once to each cell it asks, nothing
else does; results are (vector, neighbour, cosine) and per-vector top k.

Vectors of exactly one direction are one vector in the index: only the copy with
the least id is stored, so a group of copies of any size costs one row.  The
first codebook is fitted to the density of the collection, so a dense region has
many cells.  A cell that is still expected to exceed ``cell_rows`` is divided.
With ``min_cosine`` the second codebook divides it, so that what a query is
compared with doesn't grow with the collection.  Without, neighbours lie anywhere
in a cell: it is cut into blocks of stored vectors and of queries, and every block
of the one meets every block of the other, so that the same share of a collection
of any size is searched, in groups of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut_lineage


@dataclass(frozen=True)
class Options:
    """Tunables; the defaults hold for hundreds of millions of vectors.

    ``sample_rows`` bounds the rows that the codebooks are fitted on; every row
    is indexed.  ``cell_mean`` is the wished mean size of a cell while
    ``max_cells`` allows it, ``cell_rows`` the size above which one is divided.
    ``probes`` cells are searched for every vector, or ``probe_scale`` times the root of
    the number of cells if that is more, so that what is searched grows more slowly than the collection
    while cells can be added.  Of a divided cell ``sub_probes``
    parts are searched if there is a ``min_cosine``, else all of it.  The best
    ``shortlist_share`` of a cell or block by table score, but at least ``shortlist``
    and twice ``k``, are scored exactly.
    """

    dim: int = 64
    sample_rows: int = 24_000
    cell_mean: int = 400
    max_cells: int = 4096
    cell_rows: int = 6000
    probes: int = 4
    probe_scale: float = 0.0
    sub_probes: int = 12
    books: int = 4
    book_size: int = 64
    beam: int = 4
    shortlist: int = 12
    shortlist_share: float = 0.03
    rounds: int = 8

    def probed(self, cells: int) -> int:
        """How many of the cells a query asks."""
        return min(cells, max(self.probes, round(self.probe_scale * cells**0.5)))


@dataclass
class Codebooks:
    """Residual centroids; ``first`` are the cells, ``others`` refine."""

    first: np.ndarray
    others: list[np.ndarray] = field(default_factory=list)

    def encode(self, x: np.ndarray, beam: int, probes: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Beam search: codes (n, books), reconstructions (n, dim), nearest cells (n, probes).

        A hypothesis is a partial sum of centroids.  The error of one more
        centroid c is |r|^2 - 2 r.c + |c|^2 for the residual r.
        """
        n = len(x)
        width, reach = min(beam, len(self.first)), min(max(beam, probes), len(self.first))
        error = (self.first**2).sum(1)[None, :] - 2 * (x @ self.first.T)
        cells = np.argpartition(error, reach - 1, axis=1)[:, :reach] if reach < len(self.first) else np.tile(np.arange(reach), (n, 1))
        cells = np.take_along_axis(cells, np.argsort(np.take_along_axis(error, cells, 1), axis=1, kind="stable"), 1)
        best = cells[:, :width]
        score = np.take_along_axis(error, best, 1)
        residual = x[:, None, :] - self.first[best]
        codes = best[:, :, None].astype("int32")
        for book in self.others:
            step = (book**2).sum(1)[None, None, :] - 2 * (residual @ book.T)
            total = (score[:, :, None] + step).reshape(n, -1)
            keep = np.argpartition(total, width - 1, axis=1)[:, :width] if total.shape[1] > width else np.tile(np.arange(total.shape[1]), (n, 1))
            keep = np.take_along_axis(keep, np.argsort(np.take_along_axis(total, keep, 1), axis=1, kind="stable"), 1)
            parent, word = keep // len(book), keep % len(book)
            residual = np.take_along_axis(residual, parent[:, :, None], 1) - book[word]
            codes = np.concatenate([np.take_along_axis(codes, parent[:, :, None], 1), word[:, :, None].astype("int32")], axis=2)
            score = np.take_along_axis(total, keep, 1)
        return codes[:, 0], x - residual[:, 0], cells


def kmeans(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """Lloyd's rounds from a random start; empty centroids are drawn again."""
    rng = np.random.default_rng(seed)
    k = max(1, min(k, len(x)))
    centers = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        owner = np.empty(len(x), "int64")
        half = (centers**2).sum(1) / 2
        for s in range(0, len(x), 8192):
            owner[s : s + 8192] = np.argmax(x[s : s + 8192] @ centers.T - half, axis=1)
        counts = np.bincount(owner, minlength=k)
        order = np.argsort(owner, kind="stable")
        bounds = np.concatenate([[0], np.cumsum(counts)])[:-1]
        used = counts > 0
        centers[used] = np.add.reduceat(x[order], bounds[used], axis=0) / counts[used][:, None]
        if not used.all():
            centers[~used] = x[rng.choice(len(x), int((~used).sum()))]
    return centers.astype("float32")


def train(sample: np.ndarray, rows: int, options: Options, seed: int = 7) -> Codebooks:
    """Codebooks of a sample of unit vectors for a collection of ``rows``."""
    if not len(sample):
        return Codebooks(np.zeros((1, options.dim), "float32"))
    cells = int(np.clip(rows // options.cell_mean, 1, options.max_cells))
    books = Codebooks(kmeans(sample, cells, options.rounds, seed))
    _, near, _ = books.encode(sample, 1)
    residual = sample - near
    for i in range(options.books - 1):
        book = kmeans(residual, options.book_size, options.rounds, seed + i + 1)
        _, near, _ = Codebooks(book).encode(residual, 1)
        residual = residual - near
        books.others.append(book)
    if books.others:
        _refit(books, sample, options)
    return books


def _refit(books: Codebooks, sample: np.ndarray, options: Options) -> None:
    """All books but the first anew: the least squares of what remains of the sample, given the codes of the beam search."""
    codes = np.concatenate([books.encode(sample[s : s + 4096], options.beam)[0] for s in range(0, len(sample), 4096)])
    rest = (sample - books.first[codes[:, 0]]).astype("float64")
    ends = np.cumsum([0] + [len(b) for b in books.others])
    gram, target = np.zeros((ends[-1], ends[-1])), np.zeros((ends[-1], rest.shape[1]))
    for i, a in enumerate(books.others):
        own = codes[:, i + 1]
        order = np.argsort(own, kind="stable")
        used, first = np.unique(own[order], return_index=True)
        target[ends[i] + used] = np.add.reduceat(rest[order], first, axis=0)
        for j, b in enumerate(books.others):
            both = np.bincount(own * len(b) + codes[:, j + 1], minlength=len(a) * len(b))
            gram[ends[i] : ends[i + 1], ends[j] : ends[j + 1]] = both.reshape(len(a), len(b))
    # a small weight on the books as they are: sums of books are known up to what one takes from another
    weight = 1e-3 * len(sample) / ends[-1]
    before = np.concatenate(books.others)
    solved = np.linalg.solve(gram + weight * np.eye(ends[-1]), target + weight * before).astype("float32")
    books.others = [solved[a:b] for a, b in zip(ends, ends[1:])]


_VISITS = "kind string, id long, v array<float>, codes array<int>, norm float, asks boolean, stored boolean, cell int, part int"
_FOUND = "kind string, id long, other long, cosine double"


def _matrix(column: pa.Array | pa.ChunkedArray, width: int, kind: str = "float32") -> np.ndarray:
    """A list column whose lists all have ``width`` entries."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, width), kind)
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(len(column), width)


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    width = values.shape[1]
    return pa.ListArray.from_arrays(pa.array(np.arange(0, (len(values) + 1) * width, width), pa.int32()), pa.array(values.ravel(), kind))


def _codes(codes: np.ndarray, stored: np.ndarray) -> pa.Array:
    """Codes of the rows that are stored; those that only ask need none."""
    ends = np.concatenate([[0], np.cumsum(np.where(stored, codes.shape[1], 0))])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(codes[stored].ravel(), pa.int32()))


def _unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows that have a direction, scaled to length 1; which rows those are."""
    norm = np.sqrt((x.astype("float64") ** 2).sum(1))
    good = np.isfinite(norm) & (norm > 0)
    return (x[good] / norm[good, None]).astype("float32"), good


def vectors(df: DataFrame, record: str, vector: str, kind: str, dim: int = 64) -> DataFrame:
    """``kind``, ``id`` and ``v`` of the rows that can take part.

    NULL vectors, those of another length or with a NULL entry, and rows without
    an id don't; all-zero vectors and entries that aren't finite are left out
    when the direction is computed.
    """
    v = F.col(vector)
    rows = df.select(F.lit(kind).alias("kind"), F.col(record).cast("long").alias("id"), v.cast("array<float>").alias("v"))
    return rows.where(F.col("id").isNotNull() & (F.size("v") == dim) & ~F.exists("v", lambda x: x.isNull()))


def _direction_keys(rows: DataFrame, dim: int) -> DataFrame:
    """``kind``, ``id`` and 128 bits of the direction."""
    odd = np.random.default_rng(3).integers(1, 2**62, (2, dim), dtype="int64") * 2 + 1

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, good = _unit(_matrix(batch.column(2), dim))
            # to the accuracy that single precision leaves after scaling
            bits = np.rint(x.astype("float64") * 1e6).astype("int64")
            with np.errstate(over="ignore"):
                low, high = (bits * odd[0]).sum(1), (bits * odd[1]).sum(1)
            mask = pa.array(good)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask), pa.array(low), pa.array(high)], ["kind", "id", "h1", "h2"])

    return rows.mapInArrow(keys, "kind string, id long, h1 long, h2 long").distinct()


def _copies(keys: DataFrame) -> DataFrame:
    """``kind``, ``first``, ``id`` of all members of directions with several records."""
    several = keys.groupBy("kind", "h1", "h2").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return keys.join(several, ["kind", "h1", "h2"]).select("kind", "first", "id")


def neighbours(rows: DataFrame, k: int, *, min_cosine: float | None = None, queries: Column | None = None, options: Options = Options()) -> DataFrame:
    """The ``k`` most similar vectors of the same kind: ``kind``, ``id``, ``other``, ``cosine``.

    ``rows`` are those of ``vectors``.  Ties, cosines equal to six
    digits, go to the smaller id.  With ``min_cosine`` only neighbours that reach
    it are looked for.  ``queries`` restricts whose neighbours are wanted; all
    rows are searched.  A row delivered twice counts once; of one id with two vectors both take part, and
    the better cosine counts.  No vectors give no rows.
    """
    spark = rows.sparkSession
    wanted = F.lit(True) if queries is None else queries
    keys = cut_lineage(_direction_keys(rows, options.dim))  # 32 bytes a row
    copies = cut_lineage(_copies(keys))
    extra = copies.where("id <> first").select("kind", "id")
    n_extra = extra.count()
    index = rows.withColumn("asks", wanted)
    if n_extra:
        # a copy's queries are asked by the first of its group
        asked_by = copies.where(wanted).select("kind", F.col("first").alias("id"), F.lit(True).alias("__asked")).distinct()
        small = n_extra <= 500_000  # ids of 16 bytes: at most some 20 MB are broadcast
        hint = F.broadcast if small else (lambda df: df)
        index = index.join(hint(extra), ["kind", "id"], "left_anti").join(hint(asked_by), ["kind", "id"], "left")
        index = index.select("kind", "id", "v", (F.col("asks") | F.col("__asked").isNotNull()).alias("asks"))
    total, asking = keys.agg(F.count(F.lit(1)), F.count(F.when(wanted, 1))).first()
    # a bounded sample, drawn by hash so that it doesn't depend on the order of rows
    share = min(1.0, 1.1 * options.sample_rows / max(1, total))
    drawn = rows.where(F.pmod(F.xxhash64("id", "kind", F.lit(11)), F.lit(1_000_000)) < round(share * 1_000_000)).select("v").limit(options.sample_rows)
    sample, _ = _unit(_matrix(drawn.toArrow().column(0), options.dim))
    books = train(sample, total, options)
    # the expected size of each cell decides whether it is divided
    probes = options.probed(len(books.first))
    coded = [books.encode(sample[s : s + 4096], 1, probes) for s in range(0, len(sample), 4096)]
    parts = _parts([codes[:, 0] for codes, _, _ in coded], total, len(sample), books, options)
    # without a least cosine the queries of a cell are divided, too, and meet all that is stored there
    turns = _parts([cells[:, :probes].ravel() for _, _, cells in coded], asking, len(sample), books, options) if min_cosine is None else None
    held = spark.sparkContext.broadcast((books, parts, turns))

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 1024):  # bounds the hypotheses held at once
                yield _visits(batch.slice(s, 1024), *held.value, options)

    def search(table: pa.Table) -> pa.Table:
        return _search_cell(table, held.value[0], k, min_cosine, options)

    spread = index.select("kind", "id", "v", "asks").mapInArrow(visits, _VISITS)
    found = spread.groupBy("kind", "cell", "part").applyInArrow(search, _FOUND)
    if queries is None:  # a pair found from one side is a candidate for both
        sides = F.array(F.struct("id", "other"), F.struct(F.col("other").alias("id"), F.col("id").alias("other")))
        found = found.select("kind", F.explode(sides).alias("s"), "cosine").select("kind", "s.id", "s.other", "cosine")
    found = found.groupBy("kind", "id", "other").agg(F.max("cosine").alias("cosine"))
    if n_extra:
        # other directions behind the first k can't give one of the k records: each has a record of its own before theirs
        found = _expanded(_first_k(found, k), copies, k)
    return _first_k(found.where(wanted), k)


def _first_k(found: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("kind", "id").orderBy(F.desc(F.round("cosine", 6)), F.col("other")))
    return found.withColumn("place", place).where(F.col("place") <= k).select("kind", "id", "other", "cosine")


def _parts(cells: list[np.ndarray], total: int, drawn: int, books: Codebooks, options: Options) -> np.ndarray:
    """In how many parts of ``cell_rows`` each cell is divided, by the cells of a sample."""
    expected = np.bincount(np.concatenate([*cells, np.zeros(0, "int64")]), minlength=len(books.first)) * (total / max(1, drawn))
    return np.maximum(1, np.ceil(expected / options.cell_rows)).astype("int64")


def _visits(batch: pa.RecordBatch, books: Codebooks, parts: np.ndarray, turns: np.ndarray | None, options: Options) -> pa.RecordBatch:
    """A row for each cell a vector is stored in or asks."""
    x, good = _unit(_matrix(batch.column(2), options.dim))
    mask = pa.array(good)
    kind, ids, asks = batch.column(0).filter(mask), batch.column(1).filter(mask), batch.column(3).filter(mask).to_numpy(zero_copy_only=False).astype(bool)
    n = len(x)
    codes, near, cells = books.encode(x, options.beam, options.probed(len(books.first))) if n else (np.zeros((0, 1 + len(books.others)), "int32"), x, np.zeros((0, 1), "int64"))
    own = codes[:, 0].astype("int64")
    # (row, cell) once each: the own cell, and for queries the nearest ones
    pairs = np.concatenate([own[:, None], np.where(asks[:, None], cells[:, : options.probed(len(books.first))], own[:, None])], axis=1)
    row, cell = np.unique(np.stack([np.repeat(np.arange(n), pairs.shape[1]), pairs.ravel()], 1), axis=0).T if n else (np.zeros(0, "int64"), np.zeros(0, "int64"))
    number = ids.to_numpy(zero_copy_only=False).astype("int64")
    if turns is None:
        row, cell, sub, own_sub = _sub_cells(x, codes, own, asks, row, cell, books, parts, options)
        # blocks of what is still too large: a stored row lies in one, a query visits all
        blocks = _blocks(parts, books)[cell]
        times = np.where(asks[row], blocks, 1)
        home = (number[row] * 0x9E3779B1 >> 7) % blocks
        row, cell, sub, own_sub, home, first = (np.repeat(v, times) for v in (row, cell, sub, own_sub, home, np.cumsum(times) - times))
        block = np.where(asks[row], np.arange(len(row)) - first, home)
        stored = (cell == own[row]) & (sub == own_sub) & (block == home)
        part = sub * (int(_blocks(parts, books).max()) if len(parts) else 1) + block
        asked = asks[row]
    else:
        row, cell, part, stored, asked = _grid(number, own, asks, row, cell, parts, turns)
    take = pa.array(row)
    return pa.RecordBatch.from_arrays(
        [
            kind.take(take), ids.take(take), _lists(x[row], pa.float32()), _codes(codes[row].astype("int32"), stored),
            pa.array(np.linalg.norm(near, axis=1)[row], pa.float32()), pa.array(asked), pa.array(stored), pa.array(cell, pa.int32()), pa.array(part, pa.int32()),
        ],
        ["kind", "id", "v", "codes", "norm", "asks", "stored", "cell", "part"],
    )


def _grid(number: np.ndarray, own: np.ndarray, asks: np.ndarray, row: np.ndarray, cell: np.ndarray, parts: np.ndarray, turns: np.ndarray) -> tuple[np.ndarray, ...]:
    """Visits of the blocks of each cell: ``parts`` of stored vectors by ``turns`` of queries.

    A stored row lies in one block and meets all turns of queries, a query has
    one turn and meets all blocks; each pair of them meets once.
    """
    blocks, rounds = parts[cell], turns[cell]
    block, turn = (number[row] * 0x9E3779B1 >> 7) % blocks, (number[row] * 0x85EBCA6B >> 11) % rounds
    kept = cell == own[row]
    lists = []
    for chosen, times, stores in ((kept, rounds, True), (asks[row], blocks, False)):
        at = np.flatnonzero(chosen)
        n = times[at]
        at, nth = np.repeat(at, n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        lists.append((at, block[at], nth) if stores else (at, nth, turn[at]))
    # a row that is stored and asks comes once where both meet
    at, b, t = np.unique(np.concatenate([np.stack(v, 1) for v in lists]), axis=0).T
    return row[at], cell[at], b * int(turns.max()) + t, kept[at] & (b == block[at]), asks[row[at]] & (t == turn[at])


def _blocks(parts: np.ndarray, books: Codebooks) -> np.ndarray:
    """Blocks of a cell, or of each of its sub-cells."""
    return np.where(parts > 1, -(-parts // len(books.others[0])), 1) if books.others else parts


def _sub_cells(x: np.ndarray, codes: np.ndarray, own: np.ndarray, asks: np.ndarray, row: np.ndarray, cell: np.ndarray, books: Codebooks, parts: np.ndarray, options: Options) -> tuple[np.ndarray, ...]:
    """Visits with the sub-cell they are for and that of the stored row.

    A cell that is too large is divided by the second codebook: a row is stored
    under its second code, and a query visits the ``sub_probes`` nearest ones.
    """
    none = np.zeros(len(row), "int64")
    divided = parts[cell] > 1
    if not books.others or not divided.any():
        return row, cell, none, none
    at = np.flatnonzero(divided)
    book, width = books.others[0], min(options.sub_probes, len(books.others[0]))
    rest = x[row[at]] - books.first[cell[at]]
    error = (book**2).sum(1)[None, :] - 2 * rest @ book.T
    near = np.argpartition(error, width - 1, axis=1)[:, :width]
    second = codes[row[at], 1].astype("int64")
    home = cell[at] == own[row[at]]
    # one list for each visit: the own code where it is stored, the nearest ones where it asks
    lists = np.concatenate([np.where(home, second, near[:, 0])[:, None], np.where(asks[row[at]][:, None], near, np.where(home, second, near[:, 0])[:, None])], axis=1)
    visit, sub = np.unique(np.stack([np.repeat(at, lists.shape[1]), lists.ravel()], 1), axis=0).T
    whole = np.flatnonzero(~divided)
    picked = np.concatenate([whole, visit])
    own_sub = np.where(divided, codes[row, 1].astype("int64"), 0)
    return row[picked], cell[picked], np.concatenate([np.zeros(len(whole), "int64"), sub]), own_sub[picked]


def _search_cell(table: pa.Table, books: Codebooks, k: int, least: float | None, options: Options) -> pa.Table:
    """Queries of a cell against its stored vectors: table scores, then exact ones."""
    base, asking = table.filter(table["stored"]), table.filter(table["asks"])
    ids, query_ids = base["id"].to_numpy(), asking["id"].to_numpy()
    none = np.zeros(0, "int64")
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(none, none, np.zeros(0))]
    if len(ids) and len(query_ids):
        x, queries = _matrix(base["v"], options.dim), _matrix(asking["v"], options.dim)
        codes = _matrix(base["codes"], 1 + len(books.others), "int32")
        norms = np.maximum(base["norm"].to_numpy(), np.float32(1e-6))
        center = books.first[codes[0, 0]]
        width = min(len(ids), max(options.shortlist, 2 * k + 1, int(np.ceil(options.shortlist_share * len(ids)))))
        block = max(1, min(1024, 1_000_000 // len(ids)))
        for s in range(0, len(queries), block):
            q = queries[s : s + block]
            # all stored vectors share their first code: its table entry is one column
            score = np.repeat((q @ center)[:, None], len(ids), axis=1)
            for m, book in enumerate(books.others, start=1):
                score += np.take(q @ book.T, codes[:, m], axis=1)
            score /= norms
            best = np.argpartition(-score, width - 1, axis=1)[:, :width] if width < len(ids) else np.tile(np.arange(width), (len(q), 1))
            row, col = np.repeat(np.arange(len(q)), width), best.ravel()
            exact = _exact(q, x, row, col)
            keep = (ids[col] != query_ids[s + row]) & (exact >= (-2.0 if least is None else least))
            row, col, exact = row[keep], col[keep], exact[keep]
            # of rows delivered twice the better one, then the k first of each query
            order = np.lexsort((-exact, ids[col], row))
            row, col, exact = row[order], col[order], exact[order]
            once = np.append(True, (row[1:] != row[:-1]) | (ids[col[1:]] != ids[col[:-1]])) if len(row) else np.zeros(0, bool)
            row, col, exact = row[once], col[once], exact[once]
            order = np.lexsort((ids[col], -np.round(exact, 6), row))
            row, col, exact = row[order], col[order], exact[order]
            near = np.arange(len(row)) - np.searchsorted(row, row) < k
            out.append((query_ids[s + row[near]], ids[col[near]], exact[near]))
    q, o, c = (np.concatenate(z) for z in zip(*out))
    kinds = pa.array([table["kind"][0].as_py()]).take(pa.array(np.zeros(len(q), "int64")))
    return pa.Table.from_arrays([kinds, pa.array(q), pa.array(o), pa.array(c)], ["kind", "id", "other", "cosine"])


def _exact(q: np.ndarray, x: np.ndarray, row: np.ndarray, col: np.ndarray) -> np.ndarray:
    """Cosines of pairs in double precision, in chunks so that memory doesn't grow with their number."""
    parts = [np.einsum("ij,ij->i", q[row[i : i + 8192]].astype("float64"), x[col[i : i + 8192]].astype("float64")) for i in range(0, len(row), 8192)]
    return np.concatenate(parts) if parts else np.zeros(0)


def _expanded(found: DataFrame, copies: DataFrame, k: int) -> DataFrame:
    """Pairs of directions as pairs of records.

    A record's copies have cosine 1.  At most ``k + 1`` members of a direction
    can be among anybody's ``k`` neighbours, ties going to the smaller id, so no
    group is paired in full.
    """
    ranked = copies.withColumn("place", F.row_number().over(Window.partitionBy("kind", "first").orderBy("id"))).where(F.col("place") <= k + 1).drop("place")
    same = copies.join(ranked.select("kind", "first", F.col("id").alias("other")), ["kind", "first"]).where("id <> other").select("kind", "id", "other", F.lit(1.0).alias("cosine"))
    reach = found.join(ranked.select("kind", F.col("first").alias("other"), F.col("id").alias("m")), ["kind", "other"], "left").select("kind", "id", F.coalesce("m", "other").alias("other"), "cosine")
    reach = reach.join(copies.select("kind", F.col("first").alias("id"), F.col("id").alias("m")), ["kind", "id"], "left").select("kind", F.coalesce("m", "id").alias("id"), "other", "cosine")
    return reach.unionByName(same)


def mutual_pairs(found: DataFrame) -> DataFrame:
    """``kind``, ``id_a``, ``id_b`` of pairs found from both sides, ``id_a < id_b``."""
    pairs = found.select("kind", F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b"))
    return pairs.groupBy("kind", "id_a", "id_b").agg(F.count(F.lit(1)).alias("sides")).where("sides = 2").drop("sides")
