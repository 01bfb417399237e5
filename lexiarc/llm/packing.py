"""Problem 8: items of varying length in containers of fixed capacity.

Lengths are tokens, so all items are known by a histogram with at most
``capacity`` bars.  The histogram is packed, not the items:

1. Combinations of lengths that fill a window below the capacity are enumerated:
   every length leads some, its partners follow the histogram at steps of the
   golden ratio, and the last one or two are those that fill the window.
2. Non-negative least squares finds how often each combination is to be used so
   that all together use the histogram up.
3. The repeat counts are rounded, as far as the bars reach.  Where bars are low, so that
   most counts are near 0, the rest of the histogram is solved again, up to ``ROUNDS`` times.
4. What is left then, with the ``SHORTEST`` share of the items, which is kept for it, is packed greedily.

The plan is a list of (pattern, repeats), bounded by the number of classes and
combinations and not by the number of items.  Items then find their container by
their rank within their length, which is counted in two steps - per (length,
bucket) and within a bucket - so that no length is a hot key.

Only an item above the capacity is split: into full containers and one rest,
which is an item like the others.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut_lineage

#: Combinations of a round, rounds, least fill of a combination, share of the items that is kept for the end.
COMBINATIONS, ROUNDS, WINDOW, SHORTEST = 2500, 5, 0.998, 0.04

#: Up to how many rows a plan is broadcast.
SMALL = 500_000

_GOLDEN = (5**0.5 - 1) / 2


def nnls(row: np.ndarray, column: np.ndarray, value: np.ndarray, b: np.ndarray, width: int, steps: int = 400) -> np.ndarray:
    """x >= 0 with least |a x - b| for the sparse matrix of (row, column, value): accelerated projected gradient, columns scaled."""
    scale = 1 / np.sqrt(np.maximum(np.bincount(column, value**2, width), 1e-12))
    value = value * scale[column]
    times = lambda x: np.bincount(row, value * x[column], len(b))
    back = lambda r: np.bincount(column, value * r[row], width)
    # the largest eigenvalue of a'a is at most the largest sum of a row of a times that of a column
    step = 1 / max(1e-12, np.bincount(row, value, len(b)).max(initial=0) * np.bincount(column, value, width).max(initial=0))
    x = y = np.zeros(width)
    t = 1.0
    for _ in range(steps):
        new = np.maximum(0.0, y - step * back(times(y) - b))
        if (y - new) @ (new - x) > 0:  # the momentum points away: begin anew
            t = 1.0
        ahead = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / ahead * (new - x)
        moved = np.abs(new - x).max(initial=0)
        x, t = new, ahead
        if moved < 1e-4 * max(1.0, x.max(initial=0)):
            break
    return x * scale


def combinations(lengths: np.ndarray, counts: np.ndarray, capacity: int, turn: int = 0) -> list[dict[int, int]]:
    """Lengths and how many of each, with a sum in the window below the capacity."""
    share = np.cumsum(counts) / counts.sum()
    has = np.zeros(capacity + 1, bool)
    has[lengths] = True
    below = np.maximum.accumulate(np.where(has, np.arange(capacity + 1), 0))
    near = 2 * int((lengths * counts).sum() / counts.sum())
    out: dict[tuple[int, ...], None] = {}
    for v in range(-(-COMBINATIONS // len(lengths))):
        for i, lead in enumerate(lengths[::-1].tolist()):
            parts, room = [lead], capacity - lead
            at = (i * _GOLDEN + (turn * 97 + v) * _GOLDEN**2) % 1
            while room > 0:
                at = (at + _GOLDEN) % 1
                if room <= near or not below[room]:
                    parts += _closing(room, lengths, has, at)
                    break
                pick = min(int(lengths[np.searchsorted(share, at)]), int(below[room]))
                parts.append(pick)
                room -= pick
            if WINDOW * capacity <= sum(parts) <= capacity:
                out[tuple(sorted(parts))] = None
    return [{n: parts.count(n) for n in set(parts)} for parts in out]


def _closing(room: int, lengths: np.ndarray, has: np.ndarray, at: float) -> list[int]:
    """One length, or two, that fill the room; else the longest that fits."""
    fits = lengths[: np.searchsorted(lengths, room, side="right")]
    if not len(fits):
        return []
    pairs = fits[has[room - fits] & (room - fits > 0)]
    if has[room] and (not len(pairs) or at < 0.5):
        return [room]
    if len(pairs):
        first = int(pairs[int(at * len(pairs))])
        return [first, room - first]
    return [int(fits[-1])]


def plan(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Patterns (repeats, [(length, how many)]) that use up the histogram exactly."""
    left = {int(n): int(c) for n, c in zip(lengths, counts) if c > 0}
    patterns: list[tuple[int, list[tuple[int, int]]]] = []
    if full := left.pop(capacity, None):
        patterns.append((full, [(capacity, 1)]))
    return patterns + _by_least_squares(left, capacity) + _greedy(left, capacity)


def _by_least_squares(left: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Patterns of rounded least squares; takes what they use from ``left``."""
    kept: dict[int, int] = {}
    room = int(SHORTEST * sum(left.values()))
    for n in sorted(left):
        kept[n] = min(room, left[n])
        room -= kept[n]
        left[n] -= kept[n]
    patterns = []
    for turn in range(ROUNDS):
        lengths = np.array(sorted(n for n, c in left.items() if c), "int64")
        if len(lengths) < 2:
            break
        counts = np.array([left[n] for n in lengths.tolist()])
        combos = combinations(lengths, counts, capacity, turn)
        if not combos:
            break
        place = {n: i for i, n in enumerate(lengths.tolist())}
        entries = np.array([(place[n], j, m) for j, combo in enumerate(combos) for n, m in combo.items()])
        repeats = nnls(entries[:, 0], entries[:, 1], entries[:, 2].astype("float64"), counts.astype("float64"), len(combos))
        # to the next whole number; where none reaches one half, those that come nearest are used once
        least = min(0.5, float(np.quantile(repeats, 0.75)))
        for j in np.argsort(-repeats, kind="stable").tolist():
            if repeats[j] < least or repeats[j] <= 0:
                break
            times = min(max(1, round(repeats[j])), min(left[n] // m for n, m in combos[j].items()))
            if times > 0:
                patterns.append((times, list(combos[j].items())))
                for n, m in combos[j].items():
                    left[n] -= m * times
    for n, c in kept.items():
        left[n] += c
    for n in [n for n, c in left.items() if not c]:
        del left[n]
    return patterns


def _greedy(left: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Longest first, each time the longest that still fits; equal containers at once."""
    lengths = np.array(sorted(left), "int64")
    counts = np.array([left[int(n)] for n in lengths], "int64")
    patterns = []
    while len(lengths):
        room, parts = capacity, []
        hi = len(lengths)
        while True:
            k = min(int(np.searchsorted(lengths, room, side="right")), hi) - 1
            while k >= 0 and counts[k] == 0:
                k -= 1
            if k < 0:
                break
            m = int(min(counts[k], room // lengths[k])) if lengths[k] else int(counts[k])
            parts.append((k, m))
            room -= m * int(lengths[k])
            hi = k
        times = int(min(counts[k] // m for k, m in parts))
        for k, m in parts:
            counts[k] -= m * times
        patterns.append((times, [(int(lengths[k]), m) for k, m in parts]))
        if (counts == 0).any():
            lengths, counts = lengths[counts > 0], counts[counts > 0]
    return patterns


def pack(items: DataFrame, record: str, size: str, capacities: list[tuple[int, int]], buckets: int = 32) -> DataFrame:
    """An assignment of items to containers for every capacity.

    ``capacities`` are (limit_id, capacity).  Result: ``limit_id``, ``record``,
    ``part_no``, ``n_tokens`` of the part, ``container``.  A part above 0 exists
    only for items above the capacity.  Items of size 0 or NULL, or without an
    id, need no container and have no row; an item delivered twice is packed
    once, with its largest size.  No items give no rows.
    """
    spark = items.sparkSession
    rows = items.select(F.col(record).cast("long").alias("record"), F.col(size).cast("long").alias("size")).where("record is not null and size > 0").groupBy("record").agg(F.max("size").alias("size"))
    rows = cut_lineage(rows)  # ids and sizes; measuring them is the work
    # every item meets every limit: a handful of rows, fixed by the caller
    each = rows.withColumn("limit", F.explode(F.array(*(F.struct(F.lit(int(i)).alias("limit_id"), F.lit(int(c)).cast("long").alias("capacity")) for i, c in capacities)))).select("record", "size", "limit.*")
    full = F.expr("(size - 1) div capacity")
    parts = each.select("limit_id", "record", "capacity", F.posexplode(F.sequence(F.lit(0).cast("long"), full)).alias("part_no", "k"), "size")
    parts = parts.select("limit_id", "record", "part_no", F.when(F.col("part_no") < full, F.col("capacity")).otherwise(F.col("size") - full * F.col("capacity")).alias("n_tokens"), F.pmod(F.xxhash64("record", "part_no"), F.lit(buckets)).cast("int").alias("bucket"))

    per_bucket = parts.groupBy("limit_id", "n_tokens", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("limit_id", "n_tokens").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_bucket.select("limit_id", "n_tokens", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    # the histogram: at most as many rows for a limit as it has tokens
    histograms = per_bucket.groupBy("limit_id", "n_tokens").agg(F.sum("n").alias("n")).toPandas()
    slots = []
    for limit_id, capacity in capacities:
        histogram = histograms[histograms["limit_id"] == limit_id].sort_values("n_tokens")
        first, used = 0, {}
        for times, pattern in plan(histogram["n_tokens"].to_numpy(), histogram["n"].to_numpy(), int(capacity)):
            for n, m in pattern:
                # ranks from ``at`` on, m to a container
                at = used.get(n, 0)
                slots.append((int(limit_id), n, at, at + m * times, m, first))
                used[n] = at + m * times
            first += times
    ranked = parts.withColumn("within", F.row_number().over(Window.partitionBy("limit_id", "n_tokens", "bucket").orderBy("record", "part_no")) - 1)
    ranked = ranked.join(starts, ["limit_id", "n_tokens", "bucket"]).withColumn("rank", F.col("start") + F.col("within"))
    # the plan is bounded by lengths, combinations and rounds, not by items; a row takes some 50 bytes
    table = spark.createDataFrame(slots, "limit_id int, n_tokens long, low long, high long, each long, first long")
    if len(slots) <= SMALL:
        table = F.broadcast(table)
    found = ranked.join(table, (ranked["limit_id"] == table["limit_id"]) & (ranked["n_tokens"] == table["n_tokens"]) & (ranked["rank"] >= table["low"]) & (ranked["rank"] < table["high"]))
    return found.select(ranked["limit_id"], "record", "part_no", ranked["n_tokens"], (F.col("first") + F.floor((F.col("rank") - F.col("low")) / F.col("each"))).cast("long").alias("container"))
