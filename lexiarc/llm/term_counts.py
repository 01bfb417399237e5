"""Problem 5: the frequency of every distinct value, with last-seen counters.

A value's counter holds its occurrences, its rows, its records and the record
seen last.  Rows reach a counter ordered by value and record, so a record is
new exactly when it differs from the one seen last: no counter ever keeps a set
of records.

Data flow: before the shuffle each batch of rows is combined by value and record,
so that a value or a pair holding a third of all rows arrives as a row for each batch at
most.  Rows are then hashed by value and by a bucket of their record, which spreads a
hot value over ``BUCKETS`` tasks and keeps the rows of a record together.  Each
task sorts its rows and runs the counters over the stream, where a record that
comes again, from another batch or another task, is seen and not counted anew.  The
tasks' counters are added up per value; those of one value in different tasks
are of different records, so the sum is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_PARTIAL = "value string, occurrences long, rows long, records long"
_ROWS = "value string, record string, occurrences long, rows long"

#: Among how many tasks a value's records are spread.
BUCKETS = 64


def _combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each batch, combined by value and record."""
    for batch in batches:
        sums = pa.Table.from_batches([batch]).group_by(["value", "record"]).aggregate([("w", "sum"), ("w", "count")])
        yield from sums.select(["value", "record", "w_sum", "w_count"]).rename_columns(["value", "record", "occurrences", "rows"]).to_batches()


def _last_seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counters over rows sorted by value and record; one is open at a time."""
    names = ["value", "occurrences", "rows", "records"]
    open_value, open_record, counter = None, None, np.zeros(3, "int64")

    def closed(values: pa.Array, sums: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([values, *(pa.array(s) for s in sums)], names)

    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        value, record = batch.column(0), batch.column(1)
        value_before = pa.concat_arrays([pa.array([open_value], value.type), value.slice(0, n - 1)])
        seen_last = pa.concat_arrays([pa.array([open_record], record.type), record.slice(0, n - 1)])
        same_value = pc.fill_null(pc.equal(value, value_before), False)
        same_record = pc.and_(same_value, pc.fill_null(pc.equal(record, seen_last), False))
        new = pc.and_(pc.invert(same_record), pc.is_valid(record)).to_numpy(zero_copy_only=False)
        adds = np.stack([batch.column(2).to_numpy(), batch.column(3).to_numpy(), new.astype("int64")])
        totals = np.concatenate([np.zeros((3, 1), "int64"), adds.cumsum(axis=1)], axis=1)
        starts = np.flatnonzero(~same_value.to_numpy(zero_copy_only=False))
        parts = np.diff(totals[:, [0, *starts, n]], axis=1)  # the first part belongs to the open counter
        counter = counter + parts[:, 0]
        if len(starts):
            ended, sums = value.take(pa.array(starts[:-1])), parts[:, 1:-1]
            if open_value is not None:
                ended = pa.concat_arrays([pa.array([open_value], value.type), ended])
                sums = np.concatenate([counter[:, None], sums], axis=1)
            if len(ended):
                yield closed(ended, sums)
            open_value, counter = value[int(starts[-1])].as_py(), parts[:, -1]
        open_record = record[n - 1].as_py()
    if open_value is not None:
        yield closed(pa.array([open_value], pa.string()), counter[:, None])


def value_counts(df: DataFrame, value: str | Column, record: str | Column, weight: Column | None = None) -> DataFrame:
    """Every distinct value with ``occurrences``, ``rows`` and ``records``.

    ``weight`` is what a row adds to the occurrences (1 by default; NULL counts
    as 1).  NULL values aren't values and are left out; a NULL record adds to
    occurrences and rows, but is no record.  An empty text is a value like any
    other.  Rows that repeat add up.  An empty table gives an empty result.
    """
    value = F.col(value) if isinstance(value, str) else value
    record = F.col(record) if isinstance(record, str) else record
    weight = F.lit(1) if weight is None else weight
    rows = df.select(value.cast("string").alias("value"), record.cast("string").alias("record"), F.coalesce(weight.cast("long"), F.lit(1)).alias("w")).where(F.col("value").isNotNull())
    bucket = F.pmod(F.xxhash64("record"), F.lit(BUCKETS))
    sorted_rows = rows.mapInArrow(_combined, _ROWS).repartition("value", bucket).sortWithinPartitions("value", "record")
    return (
        sorted_rows.mapInArrow(_last_seen, _PARTIAL)
        .groupBy("value")
        .agg(*(F.sum(c).alias(c) for c in ("occurrences", "rows", "records")))
    )


def token_counts(df: DataFrame, text: str, record: str, pattern: str = r"[\p{L}\p{M}\p{N}]+") -> DataFrame:
    """``value_counts`` of the words of a text column, in lower case."""
    words = df.select(F.col(record).alias("__record"), F.explode(F.regexp_extract_all(F.lower(F.col(text)), F.lit(pattern), F.lit(0))).alias("__word"))
    return value_counts(words, "__word", "__record")


def mark_values(counts: DataFrame, all_records: Column, *, common_records: int = 5, common_share: float = 0.03, rare_occurrences: int = 2) -> DataFrame:
    """Add ``mark``: ``common``, ``rare`` or NULL.

    Common: in at least ``common_records`` records and ``common_share`` of all
    of them.  Rare: not common, with at most ``rare_occurrences`` occurrences.
    ``all_records`` is a scalar, for instance of ``DataFrame.scalar()``.
    """
    common = (F.col("records") >= common_records) & (F.col("records") >= F.lit(common_share) * all_records)
    return counts.withColumn("mark", F.when(common, "common").when(F.col("occurrences") <= rare_occurrences, "rare"))
