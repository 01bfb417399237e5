"""Sizes of texts in tokens of a public tokenizer.

The tokenizer is a rank file of a byte-level vocabulary, found by its path; the
path is a parameter.  Each Python worker loads it once.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spread

#: Where vocabulary files are looked for when no path is given.
FOLDER = os.environ.get("LEXIARC_TOKENIZERS", "/opt/tokenizers")
DEFAULT = "byte_bpe_multi_50k.tiktoken"

# Fixed value: the pattern that byte-level vocabularies of this kind split texts by.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def tokenizer_path(path: str | None = None) -> str:
    return path or str(Path(FOLDER) / DEFAULT)


@lru_cache(maxsize=2)
def encoding(path: str):
    """The tokenizer of a rank file: lines of a token in base64 and its rank."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


#: A text is encoded in stretches of about this many characters, cut where a word begins.
STRETCH = 20_000


def stretches(text: str) -> Iterator[str]:
    """Parts of a text that the tokenizer splits apart anyway.

    Cuts lie before a single space that a letter follows and a letter precedes,
    where a token always begins.  A text without such a place stays whole.
    """
    start = 0
    while len(text) - start > STRETCH:
        at = start + STRETCH
        while 0 < (at := text.find(" ", at)) < len(text) - 1 and not (text[at - 1].isalpha() and text[at + 1].isalpha()):
            at += 1
        if at <= 0 or at >= len(text) - 1:
            break
        yield text[start:at]
        start = at
    yield text[start:]


def count(enc, text: str) -> int:
    return sum(len(enc.encode_ordinary(part)) for part in stretches(text))


def token_counts(df: DataFrame, record: str, text: str, path: str | None = None) -> DataFrame:
    """``record``, ``n_tokens`` for every row with an id; NULL texts have 0 tokens."""
    where = tokenizer_path(path)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(where)
        for batch in batches:
            sizes = np.fromiter((count(enc, t) if t else 0 for t in (x.as_py() for x in batch.column(1))), "int64", batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes)], ["record", "n_tokens"])

    rows = df.select(F.col(record).cast("long").alias("record"), F.col(text).alias("text")).where(F.col("record").isNotNull())
    return spread(rows).mapInArrow(counted, "record long, n_tokens long")
