"""Models and extractors behind small protocols, with offline ones that need nothing."""

from __future__ import annotations

import time
import zlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.context import context_of, joined_prompt


class TextModel(Protocol):
    """Answers prompts; made once per task."""

    name: str

    def answer(self, prompts: list[str]) -> list[str]: ...


class Embedder(Protocol):
    """Turns texts into vectors of one length."""

    dim: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class EchoModel:
    """Offline: a reply that depends on the prompt only."""

    name = "echo"

    def answer(self, prompts: list[str]) -> list[str]:
        return [f"[{zlib.crc32(p.encode()):08x}] {p.rpartition(chr(10))[2]}" for p in prompts]


class HashEmbedder:
    """Offline: words hashed to signed columns, scaled to length 1."""

    def __init__(self, dim: int = 64) -> None:
        self.dim = dim

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), "float32")
        for i, text in enumerate(texts):
            for word in (text or "").lower().split():
                h = zlib.crc32(word.encode())
                out[i, h % self.dim] += 1 if h & 0x10000 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm > 0, norm, 1)


def with_retry(call: Callable[[list[str]], list[str]], prompts: list[str], tries: int = 3, wait: float = 1.0) -> list[str]:
    """Call again after a failure, waiting twice as long each time."""
    for attempt in range(tries):
        try:
            return call(prompts)
        except Exception:  # noqa: BLE001 - whatever a provider raises
            if attempt == tries - 1:
                raise
            time.sleep(wait * 2**attempt)
    raise AssertionError("unreachable")


def answers(df: DataFrame, key: str, prompt: str, make: Callable[[], TextModel], fallback: Callable[[], TextModel] | None = None, batch: int = 32, wait: float = 1.0) -> DataFrame:
    """``key``, ``reply``, ``model``, ``error``: replies in batches, from the fallback where the first model fails.

    A batch that fails on both has errors and no replies; other batches go on.
    Write the result before using it twice: replies aren't repeatable.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = make()
        second = None
        for b in batches:
            keys, prompts = b.column(0), b.column(1).to_pylist()
            replies: list[str | None] = []
            names: list[str | None] = []
            errors: list[str | None] = []
            for s in range(0, len(prompts), batch):
                part = prompts[s : s + batch]
                try:
                    replies += with_retry(first.answer, part, wait=wait)
                    names += [first.name] * len(part)
                    errors += [None] * len(part)
                except Exception as failed:  # noqa: BLE001
                    try:
                        if fallback is None:
                            raise failed
                        second = second or fallback()
                        replies += with_retry(second.answer, part, wait=wait)
                        names += [second.name] * len(part)
                        errors += [None] * len(part)
                    except Exception as again:  # noqa: BLE001
                        replies += [None] * len(part)
                        names += [None] * len(part)
                        errors += [str(again)] * len(part)
            yield pa.RecordBatch.from_arrays([keys.cast(pa.string()), pa.array(replies, pa.string()), pa.array(names, pa.string()), pa.array(errors, pa.string())], ["key", "reply", "model", "error"])

    return df.select(F.col(key).cast("string").alias("key"), prompt).mapInArrow(run, "key string, reply string, model string, error string")


def answers_in_order(df: DataFrame, make: Callable[[], TextModel], fallback: Callable[[], TextModel] | None = None, wait: float = 1.0) -> DataFrame:
    """``id``, ``reply``, ``error`` of the open pages; each prompt has the translations before it, new ones too.

    ``df`` has ``document_id``, ``page_number``, ``id``, ``head`` and ``tail`` of
    the prompt, ``translation`` and ``open``.  Documents are spread over the tasks,
    the pages of one are answered one after the other; a page that fails, on the fallback
    too if there is one, has an error, and the next ones go on without it.  Write the result before using it
    twice: replies aren't repeatable.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models, document, before = [m() for m in (make, fallback) if m], None, []
        for b in batches:
            out: list[tuple] = []
            for d, n, key, head, tail, text, is_open in zip(*(c.to_pylist() for c in b.columns)):
                if d != document:
                    document, before = d, []
                if is_open:
                    for model in models:
                        try:
                            text, error = with_retry(model.answer, [joined_prompt(head, *context_of(before), tail)], wait=wait)[0], None
                            break
                        except Exception as failed:  # noqa: BLE001
                            text, error = None, str(failed)
                    out.append((key, text, error))
                if text:
                    before = [(n, text.strip()), *before[:1]]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate((pa.int32(), pa.string(), pa.string()))], ["id", "reply", "error"])

    spark = df.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = df.select("document_id", "page_number", "id", "head", "tail", "translation", "open")
    return rows.repartition(tasks, "document_id").sortWithinPartitions("document_id", "page_number", "id").mapInArrow(run, "id int, reply string, error string")


def embeddings(df: DataFrame, key: str, text: str, make: Callable[[], Embedder], batch: int = 256) -> DataFrame:
    """``key`` and ``embedding``; NULL and blank texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make()
        for b in batches:
            texts = b.column(1).to_pylist()
            vectors = [model.embed(texts[s : s + batch]) for s in range(0, len(texts), batch)]
            flat = np.concatenate(vectors).astype("float32") if vectors else np.zeros((0, model.dim), "float32")
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (len(flat) + 1) * model.dim, model.dim), pa.int32()), pa.array(flat.ravel(), pa.float32()))
            yield pa.RecordBatch.from_arrays([b.column(0), lists], ["key", "embedding"])

    rows = df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).where(F.col("text").rlike(r"\S"))
    return rows.mapInArrow(run, "key long, embedding array<float>")
