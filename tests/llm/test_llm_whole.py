"""Operators do the whole of what they are asked, also where they divide it."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiarc.llm import leaked_items, queries, similar_vectors


@pytest.mark.parametrize("cell_rows", [10_000, 40])
def test_all_of_a_divided_cell_is_searched_without_a_least_cosine(spark, cell_rows):
    x = np.random.default_rng(5).normal(size=(700, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    cosine = x @ x.T
    np.fill_diagonal(cosine, -2)
    want = {(i, int(j)) for i in range(0, 700, 3) for j in np.argsort(-cosine[i])[:5]}
    vectors = similar_vectors.vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, e array<double>"), "id", "e", "k")
    options = similar_vectors.Options(max_cells=2, probes=2, shortlist_share=1.0, cell_rows=cell_rows)
    found = similar_vectors.neighbours(vectors, 5, queries=F.col("id") % 3 == 0, options=options)
    assert {(r["id"], r["other"]) for r in found.collect()} == want


def test_blocks_of_stored_rows_and_queries_meet_once():
    rng = np.random.default_rng(6)
    n, parts, turns = 300, np.array([4, 1, 3]), np.array([2, 5, 1])
    own, asks, number = rng.integers(0, 3, n), rng.random(n) < 0.4, rng.permutation(10 * n)[:n]
    row, cell = np.unique(np.concatenate([np.stack([np.arange(n), own], 1), np.stack([np.flatnonzero(asks), rng.integers(0, 3, asks.sum())], 1)]), axis=0).T
    at, of, part, stored, asked = similar_vectors._grid(number, own, asks, row, cell, parts, turns)
    met = [(q, s) for c, p in set(zip(of, part)) for q in at[asked & (of == c) & (part == p)] for s in at[stored & (of == c) & (part == p)]]
    want = {(q, s) for q, c in zip(row, cell) if asks[q] for s in np.flatnonzero(own == c)}
    assert len(met) == len(want) and set(met) == want


def test_runs_reach_over_the_edges_of_passages(spark):
    words = [f"word{i}" for i in range(90)]
    other = " ".join(f"other{i}" for i in range(100))
    docs = spark.createDataFrame([(1, f"{other} {' '.join(words)} {other}"), (2, f"{other} {' '.join(words[20:61])} {other}"), (3, " ".join(words[:40]))], "doc_id int, text string")
    items = spark.createDataFrame([(7, " ".join(words))], "item_id int, text string")
    got = {r["record"]: (r["run"], r["lcs"]) for r in leaked_items.leaks(docs, "doc_id", "text", items, "item_id", "text").collect()}
    assert got == {1: (90, 90), 2: (41, 41), 3: (40, 40)}


def test_p9_items_count_long_runs_and_paraphrases(spark, tmp_path):
    words = [f"{i}" if i % 4 == 0 else f"word{i}" for i in range(60)]
    changed = [f"other{i}" if i % 10 == 9 else w for i, w in enumerate(words)]
    docs = [(1, " ".join(words[:50])), (2, " ".join(changed)), (3, " ".join(f"some{i}" for i in range(80)))]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    items = [(7, "t", "en", " ".join(words)), (8, "t", "en", " ".join(f"none{i}" for i in range(40)))]
    spark.createDataFrame(items, "item_id long, task string, lang string, text string").write.parquet(f"{tmp_path}/eval_items.parquet")
    got = {r["item_id"]: (r["n_documents"], r["longest_run"], r["n_paraphrases"]) for r in queries.p9_items(spark, str(tmp_path)).collect()}
    assert got == {7: (1, 50, 1), 8: (0, 0, 0)}


def test_p9_items_against_brute_force(spark, sf_dir):
    items = {r["item_id"]: leaked_items.words(r["text"]) for r in spark.read.parquet(f"{sf_dir}/eval_items.parquet").where("text is not null").collect()}
    docs = {r["doc_id"]: leaked_items.words(r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").where("text is not null").collect()}
    want: dict[int, list[int]] = {i: [] for i in items}
    for d in docs.values():
        for i, w in items.items():
            if len(set(d) & set(w)) >= 8 and (run := max((n for n in _runs_of(d, w)), default=0)) >= 15:
                want[i].append(run)
    rows = queries.p9_items(spark, sf_dir).collect()
    assert {r["item_id"]: (r["n_documents"], r["longest_run"]) for r in rows} == {i: (len(v), max(v, default=0)) for i, v in want.items()}


def _runs_of(a, b):
    """Lengths of all common runs, by the plain table."""
    before = [0] * (len(b) + 1)
    for x in a:
        now = [0] + [before[j] + 1 if x == y else 0 for j, y in enumerate(b)]
        yield max(now)
        before = now
