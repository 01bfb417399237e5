"""The queries on the smallest tables: against SQL, or against brute force."""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiarc.llm import leaked_items, packing, pieces, queries, similar_vectors, tokens, uniform_text

SHAPES = {
    "p1_found": {"page_id": "bigint", "noise": "string"},
    "p2_found": {"record_kind": "string", "id_a": "bigint", "id_b": "bigint"},
    "p3_found": {"record_kind": "string", "record_id": "bigint"},
    "p4_found": {"id_a": "bigint", "id_b": "bigint"},
    "p5_found": {"term": "string", "mark": "string"},
    "p6_found": {"page_id": "bigint", "lang": "string", "src_no": "int", "tgt_no": "int"},
    "p7_found": {"page_id": "bigint", "field_name": "string"},
    "p9_found": {"doc_id": "bigint", "item_id": "bigint"},
}


@pytest.mark.parametrize("name", sorted(SHAPES))
def test_found_has_the_columns_given(spark, sf_dir, name):
    df = queries.QUERIES[name](spark, sf_dir)
    assert dict(df.dtypes) == SHAPES[name]
    assert df.count() == df.distinct().count()


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_matches_sql(spark, sf_dir, duck, compare, name):
    compare(queries.QUERIES[name](spark, sf_dir).toPandas(), duck.sql(queries.ORACLE_SQL[name]).df())


def test_p2_recall_against_brute_force(spark, sf_dir, duck):
    got = {tuple(r) for r in queries.p2_found(spark, sf_dir).collect()}
    near = queries.p2_neighbours(spark, sf_dir).toPandas()
    true, hits, total = set(), 0, 0
    for kind, table in (("term", "terminology"), ("page", "pages")):
        rows = duck.sql(f"SELECT id, any_value(embedding) FROM {table} WHERE len(embedding) = 64 GROUP BY id ORDER BY id").fetchall()
        ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
        norm = np.linalg.norm(x, axis=1)
        ids, x = ids[norm > 0], x[norm > 0] / norm[norm > 0, None]
        cosine = x @ x.T
        np.fill_diagonal(cosine, -2)
        best = np.argsort(-cosine, axis=1, kind="stable")[:, :5]
        close = {int(i): {int(ids[j]) for j in row if cosine[k, j] >= 0.92} for k, (i, row) in enumerate(zip(ids, best))}
        true |= {(kind, a, b) for a in close for b in close[a] if a < b and a in close[b]}
        of_kind = near[near.record_kind == kind]
        for k, i in enumerate(ids):
            if i % 20 == 0:
                hits += len(set(of_kind[of_kind.id == i].other) & {int(ids[j]) for j in best[k]})
                total += 5
    assert len(got & true) >= 0.95 * len(true) and got <= true
    assert hits >= 0.9 * total


def test_p3_against_brute_force(spark, sf_dir):
    got = {(r["record_kind"], r["record_id"]) for r in queries.p3_found(spark, sf_dir).collect()}
    want = set()
    for kind, table, column in (("term", "terminology", "term"), ("page", "pages", "original_content")):
        for r in spark.read.parquet(f"{sf_dir}/{table}.parquet").select("id", column).collect():
            text = r[1] or ""
            odd = unicodedata.normalize("NFC", text) != text or any(unicodedata.category(c) == "Cf" or unicodedata.category(c) == "Zs" and c != " " or c in "یکہ" or "ﬀ" <= c <= "ﬆ" or "ﹰ" <= c <= "﻿" or "！" <= c <= "￯" for c in text)
            shown = "".join(c for c in text if unicodedata.category(c) != "Cf")
            mixed = any(len({unicodedata.name(c, "?").split()[0] for c in w} & {"LATIN", "CYRILLIC", "GREEK"}) > 1 for w in re.findall(r"[^\W\d_]+", shown))
            if odd or mixed:
                want.add((kind, r["id"]))
    assert got == want


def test_p8_assignment_is_whole(spark, sf_dir):
    limits = {r["limit_id"]: r["max_tokens"] for r in spark.read.parquet(f"{sf_dir}/size_limits.parquet").where("purpose = 'pack'").collect()}
    sizes = {r["record"]: r["n_tokens"] for r in tokens.token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text").collect() if r["n_tokens"]}
    rows = queries.p8_containers(spark, sf_dir).toPandas()
    for limit, capacity in limits.items():
        own = rows[rows.limit_id == limit]
        assert own.groupby("doc_id").n_tokens.sum().to_dict() == sizes
        used = own.groupby("container").n_tokens.sum()
        assert used.max() <= capacity
        lengths, counts = np.unique(own.n_tokens[own.n_tokens > 0], return_counts=True)
        assert len(used) <= sum(t for t, _ in packing._greedy(dict(zip(lengths.tolist(), counts.tolist())), capacity))
        split = own.groupby("doc_id").size()
        assert all(sizes[d] > capacity for d in split[split > 1].index)


def test_p9_against_brute_force(spark, sf_dir):
    got = {(r["doc_id"], r["item_id"]) for r in queries.p9_found(spark, sf_dir).collect()}
    grams: dict[tuple, set[int]] = {}
    for r in spark.read.parquet(f"{sf_dir}/eval_items.parquet").collect():
        w = leaked_items.words(r["text"])
        for i in range(len(w) - 14):
            grams.setdefault(tuple(w[i : i + 15]), set()).add(r["item_id"])
    want = set()
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").where("text is not null").collect():
        w = leaked_items.words(r["text"])
        for i in range(len(w) - 14):
            want |= {(r["doc_id"], j) for j in grams.get(tuple(w[i : i + 15]), ())}
    assert got == want


def test_p10_pieces_are_whole_and_small(spark, sf_dir):
    enc = tokens.encoding(tokens.tokenizer_path())
    limits = {r["limit_id"]: (r["max_tokens"], r["overlap_tokens"]) for r in spark.read.parquet(f"{sf_dir}/size_limits.parquet").where("purpose = 'cut'").collect()}
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect() if r["text"]}
    rows = queries.p10_pieces(spark, sf_dir).toPandas().sort_values(["limit_id", "doc_id", "piece_no"])
    for (limit, doc), own in rows.groupby(["limit_id", "doc_id"]):
        size, overlap = limits[limit]
        assert "".join(p[s:] for p, s in zip(own.piece, own.shared)) == texts[doc]
        assert all(texts[doc][a:b] == p for a, b, p in zip(own.start, own.end, own.piece))
        assert [tokens.count(enc, p) for p in own.piece] == own.n_tokens.tolist()
        assert own.n_tokens.max() <= size
        before = 0
        for p, s, n in zip(own.piece, own.shared, own.piece_no):
            if n and before > overlap + 4:
                assert abs(tokens.count(enc, p[:s]) - overlap) <= 4
            before += tokens.count(enc, p[s:])
    over = {(i, d) for i, (size, _) in limits.items() for d, t in texts.items() if tokens.count(enc, t) > size}
    assert set(zip(rows.limit_id, rows.doc_id)) == over
    assert pieces.LEVELS[-1] == "character"


def test_uniform_text_gives_plain_forms(spark):
    rows = [
        (1, "ＡＢＣ ｅ１"), (2, "café é"), (3, "a​b­c"), (4, "x y z"), (5, "ѕоl dеs"), (6, "система Δ 5 km² x³"), (7, "ﺍلترجمة یک"), (8, "ﬁne eﬃcient"),
        (9, None), (10, ""), (11, "plain text"), (12, "q̣̇ q̣̇"), (13, "жеlеznый"), (14, "‏"), (15, "ordinary\t\ttabs  doubled"),
    ]
    df = spark.createDataFrame(rows * 2, "id int, t string").withColumn("text", F.lit("clash")).withColumn("record", F.lit(0))
    got = {r["record"]: r["plain_text"] for r in uniform_text.uniform_text(df, "id", "t").collect()}
    nfc = unicodedata.normalize("NFC", "q̣̇")
    assert got.pop(12) == f"{nfc} {nfc}"
    assert got == {1: "ABC e1", 2: "café é", 3: "abc", 4: "x y z", 5: "sol des", 7: "الترجمة يك", 8: "fine efficient", 14: ""}
    assert {r["record"] for r in uniform_text.deviating(df, "id", "t").collect()} == set(got) | {12}


def test_texts_come_from_the_records_that_deviate(spark, sf_dir):
    """The uniform form deviates no more, has the letters that composition gives, and is there for every record found."""
    rows = queries.p3_texts(spark, sf_dir).cache()
    found = queries.p3_found(spark, sf_dir)
    assert rows.select("record_kind", "record_id").distinct().exceptAll(found).isEmpty() and found.exceptAll(rows.select("record_kind", "record_id").distinct()).isEmpty()
    assert uniform_text.deviating(rows, "record_id", "plain_text").isEmpty()
    assert all(unicodedata.is_normalized("NFC", r["plain_text"]) for r in rows.collect())


def test_hangul(spark):
    words = ["한국어", "가각갂", "값 없다", "뷁"]
    rows = [(i, unicodedata.normalize("NFD", w)) for i, w in enumerate(words)] + [(10, words[0]), (11, "가\u11a8")]
    got = {r["record"]: r["plain_text"] for r in uniform_text.uniform_text(spark.createDataFrame(rows, "id int, t string"), "id", "t").collect()}
    assert got == {**dict(enumerate(words)), 11: "각"}


def test_uniform_text_of_long_text(spark):
    text = "word " * 40_000 + "ｗord"
    df = spark.createDataFrame([(1, text)], "id int, t string")
    assert uniform_text.uniform_text(df, "id", "t").first()["plain_text"] == "word " * 40_000 + "word"


def test_vectors_with_all_kinds_of_rows(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(30, 64))
    rows = [(i, v.tolist()) for i, v in enumerate(base)] + [(100 + i, (base[0] * (i + 1)).tolist()) for i in range(8)]
    rows += [(200, None), (201, []), (202, [0.0] * 64), (203, [1.0] * 63), (204, [float("nan")] * 64), (None, base[0].tolist()), (205, [None] * 64), (1, base[1].tolist())]
    df = spark.createDataFrame(rows, "id int, e array<double>").withColumn("kind", F.lit("clash")).withColumn("v", F.lit(1))
    vectors = similar_vectors.vectors(df, "id", "e", "k")
    found = similar_vectors.neighbours(vectors, 5, min_cosine=0.92).toPandas()
    copies = [0, *range(100, 108)]
    for i in copies:
        assert sorted(found[found.id == i].other) == [c for c in copies if c != i][:5]
    assert set(found.id) == set(copies)
    assert similar_vectors.neighbours(vectors.limit(0), 5).count() == 0
    every = similar_vectors.neighbours(vectors, 3).toPandas()
    assert every.groupby("id").size().max() <= 3 and set(every.id) == {*range(30), *range(100, 108)}


def test_divided_cells_find_the_same(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(400, 64))
    rows = [(i, v.tolist()) for i, v in enumerate(base)] + [(1000 + i, (v + rng.normal(size=64) * 0.1).tolist()) for i, v in enumerate(base)]
    vectors = similar_vectors.vectors(spark.createDataFrame(rows, "id int, e array<double>"), "id", "e", "k")
    want = {(i, 1000 + i) for i in range(400)}
    for options in (similar_vectors.Options(cell_mean=400, probes=2), similar_vectors.Options(cell_mean=400, cell_rows=50, probes=2), similar_vectors.Options(cell_mean=400, cell_rows=1, probes=2, book_size=8, sub_probes=6)):
        found = similar_vectors.neighbours(vectors, 5, min_cosine=0.92, options=options)
        got = {(r["id_a"], r["id_b"]) for r in similar_vectors.mutual_pairs(found).collect()}
        assert got <= want and len(got) >= 0.97 * len(want)
