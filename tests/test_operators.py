"""Operators with state, order or files."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiarc.operators import clusters, context, memory, search, state, upserts
from lexiarc.plans import pipeline, providers
from lexiarc.sources import files, sinks
from lexiarc.store import Store
from lexiarc.streaming import ingest


def plain_clusters(rows, threshold):
    seeds, out = [], {}
    for i, v in rows:
        if i in out:
            continue
        out[i] = i
        for j, w in rows:
            if j not in out and np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w) >= threshold:
                out[j] = i
        seeds.append(i)
    return out


@pytest.mark.parametrize("block", [3, 2000])
def test_greedy_clusters_match_plain(spark, monkeypatch, block):
    monkeypatch.setattr(clusters, "BLOCK", block)
    rng = np.random.default_rng(1)
    base = rng.normal(size=(5, 8))
    rows = [(i, (base[i % 5] + rng.normal(size=8) * 0.35).tolist()) for i in range(40)]
    df = spark.createDataFrame([(1, i, v) for i, v in rows] + [(1, 99, None), (2, 100, rows[0][1])], "scope int, id int, v array<float>")
    got = {r["id"]: r["seed"] for r in clusters.greedy_clusters(df, "id", "scope", "v", 0.8).collect()}
    assert got == plain_clusters(rows, 0.8) | {100: 100}


def test_chain_is_greedy_not_transitive(spark):
    angle = lambda d: [float(np.cos(np.radians(d))), float(np.sin(np.radians(d)))]
    df = spark.createDataFrame([(1, 0, angle(0)), (1, 1, angle(30)), (1, 2, angle(60)), (1, 3, [0.0, 0.0])], "scope int, id int, v array<float>")
    got = {r["id"]: r["seed"] for r in clusters.greedy_clusters(df, "id", "scope", "v", 0.8).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 3}


def test_similar_pairs_of_nothing(spark):
    df = spark.createDataFrame([], "scope int, id int, v array<float>")
    assert clusters.similar_pairs(df, "id", "scope", "v", 0.8).count() == 0


def test_bm25_of_words_that_are_nowhere(spark):
    df = spark.createDataFrame([(1, "tide audit", None), (2, None, None), (3, "", "")], "id int, term string, context string")
    assert search.bm25(df, "id", ["term", "context"], "nothing").count() == 0
    assert [r["id"] for r in search.bm25(df, "id", ["term", "context"], "tide tide").collect()] == [1]


def test_hybrid_keeps_order_of_negative_similarities(spark):
    none = spark.createDataFrame([], "id int, score double")
    near = spark.createDataFrame([(1, -0.9), (2, -0.1)], "id int, similarity double")
    assert {r["combined_score"] for r in search.hybrid(none, near).collect()} == {0.0}


def test_memory(spark):
    day = dt.datetime(2024, 1, 1)
    schema = "namespace string, key string, value string, created_at timestamp_ntz, updated_at timestamp_ntz, seq long"
    old = spark.createDataFrame([("documents/1", "a", "x", day, day, 1), ("documents/10", "b", "y", day, day, 2)], schema)
    new = spark.createDataFrame([("documents/1", "a", "z", day, day, 3)], schema)
    out = memory.put(old, new)
    assert {(r["key"], r["value"]) for r in out.collect()} == {("a", "z"), ("b", "y")}
    assert [r["key"] for r in upserts.delete_prefix(out, "namespace", "documents/1").collect()] == ["b"]
    assert [(r["pos"], r["value"]) for r in memory.mget(out, spark, "documents/1", ["q", "a"]).orderBy("pos").collect()] == [(0, None), (1, "z")]
    assert [r["key"] for r in memory.page_of(out, "documents/1", 0, 5).collect()] == ["a"]


def plain_context(pages, current):
    before = sorted(((n, t.strip()) for n, t in pages if n < current and t), reverse=True)
    if not before:
        return None, None
    left, parts = 500, []
    for n, t in before[:2]:
        if left > 0:
            s = t[: min(left, 250)] + ("..." if len(t) > 250 else "")
            parts.append(f"[Page {n + 1}]: {s}")
            left -= len(s)
    return "\n".join(parts), before[0][1][-200:]


@pytest.mark.parametrize("sizes", [[0, 10, 0, 251, 249, 600], [300, 250, 1], [0], [0, 0, 5]])
def test_previous_context_matches_plain(spark, sizes):
    pages = [(i, "abcdefghij" * 100) if n > 900 else (i, ("abcdefghij" * 100)[:n] or None) for i, n in enumerate(sizes)]
    df = spark.createDataFrame([(1, i, t) for i, t in pages], "document_id int, page_number int, translation string")
    got = {r["page_number"]: (r["previous_summary"], r["previous_ending"]) for r in context.previous_context(df).collect()}
    assert got == {i: plain_context(pages, i) for i, _ in pages}


def test_upserts(spark):
    old = spark.createDataFrame([(1, "a", "m", 5), (2, "b", "n", 6)], "k int, v string, w string, x int")
    new = spark.createDataFrame([(2, None), (3, "c")], "k int, v string")
    assert {tuple(r) for r in upserts.overwrite(old, new, ["k"], ["v"]).collect()} == {(1, "a", "m", 5), (2, None, "n", 6), (3, "c", None, None)}
    f = spark.createDataFrame([("t", 2, "c"), ("u", None, None)], "term string, n int, ctx string")
    assert {tuple(r) for r in upserts.add_frequencies(f, f, ["term"], "n", "ctx").collect()} == {("t", 4, "c"), ("u", 0, None)}


def test_latest_breaks_ties_by_id(spark):
    day = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(1, 1, day), (2, 1, day), (3, 1, None)], "id int, document_id int, updated_at timestamp_ntz")
    assert [r["id"] for r in state.latest(df, ["document_id"], ["updated_at", "id"]).collect()] == [2]


def test_ids_are_consecutive_and_repeatable(spark):
    df = spark.range(500).select(F.concat(F.lit("f"), "id").alias("full_path"))
    one = files.with_ids(df, 9).collect()
    assert sorted(r["id"] for r in one) == list(range(10, 510))
    assert {(r["full_path"], r["id"]) for r in one} == {(r["full_path"], r["id"]) for r in files.with_ids(df.repartition(3), 9).collect()}


def test_word_processor_round_trip():
    text = "# Head\n\nA **bold** line\n\n- item\n\n| a | b |\n| --- | --- |\n| c | d |"
    assert files.docx_markdown(sinks.docx_bytes(text)) == text.replace("**", "")
    assert files.docx_markdown(sinks.docx_bytes("", rtl=True)) == ""


def test_scan_and_pages(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.TXT").write_bytes("caf\xe9".encode("latin-1"))
    (tmp_path / "sub" / "b.md").write_text("héllo", encoding="utf-8")
    (tmp_path / "c.docx").write_bytes(b"not a zip")
    (tmp_path / "d.html").write_text("no")
    found = files.scan(spark, str(tmp_path))
    assert {r["relative_path"] for r in found.collect()} == {"a.TXT", "sub/b.md", "c.docx"}
    pages = {r["full_path"].rpartition("/")[2]: r for r in files.read_pages(spark, str(tmp_path)).collect()}
    assert (pages["a.TXT"]["content"], pages["a.TXT"]["confidence"]) == ("café", 0.9)
    assert (pages["b.md"]["content"], pages["b.md"]["confidence"]) == ("héllo", 1.0)
    assert pages["c.docx"]["error"]
    known = spark.createDataFrame([(str(tmp_path / "a.TXT"),)], "full_path string")
    assert files.new_files(found, known).count() == 2


def test_review_list_round_trip(spark, tmp_path):
    terms = spark.createDataFrame([(1, 'a, "b"\nc', 3, None), (2, "مصطلح", None, "term")], "id int, term string, frequency int, translation_en string")
    sinks.review_list(terms, str(tmp_path / "out"), "ar", "en")
    (tmp_path / "in.csv").write_text('term_id,corrected_translation_en\n1," x "\n2,\n9,z\nbad,q\n', encoding="utf-8")
    review = files.review_csv(spark, str(tmp_path / "in.csv"))
    rows = terms.withColumn("approved", F.lit(False))
    got = {r["id"]: (r["translation_en"], r["approved"]) for r in upserts.review_import(rows, review, "translation_en").collect()}
    assert got == {1: ("x", True), 2: ("term", True)}


def test_pipeline_continues_and_repeats_nothing(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.txt").write_text("tide audit tide audit tide audit of the harbour", encoding="utf-8")
    store = Store(spark, str(tmp_path / "store"))
    settings = pipeline.Settings(input_dir=str(source), output_dir=str(tmp_path / "out"), formats=("md", "docx"), min_frequency=3)
    pipeline.Pipeline(spark, store, settings).run()
    first = {t: sorted(map(str, store.read(t).drop("created_at", "updated_at").collect())) for t in ("doc_catalog", "pages", "terminology")}
    pipeline.Pipeline(spark, store, settings).run()
    assert first == {t: sorted(map(str, store.read(t).drop("created_at", "updated_at").collect())) for t in first}
    assert {r["term"] for r in store.read("terminology").collect()} >= {"tide", "audit", "tide audit"}
    assert {p.name for p in (tmp_path / "out").iterdir()} == {"a_en.md", "a_en.docx"}
    (source / "b.md").write_text("more", encoding="utf-8")
    pipeline.Pipeline(spark, store, settings).run()
    assert store.read("pages").count() == 2


def test_answers_fall_back_and_isolate_failures(spark):
    class Broken:
        name = "broken"

        def answer(self, prompts):
            raise OSError("down")

    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, prompt string")
    assert {r["model"] for r in providers.answers(df, "id", "prompt", Broken, providers.EchoModel, wait=0).collect()} == {"echo"}
    assert {r["error"] for r in providers.answers(df, "id", "prompt", Broken, wait=0).collect()} == {"down"}


def test_settings_from_yaml(tmp_path, monkeypatch):
    monkeypatch.setenv("LEX_LANG", "fr")
    (tmp_path / "c.yaml").write_text("target_lang: ${LEX_LANG}\nformats: [md, docx]\nunknown: 1\n")
    settings = pipeline.Settings.from_yaml(str(tmp_path / "c.yaml"))
    assert (settings.target_lang, settings.formats) == ("fr", ("md", "docx"))
    with pytest.raises(ValueError):
        pipeline.Pipeline(None, None, pipeline.Settings(target_lang="xx"))


def test_streams(spark, tmp_path, sf_dir):
    spark.read.parquet(f"{sf_dir}/processing_state.parquet").repartition(3).write.parquet(str(tmp_path / "in"))
    store = Store(spark, str(tmp_path / "store"))
    stream = ingest.table_stream(spark, "processing_state", str(tmp_path / "in"), per_trigger=1)
    ingest.upsert_stream(stream, store, "latest", ["document_id"], ["updated_at", "id"], str(tmp_path / "cp")).awaitTermination()
    want = state.latest(spark.read.parquet(f"{sf_dir}/processing_state.parquet"), ["document_id"], ["updated_at", "id"])
    assert sorted((r["document_id"], r["id"]) for r in store.read("latest").collect()) == sorted((r["document_id"], r["id"]) for r in want.collect())
    spark.read.parquet(f"{sf_dir}/processing_log.parquet").write.parquet(str(tmp_path / "log"))
    log = ingest.log_once(ingest.table_stream(spark, "processing_log", str(tmp_path / "log")), "3650 days")
    log.writeStream.format("memory").queryName("log_once").trigger(availableNow=True).start().awaitTermination()
    assert spark.table("log_once").count() == spark.read.parquet(f"{sf_dir}/processing_log.parquet").select("id").distinct().count()
