"""What the stages hand on: from page to page, and from terms to prompts."""

from __future__ import annotations

import random

from lexiarc.operators import context
from lexiarc.plans import pipeline
from lexiarc.schemas import TABLES
from lexiarc.store import Store


def table(spark, name, rows):
    columns = TABLES[name].fieldNames()
    return spark.createDataFrame([tuple(r.get(c) for c in columns) for r in rows], TABLES[name])


def repeats():
    """A model that replies with its prompt; made here, so that it travels to the tasks."""

    class Repeats:
        name = "repeats"

        def answer(self, prompts):
            if any("fails" in p.split("# Text\n")[-1] for p in prompts):
                raise OSError("down")
            return [f"<{p.split('# Text\n')[-1].split()[0]}>|{p}" for p in prompts]

    return Repeats


def test_prompts_have_the_translations_just_made(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.replace("doc_catalog", table(spark, "doc_catalog", [{"id": d, "file_name": f"{d}.txt", "total_pages": 3} for d in (1, 2)]))
    texts = [(1, 0, "one", None), (1, 1, "two", None), (1, 2, "three", None), (2, 0, "four", "kept"), (2, 1, "five", None), (2, 2, "  ", None), (2, 3, "six", None)]
    store.replace("pages", table(spark, "pages", [{"id": i, "document_id": d, "page_number": n, "original_content": t, "en_content": e} for i, (d, n, t, e) in reversed(list(enumerate(texts)))]))
    pipeline.Pipeline(spark, store, pipeline.Settings(), repeats()).translate()
    got = {r["id"]: r["en_content"] for r in store.read("pages").collect()}
    assert "came before" not in got[0]
    assert "before:\n[Page 1]: <one>|" in got[1] and f"ends with:\n...{got[0][-200:]}\n" in got[1]
    assert "before:\n[Page 2]: <two>|" in got[2] and "[Page 1]: <one>|" in got[2] and f"ends with:\n...{got[1][-200:]}\n" in got[2]
    assert got[3] == "kept" and "[Page 1]: kept\n" in got[4] and "ends with:\n...kept\n" in got[4]
    assert got[5] is None and "[Page 2]: <five>|" in got[6] and "[Page 1]: kept" in got[6]


def test_a_page_that_fails_leaves_the_others(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.replace("pages", table(spark, "pages", [{"id": n, "document_id": 1, "page_number": n, "original_content": t} for n, t in enumerate(["one", "fails", "three"])]))
    pipeline.Pipeline(spark, store, pipeline.Settings(), repeats()).translate()
    got = {r["id"]: r["en_content"] for r in store.read("pages").collect()}
    assert got[1] is None and "[Page 1]: <one>|" in got[2]


def test_context_of_a_page_is_that_of_the_columns(spark):
    rng = random.Random(3)
    rows = [(d, n, None if rng.random() < 0.3 else "ab é" * rng.choice([0, 1, 40, 62, 63, 70, 200]) + "x") for d in range(6) for n in range(6)]
    df = spark.createDataFrame(rows, "document_id int, page_number int, translation string")
    for budget, snippet in ((500, 250), (200, 250), (260, 250), (10, 4)):
        want = {(r["document_id"], r["page_number"]): (r["previous_summary"], r["previous_ending"]) for r in context.previous_context(df, "translation", budget, snippet).collect()}
        for d, n, _ in rows:
            before = [(m, t.strip()) for e, m, t in reversed(rows) if e == d and m < n and t]
            assert context.context_of(before, budget, snippet) == want[d, n]


def test_glossary_and_translated_terms_reach_the_prompts(spark, tmp_path):
    class Terms:
        name = "terms"

        def answer(self, prompts):
            import json
            import re

            return ["```json\n" + json.dumps({t: t.upper() for t in re.findall('- Term: "(.*)"', p)}) + "\n```" if p.startswith("Give the ") else p for p in prompts]

    source = tmp_path / "in"
    source.mkdir()
    listed = "\n".join(f"| mot{i} | the meaning of {i} |" for i in range(3))
    (source / "a.md").write_text(f"# Glossary\n\n| Term | Definition |\n| --- | --- |\n{listed}\n| Mot1 | again |\n\n" + "tide audit " * 5, encoding="utf-8")
    (source / "b.txt").write_text(" ".join(f"alpha{chr(97 + i // 26)}{chr(97 + i % 26)} " * 4 for i in range(60)), encoding="utf-8")
    (source / "c.txt").write_text("nothing comes back", encoding="utf-8")
    store = Store(spark, str(tmp_path / "store"))
    settings = pipeline.Settings(input_dir=str(source), output_dir=str(tmp_path / "out"))
    pipeline.Pipeline(spark, store, settings, Terms).run()
    name = {r["id"]: r["file_name"] for r in store.read("doc_catalog").collect()}
    rows = store.read("terminology").collect()
    of_a = {r["term"]: r for r in rows if name[r["document_id"]] == "a.md"}
    assert {t: of_a[t]["translation_en"] for t in ("mot0", "mot1", "mot2")} == {f"mot{i}": f"the meaning of {i}" for i in range(3)}
    assert (of_a["mot0"]["frequency"], of_a["mot0"]["context"], of_a["mot0"]["approved"]) == (100, "From glossary page 1", True)
    assert of_a["tide"]["translation_en"] == "TIDE" and "Mot1" not in of_a
    of_b = [r for r in rows if name[r["document_id"]] == "b.txt"]
    assert len(of_b) > 50 and all(r["translation_en"] == r["term"].upper() for r in of_b)
    prompt = {name[r["document_id"]]: r["en_content"] for r in store.read("pages").collect()}
    assert "  - mot0 → the meaning of 0\n" in prompt["a.md"] and "  - tide → TIDE\n" in prompt["a.md"]
    assert prompt["b.txt"].count(" → ") == 30 and "how to render" not in prompt["c.txt"]
    assert len(rows) == len({r["id"] for r in rows})


def test_failures_are_told(spark, tmp_path):
    source = tmp_path / "in"
    (source / "sub").mkdir(parents=True)
    (source / "a.txt").write_text("fails", encoding="utf-8")
    (source / "b.docx").write_bytes(b"broken")
    (source / "c.pdf").write_bytes(b"%PDF")
    (source / "d.TXT").write_text("fine", encoding="utf-8")
    (source / "sub" / "d.md").write_text("also fine", encoding="utf-8")
    store = Store(spark, str(tmp_path / "store"))
    settings = pipeline.Settings(input_dir=str(source), output_dir=str(tmp_path / "out"))
    pipeline.Pipeline(spark, store, settings, repeats()).run()
    catalog = {r["relative_path"]: (r["status"], r["total_pages"], r["id"]) for r in store.read("doc_catalog").collect()}
    assert {k: v[:2] for k, v in catalog.items()} == {"a.txt": ("failed", 1), "b.docx": ("failed", 0), "c.pdf": ("failed", 0), "d.TXT": ("completed", 1), "sub/d.md": ("completed", 1)}
    log = store.read("processing_log").collect()
    assert {(r["document_id"], r["stage"]) for r in log if r["level"] == "ERROR"} == {(catalog["a.txt"][2], "page_translate"), (catalog["b.docx"][2], "ocr"), (catalog["c.pdf"][2], "ocr")}
    assert any("no reader for pdf" in r["message"] for r in log) and any("down" in r["message"] for r in log)
    assert len(log) == len({r["id"] for r in log})
    states = {(r["document_id"], r["stage"]): r["status"] for r in store.read("processing_state").collect()}
    assert states[catalog["a.txt"][2], "page_translate"] == "failed" and states[catalog["d.TXT"][2], "export"] == "completed"
    assert {p.name for p in (tmp_path / "out").iterdir()} == {f"d_{catalog[n][2]}_en.md" for n in ("d.TXT", "sub/d.md")}
    assert store.vacuum("pages") > 0 and store.read("pages").count() == 3


def test_a_reader_of_another_kind(spark, tmp_path):
    class Lines:
        name = "lines"

        def pages(self, path, raw):
            if raw == b"?":
                raise ValueError("odd")
            return [(line, 0.9) for line in raw.decode().split("|")]

    (tmp_path / "a.pdf").write_bytes(b"one|two")
    (tmp_path / "b.pdf").write_bytes(b"?")
    from lexiarc.sources import files

    got = {(r["full_path"].rpartition("/")[2], r["page_number"]): (r["content"], r["ocr_model"], r["error"]) for r in files.read_pages(spark, str(tmp_path), readers={"pdf": Lines}).collect()}
    assert got == {("a.pdf", 0): ("one", "lines", None), ("a.pdf", 1): ("two", "lines", None), ("b.pdf", 0): ("", "lines", "ValueError: odd")}


def test_review_by_the_command_line(spark, tmp_path, monkeypatch):
    from lexiarc import cli

    monkeypatch.setattr(type(spark), "stop", lambda self: None)
    store = Store(spark, str(tmp_path / "store"))
    cli.main(["init", "--store", store.folder])
    assert {t for t in TABLES if store.version(t)} == set(TABLES)
    store.replace("terminology", table(spark, "terminology", [{"id": 1, "document_id": 1, "term": "marée", "translation_en": "sea", "approved": False}]))
    cli.main(["terms", "--store", store.folder, "--file", str(tmp_path / "list")])
    assert spark.read.option("header", True).csv(str(tmp_path / "list")).count() == 1
    (tmp_path / "in.csv").write_text("term_id,corrected_translation_en\n1,tide\n", encoding="utf-8")
    cli.main(["approve", "--store", store.folder, "--file", str(tmp_path / "in.csv")])
    row = store.read("terminology").first()
    assert (row["translation_en"], row["approved"]) == ("tide", True)
    for command in ("stats", "status", "logs"):
        cli.main([command, "--store", store.folder])


def test_search_tools(spark):
    from lexiarc.operators.tools import TOOLS, SearchTools

    rows = spark.createDataFrame([(1, 7, "tide", "marée", 3, None, [1.0, 0.0], True), (2, 7, "audit", "contrôle", None, "tide audit", [0.8, 0.6], None), (3, 8, "tide", None, 1, "", None, False)], "id int, document_id int, term string, translation_en string, frequency int, context string, embedding array<float>, approved boolean")
    tools = SearchTools(rows, embed=lambda q: [1.0, 0.0])
    assert [r["id"] for r in tools.call("search_terms", {"query": "tide", "mode": "meaning"})] == [1, 2]
    assert {r["id"] for r in tools.call("search_terms", {"query": "tide", "mode": "words"})} == {1, 2, 3}
    assert {r["id"] for r in tools.call("search_terms", {"query": "tide"})} == {1, 2, 3}
    assert tools.call("lookup_term", {"query": "tide"})[0]["translation"] == "marée" and tools.call("lookup_term", {"query": "Tide"}) == []
    assert [r["translation"] for r in tools.call("suggest_translations", {"query": "tide"})] == ["marée"]
    assert "error" in tools.call("nothing", {}) and "error" in tools.call("lookup_term", {"wrong": 1}) and "error" in tools.call("search_terms", {"query": "x", "mode": "y"})
    assert [t["name"] for t in TOOLS] == ["search_terms", "lookup_term", "suggest_translations"]
    assert SearchTools(rows.limit(0)).search_terms("tide").count() == 0
