"""Operators on small rows: nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

from __future__ import annotations

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexiarc.llm import cut_texts, format_duplicates, leaked_items, packing, pieces, scan_noise, sentence_pairs, term_counts, tokens, transliterate

QUIET = {"deadline": None, "suppress_health_check": [HealthCheck.function_scoped_fixture]}


# ---- counts ----
@settings(max_examples=15, **QUIET)
@given(st.lists(st.tuples(st.sampled_from(["a", "b", "", None, "ç"]), st.sampled_from([1, 2, 3, None]), st.sampled_from([0, 5, None])), max_size=40))
def test_counts_match_plain(spark, rows):
    df = spark.createDataFrame(rows, "value string, record int, w int").withColumn("occurrences", F.lit(7))
    got = {r["value"]: (r["occurrences"], r["rows"], r["records"]) for r in term_counts.value_counts(df, "value", "record", F.col("w")).collect()}
    want = {}
    for v in {r[0] for r in rows} - {None}:
        own = [r for r in rows if r[0] == v]
        want[v] = (sum(1 if r[2] is None else r[2] for r in own), len(own), len({r[1] for r in own} - {None}))
    assert got == want


def test_counters_cross_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        rows = [(v, i % 7) for v in "abc" for i in range(50)]
        df = spark.createDataFrame(rows, "v string, r int").coalesce(1)
        got = {r["value"]: (r["rows"], r["records"]) for r in term_counts.value_counts(df, "v", "r").collect()}
        assert got == {v: (50, 7) for v in "abc"}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_counters_see_records_again(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        rows = [(v, r) for r in (1, 2, 1, None, 2, 1) for v in ("a", "b")] * 9
        got = term_counts.value_counts(spark.createDataFrame(rows, "v string, r int").repartition(5), "v", "r")
        assert {r["value"]: (r["rows"], r["records"]) for r in got.collect()} == {v: (54, 2) for v in "ab"}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_marks(spark):
    df = spark.createDataFrame([("often", 9, 9, 9), ("seldom", 2, 2, 2), ("between", 4, 4, 4)], "value string, occurrences long, rows long, records long")
    got = {r["value"]: r["mark"] for r in term_counts.mark_values(df, F.lit(100)).collect()}
    assert got == {"often": "common", "seldom": "rare", "between": None}


# ---- format copies ----
def test_format_copies(spark):
    rows = [
        (1, 1, "Tide-Audit", "x"), (2, 1, "tide  audit.", "X!"), (3, 1, "x", "TIDE audit"), (4, 1, "tide audit", None), (5, 1, "Tide audit", None), (6, 1, "tide audit", ""),
        (7, 2, "tide audit", "x"), (8, 1, "tide audít", "x"), (9, None, "a", "b"), (10, None, "A", "b"), (11, 1, None, None), (2, 1, "tide  audit.", "X!"),
    ]
    df = spark.createDataFrame(rows, "id int, doc int, term string, tr string").withColumn("copies", F.lit(0)).withColumn("h1", F.lit(1))
    pairs = {tuple(r) for r in format_duplicates.copy_pairs(df, "id", ["doc"], ["term", "tr"]).collect()}
    assert pairs == {(1, 2), (1, 3), (2, 3), (4, 5), (9, 10)}
    groups = {r["id"]: r["copies"] for r in format_duplicates.collapse(df, "id", ["doc"], ["term", "tr"]).collect()}
    assert groups == {1: 4, 4: 2, 6: 1, 7: 1, 8: 1, 9: 2, 11: 1}
    whole = format_duplicates.kept_rows(df, format_duplicates.collapse(df, "id", ["doc"], ["term", "tr"]), "id")
    assert {(r["id"], r["term"], r["copies"]) for r in whole.collect()} >= {(1, "Tide-Audit", 4), (11, None, 1)} and whole.count() == 7
    assert format_duplicates.collapse(df.limit(0), "id", ["doc"], ["term", "tr"]).count() == 0


def test_a_shared_hash_is_no_copy(spark, monkeypatch):
    monkeypatch.setattr(format_duplicates, "hash128", lambda text: [F.lit(1).alias("__h1"), F.lit(2).alias("__h2")])
    df = spark.createDataFrame([(1, 1, "a", "b"), (2, 1, "B.", "a"), (3, 1, "c", "d")], "id int, doc int, term string, tr string")
    assert {r["id"]: r["copies"] for r in format_duplicates.collapse(df, "id", ["doc"], ["term", "tr"]).collect()} == {1: 2, 3: 1}
    assert {tuple(r) for r in format_duplicates.copy_pairs(df, "id", ["doc"], ["term", "tr"]).collect()} == {(1, 2)}


# ---- packing ----
@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 500), max_size=25))
def test_plan_uses_the_histogram_up(histogram):
    lengths, counts = np.array(list(histogram), "int64"), np.array(list(histogram.values()), "int64")
    used: dict[int, int] = {}
    for times, parts in packing.plan(lengths, counts, 60):
        assert times > 0 and sum(n * m for n, m in parts) <= 60
        for n, m in parts:
            used[n] = used.get(n, 0) + times * m
    assert used == histogram


def test_least_squares_are_not_negative():
    rng = np.random.default_rng(0)
    a = rng.random((12, 6))
    x = np.abs(rng.normal(size=6)) * 50
    row, column = (v.ravel() for v in np.indices(a.shape))
    got = packing.nnls(row, column, a.ravel(), a @ x, 6, 5000)
    assert (got >= 0).all() and np.allclose(a @ got, a @ x, rtol=0.1, atol=5)


def test_least_squares_do_the_packing():
    """Most items go where least squares put them, in no more containers than greedy packing needs."""
    rng = np.random.default_rng(1)
    sizes = np.minimum(900, 12 + rng.lognormal(5, 0.8, 20_000).astype("int64"))
    for capacity in (1000, 3000):
        lengths, counts = np.unique(sizes, return_counts=True)
        left = dict(zip(lengths.tolist(), counts.tolist()))
        placed = sum(t * m for t, parts in packing._by_least_squares(dict(left), capacity) for _, m in parts)
        greedy = sum(t for t, _ in packing._greedy(dict(left), capacity))
        assert placed >= 0.9 * len(sizes)
        assert sum(t for t, _ in packing.plan(lengths, counts, capacity)) <= greedy


def test_packing_of_odd_rows(spark):
    rows = [(1, 10), (1, 10), (2, 0), (3, None), (None, 5), (4, 25), (5, 30), (6, 7)]
    df = spark.createDataFrame(rows, "record int, size int").withColumn("n_tokens", F.lit(1))
    got = packing.pack(df, "record", "size", [(9, 10)]).toPandas()
    assert got.groupby("record").n_tokens.sum().to_dict() == {1: 10, 4: 25, 5: 30, 6: 7}
    assert got.groupby("container").n_tokens.sum().max() <= 10
    assert packing.pack(df.limit(0), "record", "size", [(9, 10)]).count() == 0


# ---- pieces ----
@settings(max_examples=30, deadline=None)
@given(st.lists(st.sampled_from(["# Head\n", "word ", "Sentence. ", "- item\n", "\n\n", "الكلمة ", "é", "日本", "x" * 30, "1) a\n", "| a | b |\n", "\r\n"]), max_size=120))
def test_pieces_join_to_the_text(parts):
    text, enc = "".join(parts), tokens.encoding(tokens.tokenizer_path())
    out = list(pieces.pieces_of(enc, text, [(1, 24, 6), (2, 40, 0)])) if text else []
    for limit, size in ((1, 24), (2, 40)):
        own = [p for p in out if p[0] == limit]
        assert not own or "".join(p[7][p[4] :] for p in own) == text
        assert all(p[5] <= size and tokens.count(enc, p[7]) == p[5] for p in own)
        assert bool(own) == (tokens.count(enc, text) > size)


def test_pieces_prefer_strong_boundaries():
    enc = tokens.encoding(tokens.tokenizer_path())
    text = "# One\n" + "First part is here. " * 4 + "\n\n# Two\n" + "Second part is here. " * 4
    out = list(pieces.pieces_of(enc, text, [(1, 32, 0)]))
    assert [p[6] for p in out] == ["section", "end"]
    assert out[1][7].startswith("# Two")


def test_pieces_of_odd_rows(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "short"), (None, "word " * 99), (4, "word " * 99)], "id int, t string").withColumn("piece", F.lit(1))
    assert {r["record"] for r in pieces.split_texts(df, "id", "t", [(1, 32, 4)]).collect()} == {4}
    with pytest.raises(ValueError):
        pieces.split_texts(df, "id", "t", [(1, 32, 30)])


# ---- leaks ----
def test_longest_common_parts():
    assert leaked_items._longest_run([1, 2, 3, 9, 4, 5], [7, 1, 2, 3, 4, 5]) == (3, 0, 1)
    a, b = np.array([[1, 2, 3, 9, 4, 5], [1, 2, 3, 4, 5, -1]]), np.array([[7, 1, 2, 3, 4, 5, -2], [0, 0, 0, 0, 0, 0, 0]])
    assert leaked_items._runs_of_pairs(a, b).tolist() == [3, 0]
    assert leaked_items._common_subsequence([1, 2, 3, 9, 4, 5], [7, 1, 2, 3, 4, 5]) == 5
    assert leaked_items._common_subsequence([], [1]) == 0


def test_leaks_of_odd_rows(spark):
    item = " ".join(f"word{i}" for i in range(40))
    other = " ".join(f"other{i}" for i in range(400))
    rows = [(1, f"{other} {' ,'.join(item.upper().split()[10:26])} {other}"), (2, other), (3, None), (4, ""), (None, item), (5, item), (5, item), (6, " ".join(item.split()[:14]) + " " + other)]
    docs = spark.createDataFrame(rows, "doc_id int, text string").withColumn("item", F.lit(0)).withColumn("run", F.lit(0))
    items = spark.createDataFrame([(7, item), (8, None), (9, ""), (7, item)], "item_id int, text string")
    got = {(r["record"], r["item"]) for r in leaked_items.leaks(docs, "doc_id", "text", items, "item_id", "text").where("run >= 15").collect()}
    assert got == {(1, 7), (5, 7)}
    assert leaked_items.leaks(docs.limit(0), "doc_id", "text", items, "item_id", "text").count() == 0
    assert leaked_items.leaks(docs, "doc_id", "text", items.limit(0), "item_id", "text").count() == 0


def test_the_latent_space_is_fitted_on_all_passages(spark):
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{w}" for w in rng.integers(0, 300, n)) for n in (1000, 33, 32, 5, 64)] + [" - ", ""]
    options = leaked_items.Options(features=64, rank=8)
    docs = spark.createDataFrame(list(enumerate(texts)), "record long, text string")
    frequency, n, passages = leaked_items._counted(docs, options)
    columns = leaked_items._Columns(64)
    coded = [[columns[w] for w in leaked_items.words(t)] for t in texts]
    whole = [t[i : i + 32] for t in coded for i in range(0, len(t), 32)]
    assert n == 5 and frequency.tolist() == [sum(c in t for t in coded) for c in range(64)]
    # A'(A x) is that of every passage, the 32nd of a long text too
    weights, x = rng.random(64).astype("float32") + 1, rng.normal(size=(64, 24)).astype("float32")
    rows = np.array([np.bincount(p, minlength=64) * weights / np.sqrt((weights[p] ** 2).sum()) for p in whole])
    got, found = leaked_items._distributed_product(passages, weights, x, options)
    assert found == len(whole) == 38 and np.allclose(got, rows.T @ (rows @ x), rtol=1e-3, atol=1e-3)
    assert leaked_items._distributed_product(passages.limit(0), weights, x, options)[0].any() == False  # noqa: E712


def test_cells_leave_no_candidate_out():
    rng = np.random.default_rng(5)
    scaled = rng.normal(size=(512, 24)).astype("float32")
    options = leaked_items.Options(features=512, rank=24)
    vocabulary = [f"w{i}" for i in range(300)]
    items = leaked_items._Items(list(range(40)), [" ".join(rng.choice(vocabulary, rng.integers(5, 90))) for _ in range(40)], scaled, options)
    vectors, owner = (np.concatenate(v) for v in zip(*items.cells))
    passages = leaked_items._rows_to_unit(vectors[rng.integers(0, len(vectors), 200)] + rng.normal(size=(200, 24)).astype("float32") * 0.15)
    cosines = passages @ vectors.T
    for least in (0.3, 0.65, 0.9):
        row, col = np.nonzero(cosines >= least)
        got = items.near(passages, least)
        assert set(zip(got[0].tolist(), got[1].tolist())) == set(zip(row.tolist(), owner[col].tolist()))


def test_planted_paraphrases(spark, sf_dir):
    """Items told again in other words, inside documents of the tables: the words for things change, names and numbers stay."""
    rng = np.random.default_rng(8)
    texts = [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").where("length(text) > 500").orderBy("doc_id").collect()]
    items = spark.read.parquet(f"{sf_dir}/eval_items.parquet").where("lang = 'en'").orderBy("item_id").limit(40)
    rows, planted = [], set()
    for k, r in enumerate(items.collect()):
        told = [w if i % 8 else f"otherwise{rng.integers(30)}" for i, w in enumerate(r["text"].split())]
        rows.append((k, f"{texts[k % len(texts)]} {' '.join(told)} {texts[(k + 1) % len(texts)]}"))
        planted.add((k, r["item_id"]))
    rows += [(1000 + k, t) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    found = leaked_items.leaks(docs, "doc_id", "text", items, "item_id", "text").where("run < 15")
    got = {(r["record"], r["item"]) for r in found.collect() if r["record"] < 1000}
    assert len(got & planted) >= 0.9 * len(planted)
    assert len(got - planted) <= 0.1 * len(planted)


# ---- cut texts ----
def test_cut_texts(spark):
    rows = [
        (1, "A whole sentence.", None, False), (2, "A sentence that st", None, True), (3, "Done.\n\n- well of Kusota\n- tide of Mama", "- بئر في كوسوتا\n- مد في ماما", False),
        (4, "Done.\n\n- well of Kusota\n- tide of Ma", "- بئر في كوسوتا\n- مد في ماما", True), (5, "It covers 17.", "مساحة 17.3 كم", True), (6, "It is 17.", "عدد 17", False), (7, "Bytes �", None, True),
        (8, "Text.\n| a | 3 |", None, False), (9, "Text.\n| a | 3", None, True), (10, "Open (see below.", None, True), (11, None, None, None), (12, "", None, None), (13, "  \n", None, None), (14, "fro&am", None, True), (15, "It could be merged w...", None, True), (16, "All is said. ...", None, False), (17, "- a of Kus…", None, True),
        (18, 'They said "it is done.', None, True), (19, 'They said "it is done."', None, False), (20, "<table><tr><td>One.</td></tr>", None, True), (21, "<p>One<br>two.</p>", None, False), (22, "```\nrun it.", None, True), (23, "```\nrun it.\n```\n\nDone.", None, False), (24, "An open (bracket.\n\nAnd on.", None, True), (25, 'A pipe of 3" is wide.', None, False),
    ]
    df = spark.createDataFrame([(i, t, s, 1) for i, t, s, _ in rows] * 2, "id int, t string, s string, doc int").withColumn("kind", F.lit(1)).withColumn("cut", F.lit(2))
    names = spark.createDataFrame([(1, "c"), (1, "c")], "doc int, collection string")
    got = {r["record"]: r["cut"] for r in cut_texts.cut_texts(df, "id", "t", "s", "doc", names).collect()}
    assert got == {i: c for i, _, _, c in rows if c is not None}
    assert cut_texts.cut_texts(df.limit(0), "id", "t", "s", "doc", names.limit(0)).count() == 0


def test_codes_of_names(spark):
    pairs = [("Kusota", "كوسوتا"), ("Shithomi", "شيثومي"), ("Feyu", "فييو"), ("Ghafa", "غافا"), ("Yukune", "يوكوني")]
    assert all(transliterate.code_text(a) == transliterate.code_text(b) for a, b in pairs)
    df = spark.createDataFrame(pairs, "a string, b string")
    assert all(r[0] == r[1] == transliterate.code_text(r[2]) for r in df.select(transliterate.code(F.col("a")), transliterate.code(F.col("b")), "a").collect())


# ---- sentences ----
def test_sentences():
    assert sentence_pairs.sentences("One 2.5 two. Three?\n\nFour") == ["One 2.5 two.", "Three?", "Four"]
    assert sentence_pairs.sentences(" \n ") == []


def test_alignment_of_merged_moved_and_missing():
    o = sentence_pairs.Options()
    a = sentence_pairs.Side("Rain hit Kusota in 1990. Tibi holds 41 maps. The year 1777 was dry in Baha. Nothing else.", sentence_pairs.Reader())
    b = sentence_pairs.Side("وصل 1777 إلى باها. المطر في كوسوتا عام ١٩٩٠ و تيبي 41.", sentence_pairs.Reader())
    assert sentence_pairs.align(a, b, {}, o) == [(0, 1), (1, 1), (2, 0)]
    assert sentence_pairs.align(a, sentence_pairs.Side("", sentence_pairs.Reader()), {}, o) == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.floats(0.5, 9)), max_size=9, unique_by=lambda x: x[0]))
def test_chain_is_the_heaviest(steps):
    from itertools import combinations

    anchors = [(i, j, s) for i, (j, s) in enumerate(steps)]
    rising = [c for n in range(len(anchors) + 1) for c in combinations(anchors, n) if all(a[1] < b[1] for a, b in zip(c, c[1:]))]
    best = max(sum(s for _, _, s in c) for c in rising)
    got = sentence_pairs._chain(anchors)
    weight = {(i, j): s for i, j, s in anchors}
    assert abs(sum(weight[p] for p in got) - best) < 1e-9 and all(a[1] < b[1] for a, b in zip(got, got[1:]))


def test_long_gaps_are_divided(monkeypatch):
    a = sentence_pairs.Side(" ".join(f"On day {i} rain fell." for i in range(1000, 1400)), sentence_pairs.Reader())
    b = sentence_pairs.Side(" ".join(f"Le jour {i} la pluie." for i in range(1000, 1400)), sentence_pairs.Reader())
    pairs: set = set()
    near = [{i: 1.0} for i in range(400)]
    sentence_pairs._gap(0, 400, 0, 400, lambda i, j: float(i == j), near, pairs)
    assert pairs == {(i, i) for i in range(400)}
    assert sentence_pairs.align(a, b, {}, sentence_pairs.Options()) == [(i, i) for i in range(400)]


def test_languages_by_their_frequent_words():
    known = {"en": frozenset({"the", "of"}), "fr": frozenset({"le"}), "ar": frozenset({"في"})}
    assert [sentence_pairs.language(t, known) for t in ("x " * 5000 + "the of le", "le", "كان في", "", "zz")] == ["en", "fr", "ar", "other", "other"]


def test_pairs_of_odd_rows(spark):
    rows = [(1, "In 1990 a. In 1991 b.", "En 1990 a. En 1991 b."), (1, "In 1990 a. In 1991 b.", "En 1990 a. En 1991 b."), (2, None, "x."), (3, "x.", None), (4, "", " "), (None, "In 5.", "En 5.")]
    df = spark.createDataFrame(rows, "id int, s string, t string").withColumn("lang", F.lit(1)).withColumn("source", F.lit(1))
    got = {tuple(r) for r in sentence_pairs.sentence_pairs(df, "id", "s", {"fr": "t"}).collect()}
    assert got == {(1, "fr", 0, 0), (1, "fr", 1, 1)}
    assert sentence_pairs.sentence_pairs(df.limit(0), "id", "s", {"fr": "t"}).count() == 0


def test_the_lexicon_is_learned_from_all_pages(spark, monkeypatch):
    # the words "ember" and "braise" meet on four pages of 12,000, beside a name and a number of their own
    def page(i):
        word = ("ember", "braise") if i % 3000 == 7 else (f"stock{i % 50}", f"cave{i % 50}")
        return i, f"Kusota{'abcdefghij'[i % 10]} {i} {word[0]} here.", f"Kusota{'abcdefghij'[i % 10]} {i} {word[1]} ici."

    held, learned = [], sentence_pairs._learned
    monkeypatch.setattr(sentence_pairs, "_learned", lambda *of: held.append(learned(*of)) or held[-1])
    df = spark.createDataFrame([page(i) for i in range(12_000)], "id long, s string, t string")
    sentence_pairs.sentence_pairs(df, "id", "s", {"fr": "t"})
    entries = {(x, y): n for words in held[0][0].values() for x, own in words.items() for y, n in own}
    assert entries["ember", "braise"] == entries["braise", "ember"] == 1.0


def test_parallel_sentences_of_many_texts_are_those_of_each():
    texts = [
        ("Rain hit Kusota in 1990. Tibi holds 41 maps. The year 1777 was dry in Baha. Nothing else.", "وصل 1777 إلى باها. المطر في كوسوتا عام ١٩٩٠ و تيبي 41."),
        ("Rain hit Kusota in 1990. Tibi holds 41 maps. The year 1777 was dry in Baha. Nothing else.", "Kusota 1990. Tibi 41. Baha 1777, Kusota."), ("", "x 5."), ("A 12 12 12. B 12.", "C 12. D 12."), ("In 5 the gar-\nden of Miro.", "5 Miro\u200b. No."),
    ]
    tokens, reader, want = sentence_pairs._Tokens(), sentence_pairs.Reader(), []
    for n, (source, target) in enumerate(texts):
        a, b = sentence_pairs.Side(source, reader), sentence_pairs.Side(target, reader)
        want += [(n, a.words[i], b.words[j]) for i, j, _ in sentence_pairs._anchors(sentence_pairs._scores(a, b, {})[0], b.n, 3.0)]
    of, sides = sentence_pairs._parallel(texts, tokens, 3.0)
    names = list(tokens.words)
    split = [[{names[w] for w in part} for part in np.split(flat, np.cumsum(sizes)[:-1])] for flat, sizes in sides]
    assert len(want) > 4 and list(zip(of.tolist(), *split)) == want


# ---- scans ----
def _scan_rows():
    clean = "The harbour protocol covers the market and the school. A cross-border group compared the parcel register with the harbour protocol."
    rows = [(100 + i, 100 + i, 0, clean, "native-text") for i in range(30)]
    page = "Harbour Protocol — Kusota    {n}\nThe harbour {w} covers the mar-\nket and the school. A cross-\nborder group compared the parcel register."
    rows += [(i, 1, i, page.format(n=i + 4, w="protocol"), "ocr-x") for i in range(4)]
    rows += [(9, 1, 9, page.format(n=13, w="pr0tocol"), None), (10, 2, 0, None, "ocr-x"), (11, 2, 1, "", "ocr-x"), (12, None, 0, "The market.", "ocr-x"), (None, 1, 0, "The mar-\nket", "ocr-x"), (0, 1, 0, page.format(n=4, w="protocol"), "ocr-x")]
    return rows


def test_page_noise(spark):
    df = spark.createDataFrame(_scan_rows(), "id int, doc int, page_number int, t string, m string").withColumn("noise", F.lit(1)).withColumn("word", F.lit(1))
    got = {tuple(r) for r in scan_noise.page_noise(df, "id", "doc", "t", "m").collect()}
    want = {(i, k) for i in (0, 1, 2, 3, 9) for k in ("hyphen_break", "running_header", "page_number")} | {(9, "bad_char")}
    assert got == want
    assert scan_noise.page_noise(df.limit(0), "id", "doc", "t", "m").count() == 0


def test_readable_pages(spark):
    df = spark.createDataFrame(_scan_rows(), "id int, doc int, page_number int, t string, m string")
    got = {(r["page"], r["paragraph_no"]): r["text"] for r in scan_noise.readable_pages(df, "id", "doc", "t", "m").collect()}
    text = "The harbour protocol covers the market and the school. A cross-border group compared the parcel register."
    assert got == {**{(i, 0): text for i in (0, 1, 2, 3, 9)}, (12, 0): "The market."}


def test_a_page_of_one_long_line(spark):
    df = spark.createDataFrame([(1, 1, "word " * 60_000, "ocr-x")], "id int, doc int, t string, m string")
    assert scan_noise.page_noise(df, "id", "doc", "t", "m").count() == 0
