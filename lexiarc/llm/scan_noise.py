"""Problem 1: noise in the text of scanned pages.

Four kinds of noise are found, and repaired by ``readable_pages``:

``hyphen_break``
    A mark between letters at a line's end.  A hyphen that the corpus has inside
    a line of trusted text, between the same parts, is the word's own.
``bad_char``
    Words are grouped by their skeleton, in which glyphs that are mistaken for
    each other are one.  A word that trusted text (pages that were not scanned)
    doesn't know is wrong if its group has a form that is known in many more
    documents, or that its own document uses more often, or if undoing one
    confusion turns impossible letter sequences into known ones.
``running_header``
    First and last lines without their page number, as skeletons with digits
    masked, that return on other pages of the document.
``page_number``
    A page number in the first or last line, alone or beside the header.

Words are counted per document first, so that a frequent word reaches a reducer
as one row a document; the words that most documents share are then dropped by a
broadcast of bounded size, and only the rare rest is joined.  Lines are reduced
to the outermost two on either side before they are shuffled by document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut_lineage
from .uniform_text import character_rows, compositions

# Glyph groups that are mistaken for each other, as (read, meant).
DIGIT_AS_LETTER = dict(zip("01956", "olgsb"))
GROUPS = [("rn", "m"), ("ri", "n"), ("vv", "w"), ("cl", "d"), ("ii", "u"), ("li", "h")]
LATIN_CLASSES = dict(zip("achfi", "oebtl"))
ARABIC_CLASSES = dict(zip("ثبنزشذغجخضظقةؤ", "تتترسدعححصطفهو"))
# Single confusions to undo in a word, as (read, meant).
UNDONE = [("c", "e"), ("o", "a"), ("f", "t"), ("0", "o"), ("0", "a"), ("ri", "n"), ("1", "l"), ("1", "i"), ("ii", "u"), ("cl", "d"), ("b", "h"), ("9", "g"), ("l", "i"), ("rn", "m"), ("vv", "w"), ("h", "li"), ("m", "rn"), ("5", "s"), ("6", "b"), ("i", "l")]
# Words that stand before a page number.
PAGE_WORDS = ["p", "pp", "pg", "page", "pages", "صفحة", "ص", "seite", "pagina"]

_ACCENTED = "aceinouyACEINOUY"
_BREAK = r"[-=¬­‐](?<=\p{L}.)[ \t]*\r?\n[ \t]*(?=\p{L})"
_WORD = r"[\p{L}\p{M}\p{N}]+"
_NATIVE = "native-text"

#: Characters at either end of a page among which its outer lines are looked for.
WINDOW = 1000
_BLANK = " \t\r\n\u000b\u000c\u00a0"

#: Share of documents from which on a known word is frequent; at most words-per-document / share words are.
FREQUENT_SHARE = 0.005


@lru_cache(maxsize=1)
def _plain_table() -> tuple[str, str, str]:
    """Single characters that look like others, what they look like, and those that show nothing."""
    single, meant, nothing = [], [], []
    for ch, parts, _, alike in character_rows():
        if not parts:
            nothing.append(ch)
        elif alike or len(parts) == 1 and parts[0] != ch and ("＀" <= ch or "ﭐ" <= ch or ch in "یکہھە" or parts[0] == " "):
            if ord(ch) < 0x10000:
                single.append(ch)
                meant.append(alike or parts[0])
    return "".join(single), "".join(meant), "".join(c for c in nothing if ord(c) < 0x10000 and not "\ud800" <= c <= "\udfff")


def plain(text: Column) -> Column:
    """A text with disguised characters replaced, so that only wrongly read ones are left."""
    single, meant, nothing = _plain_table()
    out = F.translate(text, single + nothing, meant)
    pairs = [(pair, ch) for pair, ch in compositions().items() if pair[0] in _ACCENTED and pair[1] in "\u0300\u0301\u0302\u0303\u0308\u0327"]
    # one small loop over the pairs instead of an expression for each
    table = F.array(*(F.struct(F.lit(pair).alias("a"), F.lit(ch).alias("b")) for pair, ch in pairs))
    accented = F.aggregate(table, out, lambda acc, p: F.replace(acc, p["a"], p["b"]))
    return F.when(text.rlike(r"[\u0300-\u0327]"), accented).otherwise(out)


def skeleton(word: Column) -> Column:
    """What a lower-case word has in common with all its misreadings."""
    out = F.translate(word, "".join(DIGIT_AS_LETTER), "".join(DIGIT_AS_LETTER.values()))
    for read, meant in GROUPS:
        out = F.replace(out, F.lit(read), F.lit(meant))
    classes = {**LATIN_CLASSES, **ARABIC_CLASSES}
    return F.translate(out, "".join(classes), "".join(classes.values()))


# ---- lines -----------------------------------------------------------------------------------
_NUMBER = r"(?:[\p{Nd}OoIl]{1,6}|[ivxlcdm1]{1,8})"
_PAGE_WORD = "(?:" + "|".join(PAGE_WORDS) + "|p[ao0][g9][ec]|صف[حجخ][ةه])"
_PAGE_NUMBER = rf"(?iu)^[\[(\-–—\s]*(?:{_PAGE_WORD}\.?\s*)?{_NUMBER}(?:\s*/\s*{_NUMBER}|\s+(?:of|sur|من|von|de|[\p{{L}}\p{{N}}]{{2,3}})\s+{_NUMBER})?[\])\-–—\s]*$"
_PARTS = r"\s{2,}|\s*\|\s*|\t+"


def outer_lines(pages: DataFrame) -> DataFrame:
    """The two first and two last lines of each page: ``page``, ``document``, ``side``, ``depth``, ``line``."""
    # headers are short: what is longer than the window is no header, whole or not
    whole = F.ltrim(F.rtrim(F.col("text"), F.lit(_BLANK)), F.lit(_BLANK))
    window = lambda part: F.filter(F.split(part, "\n"), lambda x: F.trim(F.rtrim(x, F.lit("\r"))) != "")
    rows = pages.select("page", "document", window(F.left(whole, F.lit(WINDOW))).alias("head"), window(F.right(whole, F.lit(WINDOW))).alias("tail"))
    n, m = F.size("head"), F.size("tail")
    spots = [("top", 1, F.get("head", 0), n > 0), ("top", 2, F.get("head", 1), n > 3), ("end", 1, F.get("tail", m - 1), m > 0), ("end", 2, F.get("tail", m - 2), m > 3)]
    kept = F.array(*(F.struct(F.lit(side).alias("side"), F.lit(depth).alias("depth"), F.when(there, F.trim(F.rtrim(line, F.lit("\r")))).alias("line")) for side, depth, line, there in spots))
    return rows.select("page", "document", F.explode(kept).alias("k")).select("page", "document", "k.*").where("line <> ''").distinct()


def _headers(lines: DataFrame) -> DataFrame:
    """Lines with ``numbered`` (has a page number), ``alone`` (has nothing else) and ``header`` (returns on other pages)."""
    line = plain(F.col("line"))
    parts = F.split(F.trim(line), _PARTS)
    is_number = lambda c: c.rlike(_PAGE_NUMBER)
    rows = lines.select("*", F.trim(line).alias("plain"), parts.alias("parts"))
    first, last, n = F.get("parts", 0), F.element_at("parts", -1), F.size("parts")
    rows = rows.withColumn("alone", is_number(F.col("plain"))).withColumn("side_no", F.when((n > 1) & is_number(last), 1).when((n > 1) & is_number(first), 0))
    rest = F.when(F.col("side_no") == 1, F.slice("parts", 1, n - 1)).when(F.col("side_no") == 0, F.slice("parts", 2, n - 1)).otherwise(F.col("parts"))
    rows = rows.withColumn("rest", F.array_join(rest, " "))
    # lines that can be headers: a few words, no list item, no end of a sentence
    few = F.regexp_count("rest", F.lit(_WORD)) <= 9
    can = ~F.col("alone") & few & F.col("rest").rlike(r"\p{L}{2}") & ~F.col("rest").rlike(r"^\s*[-*•]\s|[.!?؟,،;؛:]\s*$|\p{L}[-=¬\u00AD‐]\s*$")
    key = F.regexp_replace(skeleton(F.lower(F.regexp_replace("rest", r"\p{N}+", "#"))), r"[^\p{L}\p{M}#]+", "")
    # four lines a page at most; they are used several times below
    rows = cut_lineage(rows.select("page", "document", "side", "depth", "line", "alone", "side_no", F.when(can, key).alias("key"), F.regexp_count("plain", F.lit(_WORD)).alias("n_words")))
    # how many pages of the document have the key, on any side
    keyed = rows.where("key is not null")
    counted = keyed.groupBy("document", "key").agg(F.count_distinct("page").alias("pages"), F.max(F.col("side_no").isNotNull()).alias("with_number"))
    sizes = rows.groupBy("document").agg(F.count_distinct("page").alias("of"))
    best = counted.groupBy("document").agg(F.max(F.struct("pages", "key", "with_number")).alias("b")).where("b.pages > 1").join(sizes, "document")
    best = best.select("document", "of", F.when((F.col("b.pages") * 2 > F.col("of")) | (F.col("b.pages") > 2) | F.col("b.with_number"), F.col("b.key")).alias("main"))
    rows = rows.join(counted.where("pages > 1"), ["document", "key"], "left").join(best, "document", "left")
    returns = F.col("pages").isNotNull() & (F.col("side_no").isNotNull() | F.col("with_number") | (F.col("pages") * 2 > F.col("of")) | (F.col("n_words") <= 7))
    # the document's main header with other misreadings; a header of three letters or less has no room for them
    close = F.col("key").isNotNull() & F.col("main").isNotNull() & (F.length("main") > 6) & (F.levenshtein("key", "main") <= F.when(F.length("main") > 14, 3).otherwise(2))
    rows = rows.withColumn("returns", F.coalesce(returns | close, F.lit(False)))
    # the second line only counts where the first one is a header or a number
    outer = Window.partitionBy("document", "page", "side")
    shell = F.max((F.col("depth") == 1) & (F.col("alone") | F.col("returns"))).over(outer)
    valid = (F.col("depth") == 1) | shell
    return rows.withColumn("valid", valid).select("page", "document", "side", "depth", "line", (valid & F.col("returns")).alias("header"), (valid & (F.col("alone") | F.col("side_no").isNotNull() & F.coalesce("returns", F.lit(False)))).alias("numbered"), (valid & F.col("alone")).alias("alone"))


# ---- words -----------------------------------------------------------------------------------
def _tokens(pages: DataFrame) -> DataFrame:
    """``page``, ``document``, ``native``, ``word`` of the plain texts, breaks joined, in lower case; numbers are left out."""
    joined = F.regexp_replace(plain(F.col("text")), _BREAK, "")
    words = F.array_distinct(F.regexp_extract_all(F.lower(joined), F.lit(r"[\p{L}\p{M}\p{N}]{2,}"), F.lit(0)))
    digit = F.col("word").between("0", ":") | F.col("word").between("٠", "٪")
    return pages.select("page", "document", "native", F.explode(words).alias("word")).where(~digit | F.col("word").rlike(r"\p{L}"))


def _counts(tokens: DataFrame) -> DataFrame:
    """Documents per word, apart for trusted and scanned pages."""
    per_document = tokens.select("word", "document", "native").distinct()
    return per_document.groupBy("word").agg(F.count_if("native").alias("df_native"), F.count_if(~F.col("native")).alias("df_scan"))


def _sequences(word: str) -> Iterator[str]:
    w = f"^{word}$"
    return (w[i : i + 3] for i in range(len(w) - 2))


_LATIN = re.compile(r"[\x00-\x7Fà-ÿ]{4,30}")
_MIXED = re.compile(r"(?=.*[^\W\d_])(?=.*\d)[^\W\d_]*(?:[01569][^\W\d_]*)+")
_NUMBER_READ = re.compile(r"\d*[ol]\d+|\d+[ol]\d*")


def _sequence_form(word: str, possible: set[str]) -> str | None:
    """The form without a confusion that an impossible letter sequence gives away."""
    fine = lambda w: all(s in possible for s in _sequences(w))
    if not _LATIN.fullmatch(word) or fine(word):
        return None
    for read, meant in UNDONE:
        at = word.find(read)
        while at >= 0:
            if fine(form := word[:at] + meant + word[at + len(read) :]):
                return form
            at = word.find(read, at + 1)
    return None


def _judged(counts: DataFrame, possible: set[str]) -> DataFrame:
    """Unknown words with the evidence against them, NULL if there is none, and the form meant.

    Words lie sorted by skeleton, known ones first and frequent ones before rare
    ones, so that a group is judged by the one form that leads it while it
    streams by.
    """
    held = counts.sparkSession.sparkContext.broadcast(possible)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequences = held.value
        group, leader, lead = None, None, 0
        for batch in batches:
            out: list[tuple[str, str | None, str | None]] = []
            for skeleton_, word, known, df in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if skeleton_ != group:
                    group, leader, lead = skeleton_, (word if known else None), (df if known else 0)
                if known:
                    continue
                form, evidence = None, None
                if lead >= 20 and lead >= 4 * df:
                    form, evidence = leader, "skeleton"
                elif _NUMBER_READ.fullmatch(word):
                    form, evidence = word.replace("o", "0").replace("l", "1"), "digits"
                elif _MIXED.fullmatch(word):
                    form, evidence = _sequence_form(word, sequences), "digits"
                elif form := _sequence_form(word, sequences):
                    evidence = "sequence"
                out.append((word, evidence, form))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.string()) for i in range(3)], ["word", "evidence", "form"])

    ordered = counts.select(skeleton(F.col("word")).alias("skeleton"), "word", "known", "df").repartition("skeleton").sortWithinPartitions("skeleton", F.desc("known"), F.desc("df"), "word")
    return ordered.mapInArrow(judge, "word string, evidence string, form string")


def bad_words(pages: DataFrame) -> DataFrame:
    """Wrongly read words of scanned pages: ``page``, ``word``, the ``form`` meant (NULL if unknown) and the ``evidence``."""
    tokens = _tokens(pages)
    counts = cut_lineage(_counts(tokens))
    n = {r["native"]: r["n"] for r in pages.groupBy("native").agg(F.count_distinct("document").alias("n")).collect()}
    n_native, n_scan = n.get(True, 0), n.get(False, 0)
    # a misreading may stray into trusted text, but not at the rate of a word
    known = (F.col("df_native") > 0) & (F.col("df_native") * max(1, n_scan) >= 0.2 * F.col("df_scan") * max(1, n_native))
    counts = counts.select("word", known.alias("known"), (F.col("df_native") + F.col("df_scan")).alias("df"))
    # three letters each, so their number is bounded by the alphabets
    grams = counts.where(F.col("known") & F.col("word").rlike(r"^[\x00-\x7Fà-ÿ]+$")).select(F.concat(F.lit("^"), "word", F.lit("$")).alias("w"))
    grams = grams.select(F.explode(F.expr("transform(sequence(1, length(w) - 2), i -> substring(w, i, 3))")).alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    possible = {r["g"] for r in grams.where(F.col("n") >= max(2, int(0.00002 * n_native))).collect()}
    judged = cut_lineage(_judged(counts, possible))
    frequent = counts.where(F.col("known") & (F.col("df") >= max(2.0, FREQUENT_SHARE * (n_native + n_scan)))).select("word")

    # the rare words of every page; only these are joined
    rare = tokens.where(~F.col("native")).select("page", "document", "word").join(F.broadcast(frequent), "word", "left_anti")
    rare = cut_lineage(rare.join(judged.withColumn("unknown", F.lit(True)), "word", "left"))
    by_corpus = rare.where("evidence is not null").select("page", "word", "form", "evidence")
    # by the document: another form of the skeleton that it uses on more pages
    uses = rare.groupBy("document", "word").agg(F.count_distinct("page").alias("uses"), F.max("unknown").alias("unknown"), F.max("evidence").alias("evidence"))
    group = Window.partitionBy("document", "skeleton")
    uses = uses.withColumn("skeleton", skeleton(F.col("word"))).withColumn("lead", F.max(F.struct("uses", "word")).over(group))
    own = uses.where(F.col("unknown") & F.col("evidence").isNull() & (F.length("word") > 4) & (F.col("lead.word") != F.col("word")) & (F.col("lead.uses") > 1) & (F.col("lead.uses") >= 2 * F.col("uses"))).select("document", "word", F.col("lead.word").alias("form"))
    by_document = rare.select("page", "document", "word").join(own, ["document", "word"]).select("page", "word", "form", F.lit("document").alias("evidence"))
    return by_corpus.unionByName(by_document)


# ---- breaks ----------------------------------------------------------------------------------
def broken_words(pages: DataFrame) -> DataFrame:
    """``page``, ``left``, ``mark``, ``right`` of words broken at a line's end, compounds at their own hyphen left out."""
    whole = r"(?<![\p{L}\p{M}\p{N}])[\p{L}\p{M}\p{N}]++[-=¬­‐](?<=\p{L}.)[ \t]*\r?\n[ \t]*\p{L}[\p{L}\p{M}\p{N}]*+"
    raw = pages.where(~F.col("native") & F.col("text").rlike(r"[-=¬­‐][ \t]*\r?\n"))
    breaks = raw.select("page", F.explode(F.regexp_extract_all(plain(F.col("text")), F.lit(whole), F.lit(0))).alias("b"))
    part = lambda i: F.regexp_extract("b", r"^([^-=¬­‐]+)([-=¬­‐])\s*(.*)$", i)
    breaks = breaks.select("page", part(1).alias("left"), part(2).alias("mark"), part(3).alias("right"))
    breaks = breaks.withColumn("form", skeleton(F.lower(F.concat_ws("-", "left", "right"))))
    trusted = pages.where(F.col("native") & F.contains("text", F.lit("-")))
    inline = trusted.select("document", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(?<![\p{L}\p{N}-])\p{L}++-\p{L}++(?![\p{L}\p{N}-])"), F.lit(0))).alias("w"))
    compounds = inline.distinct().groupBy(skeleton(F.col("w")).alias("form")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("form", F.lit(True).alias("compound"))
    out = breaks.join(compounds, "form", "left")
    return out.where(F.col("compound").isNull() | ~F.col("mark").isin("-", "‐")).select("page", "left", "mark", "right")


def _prepared(df: DataFrame, record: str, document: str, page_text: str, model: str) -> DataFrame:
    native = F.coalesce(F.col(model) == _NATIVE, F.lit(False))
    rows = df.select(F.col(record).cast("long").alias("page"), F.coalesce(F.col(document).cast("long"), -F.col(record).cast("long") - 1).alias("document"), native.alias("native"), F.col(page_text).alias("text"))
    return rows.where(F.col("page").isNotNull() & (F.length("text") > 0))


def page_noise(df: DataFrame, record: str, document: str, page_text: str, model: str) -> DataFrame:
    """``page`` and ``noise``: one row per scanned page and kind of noise.

    Pages of the model ``native-text`` were not scanned: they have no noise, and
    their words are trusted.  Pages without a model count as scanned.  NULL and
    empty texts have none; rows without an id are left out; a page without a
    document is a document of its own; pages delivered twice count once.
    """
    pages = _prepared(df, record, document, page_text, model)
    lines = cut_lineage(_headers(outer_lines(pages.where(~F.col("native")))))
    kinds = [
        broken_words(pages).select("page", F.lit("hyphen_break").alias("noise")),
        bad_words(pages).select("page", F.lit("bad_char").alias("noise")),
        lines.where("header").select("page", F.lit("running_header").alias("noise")),
        lines.where("numbered").select("page", F.lit("page_number").alias("noise")),
    ]
    out = kinds[0]
    for k in kinds[1:]:
        out = out.unionByName(k)
    return out.distinct()


def readable_pages(df: DataFrame, record: str, document: str, page_text: str, model: str) -> DataFrame:
    """The paragraphs of scanned pages, repaired: ``page``, ``paragraph_no`` from 0, ``text``.

    Running headers and page numbers are left out, words joined over line ends
    (compounds keep their hyphen), wrongly read words replaced by the form meant,
    and lines joined to paragraphs, which end at blank lines, headings and list
    items.  Pages that were not scanned, NULL and empty ones have no rows here; a
    page delivered twice is returned once.
    """
    pages = _prepared(df, record, document, page_text, model)
    scanned = pages.where(~F.col("native")).select("page", "document", plain(F.col("text")).alias("text")).dropDuplicates(["page"])
    noise = _headers(outer_lines(pages.where(~F.col("native")))).where("header or alone").groupBy("page").agg(F.collect_set(F.trim(plain(F.col("line")))).alias("noise"))
    own = broken_words(pages).groupBy("page").agg(F.collect_set(F.concat("left", "mark", "right")).alias("broken"))
    first = F.row_number().over(Window.partitionBy("page", "word").orderBy("evidence", "form"))
    forms = bad_words(pages).where("form is not null").withColumn("n", first).where("n = 1").groupBy("page").agg(F.map_from_entries(F.collect_list(F.struct("word", "form"))).alias("forms"))

    lines = scanned.join(noise, "page", "left").select("page", F.coalesce("noise", F.array().cast("array<string>")).alias("noise"), F.posexplode(F.split("text", r"\r?\n")).alias("pos", "line"))
    lines = lines.withColumn("line", F.trim("line"))
    in_order = Window.partitionBy("page").orderBy("pos")
    # noise is removed at the edges only: a line in the middle may say the same
    edge = (F.sum((F.col("line") != "").cast("int")).over(in_order) <= 2) | (F.sum((F.col("line") != "").cast("int")).over(in_order.rowsBetween(0, Window.unboundedFollowing)) <= 2)
    lines = lines.withColumn("drop", edge & F.array_contains("noise", F.col("line"))).where(~F.col("drop")).drop("noise", "drop")
    item = F.col("line").rlike(r"^([-*•]|#{1,6}|\d{1,3}[.)])\s")
    last = F.lag("line").over(in_order)
    begins = (F.col("line") == "") | item | last.isNull() | (last == "") | last.rlike(r"^#{1,6}\s")
    lines = lines.withColumn("paragraph", F.sum(begins.cast("int")).over(in_order)).where("line <> ''")
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n")
    blocks = lines.groupBy("page", "paragraph").agg(whole.alias("text"), F.min("pos").alias("pos"))
    blocks = blocks.join(own, "page", "left").join(forms, "page", "left")
    words = F.regexp_extract_all("text", F.lit(rf"{_WORD}|[^\p{{L}}\p{{M}}\p{{N}}]+"), F.lit(0))

    def joined(i: Column) -> Column:
        """A line's end between two words: what stands for it."""
        piece = F.get("pieces", i)
        left, right = F.coalesce(F.get("pieces", i - 1), F.lit("")), F.coalesce(F.get("pieces", i + 1), F.lit(""))
        mark = F.substring(piece, 1, 1)
        at_end = piece.rlike(r"^[-=¬\u00ad‐][ \t]*\n[ \t]*$")
        broken = F.array_contains(F.coalesce("broken", F.array().cast("array<string>")), F.concat(left, mark, right))
        return F.when(at_end & broken, F.lit("")).when(at_end, mark).otherwise(F.regexp_replace(piece, r"\s*\n\s*", " "))

    blocks = blocks.withColumn("pieces", words)
    spaced = F.transform("pieces", lambda x, i: F.when(x.rlike(r"\n"), joined(i)).otherwise(x))
    blocks = blocks.withColumn("pieces", F.regexp_extract_all(F.array_join(spaced, ""), F.lit(rf"{_WORD}|[^\p{{L}}\p{{M}}\p{{N}}]+"), F.lit(0)))

    def repaired(word: Column) -> Column:
        form = F.col("forms")[F.lower(word)]
        # the form takes over the case of the word
        cased = F.when(word == F.upper(word), F.upper(form)).when(F.substring(word, 1, 1) == F.lower(F.substring(word, 1, 1)), form).otherwise(F.concat(F.upper(F.substring(form, 1, 1)), F.substr(form, F.lit(2))))
        return F.coalesce(F.when(F.length(word) > 1, cased), word)

    text = F.array_join(F.when(F.col("forms").isNull(), F.col("pieces")).otherwise(F.transform("pieces", repaired)), "")
    number = F.row_number().over(Window.partitionBy("page").orderBy("pos")) - 1
    return blocks.select("page", number.alias("paragraph_no"), text.alias("text"))
