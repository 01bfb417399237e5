"""Problem 3: texts that look alike but differ in characters, in one form.

Texts are cut at plain white space.  Most of the pieces hold nothing but
ordinary characters and are passed over by one regular expression; the others
are exploded to positioned code points.  Broadcast joins with two tables bounded
by the Unicode character set replace every code point by its decomposition and
give its combining class; look-alike letters are replaced where the letters of
the word around them show another alphabet.  Marks are ordered by class behind
their starter, composed again, and the pieces are put back in their texts.

All shuffles are keyed by record and piece, so no character or word, however
frequent, is a hot key.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Letters of one alphabet that look like letters of another.
CYRILLIC_AS_LATIN = dict(zip("АВЕЅІЈКМНОРСТУХҮҺԁаеѕіјорсухԛԝһԚԜӏ", "ABESIJKMHOPCTYXYhdaesijopcyxqwhQWl"))
GREEK_AS_LATIN = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧανορυικ", "ABEZHIKMNOPTYXavopuik"))
# Arabic-script letters of other languages and their usual Arabic letters.
ARABIC_VARIANTS = {"ی": "ي", "ک": "ك", "ہ": "ه", "ھ": "ه", "ە": "ه"}
# Digits of the eastern set that look like the usual Arabic-Indic ones.
ARABIC_DIGITS = dict(zip("۰۱۲۳۷۸۹", "٠١٢٣٧٨٩"))
# Letters that show nothing, beside the format characters.
INVISIBLE = "\u034f\u115f\u1160\u17b4\u17b5\u3164\uffa0"

#: Compatibility kinds whose characters look like their plain counterparts.
_SAME_LOOK = {"<wide>", "<narrow>", "<initial>", "<medial>", "<final>", "<isolated>", "<font>", "<noBreak>"}

#: A piece without any of these holds ordinary characters only.
_SUSPECT = (
    r"[^\x09-\x0D\x1C-\x7E\u00A1-\u00AC\u00AE-\u0131\u0134-\u024F"  # Latin
    r"\u060C\u061B\u061F\u0621-\u063A\u0640-\u0652\u0660-\u066C"  # Arabic
    r"\u2010\u2012-\u2027\u2030-\u205E\u2070-\u209C\u20A0-\u20C0\u2190-\u23FF]"  # signs
)
_PIECES = r"[^\x09-\x0D ]+|[\x09-\x0D ]+"

_SCRIPTS = {"LATIN": "L", "CYRILLIC": "C", "GREEK": "G"}


def _decomposed(ch: str) -> str | None:
    """What stands for a character, fully decomposed; None: itself."""
    out = unicodedata.normalize("NFD", _plain(ch))
    return None if out == ch else out


def _plain(ch: str) -> str:
    """The ordinary character or characters that a character looks like."""
    category = unicodedata.category(ch)
    shows_nothing = category == "Cf" and not "\u0600" <= ch <= "\u0605" or category == "Cc" and ch not in "\t\n\v\f\r\x1c\x1d\x1e\x1f\x85"
    if shows_nothing or ch in INVISIBLE or "\ufe00" <= ch <= "\ufe0f" or "\U000e0100" <= ch <= "\U000e01ef":
        return ""
    if category == "Zs":
        return " "
    if ch == "\u2011":
        return "-"
    if ch in ARABIC_VARIANTS or ch in ARABIC_DIGITS:
        return ARABIC_VARIANTS.get(ch) or ARABIC_DIGITS[ch]
    kind = unicodedata.decomposition(ch).partition(" ")[0]
    if kind in _SAME_LOOK or kind == "<compat>" and "LIGATURE" in unicodedata.name(ch, ""):
        return "".join(x if x == ch else _plain(x) for x in unicodedata.normalize("NFKC", ch))
    return ch


@lru_cache(maxsize=1)
def character_rows() -> list[tuple[str, list[str], str | None, str | None]]:
    """(character, decomposition, alphabet, Latin look-alike) of every character for which one of them matters.

    The table is made from Unicode's own data by rule and has fewer than 30,000
    rows whatever the input, so it can be broadcast.
    """
    rows = []
    for code in [*range(0x250), *range(0x250, 0x3400), *range(0xA640, 0xAC00), *range(0xF900, 0x10000), *range(0x10000, 0x20000), *range(0x2F800, 0x2FA20), *range(0xE0000, 0xE01F0)]:
        ch = chr(code)
        name = unicodedata.name(ch, "")
        if not name and unicodedata.category(ch) != "Cc":
            continue
        out = _decomposed(ch)
        if "가" <= ch <= "힣":
            continue
        script = _SCRIPTS.get(name.partition(" ")[0]) if unicodedata.category(ch)[0] == "L" else None
        alike = CYRILLIC_AS_LATIN.get(ch) or GREEK_AS_LATIN.get(ch)
        if out is not None or alike or script and code >= 0x250:
            rows.append((ch, list(ch if out is None else out), script, alike))
    return rows


@lru_cache(maxsize=1)
def mark_classes() -> list[tuple[str, int]]:
    """(mark, combining class) of every mark with a class above 0."""
    return [(ch, c) for ch in map(chr, range(0x300, 0x1F000)) if (c := unicodedata.combining(ch))]


@lru_cache(maxsize=1)
def compositions() -> dict[str, str]:
    """Primary composites: starter and mark to the composed character."""
    out = {}
    for ch in map(chr, [*range(0xC0, 0x3400), *range(0xFB1D, 0xFB50), *range(0x11080, 0x11A00)]):
        parts = unicodedata.decomposition(ch).split()
        if len(parts) == 2 and not parts[0].startswith("<"):
            pair = "".join(chr(int(p, 16)) for p in parts)
            if unicodedata.normalize("NFC", pair) == ch:
                out[pair] = ch
    return out


def _composed(cluster: Column) -> Column:
    """A starter with its ordered marks, composed; arrays of (class, char)."""
    table = F.create_map(*[F.lit(x) for pair in compositions().items() for x in pair])

    def step(state: Column, mark: Column) -> Column:
        base, rest, last = state["base"], state["rest"], state["last"]
        pair = F.element_at(table, F.concat(base, mark["ch"]))
        fits = pair.isNotNull() & (last < mark["ccc"])
        return F.struct(
            F.when(fits, pair).otherwise(base).alias("base"),
            F.when(fits, rest).otherwise(F.concat(rest, mark["ch"])).alias("rest"),
            F.when(fits, last).otherwise(mark["ccc"]).alias("last"),
        )

    head = F.element_at(cluster, 1)["ch"]
    start = F.struct(head.alias("base"), F.lit("").alias("rest"), F.lit(0).alias("last"))
    return F.when(F.size(cluster) == 1, head).otherwise(F.aggregate(F.slice(cluster, 2, F.size(cluster)), start, step, lambda s: F.concat(s["base"], s["rest"])))


#: Hangul syllables in code order, made of a leading consonant, a vowel and up to one of the trailing consonants.
_SYLLABLES = "".join(map(chr, range(0xAC00, 0xD7A4)))
_LEADING, _VOWELS, _TRAILING = ("".join(map(chr, range(*r))) for r in ((0x1100, 0x1113), (0x1161, 0x1176), (0x11A8, 0x11C3)))


def _hangul_composed(text: Column) -> Column:
    """Conjoining letters of Hangul as syllables, by the arithmetic of their code points."""
    at = lambda signs, ch: F.instr(F.lit(signs), ch) - 1
    syllable = lambda i: F.substr(F.lit(_SYLLABLES), i + 1, F.lit(1))

    def step(state: Column, ch: Column) -> Column:
        last = state["last"]
        lead, vowel, tail, open_ = at(_LEADING, last), at(_VOWELS, ch), at(_TRAILING, ch), at(_SYLLABLES, last)
        met = F.when((last != "") & (lead >= 0) & (vowel >= 0), syllable((lead * 21 + vowel) * 28))
        met = met.when((last != "") & (open_ >= 0) & (open_ % 28 == 0) & (tail >= 0), syllable(open_ + tail + 1))
        return F.struct(F.when(met.isNull(), F.concat(state["done"], last)).otherwise(state["done"]).alias("done"), F.coalesce(met, ch).alias("last"))

    start = F.struct(F.lit("").alias("done"), F.lit("").alias("last"))
    letters = F.filter(F.split(text, ""), lambda c: c != "")
    return F.when(text.rlike("[\u1161-\u1175\u11a8-\u11c2]"), F.aggregate(letters, start, step, lambda x: F.concat(x["done"], x["last"]))).otherwise(text)


def _table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return F.broadcast(spark.createDataFrame(rows, schema))


def uniform_pieces(pieces: DataFrame, key: list[str], piece: str) -> DataFrame:
    """``key``, ``piece`` and ``plain`` for pieces whose plain form differs.

    ``key`` must identify a row.  The plain form has composed accents, half-width
    and unligatured letters of the word's own alphabet, plain spaces, nothing
    invisible and the usual Arabic letters.
    """
    spark = pieces.sparkSession
    points = pieces.select(*key, F.posexplode(F.split(F.col(piece), "")).alias("pos", "ch")).where("ch <> ''")
    table = _table(spark, character_rows(), "ch string, parts array<string>, script string, alike string")
    points = points.join(table, "ch", "left").select(*key, "pos", "ch", F.coalesce("parts", F.array("ch")).alias("parts"), _script().alias("script"), "alike", F.col("ch").rlike(r"[\p{L}\p{M}\p{Cf}]").alias("in_word"))

    # words: runs of letters, marks and invisible characters inside a piece
    by_piece = Window.partitionBy(*key).orderBy("pos")
    points = points.withColumn("word", F.sum(F.when(F.col("in_word"), 0).otherwise(1)).over(by_piece))
    by_word = Window.partitionBy(*key, "word")
    for name in ("L", "C", "G"):
        points = points.withColumn(f"n_{name}", F.sum((F.col("script") == name).cast("int")).over(by_word))
    fixed = (F.col("script") != "L") & F.col("alike").isNull()
    points = points.withColumn("foreign", F.coalesce(F.max(fixed).over(by_word), F.lit(False)))
    # a letter that only looks Latin is one where the word has Latin letters, and no letter or no majority of another alphabet speaks against it
    replaced = F.col("alike").isNotNull() & (F.coalesce(F.col("n_L"), F.lit(0)) > 0) & (~F.col("foreign") | (F.col("n_L") > F.coalesce(F.col("n_C"), F.lit(0)) + F.coalesce(F.col("n_G"), F.lit(0))))
    parts = F.when(replaced, F.array("alike")).otherwise(F.col("parts"))
    latin_in_foreign = _latin_as_cyrillic(spark)
    points = points.join(latin_in_foreign, "ch", "left")
    own_cyrillic = F.col("cyrillic").isNotNull() & F.col("foreign") & (F.coalesce(F.col("n_C"), F.lit(0)) > F.col("n_L"))
    parts = F.when(own_cyrillic, F.array("cyrillic")).otherwise(parts)

    single = points.select(*key, "pos", F.posexplode_outer(parts).alias("sub", "ch"))
    classes = _table(spark, mark_classes(), "ch string, ccc int")
    single = single.join(classes, "ch", "left").withColumn("ccc", F.coalesce("ccc", F.lit(0))).withColumn("sub", F.coalesce("sub", F.lit(0)))
    # NULL characters stand for pieces of invisible characters only, and begin no cluster
    order = Window.partitionBy(*key).orderBy("pos", "sub")
    single = single.withColumn("cluster", F.sum(F.when(F.col("ch").isNotNull() & (F.col("ccc") == 0), 1).otherwise(0)).over(order))
    marks = F.array_sort(F.collect_list(F.when(F.col("ch").isNotNull(), F.struct("ccc", "pos", "sub", "ch"))))
    clusters = single.groupBy(*key, "cluster").agg(marks.alias("m")).where(F.size("m") > 0)
    clusters = clusters.select(*key, "cluster", _composed(F.col("m")).alias("text"))
    rebuilt = clusters.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("cluster", "text"))), lambda x: x["text"]), "").alias("plain"))
    return pieces.join(rebuilt, key, "left").select(*key, piece, _hangul_composed(F.coalesce("plain", F.lit(""))).alias("plain")).where(F.col(piece) != F.col("plain"))


def _script() -> Column:
    return F.coalesce(F.col("script"), F.when(F.col("ch").rlike(r"[A-Za-zÀ-ɏＡ-Ｚａ-ｚ]"), "L"))


def _latin_as_cyrillic(spark: SparkSession) -> DataFrame:
    return _table(spark, [(b, a) for a, b in CYRILLIC_AS_LATIN.items() if a in "АВЕКМНОРСТУХаеорсух"], "ch string, cyrillic string")


def uniform_text(df: DataFrame, record: str, text: str) -> DataFrame:
    """Records whose text has disguised characters, with the text in one form.

    Result: ``record``, ``text``, ``plain_text``, one row per distinct pair of
    record and text that deviates.  NULL and empty texts don't; rows without a
    record id are left out; rows delivered twice count once; a record with two
    texts has a row for each that deviates.  An empty table gives no rows.
    """
    rows = df.select(F.col(record).cast("long").alias("record"), F.col(text).alias("text")).where(F.col("record").isNotNull() & F.col("text").rlike(_SUSPECT)).distinct()
    rows = rows.withColumn("text_key", F.xxhash64("text"))
    pieces = rows.select("record", "text_key", F.posexplode(F.regexp_extract_all("text", F.lit(_PIECES), F.lit(0))).alias("piece_no", "piece")).where(F.col("piece").rlike(_SUSPECT))
    plain = uniform_pieces(pieces, ["record", "text_key", "piece_no"], "piece")
    changes = plain.groupBy("record", "text_key").agg(F.map_from_entries(F.collect_list(F.struct("piece_no", "plain"))).alias("changes"))
    texts = rows.join(changes, ["record", "text_key"])
    rebuilt = F.array_join(F.transform(F.regexp_extract_all("text", F.lit(_PIECES), F.lit(0)), lambda x, i: F.coalesce(F.col("changes")[i], x)), "")
    return texts.select("record", "text", rebuilt.alias("plain_text"))


def deviating(df: DataFrame, record: str, text: str) -> DataFrame:
    """Ids of the records whose text isn't in the uniform form (``uniform_text`` without rebuilding texts)."""
    rows = df.select(F.col(record).cast("long").alias("record"), F.col(text).alias("text")).where(F.col("record").isNotNull() & F.col("text").rlike(_SUSPECT)).distinct()
    rows = rows.withColumn("text_key", F.xxhash64("text"))
    pieces = rows.select("record", "text_key", F.posexplode(F.regexp_extract_all("text", F.lit(_PIECES), F.lit(0))).alias("piece_no", "piece")).where(F.col("piece").rlike(_SUSPECT))
    return uniform_pieces(pieces, ["record", "text_key", "piece_no"], "piece").select("record").distinct()
