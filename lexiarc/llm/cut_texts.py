"""Problem 7: texts that stop before they are complete.

A text is read by a stack automaton: brackets, quotes, elements of markup and code
fences that it opens and never closes.  Its ending shows broken bytes or escapes or an
ellipsis, and
then, by the kind of its last line, a missing end - a sentence without its mark,
a table row without its bar, a list item that is shorter than the others or than
its counterpart in the page's source text, a number that goes on there.

Lines without a mark may still be complete endings: those whose pattern closes a
fair share of the field's texts.  And where a source (collection) as a rule
doesn't end its texts with a mark, a missing mark says nothing.  Both baselines
are counted over all rows; the tables that are broadcast for them are bounded by
the shares they stand for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage
from .transliterate import code

_END = r"[.!?؟。۔…][)\]}\"'»”’]*\s*$"
_ITEM = r"^\s*([-*•‣▪]|\d{1,3}[.)])\s"
_BROKEN = r"(\x{FFFD}+|&#?\w{0,8}|\\(u[0-9A-Fa-f]{0,3}|x[0-9A-Fa-f]?)?|%[0-9A-Fa-f]?|<[^<>\n]{0,200})\s*$"
# an ellipsis behind something that isn't a whole sentence marks the cut itself
_ELIDED = r"\s*[\[(]?(\.{3,}|…)[\])]?$"
_ENDS_OF_ELEMENTS = r"(\s*</[A-Za-z][A-Za-z0-9]*\s*>)+$"
_DIGITS = ("٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹", "01234567890123456789")

_BLANK = " \t\n\r\u000b\u000c\u00a0\u200e\u200f\ufeff"

#: Closing lines are no longer than this.
LONGEST_CLOSING = 80
#: Least share of a field's unmarked last lines, for words and for patterns.
PATTERN_SHARE = 0.02
#: A collection in which fewer texts than this end with a mark has no rule to break.
RULE_SHARE = 0.5


# Elements of markup that have no end.
_EMPTY = ("br", "hr", "img", "input", "meta", "link", "wbr", "col")
#: What goes on the stack: fences, tags, brackets, quotes; a straight quote behind a digit is a unit.
_SIGNS = r"(?m)^\s*```|</?[A-Za-z][A-Za-z0-9]*(?:\s[^<>]*)?>|[()\[\]{}«»“”]|(?<!\d)\""


def _unclosed(text: Column) -> Column:
    """Whether brackets, quotes, elements or fences are open at the end of a text.

    An end without its beginning is passed over, as in numbering like ``a)``; the end of an
    element also closes what it holds.
    """
    signs = F.transform(F.regexp_extract_all(text, F.lit(_SIGNS), F.lit(0)), lambda x: F.trim(x))
    tag = lambda x: F.lower(F.regexp_extract(x, r"^</?([A-Za-z0-9]+)", 1))

    def step(stack: Column, sign: Column) -> Column:
        top = F.get(stack, F.size(stack) - 1)
        less = F.slice(stack, 1, F.greatest(F.size(stack) - 1, F.lit(0)))
        opens = F.concat(stack, F.array(sign))
        begins = F.concat(F.lit("<"), tag(sign))
        place = F.size(stack) - F.array_position(F.reverse(stack), begins) + 1
        same = F.translate(sign, ")]}»”", "([{«“")
        return (
            F.when(sign.isin("```", '"'), F.when(top.eqNullSafe(sign), less).otherwise(opens))
            .when(sign.startswith("</"), F.when(F.array_contains(stack, begins), F.slice(stack, 1, (place - 1).cast("int"))).otherwise(stack))
            .when(sign.startswith("<"), F.when(tag(sign).isin(*_EMPTY) | sign.endswith("/>"), stack).otherwise(F.concat(stack, F.array(begins))))
            .when(same == sign, opens)
            .when(top.eqNullSafe(same), less)
            .otherwise(stack)
        )

    return F.when(text.rlike('[(\\[{«“<`"]'), F.size(F.aggregate(signs, F.array().cast("array<string>"), step)) > 0).otherwise(False)


def _numbers(text: Column) -> Column:
    """Numbers of a text in ASCII digits, without thousands separators."""
    plain = F.translate(text, *_DIGITS)
    plain = F.regexp_replace(plain, r"(?<=\d)[,٬  ](?=\d{3}(?!\d))", "")
    return F.regexp_extract_all(plain, F.lit(r"\d+(?:[.٫]\d+)?"), F.lit(0))


def endings(df: DataFrame, record: str, text: str, source_text: str, source: str) -> DataFrame:
    """What the ending of each text shows, one row per record and text.

    NULL texts and those of white space only are left out.
    """
    rows = df.select(F.col(record).cast("long").alias("record"), F.col(source).alias("source_id"), F.rtrim(F.col(text), F.lit(_BLANK)).alias("t"), F.col(source_text).alias("source")).where(F.col("record").isNotNull() & F.col("t").isNotNull() & (F.length("t") > 0))
    rows = rows.withColumn("line", F.ltrim(F.substring_index(F.replace("t", F.lit("\r"), F.lit("\n")), "\n", -1), F.lit(_BLANK)))
    rows = rows.withColumn("before", F.expr("right(left(t, length(t) - length(line)), 200)"))
    rows = rows.withColumn("tail", F.regexp_replace(F.right("t", F.lit(220)), _ENDS_OF_ELEMENTS, ""))
    item = F.col("line").rlike(_ITEM)
    # the item's counterpart is the source's item of the same number
    items = F.filter(F.split("t", r"\r?\n"), lambda x: x.rlike(_ITEM))
    others = F.filter(F.split("source", r"\r?\n"), lambda x: x.rlike(_ITEM))
    words = lambda c: F.regexp_extract_all(c, F.lit(r"[\p{L}\p{M}\p{N}]+"), F.lit(0))
    nth = F.get(others, F.size(items) - 1)
    last, before = F.element_at(words(F.col("line")), -1), F.get(words(F.col("line")), F.size(words(F.col("line"))) - 2)
    previous = F.get(items, F.size(items) - 2)
    joint = F.get(words(previous), F.size(words(previous)) - 2)
    there = code(F.element_at(words(nth), -1))
    here = code(last)
    shorter = F.startswith(there, here) & (there != here)
    # without a counterpart that matches, the item is held against the one before it
    unlike = (F.size(items) > 1) & ~before.eqNullSafe(joint)
    lone = (F.size(items) == 1) & nth.isNotNull() & ~F.exists(words(F.col("line")), lambda w: code(w) == there)
    bare = F.col("line").rlike(_ITEM + r"?\s*$") | (F.size(words(F.col("line"))) < 2)
    item_cut = bare | F.when(there == here, False).otherwise(F.coalesce(shorter, F.lit(False)) | unlike | F.coalesce(lone, F.lit(False)))

    table = F.col("line").startswith("|")
    marked = F.col("tail").rlike(_END)
    number = F.element_at(_numbers(F.regexp_extract("line", r"([\d٠-٩۰-۹,٬]+)\.$", 1)), 1)
    goes_on = F.col("line").rlike(r"[\d٠-٩۰-۹]\.$") & F.exists(_numbers("source"), lambda n: F.startswith(F.replace(n, F.lit("٫"), F.lit(".")), F.concat(number, F.lit(".")))) & ~F.array_contains(_numbers("source"), number)
    kind = F.when(item, "item").when(table, "row").when(marked, "marked").otherwise("open")
    # a line of its own below a finished line may be a closing line
    own_line = F.col("before").rlike(r"[^\n]\r?\n[ \t]*\z") & F.rtrim(F.col("before"), F.lit(_BLANK)).rlike(_END + r"|\|$|(^|\n)\s*[-*•].*$") & (F.length("line") <= LONGEST_CLOSING)
    return rows.select(
        "record", "source_id", kind.alias("kind"),
        (F.col("tail").rlike(_BROKEN) | F.col("tail").rlike(_ELIDED) & ~F.regexp_replace("tail", _ELIDED, "").rlike(_END)).alias("broken"),
        _unclosed(F.col("t")).alias("unclosed"),
        F.when(item, F.coalesce(item_cut, F.lit(True))).otherwise(False).alias("item_cut"),
        F.when(table, ~F.col("line").rlike(r"\|.*\|$")).otherwise(False).alias("row_cut"),
        F.coalesce(goes_on, F.lit(False)).alias("goes_on"),
        F.when((kind == "open") & own_line, F.col("line")).alias("closing_line"),
    )


def _patterns(ends: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Possible closing lines with their pattern; the patterns that close texts."""
    lines = ends.where("closing_line is not null")
    shaped = lines.select("record", "closing_line", F.posexplode(F.regexp_extract_all("closing_line", F.lit(r"[\p{L}\p{M}]+|\p{N}+|[^\s\p{L}\p{M}\p{N}]"), F.lit(0))).alias("pos", "word"))
    shaped = shaped.withColumn("word", F.when(F.col("word").rlike(r"^\p{N}{4}$"), "0000").when(F.col("word").rlike(r"^\p{N}"), "0").otherwise(F.col("word")))
    least = lines.agg(F.count(F.lit(1)) * PATTERN_SHARE).scalar()
    # at most words-per-line / PATTERN_SHARE words can have this share
    frequent = shaped.groupBy("word").agg(F.count_distinct("record").alias("n")).where((F.col("n") >= least) & (F.col("n") > 1)).select("word", F.lit(True).alias("kept"))
    shaped = shaped.join(F.broadcast(frequent), "word", "left").withColumn("word", F.when(F.col("kept"), F.col("word")).otherwise("N"))
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"])
    patterns = shaped.groupBy("record", "closing_line").agg(F.array_join(in_order, " ").alias("pattern"))
    closing = patterns.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") >= least) & (F.col("n") > 1) & F.col("pattern").rlike("[^N ]")).select("pattern")
    return patterns, closing


def cut_texts(df: DataFrame, record: str, text: str, source_text: str, source: str, collections: DataFrame) -> DataFrame:
    """``record``, ``collection`` and ``cut`` for every record with a text.

    ``collections`` maps the column ``source`` of ``df`` to a ``collection``; it
    is joined to what is left of the texts, not to the texts.  A record
    delivered twice has one row, and is cut if any of its texts is.  NULL, empty
    and blank texts have no row.  Records without a collection form one of their
    own; a NULL source text just can't contradict.  Empty tables give no rows.
    """
    ends = endings(df, record, text, source_text, source)
    known = collections.select(F.col(source).alias("source_id"), "collection").dropDuplicates(["source_id"])
    ends = cut_lineage(ends.join(known, "source_id", "left"))
    patterns, closing = _patterns(ends)
    closed = patterns.join(F.broadcast(closing), "pattern", "left_semi").select("record", "closing_line", F.lit(True).alias("closes"))
    rules = ends.groupBy(F.col("collection").alias("c2")).agg(F.avg(F.when(F.col("kind") == "marked", 1.0).when(F.col("kind") == "open", 0.0)).alias("ruled"))
    ends = ends.join(closed, ["record", "closing_line"], "left").join(rules, F.col("collection").eqNullSafe(F.col("c2")), "left")
    unmarked = (F.col("kind") == "open") & F.col("closes").isNull() & (F.coalesce("ruled", F.lit(1.0)) >= RULE_SHARE)
    cut = F.col("broken") | F.col("unclosed") | F.col("item_cut") | F.col("row_cut") | F.col("goes_on") | unmarked
    return ends.groupBy("record").agg(F.min("collection").alias("collection"), F.max(cut).alias("cut"))
