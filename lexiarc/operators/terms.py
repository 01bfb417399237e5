"""Terms of documents: words and word sequences by frequency, with contexts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T


def concat_pages(pages: DataFrame, document: str, number: str, text: str, joint: str = "\n") -> DataFrame:
    """One text per document, its pages in order; pages without text are left out."""
    rows = F.array_sort(F.collect_list(F.when(F.col(text).isNotNull(), F.struct(F.col(number).alias("n"), F.col(text).alias("t")))))
    return pages.groupBy(document).agg(F.array_join(F.transform(rows, lambda x: x["t"]), joint).alias("text"))


def ngrams(tokens: Column, n: int) -> Column:
    """Sequences of ``n`` tokens, NULL where one of them is NULL; none where there are fewer."""
    starts = F.when(F.size(tokens) >= n, F.sequence(F.lit(0), F.size(tokens) - n)).otherwise(F.array().cast("array<int>"))

    def joined(i: Column) -> Column:
        parts = [F.get(tokens, i)]
        for k in range(1, n):
            parts += [F.lit(" "), F.get(tokens, i + k)]
        return F.concat(*parts)

    return F.transform(starts, joined)


def _placed(n: int) -> Callable[[Column, Column], Column]:
    return lambda term, i: F.struct(F.lit(n).alias("n"), i.alias("pos"), term.alias("term"))


def term_frequencies(docs: DataFrame, document: str, text: str, sizes: tuple[int, ...] = (1, 2, 3, 4), valid_only: bool = False) -> DataFrame:
    """How often every word and sequence occurs in each document: ``term``, ``n``, ``frequency``, ``first_pos``.

    Sequences run over the words that count, so they may span stop words.  Each
    text is tokenised once; its sequences are exploded together and combined on
    the map side.  ``valid_only`` drops those with a word that is no term before
    they are exploded: a word is judged once for all its sequences.
    """
    words = T.tokens(T.normalize(F.col(text)))
    if valid_only:  # the words are long enough, no stop words and no numbers by now
        words = F.transform(words, lambda w: F.when(~w.rlike(r"[^\p{L}]"), w).when(T.alpha_share(w) >= 0.7, w))
    tokens = docs.select(F.col(document).alias("document_id"), words.alias("tokens"))
    grams = F.flatten(F.array(*(F.filter(F.transform(ngrams(F.col("tokens"), n), _placed(n)), lambda g: g["term"].isNotNull()) for n in sizes)))
    return tokens.select("document_id", F.explode(grams).alias("g")).groupBy("document_id", F.col("g.term").alias("term"), F.col("g.n").alias("n")).agg(F.count(F.lit(1)).alias("frequency"), F.min("g.pos").alias("first_pos"))


def ranked_terms(frequencies: DataFrame, min_frequency: int = 3, max_terms: int = 500) -> DataFrame:
    """The most frequent terms of each document, with their ``rank``; ties by length of sequence, position and text."""
    order = Window.partitionBy("document_id").orderBy(F.desc("frequency"), "n", "first_pos", "term")
    return frequencies.where(F.col("frequency") >= min_frequency).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max_terms)


def extract_terms(docs: DataFrame, document: str, text: str, min_frequency: int = 3, max_terms: int = 500) -> DataFrame:
    """``document_id``, ``term``, ``n``, ``frequency``, ``rank`` of the valid terms of each document."""
    found = term_frequencies(docs, document, text, valid_only=True)
    return ranked_terms(found, min_frequency, max_terms).select("document_id", "term", "n", "frequency", "rank")


def contexts(text: Column, term: Column, width: int = 50, found: int = 5, kept: int = 3) -> Column:
    """Snippets of a normalised text around the first occurrences of a term.

    Offsets come from splitting at the term, so no search is repeated.
    """
    parts = F.split(text, F.concat(F.lit(r"\Q"), term, F.lit(r"\E")))
    # where occurrence i begins: the lengths of the parts before it, and the terms between them
    starts = F.transform(F.sequence(F.lit(1), F.least(F.size(parts) - 1, F.lit(found))), lambda i: F.aggregate(F.slice(parts, 1, i), F.lit(0), lambda a, p: a + F.length(p)) + (i - 1) * F.length(term))

    def snippet(at: Column) -> Column:
        low, high = F.greatest(at - width, F.lit(0)), F.least(at + F.length(term) + width, F.length(text))
        body = F.trim(F.substr(text, low + 1, high - low))
        return F.concat(F.when(low > 0, "...").otherwise(""), body, F.when(high < F.length(text), "...").otherwise(""))

    return F.when(F.size(parts) > 1, F.slice(F.transform(starts, snippet), 1, kept)).otherwise(F.array().cast("array<string>"))


def chunks(text: Column, limit: int = 4000) -> Column:
    """Paragraphs packed in order into chunks of at most ``limit`` characters; a longer paragraph is a chunk."""
    paragraphs = F.split(text, "\n\n")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def add(state: Column, paragraph: Column) -> Column:
        fits = F.length(state["open"]) + F.length(paragraph) + 2 <= limit
        closed = F.when(T.is_blank(state["open"]), state["done"]).otherwise(F.concat(state["done"], F.array(T.strip(state["open"]))))
        return F.struct(F.when(fits, state["done"]).otherwise(closed).alias("done"), F.when(fits, F.concat(state["open"], paragraph, F.lit("\n\n"))).otherwise(F.concat(paragraph, F.lit("\n\n"))).alias("open"))

    out = F.aggregate(paragraphs, start, add, lambda s: F.when(T.is_blank(s["open"]), s["done"]).otherwise(F.concat(s["done"], F.array(T.strip(s["open"])))))
    return F.when(F.size(out) > 0, out).otherwise(F.array(F.left(text, F.lit(limit))))


def batches(df: DataFrame, scope: list[str], order: list[str], size: int) -> DataFrame:
    """Add ``batch``: rows of each scope in groups of ``size``, from 0."""
    number = F.row_number().over(Window.partitionBy(*scope).orderBy(*order))
    return df.withColumn("batch", F.floor((number - 1) / size).cast("int"))
