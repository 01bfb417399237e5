"""Column builders for text: normalisation, tokens, quality, markup."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that are no terms, English and Arabic.
STOP_WORDS = (
    "the a an and or but in on at to for of with by from as is was are were been be have has had do does did will would could "
    "should may might must shall can need this that these those it its i you he she we they what which who whom when where why "
    "how all each every both few more most other some such no not only own same so than too very just also now here there "
    "في من إلى على عن مع هذا هذه ذلك تلك التي الذي كان كانت يكون أن إن لا ما هو هي هم نحن أنا أنت كل بعض أي"
).split()

#: Least length of a word that counts.
MIN_WORD = 3
#: White space as Unicode has it; Java's \s and RE2's know ASCII only.
WS = r"[\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: A word: letters, digits and underscores, inside also other characters of the Arabic block.
WORD = r"[\p{L}\p{N}_](?:[\p{L}\p{N}_\x{600}-\x{6FF}]*[\p{L}\p{N}_])?"
_MARKDOWN = r"[#*_`\[\](){}|]"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def strip(text: Column) -> Column:
    """Without white space at either end, tabs and line ends included."""
    return F.regexp_replace(text, rf"^{WS}+|{WS}+\z", "")


def normalize(text: Column) -> Column:
    """Lower case, without markdown signs and addresses, single spaces."""
    out = F.regexp_replace(F.lower(text), _MARKDOWN, " ")
    out = F.regexp_replace(out, r"https?://[^\s]+", " ")
    return F.trim(F.regexp_replace(out, rf"{WS}+", " "))


def words(normalized: Column) -> Column:
    """All words of a normalised text, in order."""
    return F.regexp_extract_all(normalized, F.lit(WORD), F.lit(0))


def stop_words() -> Column:
    return F.array(*(F.lit(w) for w in STOP_WORDS))


def tokens(normalized: Column) -> Column:
    """Words of at least three characters that are neither stop words nor digits only."""
    return F.filter(words(normalized), lambda w: (F.length(w) >= MIN_WORD) & ~F.array_contains(stop_words(), w) & ~w.rlike(r"^\p{Nd}+$"))


def alpha_share(word: Column) -> Column:
    return F.length(F.regexp_replace(word, r"[^\p{L}]", "")) / F.length(word)


def is_term(word: Column) -> Column:
    """A word that can be a term: long enough, no stop word, no number, 70 % letters."""
    return (F.length(word) >= MIN_WORD) & ~word.isin(STOP_WORDS) & ~word.rlike(r"^\p{Nd}+$") & (alpha_share(word) >= 0.7)


def word_count(text: Column) -> Column:
    """Runs of characters between white space; 0 for NULL."""
    return let(strip(text), lambda t: F.when(t.isNull() | (t == ""), 0).otherwise(F.regexp_count(t, F.lit(WS + "+")) + 1))


def is_blank(text: Column) -> Column:
    return F.coalesce(strip(text), F.lit("")) == ""


def quality_score(text: Column) -> Column:
    """Score of a text by word length, signs and repeated characters; blank texts have 0."""
    n = F.length(text)
    # what is left without letters, digits and white space; a class of what to drop is much faster than its complement
    signs = F.length(F.regexp_replace(text, r"[\p{L}\p{N}" + WS[1:-1] + "]+", "")) / n
    repeats = F.regexp_count(text, F.lit(r"(?s)(.)(?=\1\1)")) / n

    def score(v: Column) -> Column:
        average = n / v["words"]
        out = (
            F.lit(1.0)
            - F.when((average < 2) | (average > 15), 0.2).otherwise(0.0)
            - F.when(v["signs"] > 0.3, 0.3).when(v["signs"] > 0.2, 0.1).otherwise(0.0)
            - F.when(v["repeats"] > 0.1, 0.3).when(v["repeats"] > 0.05, 0.15).otherwise(0.0)
        )
        return F.when(v["words"] == 0, 0.0).otherwise(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), out)), 6))

    measured = F.struct(F.nullif(word_count(text), F.lit(0)).alias("words"), signs.alias("signs"), repeats.alias("repeats"))
    return F.when(is_blank(text), 0.0).otherwise(let(measured, score))


def quality_label(score: Column) -> Column:
    return F.when(score >= 0.85, "excellent").when(score >= 0.7, "good").when(score >= 0.5, "fair").otherwise("poor")


def _occurrences(text: Column, part: str) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)


def confidence_label(confidence: Column, text: Column) -> Column:
    """Quality by a recognition confidence, else by artifacts in the text."""
    artifacts = sum((_occurrences(text, a) for a in ("???", "###", "...", "   ")), F.lit(0.0))
    n = F.length(text)
    by_text = F.when(is_blank(text), "poor").when(artifacts > n * 0.1, "poor").when(artifacts > n * 0.05, "fair").otherwise("good")
    c = confidence.cast("double")
    return F.when(c.isNull(), by_text).when(c >= 0.95, "excellent").when(c >= 0.8, "good").when(c >= 0.6, "fair").otherwise("poor")


# ---- files -----------------------------------------------------------------------------------
# File suffixes and the kind of document each stands for.
FILE_KINDS = {".pdf": "pdf", ".docx": "docx", ".doc": "doc", ".md": "markdown", ".markdown": "markdown", ".txt": "text"}
# Media types by suffix.
MEDIA_TYPES = {".pdf": "application/pdf", ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", ".doc": "application/msword", ".md": "text/markdown", ".markdown": "text/markdown", ".txt": "text/plain"}


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")


def lookup(key: Column, table: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for k, v in table.items():
        out = F.when(key == k, v).otherwise(out)
    return out


def safe_filename(name: Column) -> Column:
    return F.regexp_replace(name, r"[^\p{L}\p{N}._\- ]", "_")


def page_estimate(text: Column, kind: Column, real_pages: Column) -> Column:
    """Pages of a document: real ones of a pdf, 500 words or 50 lines to a page else."""
    by_words = F.greatest(F.lit(1), F.floor(word_count(text) / 500)).cast("int")
    by_lines = F.greatest(F.lit(1), F.floor(F.regexp_count(text, F.lit("\n")) / 50)).cast("int")
    return F.when(kind == "pdf", F.coalesce(real_pages, F.lit(1))).when(kind == "docx", by_words).when(kind.isin("markdown", "text"), F.coalesce(by_lines, F.lit(1))).otherwise(1)


# ---- markup ----------------------------------------------------------------------------------
def bullets_to_dashes(text: Column, reindent: bool = False) -> Column:
    """Lines that begin with a bullet sign as list items.

    The indent stays; with ``reindent`` it becomes two spaces for every two, and
    lines that begin with ``- `` or ``* `` are rewritten as well.
    """
    sign = r"(?:[•●○▪▫◦]|[*-] )" if reindent else r"[•●○▪▫◦]"

    def line(x: Column) -> Column:
        indent = F.length(F.regexp_extract(x, r"^([ \t]*)", 1))
        rest = F.regexp_extract(x, rf"^[ \t]*{sign}(.+)$", 1)
        pad = F.repeat(F.lit("  "), F.floor(indent / 2).cast("int")) if reindent else F.repeat(F.lit(" "), indent)
        return F.when(rest != "", F.concat(pad, F.lit("- "), F.trim(rest))).otherwise(x)

    return F.array_join(F.transform(F.split(text, "\n"), line), "\n")


def plain_links(text: Column) -> Column:
    """Links to anchors or to nothing as their text."""
    return F.regexp_replace(text, r"\[([^\]]+)\]\((?:#[^)]*|\s*)\)", "$1")


def without_fence(reply: Column) -> Column:
    """A reply without its first and last line if it is a fenced block."""
    text = strip(reply)
    lines = F.split(text, "\n")
    return F.when(text.startswith("```") & (F.size(lines) > 2), F.array_join(F.slice(lines, 2, F.size(lines) - 2), "\n")).otherwise(text)


def json_block(reply: Column, kind: str = "array") -> Column:
    """From the first opening to the last closing bracket of a reply."""
    return F.regexp_extract(reply, r"(?s)\[.*\]" if kind == "array" else r"(?s)\{.*\}", 0)


def reversed_table_rows(text: Column) -> Column:
    """Markdown table rows with their cells in reverse order; other lines stay."""

    def line(x: Column) -> Column:
        row = strip(x)
        cells = F.split(row, r"\|")
        return F.when(row.rlike(r"^\|.*\|$") & (F.length(row) > 1), F.concat(F.lit("|"), F.array_join(F.reverse(F.slice(cells, 2, F.size(cells) - 2)), "|"), F.lit("|"))).otherwise(x)

    return F.array_join(F.transform(F.split(text, "\n"), line), "\n")


# ---- languages -------------------------------------------------------------------------------
# The three sets of right-to-left languages, one for each use.
RTL_TABLES = ["ar", "he", "fa", "ur", "yi", "ps", "sd"]
RTL_PROMPTS = ["ar", "he", "fa", "ur"]
RTL_SCRIPTS = ["arabic", "hebrew"]


def direction_changes(source: Column, target: Column) -> Column:
    """Whether columns of a table must be reversed: from right-to-left to another direction."""
    return source.isin(RTL_TABLES) & ~target.isin(RTL_TABLES)


def share_of(text: Column, character_class: str) -> Column:
    return F.try_divide(F.regexp_count(text, F.lit(character_class)).cast("double"), F.length(text))


def script_language(text: Column) -> Column:
    """ar, en or he where more than half of the letters are Arabic, Latin or Hebrew."""
    arabic, latin, hebrew = (F.regexp_count(text, F.lit(c)) for c in (r"[\x{600}-\x{6FF}]", r"[a-zA-Z]", r"[\x{590}-\x{5FF}]"))
    n = arabic + latin + hebrew
    return F.when(arabic > n * 0.5, "ar").when(hebrew > n * 0.5, "he").when(latin > n * 0.5, "en")


def color_hex(color: Column) -> Column:
    """An integer colour as #rrggbb."""
    return F.concat(F.lit("#"), F.lower(F.lpad(F.hex(color.cast("long")), 6, "0")))


def recognition_choice(native: Column, primary: Column, fallback: Column) -> Column:
    """``source`` and ``quality`` of the text taken, by the qualities of three attempts.

    Native text is taken at once if it is good or excellent.  Else the first
    recognition is, unless it is poor and the second one is better.  A NULL quality is
    an attempt that wasn't made.
    """
    sound = lambda q: F.coalesce(q.isin("excellent", "good"), F.lit(False))
    poor = F.coalesce(primary, F.lit("poor")) == "poor"
    better = F.coalesce(fallback.isin("excellent", "good", "fair"), F.lit(False))
    source = F.when(sound(native), "native").when(poor & better, "fallback").otherwise("primary")
    return F.struct(source.alias("source"), F.when(sound(native), native).when(poor & better, fallback).otherwise(F.coalesce(primary, F.lit("poor"))).alias("quality"))
