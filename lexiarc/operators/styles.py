"""Styles of text spans: dominant values, palettes, headings; fonts for a language."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def weighted_mode(spans: DataFrame, scope: list[str], value: str | list[str], weight: str, order: str) -> DataFrame:
    """The value with the largest sum of weights in each scope; ties go to the one seen first."""
    values = [value] if isinstance(value, str) else value
    sums = spans.groupBy(*scope, *values).agg(F.sum(weight).alias("weight"), F.min(order).alias("seen"))
    best = F.max_by(F.struct(*values), F.struct("weight", -F.col("seen"))).alias("v")
    return (sums.groupBy(*scope) if scope else sums.groupBy()).agg(best, F.max("weight").alias("weight")).select(*scope, "v.*", "weight")


def top_values(spans: DataFrame, scope: list[str], value: str, weight: str, order: str, k: int = 5) -> DataFrame:
    """The ``k`` values of largest weight of each scope, as an array in that order."""
    sums = spans.groupBy(*scope, value).agg(F.sum(weight).alias("weight"), F.min(order).alias("seen"))
    ranked = sums.withColumn("rank", F.row_number().over(Window.partitionBy(*scope).orderBy(F.desc("weight"), "seen"))).where(F.col("rank") <= k)
    return ranked.groupBy(*scope).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", value))), lambda x: x[value]).alias("palette"))


def is_heading(size: Column, bold: Column, chars: Column) -> Column:
    return (size > 14) | (bold & (chars < 200))


# Scripts of languages, Latin where none is given.
SCRIPTS = {"ar": "arabic", "fa": "arabic", "ur": "arabic", "he": "hebrew", "zh": "cjk", "ja": "cjk", "ko": "cjk", "ru": "cyrillic", "el": "greek", "th": "thai", "hi": "devanagari"}
# Fonts and the scripts they support.
FONT_SCRIPTS = {
    "Arial": ["latin", "cyrillic", "greek", "arabic"],
    "Helvetica": ["latin", "cyrillic", "greek"],
    "Times New Roman": ["latin", "cyrillic", "greek"],
    "Georgia": ["latin"],
    "Courier New": ["latin", "cyrillic"],
    "Consolas": ["latin"],
    "Tahoma": ["arabic", "latin", "hebrew"],
    "Segoe UI": ["arabic", "latin", "hebrew"],
    "Traditional Arabic": ["arabic"],
    "Arabic Typesetting": ["arabic"],
    "David": ["hebrew"],
    "SimSun": ["cjk"],
    "Microsoft YaHei": ["cjk"],
}
# Default fonts by script, for serif, sans-serif and monospace.
DEFAULT_FONTS = {
    "latin": ("Times New Roman", "Arial", "Courier New"),
    "arabic": ("Traditional Arabic", "Tahoma", "Courier New"),
    "hebrew": ("David", "Tahoma", "Courier New"),
    "cjk": ("SimSun", "Microsoft YaHei", "Microsoft YaHei"),
}


def font_category(font: Column) -> Column:
    """monospace, serif or sans-serif by keywords; "sans-serif" holds "serif" and counts as serif."""
    name = F.lower(font)
    return F.when(name.rlike("mono|courier|consolas|code|fixed"), "monospace").when(name.rlike("times|georgia|garamond|palatino|serif|roman"), "serif").otherwise("sans-serif")


def script_of(lang: Column) -> Column:
    out = F.lit("latin")
    for code, script in SCRIPTS.items():
        out = F.when(lang == code, script).otherwise(out)
    return out


def fallback_font(font: Column, lang: Column) -> Column:
    """The font itself where it supports the language's script, else the script's default of its category."""
    script = script_of(lang)
    supported = F.lit(False)
    for name, scripts in FONT_SCRIPTS.items():
        supported = F.when(font == name, script.isin(scripts)).otherwise(supported)
    category = F.when(font.isNull(), "sans-serif").otherwise(font_category(font))
    default = F.lit(None).cast("string")
    for name, fonts in DEFAULT_FONTS.items():
        known = script == name if name != "latin" else ~script.isin([s for s in DEFAULT_FONTS if s != "latin"])
        default = F.when(known, F.when(category == "serif", fonts[0]).when(category == "monospace", fonts[2]).otherwise(fonts[1])).otherwise(default)
    return F.when(font.isNotNull() & supported, font).otherwise(default)
