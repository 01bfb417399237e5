"""One code for a name in Latin and in Arabic letters.

Both spellings of a name are written in a common alphabet, so that they can be
compared for equality or as prefixes.  Long vowels and their half vowels share a
code, as Arabic writes them with one letter.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Latin letter groups and letters, and the code of each.
LATIN_GROUPS = {"th": "T", "dh": "D", "sh": "S", "ch": "S", "kh": "X", "gh": "G", "ph": "f", "ou": "U", "oo": "U", "ee": "I"}
LATIN_LETTERS = dict(zip("aeiouywbdfghjklmnprstvzqcx", "AIIUUIUbdfGhjklmnbrstfzkks"))
# Arabic letters and the code of each; "-" is left out.
ARABIC_LETTERS = dict(zip("ابتثجحخدذرزسشصضطظعغفقكلمنهويىةآأإؤئء", "AbtTjhXdDrzsSsdtz-GfkklmnhUIIAAAAUI-"))

_ACCENTED = "àâäáãéèêëíìîïóòôöõúùûüçñ"
_PLAIN = "aaaaaeeeeiiiiooooouuuucn"


def code(word: Column) -> Column:
    """The code of a word of Latin or Arabic letters; other characters are left out."""
    out = F.translate(F.lower(word), _ACCENTED, _PLAIN)
    for group, c in LATIN_GROUPS.items():
        out = F.replace(out, F.lit(group), F.lit(c))
    letters = {**LATIN_LETTERS, **ARABIC_LETTERS}
    out = F.translate(out, "".join(letters), "".join(letters.values()))
    return F.regexp_replace(out, r"[^A-Za-z]|-", "")


_TABLE = {ord(a): b for a, b in [*zip(_ACCENTED, _PLAIN)]}
_CODES = {ord(k): ("" if v == "-" else v) for k, v in {**LATIN_LETTERS, **ARABIC_LETTERS}.items()}


def code_text(word: str) -> str:
    """``code`` of a Python string."""
    out = word.lower().translate(_TABLE)
    for group, c in LATIN_GROUPS.items():
        if group in out:
            out = out.replace(group, c)
    return out.translate(_CODES)
