"""Transliteration over IPA as column expressions.

A table is applied greedily from the left, longest key first. Catalyst has no such
expression: regular expressions that cut texts into arrays of tokens, looked up one by
one, take ten times as long as an Arrow function. There, keys of several characters
become single private characters in one pass of a compiled pattern, and one
``str.translate`` maps all characters.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import script

# Letter tables of the three scripts.
NKO_TO_IPA = {
    "ߊ": "a", "ߋ": "o", "ߌ": "i", "ߍ": "e", "ߎ": "u", "ߏ": "ɔ", "ߐ": "ɛ", "ߑ": "a",
    "ߒ": "n", "ߓ": "b", "ߔ": "p", "ߕ": "t", "ߖ": "dʒ", "ߗ": "tʃ", "ߘ": "d", "ߙ": "r", "ߚ": "rr", "ߛ": "s", "ߜ": "gb", "ߝ": "f",
    "ߞ": "k", "ߟ": "l", "ߠ": "na", "ߡ": "m", "ߢ": "ɲ", "ߣ": "n", "ߤ": "h", "ߥ": "w", "ߦ": "j", "ߧ": "ŋ", "ߨ": "p", "ߩ": "r", "ߪ": "s",
    "߀": "0", "߁": "1", "߂": "2", "߃": "3", "߄": "4", "߅": "5", "߆": "6", "߇": "7", "߈": "8", "߉": "9",
    "߫": "́", "߬": "̀", "߭": "̂", "߮": "̌", "߯": "ː",
    "߸": ",", "߹": ".", "߷": "!", "ߺ": "-", "߲": "ⁿ", "߳": "̃",
}
IPA_TO_NKO = {
    "a": "ߊ", "o": "ߋ", "i": "ߌ", "e": "ߍ", "u": "ߎ", "ɔ": "ߏ", "ɛ": "ߐ", "ə": "ߐ",
    "n": "ߣ", "b": "ߓ", "p": "ߔ", "t": "ߕ", "dʒ": "ߖ", "tʃ": "ߗ", "d": "ߘ", "r": "ߙ", "rr": "ߚ", "s": "ߛ", "z": "ߛ", "ʃ": "ߛ", "gb": "ߜ", "g": "ߜ", "f": "ߝ",
    "k": "ߞ", "l": "ߟ", "m": "ߡ", "ɲ": "ߢ", "h": "ߤ", "w": "ߥ", "j": "ߦ", "ŋ": "ߧ",
    "0": "߀", "1": "߁", "2": "߂", "3": "߃", "4": "߄", "5": "߅", "6": "߆", "7": "߇", "8": "߈", "9": "߉",
    "́": "߫", "̀": "߬", "̂": "߭", "̌": "߮", "ː": "߯",
    ",": "߸", ".": "߹", "!": "߷", "-": "ߺ", "ⁿ": "߲", "̃": "߳",
}
IPA_TO_LATIN = {
    "a": "a", "e": "e", "i": "i", "o": "o", "u": "u", "ɔ": "ɔ", "ɛ": "ɛ", "ə": "e", "aː": "aa", "eː": "ee", "iː": "ii", "oː": "oo", "uː": "uu",
    "b": "b", "d": "d", "f": "f", "g": "g", "h": "h", "k": "k", "l": "l", "m": "m", "n": "n", "p": "p", "r": "r", "s": "s", "t": "t", "v": "v", "w": "w", "z": "z", "j": "y",
    "dʒ": "j", "tʃ": "c", "gb": "gb", "ŋ": "ng", "ɲ": "ny", "rr": "rr", "na": "na", "ʔ": "'", "ɣ": "gh", "ʃ": "sh", "ʒ": "zh", "θ": "th", "ð": "dh", "x": "kh", "ħ": "h", "ʕ": "'", "q": "q",
    "sˤ": "s", "dˤ": "d", "tˤ": "t", "ðˤ": "dh", "́": "", "̀": "", "̂": "", "̌": "", "ː": "", "̄": "", "̃": "n", "ⁿ": "n",
}
LATIN_TO_IPA = {
    "ch": "tʃ", "sh": "ʃ", "th": "θ", "dh": "ð", "gh": "ɣ", "kh": "x", "ng": "ŋ", "ny": "ɲ", "gb": "gb", "rr": "rr", "ph": "f", "wh": "w", "dj": "dʒ", "nk": "ŋk",
    "a": "a", "b": "b", "c": "tʃ", "d": "d", "e": "e", "f": "f", "g": "g", "h": "h", "i": "i", "j": "dʒ", "k": "k", "l": "l", "m": "m", "n": "n", "o": "o", "p": "p", "q": "k",
    "r": "r", "s": "s", "t": "t", "u": "u", "v": "v", "w": "w", "x": "ks", "y": "j", "z": "z", "ɔ": "ɔ", "ɛ": "ɛ", "ə": "ə", "ɲ": "ɲ", "ŋ": "ŋ",
    "̀": "̀", "́": "́", "̂": "̂", "̌": "̌", "̃": "̃", "'": "ʔ",
}
ARABIC_TO_IPA = {
    "ء": "ʔ", "ا": "aː", "آ": "ʔaː", "ب": "b", "ت": "t", "ث": "θ", "ج": "dʒ", "ح": "ħ", "خ": "x", "د": "d", "ذ": "ð", "ر": "r", "ز": "z", "س": "s", "ش": "ʃ",
    "ص": "sˤ", "ض": "dˤ", "ط": "tˤ", "ظ": "ðˤ", "ع": "ʕ", "غ": "ɣ", "ف": "f", "ق": "q", "ك": "k", "ل": "l", "م": "m", "ن": "n", "ه": "h", "و": "w", "ي": "j", "ى": "aː",
    "َ": "a", "ِ": "i", "ُ": "u", "ْ": "", "ً": "an", "ٍ": "in", "ٌ": "un", "ة": "a", "ّ": "ː",
    "٠": "0", "١": "1", "٢": "2", "٣": "3", "٤": "4", "٥": "5", "٦": "6", "٧": "7", "٨": "8", "٩": "9", "،": ",", "؛": ";", "؟": "?",
}
IPA_TO_ARABIC = {
    "b": "ب", "t": "ت", "d": "د", "r": "ر", "z": "ز", "s": "س", "f": "ف", "k": "ك", "l": "ل", "m": "م", "n": "ن", "h": "ه", "w": "و", "j": "ي", "q": "ق", "x": "خ", "g": "غ",
    "a": "ا", "i": "ي", "u": "و", "e": "ي", "o": "و", "ʔ": "ء", "ħ": "ح", "ʕ": "ع", "ɣ": "غ", "ʃ": "ش", "θ": "ث", "ð": "ذ", "dʒ": "ج", "tʃ": "ش", "ŋ": "نغ", "ɲ": "ني",
    "ɔ": "و", "ɛ": "ي", "ə": "ا", "gb": "غب", "rr": "ر", "na": "نا", "sˤ": "ص", "dˤ": "ض", "tˤ": "ط", "ðˤ": "ظ",
    "0": "٠", "1": "١", "2": "٢", "3": "٣", "4": "٤", "5": "٥", "6": "٦", "7": "٧", "8": "٨", "9": "٩",
}
#: Simplified script-to-Latin letters of evaluation code, without digraph rules.
SIMPLE_LATIN = {k: IPA_TO_LATIN.get(v, v) for k, v in NKO_TO_IPA.items()}


def decompositions() -> dict[str, str]:
    """NFD of the precomposed Latin letters, by rule."""
    spans = (range(0xC0, 0x250), range(0x1E00, 0x1F00))
    return {chr(c): d for span in spans for c in span if (d := unicodedata.normalize("NFD", chr(c))) != chr(c)}


NFD = decompositions()


def pattern(keys) -> str:
    """A regular expression of one group: the keys, longest first, or any character."""
    inner = "|".join(re.escape(k) for k in sorted((k for k in keys if len(k) > 1), key=lambda k: (-len(k), k)))
    return f"(?s)({inner}|.)" if inner else "(?s)(.)"


def as_map(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for k, v in d.items() for x in (k, v)])


def tokens(text: Column, keys) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern(keys)), F.lit(1))


#: Private characters that stand for keys of several characters.
_PRIVATE = 0xF0000


@lru_cache(maxsize=None)
def _compiled(items: tuple[tuple[str, str], ...]):
    """A function of a text that applies a table."""
    long = sorted((k for k, _ in items if len(k) > 1), key=lambda k: (-len(k), k))
    table = dict(items)
    codes = {k: chr(_PRIVATE + i) for i, k in enumerate(long)}
    mapped = str.maketrans({k: v for k, v in items if len(k) == 1} | {codes[k]: table[k] for k in long})
    if not long:
        return lambda t: t.translate(mapped)
    found = re.compile("|".join(map(re.escape, long)))
    private = re.compile(f"[{chr(_PRIVATE)}-{chr(_PRIVATE + len(long))}]")
    whole = re.compile(pattern(table), re.S)

    def apply(t: str) -> str:
        if private.search(t):  # the text has such characters of its own
            return whole.sub(lambda m: table.get(m[0], m[0]), t)
        return found.sub(lambda m: codes[m[0]], t).translate(mapped)

    return apply


def apply(text: str | None, *tables: dict[str, str]) -> str | None:
    """A text with each table applied in turn."""
    for d in tables if text else ():
        text = _compiled(tuple(d.items()))(text)
    return text


def _function(*tables: dict[str, str]):
    keys = [tuple(d.items()) for d in tables]

    @F.pandas_udf(StringType())
    def substituted(text: pd.Series) -> pd.Series:
        steps = [_compiled(k) for k in keys]

        def one(t):
            if t is None:
                return None
            for step in steps:
                t = step(t)
            return t

        return pd.Series([one(t) for t in text], dtype=object)

    return substituted


def substitute(text: Column, *tables: dict[str, str]) -> Column:
    """Each token that is a key replaced by its value, greedily from the left; tables in turn."""
    return _function(*tables)(text)


def nfd(text: Column) -> Column:
    """Canonical decomposition of precomposed Latin letters."""
    return substitute(text, NFD)


def latin_to_ipa(text: Column) -> Column:
    return substitute(F.lower(text), NFD, LATIN_TO_IPA)


def nko_to_ipa(text: Column) -> Column:
    return substitute(text, NKO_TO_IPA)


def arabic_to_ipa(text: Column) -> Column:
    return substitute(text, ARABIC_TO_IPA)


@F.pandas_udf(StringType())
def _to_ipa(text: pd.Series, low: pd.Series, source: pd.Series) -> pd.Series:
    def one(t, lower, src):
        if src == "nko":
            return apply(t, NKO_TO_IPA)
        return apply(t, ARABIC_TO_IPA) if src == "arabic" else apply(lower, NFD, LATIN_TO_IPA)

    return pd.Series([one(*row) for row in zip(text, low, source, strict=True)], dtype=object)


def to_ipa(text: Column, source: Column) -> Column:
    return _to_ipa(text, F.lower(text), source)


def from_ipa(ipa: Column, target: str) -> Column:
    return substitute(ipa, {"nko": IPA_TO_NKO, "latin": IPA_TO_LATIN, "arabic": IPA_TO_ARABIC}[target])


def transliterate(text: Column, target: str = "latin", source: str | None = None) -> Column:
    """struct(source_script, target_text, ipa, confidence); text of the target's own script is kept."""
    src = script.detect_vote(text) if source is None else F.lit(source)
    ipa = to_ipa(text, src)
    result = from_ipa(ipa, target)
    total, mapped = script.count(text, r"\S"), script.count(result, r"\S")
    same = src == target
    return F.struct(
        src.alias("source_script"),
        F.when(same, text).otherwise(result).alias("target_text"),
        F.when(~same, ipa).alias("ipa"),
        F.when(same, F.lit(1.0)).otherwise(F.round(F.least(mapped / F.greatest(total, F.lit(1)), F.lit(1.0)), 3)).alias("confidence"),
    )


def syllabify_ipa(ipa: Column) -> Column:
    """Syllables that end after a vowel; what is left over joins the last one."""
    vowel = "[aeiouɔɛə]"
    whole = F.regexp_extract_all(ipa, F.lit(f"((?s)[^aeiouɔɛə]*{vowel})"), F.lit(1))
    rest = F.regexp_extract(ipa, "([^aeiouɔɛə]*)$", 1)
    return F.when(F.size(whole) == 0, F.array(ipa)).otherwise(F.concat(F.slice(whole, 1, F.size(whole) - 1), F.array(F.concat(F.element_at(whole, -1), rest))))
