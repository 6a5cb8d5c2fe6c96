"""Detection and composition of scripts as column expressions.

Code point ranges are fixed values of Unicode and of the detectors.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from . import _vector

NKO = r"[\x{07C0}-\x{07FF}]"
ARABIC = r"[\x{0600}-\x{06FF}\x{0750}-\x{077F}\x{FB50}-\x{FDFF}]"
ARABIC_NARROW = r"[\x{0600}-\x{06FF}\x{0750}-\x{077F}]"
LATIN = r"[A-Za-z\x{00C0}-\x{024F}\x{025B}\x{0254}\x{0259}]"
LATIN_ASCII = "[A-Za-z]"
NKO_VOWEL = r"[\x{07CA}-\x{07D0}]"
NKO_CONSONANT = r"[\x{07D1}-\x{07EA}]"
NKO_LETTER = r"[\x{07CA}-\x{07EA}]"
NKO_ALPHABETIC = r"[\x{07CA}-\x{07EA}\x{07F4}\x{07F5}\x{07FA}]"
NKO_DIGIT = r"[\x{07C0}-\x{07C9}]"
NKO_TONE = r"[\x{07EB}-\x{07EF}]"
NKO_NASAL = r"[\x{07F2}\x{07F3}]"
NKO_MARK = r"[\x{07EB}-\x{07EF}\x{07F2}\x{07F3}]"
NKO_DIGITS = "߀߁߂߃߄߅߆߇߈߉"


#: Classes of characters that are counted together. Fixed values.
CLASSES = {"nko": NKO, "arabic": ARABIC, "arabic_narrow": ARABIC_NARROW, "latin": LATIN, "latin_ascii": LATIN_ASCII, "white": r"[\x{0009}-\x{000D}\x{0020}]"}


def ranges(pattern: str) -> list[tuple[int, int]]:
    """Code point ranges of a class pattern of this module."""
    one = r"(?:\\x\{([0-9A-F]+)\}|([A-Za-z]))"
    spans = re.findall(f"{one}(?:-{one})?", pattern)
    return [(int(a, 16) if a else ord(b), int(c, 16) if c else ord(d) if d else int(a, 16) if a else ord(b)) for a, b, c, d in spans]


_TABLES = [_vector.lookup(ranges(p)) for p in CLASSES.values()]


@F.pandas_udf(StructType([StructField(k, IntegerType()) for k in [*CLASSES, "length"]]))
def _counts(text: pd.Series) -> pd.DataFrame:
    out = np.zeros((len(text), len(CLASSES) + 1), np.int32)
    for a, b, codes, bounds in _vector.segments(text):
        for i, table in enumerate(_TABLES):
            out[a:b, i] = _vector.sums(_vector.member(table, codes), bounds)
        out[a:b, -1] = np.diff(bounds)
    return pd.DataFrame(out, columns=[*CLASSES, "length"])


def counts(text: Column) -> Column:
    """struct of the numbers of characters in each of CLASSES, and of all; one pass over the text. Null counts as empty."""
    return _counts(text)


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def has_nko(text: Column) -> Column:
    """Any character of the script."""
    return text.rlike(NKO)


def detect_vote(text: Column) -> Column:
    """The script with most characters; ties go to nko, then arabic; none is latin."""
    c = counts(text)
    n, a, l = c["nko"], c["arabic"], c["latin"]
    return F.when(text.isNull() | (n + a + l == 0), "latin").when((n >= a) & (n >= l), "nko").when(a >= l, "arabic").otherwise("latin")


def detect_mixed(text: Column) -> Column:
    """As a vote over ASCII Latin, but ``mixed`` where the largest share is under 0.6 of more than two characters."""
    c = counts(text)
    n, a, l = c["nko"], c["arabic_narrow"], c["latin_ascii"]
    total, top = n + a + l, F.greatest(n, a, l)
    best = F.when(n == top, "nko").when(a == top, "arabic").otherwise("latin")
    return F.when(total == 0, "latin").when((total > 2) & (top / total < 0.6), "mixed").otherwise(best)


def detect_first(text: Column) -> Column:
    """The script of the first character that decides; latin if none does."""
    first = F.regexp_extract(text, f"({NKO}|{ARABIC}|{LATIN})", 1)
    return F.when(first.rlike(NKO), "nko").when(first.rlike(ARABIC), "arabic").otherwise("latin")


def composition(text: Column) -> Column:
    """Counts of characters by script; other is neither script nor white space."""
    c = counts(text)
    n, a, l = c["nko"], c["arabic_narrow"], c["latin_ascii"]
    return F.struct(n.alias("nko"), a.alias("arabic"), l.alias("latin"), (c["length"] - c["white"] - n - a - l).alias("other"))


def purity_of_letters(text: Column) -> Column:
    """Share of the script among letters; 0 without letters."""
    letters = count(text, r"\p{L}")
    return F.when(letters > 0, count(text, NKO_ALPHABETIC) / letters).otherwise(F.lit(0.0))


def purity_of_visible(text: Column) -> Column:
    """Share of the script among characters that are not white space; 0 without any."""
    c = counts(text)
    seen = c["length"] - c["white"]
    return F.when(seen > 0, c["nko"] / seen).otherwise(F.lit(0.0))


def only_nko(text: Column) -> Column:
    """The text with nothing but the script left."""
    return F.regexp_replace(text, r"[^\x{07C0}-\x{07FF}]", "")


def classify(ch: Column) -> Column:
    """Class of a single character."""
    return (
        F.when(ch.rlike(f"^{NKO_VOWEL}"), "vowel").when(ch.rlike(f"^{NKO_CONSONANT}"), "consonant").when(ch.rlike(f"^{NKO_TONE}"), "tone").when(ch.rlike(f"^{NKO_NASAL}"), "combining")
        .when(ch.rlike(f"^{NKO_DIGIT}"), "digit").when(ch.rlike(f"^{NKO}"), "punctuation").when(ch.rlike(f"^{ARABIC}"), "arabic").when(ch.rlike(f"^{LATIN}"), "latin").otherwise("other")
    )


def native_digits(n: Column) -> Column:
    """A non-negative integer in the script's digits; null for negative ones."""
    return F.when(n >= 0, F.translate(n.cast("string"), "0123456789", NKO_DIGITS))


def digit_value(ch: Column) -> Column:
    """The value of a digit of the script, else null."""
    return F.when(ch.rlike(f"^{NKO_DIGIT}$"), F.translate(ch, NKO_DIGITS, "0123456789").cast("int"))


def strip_tones(text: Column) -> Column:
    return F.regexp_replace(text, NKO_TONE, "")


def tone_positions(text: Column) -> Column:
    """(position, tone) of each tone mark, positions of characters from 0."""
    names = F.create_map(*[F.lit(x) for k, v in TONE_NAMES.items() for x in (k, v)])
    chars = F.split(text, "")
    marked = F.transform(chars, lambda c, i: F.struct(i.alias("position"), names[c].alias("tone")))
    return F.filter(marked, lambda s: s["tone"].isNotNull())


#: Names of tone marks. Fixed values.
TONE_NAMES = {"߫": "HIGH", "߬": "LOW", "߭": "RISING", "߮": "LONG", "߯": "VERY_LONG"}
