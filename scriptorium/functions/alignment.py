"""Scores that need an alignment table, as Arrow functions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _lcs(a: str, b: str) -> int:
    """Length of a longest common subsequence, in bit rows of one big integer."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    row = (1 << len(a)) - 1
    full = row
    for c in b:
        hit = row & at.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


@F.pandas_udf(T.DoubleType())
def lcs_ratio(ref: pd.Series, hyp: pd.Series) -> pd.Series:
    """Length of the longest common subsequence over the longer text; 1 for two empty texts."""
    return pd.Series([_lcs(a, b) / max(len(a), len(b)) if a or b else 1.0 for a, b in zip(ref.fillna(""), hyp.fillna(""), strict=True)])


def _rows(a: np.ndarray, b: np.ndarray, first: np.ndarray):
    """Rows of the edit table after ``first``, one for each entry of a."""
    steps, row = np.arange(len(b) + 1), first
    for x in a.tolist():
        new = np.minimum(row[1:] + 1, row[:-1] + (b != x))
        row = np.minimum.accumulate(np.concatenate([[row[0] + 1], new]) - steps) + steps
        yield row


def distance(a: list, b: list) -> int:
    """Edit distance of two lists of any entries; memory is a row of the table."""
    codes: dict = {}
    x, y = (np.array([codes.setdefault(v, len(codes)) for v in side], np.int64) for side in (a, b))
    row = np.arange(len(y) + 1)
    for row in _rows(x, y, row):
        pass
    return int(row[-1])


@F.pandas_udf(T.LongType())
def word_distance(ref: pd.Series, hyp: pd.Series) -> pd.Series:
    """Edit distance of word arrays."""
    return pd.Series([distance(list(a), list(b)) for a, b in zip(ref, hyp, strict=True)])


def trace(a: str, b: str):
    """(operation, place in a, place in b) of an optimal alignment, from the end; of equal
    ones a match or substitution comes first, then a deletion. Rows of the table are kept at
    every r-th place only, r about the root of the length, and made again in between."""
    x, y = (np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) for t in (a, b))
    every = max(1, int(len(x) ** 0.5))
    row = np.arange(len(y) + 1)
    kept = [row]
    for i, row in enumerate(_rows(x, y, row), 1):
        if i % every == 0:
            kept.append(row)
    i, j = len(x), len(y)
    while i or j:
        base = max(0, (i - 1) // every) * every
        table = [kept[base // every], *_rows(x[base:i], y, kept[base // every])]
        while (i > base or i == 0) and (i or j):
            here = table[i - base][j]
            if i and j and here == table[i - base - 1][j - 1] + (x[i - 1] != y[j - 1]):
                yield ("correct" if x[i - 1] == y[j - 1] else "substituted"), i - 1, j - 1
                i, j = i - 1, j - 1
            elif i and here == table[i - base - 1][j] + 1:
                yield "deleted", i - 1, None
                i -= 1
            else:
                yield "inserted", None, j - 1
                j -= 1


EDITS = ("correct", "substituted", "deleted", "inserted")


@F.pandas_udf(T.StructType([T.StructField(c, T.LongType()) for c in EDITS]))
def edits(ref: pd.Series, hyp: pd.Series) -> pd.DataFrame:
    """Tallies of an optimal alignment of all characters."""
    out = np.zeros((len(ref), 4), np.int64)
    for k, (a, b) in enumerate(zip(ref.fillna(""), hyp.fillna(""), strict=True)):
        for op, _, _ in trace(a, b):
            out[k, EDITS.index(op)] += 1
    return pd.DataFrame(out, columns=EDITS)


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("class", T.StringType()), *(T.StructField(c, T.LongType()) for c in EDITS)])))
def class_edits(ref: pd.Series, hyp: pd.Series) -> pd.Series:
    """Tallies of an optimal alignment by the class of the reference's character (of the
    other one for insertions), over the script's characters and spaces."""
    out = []
    for a, b in zip(ref.fillna(""), hyp.fillna(""), strict=True):
        a, b = ("".join(c for c in t if c == " " or "\u07c0" <= c <= "\u07ff") for t in (a, b))
        tally: dict[str, list[int]] = {}
        for op, i, j in trace(a, b):
            tally.setdefault(char_class(a[i] if i is not None else b[j]), [0] * 4)[EDITS.index(op)] += 1
        out.append([(k, *v) for k, v in sorted(tally.items())])
    return pd.Series(out, dtype=object)


def char_class(c: str) -> str:
    """vowel, consonant, tone, nasal, digit or space; other characters count as vowels."""
    code = ord(c)
    if c == " ":
        return "space"
    for name, low, high in CLASSES:
        if low <= code <= high:
            return name
    return "vowel"


#: Ranges of code points of the classes. Fixed values of Unicode.
CLASSES = [("consonant", 0x07D1, 0x07EA), ("tone", 0x07EB, 0x07EF), ("nasal", 0x07F2, 0x07F3), ("digit", 0x07C0, 0x07C9)]
