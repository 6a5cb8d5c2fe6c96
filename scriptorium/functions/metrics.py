"""Scores of text pairs as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .alignment import word_distance
from .clean import words
from .features import ngrams


def char_error(ref: Column, hyp: Column, clamp: bool = True) -> Column:
    """Character error rate; an empty reference gives 0 or 1."""
    rate = F.levenshtein(ref, hyp) / F.length(ref)
    out = F.when(F.length(ref) == 0, F.when(F.length(hyp) == 0, 0.0).otherwise(1.0)).otherwise(rate)
    return F.least(out, F.lit(1.0)) if clamp else out


def word_error(ref: Column, hyp: Column, clamp: bool = True) -> Column:
    """Word error rate; an empty reference gives 0 or 1."""
    r, h = words(F.coalesce(ref, F.lit(""))), words(F.coalesce(hyp, F.lit("")))
    rate = word_distance(r, h) / F.size(r)
    out = F.when(F.size(r) == 0, F.when(F.size(h) == 0, 0.0).otherwise(1.0)).otherwise(rate)
    return F.least(out, F.lit(1.0)) if clamp else out


def exact(pred: Column, ref: Column, case: bool = False) -> Column:
    a, b = F.trim(pred), F.trim(ref)
    return (a == b) if case else (F.lower(a) == F.lower(b))


def partial(pred: Column, ref: Column) -> Column:
    """1 if the reference is contained, 0.5 if one of its words of over two letters is, else 0."""
    p, r = F.lower(pred), F.lower(ref)
    return F.when(p.contains(r), 1.0).when(F.exists(words(r), lambda w: (F.length(w) > 2) & p.contains(w)), 0.5).otherwise(0.0)


def word_set(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("([\\p{L}\\p{N}_]+)"), F.lit(1)))


def set_jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of arrays as sets; 0 if one is empty."""
    some = (F.size(a) > 0) & (F.size(b) > 0)
    return F.when(some, F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(F.lit(0.0))


def word_jaccard(pred: Column, ref: Column) -> Column:
    return set_jaccard(word_set(pred), word_set(ref))


def chars(text: Column) -> Column:
    """The different characters of a text."""
    return F.array_distinct(F.filter(F.split(text, ""), lambda c: c != ""))


def char_jaccard(a: Column, b: Column) -> Column:
    return set_jaccard(chars(a), chars(b))


def char_recall(pred: Column, ref: Column) -> Column:
    r = chars(ref)
    return F.when(F.size(r) > 0, F.size(F.array_intersect(chars(pred), r)) / F.size(r)).otherwise(F.lit(0.0))


def word_recall(pred: Column, ref: Column) -> Column:
    """1 if equal, else the share of the reference's words that the prediction has."""
    r = F.array_distinct(words(F.lower(ref)))
    share = F.when(F.size(r) > 0, F.size(F.array_intersect(r, words(F.lower(pred)))) / F.size(r)).otherwise(F.lit(0.0))
    return F.when(exact(pred, ref), 1.0).otherwise(share)


def _times(array: Column, x: Column) -> Column:
    return F.size(F.filter(array, lambda y: y == x))


def clipped(pred: Column, ref: Column) -> Column:
    """Matches of two arrays as bags: for each different entry the lesser count."""
    return F.aggregate(F.array_intersect(pred, ref), F.lit(0), lambda a, x: a + F.least(_times(pred, x), _times(ref, x)))


def bleu_1(pred: Column, ref: Column) -> Column:
    p, r = words(F.lower(pred)), words(F.lower(ref))
    some = (F.size(p) > 0) & (F.size(r) > 0)
    return F.when(some, F.least(F.lit(1.0), F.size(p) / F.size(r)) * clipped(p, r) / F.size(p)).otherwise(F.lit(0.0))


def numeric_score(text: Column, correct: Column, tolerance: float = 0.1) -> Column:
    """By the last number of the text: 1 within the tolerance, else exp(-5 relative error)."""
    numbers = F.regexp_extract_all(text, F.lit("(-?[0-9]+\\.?[0-9]*)"), F.lit(1))
    value = F.try_element_at(numbers, F.lit(-1)).cast("double")
    error = F.abs(value - correct) / F.abs(correct)
    return (
        F.when(F.size(numbers) == 0, 0.0).when(correct == 0, F.when(F.abs(value) < 0.01, 1.0).otherwise(0.0))
        .when(error <= tolerance, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.exp(-5.0 * error))))
    )


def keyword_score(text: Column, keywords: Column, threshold: int = 2) -> Column:
    low = F.lower(text)
    hits = F.size(F.filter(keywords, lambda k: low.contains(F.lower(k))))
    return F.least(hits / threshold, F.lit(1.0))
