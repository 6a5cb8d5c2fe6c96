"""Features, labels, hashes and provenance of texts as column expressions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from . import _vector

from .clean import words
from .script import NKO


def ratio(a: Column, b: Column, empty: float = 0.0) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(empty))


def unique_ratio(w: Column) -> Column:
    return ratio(F.size(F.array_distinct(w)), F.size(w))


def repetitive(w: Column, threshold: float = 0.3) -> Column:
    """More than six words, of which under the threshold are different."""
    return (F.size(w) > 6) & (unique_ratio(w) < threshold)


def ngrams(w: Column, n: int) -> Column:
    """Joined runs of n entries of an array."""
    last = F.size(w) - n
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.array_join(F.slice(w, i + 1, n), "\x01"))).otherwise(F.array().cast("array<string>"))


def pairs(w: Column) -> Column:
    """Joined adjacent entries, in one pass over the array."""
    n = F.size(w)
    return F.when(n > 1, F.zip_with(F.slice(w, 1, F.greatest(n - 1, F.lit(0))), F.slice(w, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.concat_ws("\x01", a, b))).otherwise(F.array().cast("array<string>"))


def distinct_n(w: Column, n: int) -> Column:
    """Share of different n-grams."""
    grams = pairs(w) if n == 2 else w if n == 1 else ngrams(w, n)
    return ratio(F.size(F.array_distinct(grams)), F.size(grams))


def complexity(w: Column) -> Column:
    return F.when(F.size(w) <= 3, "simple").when(F.size(w) <= 10, "medium").otherwise("complex")


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "[.!?]+"), F.trim), lambda s: ~s.rlike("^\\s*$"))


def turn_features(df: DataFrame, key: list[str], text: str = "text", before: str | None = None) -> DataFrame:
    """df with word_count, unique_words, ttr, char_count, sentence_count, avg_sentence_len,
    question_density, bigram_novelty, overlap_ratio."""
    t = F.coalesce(F.col(text), F.lit(""))
    w = F.col("__w")
    out = df.withColumn("__w", words(F.lower(t))).withColumn("word_count", F.size(w)).withColumn("unique_words", F.size(F.array_distinct(w)))
    out = out.withColumn("ttr", ratio(F.col("unique_words"), F.col("word_count"))).withColumn("char_count", F.length(t))
    out = out.withColumn("sentence_count", F.size(sentences(t)))
    out = out.withColumn("avg_sentence_len", F.when(F.col("sentence_count") > 0, F.col("word_count") / F.col("sentence_count")).otherwise(F.col("word_count").cast("double")))
    out = out.withColumn("question_density", ratio(F.length(t) - F.length(F.replace(t, F.lit("?"), F.lit(""))), F.col("sentence_count")))
    out = out.withColumn("bigram_novelty", F.when(F.col("word_count") > 1, distinct_n(w, 2)).otherwise(F.lit(1.0)))
    if before:
        p = words(F.lower(F.coalesce(F.col(before), F.lit(""))))
        both = F.size(F.array_union(w, p))
        some = (F.size(w) > 0) & (F.size(p) > 0)
        overlap = F.when(some, F.size(F.array_intersect(w, p)) / both).otherwise(F.lit(0.0))
    else:
        overlap = F.lit(0.0)
    return out.withColumn("overlap_ratio", overlap).drop("__w")


@F.pandas_udf(StructType([StructField("n", IntegerType()), StructField("top", IntegerType()), StructField("distinct", IntegerType()), StructField("entropy", DoubleType())]))
def _char_counts(text: pd.Series) -> pd.DataFrame:
    out = np.zeros((len(text), 4))
    for a, b, codes, bounds in _vector.segments(text):
        size = np.diff(bounds)
        row = np.repeat(np.arange(b - a, dtype=np.int64), size)
        key, count = np.unique(row << 21 | codes.astype(np.int64), return_counts=True)
        row, share = key >> 21, count / size[key >> 21]
        out[a:b, 0] = size
        np.maximum.at(out[a:b, 1], row, count)
        out[a:b, 2] = np.bincount(row, minlength=b - a)
        out[a:b, 3] = np.bincount(row, -share * np.log2(share), b - a)
    return pd.DataFrame({"n": out[:, 0].astype(np.int32), "top": out[:, 1].astype(np.int32), "distinct": out[:, 2].astype(np.int32), "entropy": out[:, 3]})


def char_counts(text: Column) -> Column:
    """struct(n, top, distinct, entropy): characters, those of the most frequent one, the
    different ones, and the Shannon entropy in bits; one sort of each text's characters."""
    return _char_counts(text)


def entropy(text: Column) -> Column:
    """Shannon entropy (bits) of the characters of the lower-cased text."""
    return char_counts(F.lower(text))["entropy"]


#: Labels of turns in the order of their rules, and their marks. Fixed values.
LABELS = ["echo", "dwell", "novelty", "transition", "stabilization", "oscillation", "recovery", "dispersion", "place_shift"]
MARKS = {"stabilization": "ߛ", "dispersion": "ߜ", "transition": "ߕ", "return": "ߙ", "dwell": "ߡ", "oscillation": "ߚ", "recovery": "ߞ", "novelty": "ߣ", "place_shift": "ߠ", "echo": "ߥ"}


def labels(limit: int = 5) -> Column:
    """Up to ``limit`` labels of a row with turn_features() and char_entropy; the label
    ``return`` needs a feature that nothing sets, so it never comes."""
    c = F.col
    rules = [
        c("overlap_ratio") > 0.4, (c("ttr") < 0.5) & (c("word_count") > 10), c("ttr") > 0.85, c("question_density") > 0.3, c("avg_sentence_len") > 20,
        (c("avg_sentence_len") < 8) & (c("sentence_count") > 3), c("char_entropy") < 3.5, c("char_entropy") > 4.5, (c("bigram_novelty") > 0.95) & (c("word_count") > 15),
    ]
    found = F.array_compact(F.array(*(F.when(r, n) for r, n in zip(rules, LABELS, strict=True))))
    return F.slice(F.when(F.size(found) == 0, F.array(F.lit("stabilization"))).otherwise(found), 1, limit)


def operators(text: Column) -> Column:
    """Operator codes: stabilise 0, scale 1 for more than three characters, bind 2 for the script, close 3."""
    n = F.length(text)
    return F.array_compact(F.array(F.lit(0), F.when(n > 3, 1), F.when(text.rlike(NKO) & (n > 1), 2), F.lit(3)))


def signature(text: Column) -> Column:
    """The first 16 hex digits of sha256 over the operators and the trimmed surface."""
    codes = F.array_join(F.transform(operators(text), lambda x: x.cast("string")), ",")
    return F.substring(F.sha2(F.concat(F.lit("ops:"), codes, F.lit("|surf:"), F.trim(text)), 256), 1, 16)


def unsigned(hexadecimal: Column) -> Column:
    """16 hex digits as an unsigned number."""
    return F.conv(hexadecimal, 16, 10).cast("decimal(20,0)")


def chain(text: Column, concept: Column, script: Column, labels_: Column) -> Column:
    """struct of a sha256 for each layer, and provenance over their join."""
    hashes = [F.sha2(x, 256) for x in (text, concept, script, labels_)]
    return F.struct(*(h.alias(f"layer_{i}") for i, h in enumerate(hashes)), F.sha2(F.concat_ws("|", *hashes), 256).alias("provenance"))


def density(chars: Column, native: Column, marks: Column) -> Column:
    """chars / native / marks in thousandths, cut to an integer of at most 9999."""
    one = lambda x: F.when(x == 0, 1).otherwise(x)
    return F.least(F.floor(chars / one(native) * (1 / one(marks)) * 1000).cast("int"), F.lit(9999))


def invariance(n: Column, concentration: Column, curvature: Column, entropy_: Column) -> Column:
    """struct(passed, score, failure) of the ordered gates with limits 10, 0.5, 0.4, 0.5."""
    ok = (n >= 10) & (concentration >= 0.5) & (curvature >= 0.4) & (entropy_ >= 0.5)
    failure = F.when(n < 10, "insufficient_coverage").when(concentration < 0.5, "inconsistent_direction").when(curvature < 0.4, "curvature_noise").when(entropy_ < 0.5, "low_context_entropy")
    score = F.when(n < 10, n / 10).when(concentration < 0.5, 0.5 * concentration / 0.5).when(curvature < 0.4, 0.5 * curvature / 0.4).when(entropy_ < 0.5, 0.5 * entropy_ / 0.5).otherwise(F.least(F.lit(1.0), 0.5 + 0.1 * (n / 10 - 1)))
    return F.struct(ok.alias("passed"), score.alias("score"), failure.alias("failure"))
