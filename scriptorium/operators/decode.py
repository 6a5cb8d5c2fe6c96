"""Decoding of per-frame scores: greedy collapse and prefix beam search."""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType


def collapse(ids: Column, blank: int = 0) -> Column:
    """Repeats in a row dropped, then blanks."""
    fresh = F.filter(F.transform(ids, lambda x, i: F.when((i == 0) | (x != F.element_at(ids, F.greatest(i, F.lit(1)))), x)), lambda x: x.isNotNull())
    return F.filter(fresh, lambda x: x != blank)


def beam(
    frames, alphabet: list[str], width: int = 5, blank: int = 0, language: Callable[[str, str], float] | None = None, weight: float = 0.3, admits: Callable[[str, str], bool] | None = None, complete: Callable[[str], bool] | None = None, penalty: float = 2.0
) -> tuple[str, float]:
    """The best text of log-probability frames. Beams with one text are merged; a language
    model scores next characters; an automaton rejects characters while a beam is extended
    (``admits``), and texts that end in the middle of something cost ``penalty``."""

    def add(a: float, b: float) -> float:
        if a == -math.inf:
            return b
        if b == -math.inf:
            return a
        m = max(a, b)
        return m + math.log(math.exp(a - m) + math.exp(b - m))

    beams = {"": (0.0, -math.inf, 0.0)}  # log probability ending in blank, in a character, model score
    for frame in frames:
        new: dict[str, list[float]] = {}

        def put(text, blank_, char, model, new=new):
            b = new.setdefault(text, [-math.inf, -math.inf, model])
            b[0], b[1] = add(b[0], blank_), add(b[1], char)

        for text, (pb, pc, lm) in beams.items():
            put(text, add(pb, pc) + frame[blank], -math.inf, lm)
            for i, c in enumerate(alphabet):
                if i == blank or admits and not (text and text[-1] == c) and not admits(text, c):
                    continue
                p = frame[i]
                if text and text[-1] == c:
                    put(text, -math.inf, pc + p, lm)
                    base = pb
                    if admits and not admits(text, c):
                        continue
                else:
                    base = add(pb, pc)
                score = lm + (weight * language(text, c) if language else 0.0)
                put(text + c, -math.inf, base + p, score)
        beams = dict(sorted(new.items(), key=lambda x: (-(add(x[1][0], x[1][1]) + x[1][2]), x[0]))[:width])

    def final(item):
        text, (pb, pc, lm) = item
        return add(pb, pc) + lm - (penalty if complete and not complete(text) else 0.0)

    best = max(sorted(beams.items()), key=final)
    return best[0], final(best)


class PairModel:
    """Smoothed log probabilities of a character after the one before it, from counts of pairs."""

    def __init__(self, counts: dict[str, int], letters: int):
        self.counts, self.letters = counts, letters
        self.totals: dict[str, int] = {}
        for pair, n in counts.items():
            self.totals[pair[0]] = self.totals.get(pair[0], 0) + n

    def __call__(self, text: str, c: str) -> float:
        if not text:
            return -math.log(self.letters)
        return math.log((self.counts.get(text[-1] + c, 0) + 1) / (self.totals.get(text[-1], 0) + self.letters))


def beam_search(df: DataFrame, frames: str, alphabet: list[str], **options) -> DataFrame:
    """df with (text, score) of each row's frames (array<array<double>>), in Arrow batches."""

    @F.pandas_udf(StructType([StructField("text", StringType()), StructField("score", DoubleType())]))
    def run(col: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([beam(x, alphabet, **options) for x in col], columns=["text", "score"])

    return df.withColumn("decoded", run(F.col(frames))).select(*df.columns, "decoded.*")
