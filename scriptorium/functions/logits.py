"""Adjustments of next-token logits (arrays over a vocabulary) as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def masked(logits: Column, admitted: Column, penalty: float = 100.0) -> Column:
    """A penalty on tokens that are not admitted; tokens beyond the mask are admitted."""
    return F.transform(logits, lambda x, i: F.when(F.coalesce(F.try_element_at(admitted, i + 1), F.lit(True)), x).otherwise(x - penalty))


def repeated(logits: Column, recent: Column, penalty: float = 1.3, window: int = 32) -> Column:
    """Tokens (numbers from 0) among the last ``window`` ones are made less likely: positive
    logits are divided by the penalty, others multiplied."""
    last = F.when(F.size(recent) > window, F.slice(recent, F.size(recent) - window + 1, window)).otherwise(recent)
    return F.transform(logits, lambda x, i: F.when(F.array_contains(last, i), F.when(x > 0, x / penalty).otherwise(x * penalty)).otherwise(x))


def boosts(context: Column, tokens: Column, words: Column, followers: Column, boost: float = 2.0) -> Column:
    """A boost for each token: whole, where it makes the unfinished last word of the context
    a known word; half, where after a finished word it is one of its followers; a quarter,
    where it begins one."""
    unfinished = F.regexp_extract(context, "([^ \\n]*)$", 1)

    def one(token: Column) -> Column:
        bare = F.trim(token)
        after = F.when(F.array_contains(followers, bare), boost / 2).when((bare != "") & F.exists(followers, lambda w: w.startswith(bare)), boost / 4).otherwise(0.0)
        return F.when(unfinished != "", F.when(F.array_contains(words, F.concat(unfinished, token)), boost).otherwise(0.0)).otherwise(after)

    return F.transform(tokens, one)
