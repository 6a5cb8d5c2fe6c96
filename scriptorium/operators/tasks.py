"""Benchmark tasks over stored answers: prompts joined with answers, scored, rolled up.

A model's answers are a table; calling a model is not part of the engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import metrics

#: Weights of scores by task. Fixed values.
WEIGHTS = {"translation": {"exact": 0.4, "words": 0.6}, "vocabulary": {"exact": 0.5, "partial": 0.5}}


def run(prompts: DataFrame, answers: DataFrame) -> DataFrame:
    """A result row for each prompt (task, sample_id, source_lang, target_lang, source_text,
    expected) and model: answers (model, task, sample_id, predicted, latency_ms, error). A
    prompt that a model has not answered is a failure with the error ``missing``."""
    models = answers.select("model").distinct()  # a row for each model
    asked = prompts.crossJoin(F.broadcast(models))
    rows = asked.join(answers, ["model", "task", "sample_id"], "left")
    error = F.when(F.col("predicted").isNull() & F.col("error").isNull(), "missing").otherwise(F.col("error"))
    return rows.withColumn("error", error).withColumn("success", F.col("error").isNull())


def scored(results: DataFrame) -> DataFrame:
    """results with exact, partial, words and their blend by task; failed rows score 0."""
    predicted, expected = F.coalesce("predicted", F.lit("")), F.col("expected")
    ok = F.col("success")
    parts = {"exact": metrics.exact(predicted, expected).cast("double"), "partial": metrics.partial(predicted, expected), "words": metrics.word_jaccard(predicted, expected)}
    rows = results.withColumns({k: F.when(ok, v).otherwise(0.0) for k, v in parts.items()})
    score: Column | None = None
    for task, weights in WEIGHTS.items():
        blend = sum((F.col(k) * w for k, w in weights.items()), F.lit(0.0))
        score = F.when(F.col("task") == task, blend) if score is None else score.when(F.col("task") == task, blend)
    return rows.withColumn("score", score.otherwise(F.col("exact")))


def rollup(rows: DataFrame) -> DataFrame:
    """By model, task and direction, and by model alone: tests, successes, mean latency of successes, mean score in percent."""
    keys = ("model", "task", "source_lang", "target_lang")
    grouped = rows.groupingSets([[F.col(k) for k in keys], [F.col("model")]], *(F.col(k) for k in keys))
    return grouped.agg(
        F.count("*").alias("tests"), F.count_if("success").alias("successes"), F.avg(F.when(F.col("success"), F.col("latency_ms"))).alias("latency_ms"), (F.avg("score") * 100).alias("score"),
    )


def ranking(totals: DataFrame) -> DataFrame:
    """Models by falling score, ranks from 1 (a row for each model)."""
    own = totals.where("task is null").select("model", "tests", "successes", "latency_ms", "score")
    return own.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(F.round("score", 9)), "model")))
