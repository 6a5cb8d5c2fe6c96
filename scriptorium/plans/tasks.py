"""Queries of benchmark tasks, reports, logits and signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import logits, signals
from ..operators import tasks
from ..shared import folder
from ..sources import sinks
from ._base import query, quoted, table
from .conversations import PAIRS, pairs

_PROMPTS = f"""WITH {PAIRS}, q AS (SELECT CASE WHEN conv_id % 2 = 0 THEN 'translation' ELSE 'vocabulary' END AS task, conv_id * 1000 + turn AS sample_id, 'nko' AS source_lang, CASE WHEN conv_id % 4 < 2 THEN 'en' ELSE 'fr' END AS target_lang, ref AS expected, pred, conv_id FROM p),
  m AS (SELECT * FROM (VALUES ('large'), ('small')) v(model)),
  r AS (SELECT m.model, q.*, NOT (m.model = 'small' AND q.sample_id % 3 = 0) AS answered, m.model = 'large' AND q.sample_id % 5 = 0 AS failed, CASE WHEN m.model = 'large' AND q.sample_id % 2 = 1 THEN q.expected ELSE q.pred END AS predicted, CAST(q.sample_id % 100 + length(m.model) AS DOUBLE) AS latency FROM q, m),
  s AS (SELECT *, answered AND NOT failed AS success FROM r),
  w AS (SELECT *, list_distinct(regexp_extract_all(lower(predicted), '[\\p{{L}}\\p{{N}}_]+')) AS a, list_distinct(regexp_extract_all(lower(expected), '[\\p{{L}}\\p{{N}}_]+')) AS b FROM s),
  x AS (SELECT *, CASE WHEN NOT success THEN 0.0 WHEN lower(trim(predicted)) = lower(trim(expected)) THEN 1.0 ELSE 0.0 END AS exact,
    CASE WHEN NOT success THEN 0.0 WHEN contains(lower(predicted), lower(expected)) THEN 1.0 WHEN len(list_filter(list_filter(string_split_regex(lower(expected), '\\s+'), lambda t: length(t) > 2), lambda t: contains(lower(predicted), t))) > 0 THEN 0.5 ELSE 0.0 END AS partial,
    CASE WHEN success AND len(a) > 0 AND len(b) > 0 THEN len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) ELSE 0.0 END AS words FROM w),
  y AS (SELECT *, CASE task WHEN 'translation' THEN 0.4::DOUBLE * exact + 0.6::DOUBLE * words ELSE 0.5::DOUBLE * exact + 0.5::DOUBLE * partial END AS score FROM x)"""


def _results(spark, d):
    p = pairs(spark, d).withColumn("sample_id", F.col("conv_id") * 1000 + F.col("turn"))
    p = p.withColumn("task", F.when(F.col("conv_id") % 2 == 0, "translation").otherwise("vocabulary"))
    prompts = p.select("task", "sample_id", F.lit("nko").alias("source_lang"), F.when(F.col("conv_id") % 4 < 2, "en").otherwise("fr").alias("target_lang"), F.col("pred").alias("source_text"), F.col("ref").alias("expected"))
    one = p.select("task", "sample_id", "ref", "pred", F.explode(F.array(F.lit("large"), F.lit("small"))).alias("model"))
    failed = (F.col("model") == "large") & (F.col("sample_id") % 5 == 0)
    said = F.when((F.col("model") == "large") & (F.col("sample_id") % 2 == 1), F.col("ref")).otherwise(F.col("pred"))
    answers = one.where(~((F.col("model") == "small") & (F.col("sample_id") % 3 == 0))).select(
        "model", "task", "sample_id", F.when(~failed, said).alias("predicted"), (F.col("sample_id") % 100 + F.length("model")).cast("double").alias("latency_ms"), F.when(failed, "timeout").alias("error"),
    )
    return tasks.scored(tasks.run(prompts, answers))


@query(f"{_PROMPTS} SELECT model, sample_id, CASE WHEN NOT answered THEN 'missing' WHEN failed THEN 'timeout' END AS error, exact, partial, round(words, 9) AS words, round(score, 9) AS score FROM y")
def task_results(spark, d):
    """EXT02: a scored result for each prompt and model, from stored answers."""
    return _results(spark, d).select("model", "sample_id", "error", "exact", "partial", F.round("words", 9).alias("words"), F.round("score", 9).alias("score"))


_ROLLUP = "count(*) AS tests, count(*) FILTER (success) AS successes, round(avg(latency) FILTER (success), 6) AS latency_ms, round(avg(score) * 100, 6) AS score"


@query(f"{_PROMPTS} SELECT model, task, source_lang, target_lang, {_ROLLUP} FROM y GROUP BY GROUPING SETS ((model, task, source_lang, target_lang), (model))")
def task_rollup(spark, d):
    """EXT03: the driver's scores by model, task and direction, and by model."""
    r = tasks.rollup(_results(spark, d))
    return r.select("model", "task", "source_lang", "target_lang", "tests", "successes", F.round("latency_ms", 6).alias("latency_ms"), F.round("score", 6).alias("score"))


@query(
    f"""{_PROMPTS}, t AS (SELECT model, {_ROLLUP} FROM y GROUP BY model), k AS (SELECT *, row_number() OVER (ORDER BY score DESC, model) AS rank FROM t)
  SELECT 'json' AS kind, rank, model FROM k UNION ALL SELECT 'markdown', rank, model FROM k"""
)
def comparison_report(spark, d):
    """SNK08: the models' ranking as a JSON and a Markdown report, written and read back."""
    path = folder(spark)
    sinks.report(tasks.ranking(tasks.rollup(_results(spark, d))).orderBy("rank").select("rank", "model", "tests", "successes", F.round("score", 1).alias("score")), "Comparison of models", path)
    rows = spark.read.json(f"{path}/json").select(F.lit("json").alias("kind"), "rank", "model")
    cells = F.split("value", r" *\| *")
    lines = spark.read.text(f"{path}/markdown").where(F.col("value").rlike(r"^\| *[0-9]"))
    return rows.union(lines.select(F.lit("markdown"), cells[1].cast("long"), cells[2]))


_TOKENS = ["ta", "so", " ", "ka", "be", "la", "den", "mo"]
_L = "list_transform(embedding[1:8], lambda x: CAST(x AS DOUBLE) * 10)"


@query(
    f"""SELECT vec_id, list_sum(list_transform(range(1, 9), lambda i: i * m[i])) AS masked, list_sum(list_transform(range(1, 9), lambda i: i * r[i])) AS repeated, list_sum(b) AS boosted FROM (SELECT vec_id,
  list_transform(x, lambda v, i: CASE WHEN i <= 6 AND (vec_id + i) % 3 = 0 THEN v - 100 ELSE v END) AS m,
  list_transform(x, lambda v, i: CASE WHEN i - 1 IN (vec_id % 8, (vec_id + 3) % 8) THEN CASE WHEN v > 0 THEN v / 1.3::DOUBLE ELSE v * 1.3::DOUBLE END ELSE v END) AS r,
  list_transform({_TOKENS}, lambda t: CASE vec_id % 3 WHEN 0 THEN CASE WHEN 'mu' || t IN ('muso', 'muka') THEN 2.0 ELSE 0.0 END ELSE CASE WHEN trim(t) IN ('den', 'kan') THEN 1.0 WHEN trim(t) <> '' AND (starts_with('den', trim(t)) OR starts_with('kan', trim(t))) THEN 0.5 ELSE 0.0 END END) AS b
  FROM (SELECT vec_id, {_L} AS x FROM embeddings))"""
)
def logit_adjustments(spark, d):
    """DEC02: masks, repetition penalties and boosts over stored logits."""
    v = table(spark, d, "embeddings").select("vec_id", F.transform(F.slice("embedding", 1, 8), lambda x: x.cast("double") * 10).alias("x"))
    admitted = F.transform(F.sequence(F.lit(1), F.lit(6)), lambda i: (F.col("vec_id") + i) % 3 != 0)
    recent = F.concat(F.array_repeat((F.col("vec_id") + 1) % 8, 3), F.array(F.col("vec_id") % 8, (F.col("vec_id") + 3) % 8)).cast("array<int>")
    context = F.when(F.col("vec_id") % 3 == 0, "ne ye mu").otherwise("ne ye mogo ")
    arrays = {"m": logits.masked(F.col("x"), admitted), "r": logits.repeated(F.col("x"), recent, window=2), "b": logits.boosts(context, F.array(*map(F.lit, _TOKENS)), F.array(F.lit("muso"), F.lit("muka")), F.array(F.lit("den"), F.lit("kan")))}
    total = lambda a: F.aggregate(F.transform(a, lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return v.withColumns(arrays).select("vec_id", total(F.col("m")).alias("masked"), total(F.col("r")).alias("repeated"), F.aggregate("b", F.lit(0.0), lambda s, x: s + x).alias("boosted"))


_V = "list_transform(embedding, lambda x: CAST(x AS DOUBLE))"


@query(
    f"""SELECT vec_id, len(y) AS size, round(list_sum(list_transform(y, lambda v, i: v * i)), 9) AS total FROM (SELECT vec_id, list_transform(range(0, CAST(floor(len(x) * 0.625::DOUBLE) AS BIGINT)), lambda i: list_transform([greatest((i + 0.5::DOUBLE) * (len(x) / floor(len(x) * 0.625::DOUBLE)) - 0.5::DOUBLE, 0.0::DOUBLE)],
  lambda p: x[CAST(floor(p) AS BIGINT) + 1] * (1 - (p - floor(p))) + x[least(CAST(floor(p) AS BIGINT) + 2, len(x))] * (p - floor(p)))[1]) AS y FROM (SELECT vec_id, {_V} AS x FROM embeddings))"""
)
def signal_resampled(spark, d):
    """VEC07: linear resampling from 16 to 10 kHz."""
    v = table(spark, d, "embeddings").select("vec_id", signals.resampled(F.transform("embedding", lambda x: x.cast("double")), 16_000, 10_000).alias("y"))
    return v.select("vec_id", F.size("y").cast("long").alias("size"), F.round(F.aggregate(F.transform("y", lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x), 9).alias("total"))


@query(
    """WITH e AS (SELECT i, CAST(floor(401 * (700 * (pow(10, (i * 2595 * log10(1 + 8000 / 700.0::DOUBLE) / 41) / 2595) - 1)) / 16000) AS INT) AS bin FROM range(42) t(i)),
  t AS (SELECT CAST(a.i AS INT) AS band, a.bin AS low, b.bin AS mid, c.bin AS high FROM e a JOIN e b ON b.i = a.i + 1 JOIN e c ON c.i = a.i + 2)
  SELECT band, CAST(j AS INT) AS bin, round(w, 9) AS weight FROM (SELECT band, j, CASE WHEN j < mid THEN (j - low) / (mid - low) ELSE (high - j) / (high - mid) END AS w FROM (SELECT *, unnest(range(low, high)) AS j FROM t)) WHERE w > 0"""
)
def mel_filterbank(spark, d):
    """VEC07: weights of 40 mel bands over 201 frequency bins."""
    return signals.mel_filters(spark, 16_000, 400, 40).select("band", "bin", F.round("weight", 9).alias("weight"))


@query()
def signal_log_mel(spark, d):
    """VEC07: log-mel spectrograms of the vectors, repeated to a signal each."""
    v = table(spark, d, "embeddings").select("vec_id", F.flatten(F.array_repeat(F.transform("embedding", lambda x: x.cast("double")), 16)).alias("x"))
    m = v.select("vec_id", signals.log_mel(F.col("x"), bands=20).alias("m"))
    return m.select("vec_id", F.size("m").alias("frames"), F.round(F.aggregate(F.flatten("m"), F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


def _drawn(salt: str, low: int, high: str) -> str:
    return f"({low} + CAST('0x' || substr(md5({quoted(salt + '-')} || vec_id), 1, 8) AS BIGINT) % greatest({high} - {low} + 1, 1))"


@query(
    f"""SELECT vec_id, len(list_filter(k, lambda x: x = 0.0)) AS zeros, round(list_sum(k), 9) AS total FROM (SELECT vec_id, list_transform(x, lambda v, i: CASE WHEN ((i - 1) // 8) >= tf AND ((i - 1) // 8) < tf + tw OR ((i - 1) % 8) >= bf AND ((i - 1) % 8) < bf + bw THEN 0.0 ELSE v END) AS k
  FROM (SELECT *, {_drawn("tf", 0, "8 - tw")} AS tf, {_drawn("bf", 0, "8 - bw")} AS bf FROM (SELECT vec_id, {_V} AS x, {_drawn("tw", 1, "3")} AS tw, {_drawn("bw", 1, "2")} AS bw FROM embeddings)))"""
)
def signal_masked(spark, d):
    """VEC08: a run of times and a run of bands set to 0, drawn by hash."""
    key = F.col("vec_id")
    v = table(spark, d, "embeddings").select("vec_id", F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.transform(F.slice("embedding", i * 8 + 1, 8), lambda x: x.cast("double"))).alias("x"))
    v = v.withColumns({"tw": signals.drawn(key, "tw", 1, F.lit(3)), "bw": signals.drawn(key, "bw", 1, F.lit(2))})
    v = v.withColumns({"tf": signals.drawn(key, "tf", 0, 8 - F.col("tw")), "bf": signals.drawn(key, "bf", 0, 8 - F.col("bw"))})
    k = F.flatten(signals.masked(F.col("x"), [(F.col("tf"), F.col("tw"))], [(F.col("bf"), F.col("bw"))]))
    return v.select("vec_id", F.size(F.filter(k, lambda x: x == 0.0)).cast("long").alias("zeros"), F.round(F.aggregate(k, F.lit(0.0), lambda s, x: s + x), 9).alias("total"))
