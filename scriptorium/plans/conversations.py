"""Queries over conversations: turn features, labels, and scores of user and assistant turns."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import alignment, clean, features, metrics, translit
from ._base import query, table

W = r"list_filter(string_split_regex({}, '\s+'), lambda w: w <> '')"
LW = W.format("lower(text)")
FEATURES = rf"""f AS (SELECT conv_id, turn, text, w, len(w) AS word_count, len(list_distinct(w)) AS unique_words, length(text) AS char_count,
    len(list_filter(string_split_regex(text, '[.!?]+'), lambda s: NOT regexp_matches(s, '^\s*$'))) AS sentence_count, length(text) - length(replace(text, '?', '')) AS questions,
    CASE WHEN len(w) > 1 THEN len(list_distinct(list_zip(w[:-2], w[2:]))) / (len(w) - 1) ELSE 1.0 END AS bigram_novelty,
    lag(w) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM (SELECT *, {LW} AS w FROM conversations)),
  g AS (SELECT conv_id, turn, text, word_count, unique_words, CASE WHEN word_count > 0 THEN unique_words / word_count ELSE 0.0 END AS ttr, char_count, sentence_count,
    CASE WHEN sentence_count > 0 THEN word_count / sentence_count ELSE word_count END AS avg_sentence_len, CASE WHEN sentence_count > 0 THEN questions / sentence_count ELSE 0.0 END AS question_density, bigram_novelty,
    CASE WHEN p IS NOT NULL AND len(p) > 0 AND len(w) > 0 THEN len(list_intersect(w, p)) / len(list_distinct(list_concat(w, p))) ELSE 0.0 END AS overlap_ratio FROM f),
  e AS (SELECT conv_id, turn, sum(-(k / n) * log2(k / n)) AS char_entropy FROM (SELECT conv_id, turn, c, count(*) AS k, sum(count(*)) OVER (PARTITION BY conv_id, turn) AS n FROM (SELECT conv_id, turn, unnest(string_split(lower(text), '')) AS c FROM conversations) GROUP BY conv_id, turn, c) GROUP BY conv_id, turn)"""


def turns(spark, d):
    return table(spark, d, "conversations")


def _features(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = turns(spark, d).withColumn("before", F.lag("text").over(w))
    return features.turn_features(t, ["conv_id", "turn"], "text", "before")


@query(f"WITH {FEATURES} SELECT conv_id, turn, word_count, unique_words, ttr, char_count, sentence_count, avg_sentence_len, question_density, bigram_novelty, overlap_ratio, round(char_entropy, 6) AS char_entropy FROM g JOIN e USING (conv_id, turn)")
def conv_features(spark, d):
    """FEA01, WN01."""
    ints = ("word_count", "unique_words", "char_count", "sentence_count")
    f = _features(spark, d).withColumn("char_entropy", F.round(features.entropy(F.col("text")), 6))
    return f.select("conv_id", "turn", *(F.col(c).cast("long").alias(c) for c in ints), "ttr", "avg_sentence_len", "question_density", "bigram_novelty", "overlap_ratio", "char_entropy")


LABELS = """l AS (SELECT conv_id, turn, list_filter([CASE WHEN overlap_ratio > 0.4 THEN 'echo' END, CASE WHEN ttr < 0.5 AND word_count > 10 THEN 'dwell' END, CASE WHEN ttr > 0.85 THEN 'novelty' END, CASE WHEN question_density > 0.3 THEN 'transition' END,
  CASE WHEN avg_sentence_len > 20 THEN 'stabilization' END, CASE WHEN avg_sentence_len < 8 AND sentence_count > 3 THEN 'oscillation' END, CASE WHEN char_entropy < 3.5 THEN 'recovery' END, CASE WHEN char_entropy > 4.5 THEN 'dispersion' END, CASE WHEN bigram_novelty > 0.95 AND word_count > 15 THEN 'place_shift' END], lambda x: x IS NOT NULL) AS l FROM g JOIN e USING (conv_id, turn))"""


@query(f"WITH {FEATURES}, {LABELS} SELECT conv_id, turn, array_to_string(CASE WHEN len(l) = 0 THEN ['stabilization'] ELSE l[1:5] END, ',') AS labels FROM l")
def conv_labels(spark, d):
    """FEA02, FEA03."""
    f = _features(spark, d).withColumn("char_entropy", features.entropy(F.col("text")))
    return f.select("conv_id", "turn", F.array_join(features.labels(), ",").alias("labels"))


@query(f"WITH {FEATURES}, {LABELS} SELECT label, count(*) AS n FROM (SELECT unnest(CASE WHEN len(l) = 0 THEN ['stabilization'] ELSE l[1:5] END) AS label FROM l) GROUP BY label")
def conv_label_histogram(spark, d):
    """AG13 (histogram), AG02."""
    f = _features(spark, d).withColumn("char_entropy", features.entropy(F.col("text")))
    return f.select(F.explode(features.labels()).alias("label")).groupBy("label").agg(F.count("*").alias("n"))


@query(f"WITH {FEATURES}, {LABELS} SELECT CAST(sum(char_count) AS BIGINT) AS chars, CAST(sum(marks) AS BIGINT) AS marks, sum(char_count) / sum(marks) AS ratio_of_sums, avg(r) AS mean, quantile_cont(r, 0.5) AS median, stddev_pop(r) AS std, min(r) AS least, max(r) AS most FROM (SELECT char_count, greatest(1, least(5, len(l))) AS marks, char_count / greatest(1, least(5, len(l))) AS r FROM g JOIN l USING (conv_id, turn))")
def conv_compression(spark, d):
    """AG13, FEA06."""
    f = _features(spark, d).withColumn("char_entropy", features.entropy(F.col("text"))).select("char_count", F.size(features.labels()).alias("marks"))
    r = F.col("char_count") / F.col("marks")
    return f.agg(F.sum("char_count").cast("long").alias("chars"), F.sum("marks").cast("long").alias("marks"), (F.sum("char_count") / F.sum("marks")).alias("ratio_of_sums"), F.avg(r).alias("mean"), F.percentile(r, 0.5).alias("median"), F.stddev_pop(r).alias("std"), F.min(r).alias("least"), F.max(r).alias("most"))


@query("SELECT conv_id, count(*) AS turns, string_agg(role || ': ' || md5(coalesce(text, '')), '|' ORDER BY turn) AS record FROM conversations GROUP BY conv_id")
def conv_chat_records(spark, d):
    """PRJ03, PRJ11, WN09: one record of a conversation's messages in order."""
    m = turns(spark, d).select("conv_id", F.struct("turn", F.concat("role", F.lit(": "), F.md5(F.coalesce("text", F.lit("")))).alias("m")).alias("m"))
    g = m.groupBy("conv_id").agg(F.array_sort(F.collect_list("m")).alias("m"))
    return g.select("conv_id", F.size("m").cast("long").alias("turns"), F.array_join(F.transform("m", lambda x: x["m"]), "|").alias("record"))


@query(
    """SELECT verdict, count(*) AS n FROM (SELECT CASE WHEN n < 2 THEN 'too_few' WHEN bad > 0 THEN 'bad_message' WHEN NOT ok THEN 'no_assistant' ELSE 'ok' END AS verdict
  FROM (SELECT conv_id, count(*) AS n, count(*) FILTER (role IS NULL OR text IS NULL OR trim(text) = '') AS bad, bool_or(role = 'assistant') AS ok FROM conversations GROUP BY conv_id)) GROUP BY verdict"""
)
def conv_shape_validation(spark, d):
    """FLT14."""
    bad = F.col("role").isNull() | F.col("text").isNull() | (F.trim("text") == "")
    g = turns(spark, d).groupBy("conv_id").agg(F.count("*").alias("n"), F.count_if(bad).alias("bad"), F.bool_or(F.col("role") == "assistant").alias("ok"))
    verdict = F.when(F.col("n") < 2, "too_few").when(F.col("bad") > 0, "bad_message").when(~F.col("ok"), "no_assistant").otherwise("ok")
    return g.groupBy(verdict.alias("verdict")).agg(F.count("*").alias("n"))


PAIRS = "SELECT conv_id, turn, text AS ref, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS pred, role, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next FROM conversations"
PAIRS = f"p AS (SELECT conv_id, turn, ref, pred FROM ({PAIRS}) WHERE role = 'user' AND next = 'assistant')"


def pairs(spark, d):
    """A user's turn as the reference, the assistant's answer as the prediction."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = turns(spark, d).select("conv_id", "turn", F.col("text").alias("ref"), F.lead("text").over(w).alias("pred"), "role", F.lead("role").over(w).alias("next"))
    return t.where("role = 'user' AND next = 'assistant'").select("conv_id", "turn", "ref", "pred")


@query(f"WITH {PAIRS}, s AS (SELECT *, list_distinct(regexp_extract_all(lower(pred), '[\\p{{L}}\\p{{N}}_]+')) AS a, list_distinct(regexp_extract_all(lower(ref), '[\\p{{L}}\\p{{N}}_]+')) AS b FROM p) SELECT conv_id, turn, CASE WHEN len(a) > 0 AND len(b) > 0 THEN len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) ELSE 0.0 END AS jaccard FROM s")
def conv_metric_jaccard(spark, d):
    """MET06, SET03."""
    return pairs(spark, d).select("conv_id", "turn", metrics.word_jaccard(F.col("pred"), F.col("ref")).alias("jaccard"))


@query(f"WITH {PAIRS} SELECT conv_id, turn, CASE WHEN contains(lower(pred), lower(ref)) THEN 1.0::DOUBLE WHEN len(list_filter({W.format('lower(ref)')}, lambda x: length(x) > 2 AND contains(lower(pred), x))) > 0 THEN 0.5 ELSE 0.0 END AS partial, lower(trim(pred)) = lower(trim(ref)) AS exact FROM p")
def conv_partial_match(spark, d):
    """MET04, MET05."""
    return pairs(spark, d).select("conv_id", "turn", metrics.partial(F.col("pred"), F.col("ref")).alias("partial"), metrics.exact(F.col("pred"), F.col("ref")).alias("exact"))


ASCII = "regexp_replace({}, '[^ -~]', '', 'g')"


@query(f"WITH {PAIRS}, a AS (SELECT conv_id, turn, {ASCII.format('ref')} AS ref, {ASCII.format('pred')} AS pred FROM p) SELECT conv_id, turn, CASE WHEN length(ref) = 0 THEN CASE WHEN length(pred) = 0 THEN 0.0 ELSE 1.0 END ELSE least(levenshtein(ref, pred) / length(ref), 1.0) END AS cer FROM a")
def conv_cer(spark, d):
    """MET01, MET02, on the ASCII characters (the oracle's distance counts bytes)."""
    p = pairs(spark, d).select("conv_id", "turn", *(F.regexp_replace(c, "[^ -~]", "").alias(c) for c in ("ref", "pred")))
    return p.select("conv_id", "turn", metrics.char_error(F.col("ref"), F.col("pred")).alias("cer"))


_DISTANCE = """list_reduce(range(1, len(r) + 1), lambda row, i: list_transform([list_prepend(i - 0, list_transform(range(1, len(h) + 1), lambda j: least(row[j + 1] + 1, row[j] + CAST(r[i] <> h[j] AS INT)) - j))], lambda u: list_transform(range(1, len(h) + 2), lambda j: j - 1 + list_min(u[1:j])))[1], range(0, len(h) + 1))[-1]"""


@query(
    f"""WITH {PAIRS}, w AS (SELECT conv_id, turn, {W.format("coalesce(ref, '')")} AS r, {W.format("coalesce(pred, '')")} AS h FROM p),
  e AS (SELECT conv_id, turn, CASE WHEN len(r) = 0 THEN CASE WHEN len(h) = 0 THEN 0.0 ELSE 1.0 END ELSE {_DISTANCE} / len(r) END AS unclamped FROM w)
  SELECT conv_id, turn, least(unclamped, 1.0) AS wer, unclamped FROM e"""
)
def conv_wer(spark, d):
    """MET02: word error rates."""
    return pairs(spark, d).select("conv_id", "turn", metrics.word_error(F.col("ref"), F.col("pred")).alias("wer"), metrics.word_error(F.col("ref"), F.col("pred"), False).alias("unclamped"))




@query(
    f"""WITH {PAIRS}, w AS (SELECT conv_id, turn, {W.format('lower(pred)')} AS a, {W.format('lower(ref)')} AS b FROM p),
  x AS (SELECT conv_id, turn, len(a) AS na, len(b) AS nb, unnest(list_distinct(a)) AS t, a, b FROM w),
  c AS (SELECT conv_id, turn, na, nb, sum(least(len(list_filter(a, lambda y: y = t)), len(list_filter(b, lambda y: y = t)))) AS m FROM x GROUP BY conv_id, turn, na, nb)
  SELECT conv_id, turn, CASE WHEN na > 0 AND nb > 0 THEN least(1.0, na / nb) * m / na ELSE 0.0 END AS bleu_1 FROM c"""
)
def conv_bleu_1(spark, d):
    """MET11."""
    return pairs(spark, d).select("conv_id", "turn", metrics.bleu_1(F.col("pred"), F.col("ref")).alias("bleu_1"))


def _numbered(grams, n: int):
    """n-grams with their order."""
    return F.transform(grams, lambda x: F.struct(F.lit(n).alias("n"), x.alias("x")))


def _grams(x: str, n: int) -> str:
    return f"list_transform(range(1, len({x}) - {n} + 2), lambda i: array_to_string({x}[i:i+{n - 1}], chr(1)))"


@query(
    f"""WITH {PAIRS}, w AS (SELECT conv_id, turn, {W.format('pred')} AS a, {W.format('ref')} AS b FROM p),
  l AS (SELECT sum(len(a)) AS la, sum(len(b)) AS lb FROM w),
  g AS ({" UNION ALL ".join(f"SELECT {n} AS n, conv_id, turn, {_grams('a', n)} AS ga, {_grams('b', n)} AS gb FROM w" for n in (1, 2, 3, 4))}),
  a AS (SELECT n, conv_id, turn, x, count(*) AS k FROM (SELECT n, conv_id, turn, unnest(ga) AS x FROM g) GROUP BY ALL), b AS (SELECT n, conv_id, turn, x, count(*) AS k FROM (SELECT n, conv_id, turn, unnest(gb) AS x FROM g) GROUP BY ALL),
  s AS (SELECT n, (SELECT sum(k) FROM a z WHERE z.n = t.n) AS total, coalesce((SELECT sum(least(a.k, b.k)) FROM a JOIN b USING (n, conv_id, turn, x) WHERE n = t.n), 0) AS m FROM (VALUES (1), (2), (3), (4)) t(n))
  SELECT CAST(n AS BIGINT) AS n, CAST(total AS BIGINT) AS total, CAST(m AS BIGINT) AS matched, m / total AS precision, (SELECT CASE WHEN la >= lb THEN 1.0 ELSE exp(1 - lb / la) END FROM l) AS brevity FROM s"""
)
def conv_bleu(spark, d):
    """MET09: corpus precisions and brevity penalty. Clipped counts are joins of
    pre-aggregated n-gram counts."""
    w = pairs(spark, d).select("conv_id", "turn", clean.words(F.col("pred")).alias("a"), clean.words(F.col("ref")).alias("b"))
    grams = [(n, features.ngrams(F.col("a"), n), features.ngrams(F.col("b"), n)) for n in (1, 2, 3, 4)]

    def counts(side):
        every = F.explode(F.flatten(F.array(*(_numbered(g[side], g[0]) for g in grams)))).alias("g")
        return w.select("conv_id", "turn", every).groupBy("conv_id", "turn", "g").agg(F.count("*").alias("k"))

    a, b = counts(1), counts(2).withColumnRenamed("k", "r")
    j = a.join(b, ["conv_id", "turn", "g"], "left").groupBy(F.col("g.n").cast("long").alias("n")).agg(F.sum("k").alias("total"), F.sum(F.least("k", F.coalesce("r", F.lit(0)))).alias("matched"))
    lengths = w.agg(F.sum(F.size("a")).alias("la"), F.sum(F.size("b")).alias("lb"))
    brevity = F.when(F.col("la") >= F.col("lb"), 1.0).otherwise(F.exp(1 - F.col("lb") / F.col("la")))
    return j.crossJoin(F.broadcast(lengths)).select("n", "total", "matched", (F.col("matched") / F.col("total")).alias("precision"), brevity.alias("brevity"))


@query(
    f"""WITH {PAIRS}, c AS (SELECT conv_id, turn, list_filter(string_split(pred, ''), lambda x: x NOT IN (' ', chr(10))) AS a, list_filter(string_split(ref, ''), lambda x: x NOT IN (' ', chr(10))) AS b FROM p),
  g AS ({" UNION ALL ".join(f"SELECT {n} AS n, conv_id, turn, {_grams('a', n)} AS ga, {_grams('b', n)} AS gb FROM c" for n in (1, 2, 3))}),
  a AS (SELECT n, conv_id, turn, x, count(*) AS k FROM (SELECT n, conv_id, turn, unnest(ga) AS x FROM g) GROUP BY ALL), b AS (SELECT n, conv_id, turn, x, count(*) AS k FROM (SELECT n, conv_id, turn, unnest(gb) AS x FROM g) GROUP BY ALL),
  ta AS (SELECT n, sum(k) AS t FROM a GROUP BY n), tb AS (SELECT n, sum(k) AS t FROM b GROUP BY n), m AS (SELECT n, sum(least(a.k, b.k)) AS m FROM a JOIN b USING (n, conv_id, turn, x) GROUP BY n)
  SELECT CAST(n AS BIGINT) AS n, m / ta.t AS precision, m / tb.t AS recall, 5 * (m / ta.t) * (m / tb.t) / (4 * (m / ta.t) + m / tb.t) AS f2 FROM m JOIN ta USING (n) JOIN tb USING (n)"""
)
def conv_chrf(spark, d):
    """MET09: character n-gram precision, recall and F2 by order, white space left out."""
    c = pairs(spark, d).select("conv_id", "turn", *(F.filter(F.split(x, ""), lambda y: ~y.isin(" ", "\n")).alias(k) for k, x in (("a", "pred"), ("b", "ref"))))

    def counts(side):
        every = F.explode(F.flatten(F.array(*(_numbered(features.ngrams(F.col(side), n), n) for n in (1, 2, 3))))).alias("g")
        return c.select("conv_id", "turn", every).groupBy("conv_id", "turn", "g").agg(F.count("*").alias("k"))

    a, b = counts("a"), counts("b").withColumnRenamed("k", "r")
    j = a.join(b, ["conv_id", "turn", "g"], "full").groupBy(F.col("g.n").cast("long").alias("n")).agg(F.sum("k").alias("ta"), F.sum("r").alias("tb"), F.sum(F.least(F.coalesce("k", F.lit(0)), F.coalesce("r", F.lit(0)))).alias("m"))
    p, r = F.col("m") / F.col("ta"), F.col("m") / F.col("tb")
    return j.select("n", p.alias("precision"), r.alias("recall"), (5 * p * r / (4 * p + r)).alias("f2"))


@query(f"WITH {PAIRS}, c AS (SELECT conv_id, turn, list_distinct(string_split(pred, '')) AS a, list_distinct(string_split(ref, '')) AS b, list_distinct({W.format('lower(ref)')}) AS r, {W.format('lower(pred)')} AS w, lower(trim(pred)) = lower(trim(ref)) AS same FROM p) SELECT conv_id, turn, len(list_intersect(a, b)) / len(b) AS char_recall, len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) AS char_jaccard, len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) >= 0.85 AS fuzzy, CASE WHEN same THEN 1.0 ELSE len(list_intersect(r, w)) / len(r) END AS word_recall FROM c")
def conv_set_scores(spark, d):
    """MET08, MET10, MET12, MET13."""
    a, b = F.col("pred"), F.col("ref")
    j = metrics.char_jaccard(a, b)
    return pairs(spark, d).select("conv_id", "turn", metrics.char_recall(a, b).alias("char_recall"), j.alias("char_jaccard"), (j >= 0.85).alias("fuzzy"), metrics.word_recall(a, b).alias("word_recall"))


@query("SELECT direction, count(*) AS n, CAST(sum(length(src)) AS BIGINT) AS chars FROM (WITH " + PAIRS + " SELECT 'user-assistant' AS direction, ref AS src FROM p WHERE length(ref) BETWEEN 3 AND 500 AND length(pred) BETWEEN 3 AND 500 UNION ALL SELECT 'user-assistant_rev', pred FROM p WHERE length(ref) BETWEEN 3 AND 500 AND length(pred) BETWEEN 3 AND 500) GROUP BY direction")
def conv_reverse_pairs(spark, d):
    """FLT08, PRJ07: length band on both sides, reversed copies."""
    p = pairs(spark, d).where(F.length("ref").between(3, 500) & F.length("pred").between(3, 500))
    both = p.select(F.lit("user-assistant").alias("direction"), F.col("ref").alias("src")).unionByName(p.select(F.lit("user-assistant_rev").alias("direction"), F.col("pred").alias("src")))
    return both.groupBy("direction").agg(F.count("*").alias("n"), F.sum(F.length("src")).cast("long").alias("chars"))


@query()
def conv_lcs_ratio(spark, d):
    """MET03: character accuracy by the longest common subsequence."""
    return pairs(spark, d).select("conv_id", "turn", alignment.lcs_ratio("ref", "pred").alias("accuracy"))


@query()
def conv_error_classes(spark, d):
    """AG22: tallies of aligned characters by class, over the turns in the script."""
    native = lambda c: translit.from_ipa(translit.latin_to_ipa(F.col(c)), "nko").alias(c)
    e = pairs(spark, d).select(native("ref"), native("pred")).select(F.explode(alignment.class_edits("ref", "pred")).alias("e")).select("e.*")
    return e.groupBy("class").agg(*(F.sum(c).alias(c) for c in alignment.EDITS))


@query(r"WITH " + PAIRS + r" SELECT conv_id, turn, CASE WHEN v IS NULL THEN 0.0 WHEN rel <= 0.1 THEN 1.0 ELSE greatest(0.0, least(1.0, exp(-5.0 * rel))) END AS numeric, least(k / 2, 1.0) AS keywords FROM (SELECT *, abs(v - length(ref)) / length(ref) AS rel, CAST(contains(lower(pred), 'the') AS INT) + CAST(contains(lower(pred), 'que') AS INT) + CAST(contains(lower(pred), 'der') AS INT) AS k FROM (SELECT *, CAST(regexp_extract_all(pred || ' ' || length(pred), '-?[0-9]+\.?[0-9]*')[-1] AS DOUBLE) AS v FROM p))")
def conv_probe_scores(spark, d):
    """MET14, MET15: a numeric answer (here the length, against the reference's) and keywords."""
    answer = F.concat_ws(" ", "pred", F.length("pred").cast("string"))
    words = F.array(*map(F.lit, ("the", "que", "der")))
    return pairs(spark, d).select("conv_id", "turn", metrics.numeric_score(answer, F.length("ref")).alias("numeric"), metrics.keyword_score(F.col("pred"), words).alias("keywords"))
