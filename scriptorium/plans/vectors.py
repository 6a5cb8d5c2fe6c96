"""Queries over embeddings: statistics, profiles, nearest neighbours, contrastive loss."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import vector
from ._base import query, table


def vectors(spark, d):
    return table(spark, d, "embeddings")


V = "list_transform(embedding, lambda x: CAST(x AS DOUBLE))"
STATS = f"""SELECT vec_id, label, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS l2, list_sum(list_transform(v, lambda x: CASE WHEN x <> 0 THEN -(abs(x) / m) * ln(abs(x) / m) ELSE 0 END)) AS entropy,
  len(list_filter(v, lambda x: abs(x) < 0.01)) / len(v) AS sparsity, mu AS mean, sqrt(s2) AS std, list_sum(list_transform(v, lambda x: pow(x - mu, 4))) / len(v) / (s2 * s2) - 3 AS kurtosis, list_max(list_transform(v, lambda x: abs(x))) AS peak, m / len(v) AS mean_abs
  FROM (SELECT *, list_sum(list_transform(v, lambda x: pow(x - mu, 2))) / len(v) AS s2 FROM (SELECT vec_id, label, v, list_sum(v) / len(v) AS mu, list_sum(list_transform(v, lambda x: abs(x))) AS m FROM (SELECT vec_id, label, {V} AS v FROM embeddings)))"""
NAMES = ["l2", "entropy", "sparsity", "kurtosis", "mean", "std"]


def _stats(spark, d):
    return vectors(spark, d).select("vec_id", "label", vector.stats(F.col("embedding")).alias("s")).select("vec_id", "label", "s.*")


@query(STATS)
def vec_layer_stats(spark, d):
    """VEC01, VEC03."""
    return _stats(spark, d)


@query(f"SELECT label, {', '.join(f'round(avg({n}), 9) AS {n}' for n in NAMES)}, count(*) AS n FROM ({STATS}) GROUP BY label")
def vec_label_profile(spark, d):
    """AG07: mean statistics by label, taken as the layer."""
    return _stats(spark, d).groupBy("label").agg(*(F.round(F.avg(n), 9).alias(n) for n in NAMES), F.count("*").alias("n"))


@query(
    f"""WITH s AS ({STATS}), a AS (SELECT label, avg(l2) AS l2, avg(kurtosis) AS kurtosis FROM s WHERE vec_id % 2 = 0 GROUP BY label), b AS (SELECT label, avg(l2) AS l2, avg(kurtosis) AS kurtosis FROM s WHERE vec_id % 2 = 1 GROUP BY label)
  SELECT label, a.l2 - b.l2 AS delta_l2, a.kurtosis - b.kurtosis AS delta_kurtosis FROM a JOIN b USING (label) ORDER BY round(abs(delta_kurtosis), 9) DESC, label LIMIT 5"""
)
def vec_profile_delta(spark, d):
    """JN12: deltas of two profile sets, the five largest."""
    means = [F.avg("l2").alias("l2"), F.avg("kurtosis").alias("kurtosis")]
    s = _stats(spark, d)
    a, b = (s.where(F.col("vec_id") % 2 == k).groupBy("label").agg(*means).alias("ab"[k]) for k in (0, 1))
    j = a.join(b, "label").select("label", (F.col("a.l2") - F.col("b.l2")).alias("delta_l2"), (F.col("a.kurtosis") - F.col("b.kurtosis")).alias("delta_kurtosis"))
    return j.orderBy(F.round(F.abs("delta_kurtosis"), 9).desc(), "label").limit(5)


@query(f"SELECT vec_id, label, list_sum(list_transform(v, lambda x: pow(x / (n + 1e-8), 2))) AS squared FROM (SELECT vec_id, label, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM (SELECT vec_id, label, {V} AS v FROM embeddings))")
def vec_normalized(spark, d):
    """VEC04."""
    return vectors(spark, d).select("vec_id", "label", vector.total(F.transform(vector.unit(vector.doubles(F.col("embedding"))), lambda x: x * x)).alias("squared"))


COSINE = f"""WITH e AS (SELECT vec_id, label, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) + 1e-8 AS n FROM (SELECT vec_id, label, {V} AS v FROM embeddings)),
  s AS (SELECT q.vec_id AS query_id, i.vec_id AS item_id, q.label AS ql, i.label AS il, list_dot_product(q.v, i.v) / (q.n * i.n) AS score FROM e q, e i WHERE q.vec_id % 50 = 0),
  r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, item_id) AS rank FROM s)"""


def _top(spark, d, k):
    v = vectors(spark, d).select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("v"))
    return vector.top_k(v.where("item_id % 50 = 0").select(F.col("item_id").alias("query_id"), "v"), v, k)


@query(f"{COSINE} SELECT query_id, item_id, score, CAST(rank AS BIGINT) AS rank FROM r WHERE rank <= 10")
def vec_topk_cosine(spark, d):
    """JN14, JN18: every fiftieth vector against all."""
    return _top(spark, d, 10).select("query_id", "item_id", "score", F.col("rank").cast("long"))


@query(f"{COSINE}, f AS (SELECT query_id, min(rank) FILTER (il = ql AND item_id <> query_id) AS first FROM r WHERE rank <= 11 GROUP BY query_id) SELECT avg(CAST(coalesce(first, 99) <= 2 AS INT)) AS at_1, avg(CAST(coalesce(first, 99) <= 6 AS INT)) AS at_5, avg(CAST(coalesce(first, 99) <= 11 AS INT)) AS at_10, count(*) AS n FROM f")
def vec_recall_at_k(spark, d):
    """VEC06: a neighbour of the same label among the first 1, 5, 10 others."""
    labels = vectors(spark, d).select("vec_id", "label")
    t = _top(spark, d, 11).join(labels.withColumnsRenamed({"vec_id": "query_id", "label": "ql"}), "query_id").join(labels.withColumnsRenamed({"vec_id": "item_id", "label": "il"}), "item_id")
    f = t.groupBy("query_id").agg(F.min(F.when((F.col("il") == F.col("ql")) & (F.col("item_id") != F.col("query_id")), F.col("rank"))).alias("first"))
    hit = lambda k: F.avg((F.coalesce("first", F.lit(99)) <= k + 1).cast("int"))
    return f.agg(hit(1).alias("at_1"), hit(5).alias("at_5"), hit(10).alias("at_10"), F.count("*").alias("n"))


MEANS = f"WITH m AS (SELECT label, list(mu ORDER BY i) AS v FROM (SELECT label, i, avg(x) AS mu FROM (SELECT label, unnest({V}) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i) GROUP BY label), n AS (SELECT label, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) + 1e-8 AS n FROM m)"


def _means(spark, d):
    x = vectors(spark, d).select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("mu"))
    return x.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "mu"))), lambda s: s["mu"]).alias("v"))


@query(f"{MEANS} SELECT label, len(v) AS size, round(list_sum(v), 9) AS total FROM m")
def vec_label_means(spark, d):
    """TOK05: mean vectors, by exploded places with map-side combining."""
    return _means(spark, d).select("label", F.size("v").cast("long").alias("size"), F.round(vector.total(F.col("v")), 9).alias("total"))


@query(f"{MEANS}, e AS (SELECT vec_id, label, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) + 1e-8 AS n FROM (SELECT vec_id, label, {V} AS v FROM embeddings)), l AS (SELECT vec_id, e.label = n.label AS own, list_dot_product(e.v, n.v) / (e.n * n.n) / 0.07 AS z FROM e, n) SELECT avg(total - own) AS loss, count(*) AS n FROM (SELECT vec_id, ln(sum(exp(z))) AS total, sum(z) FILTER (own) AS own FROM l GROUP BY vec_id)")
def vec_infonce(spark, d):
    """VEC05: cross-entropy of vectors against the codebook of label means."""
    means = _means(spark, d).select(F.col("label").alias("code"), vector.unit(F.col("v")).alias("c"))
    codes = means.agg(F.collect_list(F.struct("code", "c")).alias("codes"))  # a row for each label
    e = vectors(spark, d).select("label", vector.unit(vector.doubles(F.col("embedding"))).alias("v")).crossJoin(F.broadcast(codes))
    z = F.transform("codes", lambda s: F.struct((s["code"] == F.col("label")).alias("own"), (vector.dot(F.col("v"), s["c"]) / 0.07).alias("z")))
    total = F.ln(vector.total(F.transform(z, lambda s: F.exp(s["z"]))))
    own = vector.total(F.transform(F.filter(z, lambda s: s["own"]), lambda s: s["z"]))
    return e.agg(F.avg(total - own).alias("loss"), F.count("*").alias("n"))


@query(f"SELECT vec_id, list_sum(list_transform(range(0, 16), lambda i: v[CAST(floor(i * 63 / 15) AS BIGINT) + 1])) AS fused FROM (SELECT vec_id, {V} AS v FROM embeddings)")
def vec_resample(spark, d):
    """JN15: evenly spaced places of a sequence."""
    r = vector.resample(vectors(spark, d).select("vec_id", vector.doubles(F.col("embedding")).alias("v")), "v", F.lit(16))
    return r.select("vec_id", vector.total(F.col("v")).alias("fused"))


@query(f"SELECT label, CAST(least(floor(abs(x) * 64), 8191) AS BIGINT) AS bin, count(*) AS n FROM (SELECT label, unnest({V}) AS x FROM embeddings) GROUP BY label, bin")
def vec_histogram(spark, d):
    """VEC02: histogram of absolute values."""
    x = vectors(spark, d).select("label", F.explode(vector.doubles(F.col("embedding"))).alias("x"))
    return x.groupBy("label", F.least(F.floor(F.abs("x") * 64), F.lit(8191)).alias("bin")).agg(F.count("*").alias("n"))
