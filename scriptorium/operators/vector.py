"""Vector functions and nearest-neighbour joins over array columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def unit(v: Column, eps: float = 1e-8) -> Column:
    return F.transform(v, lambda x: x / (norm(v) + eps))


def stats(v: Column, sparse: float = 0.01) -> Column:
    """struct(l2, entropy, sparsity, kurtosis, mean, std, peak, mean_abs) of a vector: entropy of
    the absolute values over their sum, population moments, excess kurtosis."""
    n = F.size(v)
    mean = total(doubles(v)) / n
    mags = F.transform(v, lambda x: F.abs(x.cast("double")))
    mass = total(mags)
    second = total(F.transform(v, lambda x: F.pow(x.cast("double") - mean, 2))) / n
    fourth = total(F.transform(v, lambda x: F.pow(x.cast("double") - mean, 4))) / n
    entropy = total(F.transform(mags, lambda x: F.when(x > 0, -(x / mass) * F.ln(x / mass)).otherwise(0.0)))
    return F.struct(
        norm(v).alias("l2"), F.when(mass > 0, entropy).otherwise(0.0).alias("entropy"), (F.size(F.filter(mags, lambda x: x < sparse)) / n).alias("sparsity"),
        F.when(second > 0, fourth / (second * second) - 3).otherwise(0.0).alias("kurtosis"), mean.alias("mean"), F.sqrt(second).alias("std"), F.array_max(mags).alias("peak"), (mass / n).alias("mean_abs"),
    )


def top_k(queries: DataFrame, items: DataFrame, k: int, *, block_bytes: int = 1 << 24) -> DataFrame:
    """(query_id, item_id, score, rank): the k largest cosines of each query over all items.

    queries (query_id, v) is a stated set, taken in blocks: the items are read once for each
    block of queries, whose vectors are broadcast (``block_bytes`` at most, some 30,000
    queries of 64 numbers). Each task keeps k candidates of a query before anything is
    shuffled. Work is in Arrow batches, by matrix products of 512 queries and 512 items.
    Ties go to the lesser item_id."""
    import numpy as np
    import pandas as pd

    head = queries.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).first()
    n, block = head["n"], max(1, block_bytes // (8 * max(1, head["width"] or 1)))
    parts, out = -(-n // block) or 1, None
    for p in range(parts):
        own = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == p).orderBy("query_id").toPandas()
        if not len(own):
            continue
        q = np.array(own["v"].tolist(), np.float64)
        q /= np.linalg.norm(q, axis=1, keepdims=True) + 1e-8
        shared = queries.sparkSession.sparkContext.broadcast((own["query_id"].to_numpy(), q))

        def run(batches, shared=shared):
            ids, q = shared.value
            best_s, best_i = np.full((len(ids), k), -np.inf), np.full((len(ids), k), np.iinfo(np.int64).max)
            for pdf in batches:
                for s0 in range(0, len(pdf), 512):
                    own = pdf.iloc[s0 : s0 + 512]
                    v = np.array(own["v"].tolist(), np.float64)
                    v /= np.linalg.norm(v, axis=1, keepdims=True) + 1e-8
                    item = own["item_id"].to_numpy(np.int64)
                    for q0 in range(0, len(ids), 512):
                        here = slice(q0, q0 + 512)
                        s = np.concatenate([best_s[here], q[here] @ v.T], 1)
                        i = np.concatenate([best_i[here], np.broadcast_to(item, (len(s), len(item)))], 1)
                        order = np.lexsort((i, -np.round(s, 12)), axis=1)[:, :k]
                        best_s[here], best_i[here] = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)
            some = best_s > -np.inf
            yield pd.DataFrame({"query_id": np.repeat(ids, k)[some.reshape(-1)], "item_id": best_i[some], "score": best_s[some]})

        found = items.select("item_id", "v").mapInPandas(run, "query_id long, item_id long, score double")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return queries.sparkSession.createDataFrame([], "query_id long, item_id long, score double, rank int")
    from pyspark.sql import Window

    w = Window.partitionBy("query_id").orderBy(F.round("score", 12).desc(), "item_id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def resample(rows: DataFrame, frames: str, n_to: Column) -> DataFrame:
    """rows with ``frames`` (an array) resampled to n_to entries at evenly spaced places."""
    size = F.size(frames)
    return rows.withColumn(frames, F.transform(F.sequence(F.lit(0), n_to - 1), lambda i: F.element_at(frames, (F.floor(i * (size - 1) / F.greatest(n_to - 1, F.lit(1))) + 1).cast("int"))))
