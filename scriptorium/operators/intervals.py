"""Interval joins, gaps and islands, and path-dependent merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def points_in(points: DataFrame, spans: DataFrame, key: str, at: str, start: str, end: str, width: int) -> DataFrame:
    """points joined with the spans of their key that hold them (start <= at < end).

    An equi-join on (key, bucket of ``width``): spans are put into each bucket they touch,
    points into one, and the true condition is checked after; no nested loop."""
    p = points.withColumn("__b", F.floor(F.col(at) / width))
    s = spans.withColumn("__b", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))
    return p.join(s, [key, "__b"]).where((F.col(start) <= F.col(at)) & (F.col(at) < F.col(end))).drop("__b")


def best_overlap(left: DataFrame, right: DataFrame, key: str, a: tuple[str, str], b: tuple[str, str], left_id: str, right_id: str, width: int) -> DataFrame:
    """Each left interval with the right one it overlaps most (the first of equal ones), by
    buckets as in points_in(); a pair that shares several buckets counts in its first."""
    l_ = left.withColumn("__b", F.explode(F.sequence(F.floor(F.col(a[0]) / width), F.floor(F.col(a[1]) / width))))
    r = right.withColumn("__b", F.explode(F.sequence(F.floor(F.col(b[0]) / width), F.floor(F.col(b[1]) / width))))
    first = F.col("__b") == F.floor(F.greatest(a[0], b[0]) / width)
    met = l_.join(r, [key, "__b"]).where(first & (F.col(a[0]) < F.col(b[1])) & (F.col(b[0]) < F.col(a[1])))
    overlap = F.least(a[1], b[1]) - F.greatest(a[0], b[0])
    best = met.groupBy(key, left_id, *a).agg(F.max_by(F.struct(right_id, overlap.alias("overlap")), F.struct(overlap, -F.col(right_id))).alias("m"))
    return best.select(key, left_id, F.col(f"m.{right_id}").alias(right_id), F.col("m.overlap").alias("overlap"), (F.col("m.overlap") / (F.col(a[1]) - F.col(a[0]))).alias("confidence"))


def islands(df: DataFrame, key: str, order: list[str], new: Column, out: str) -> DataFrame:
    """df with the number of the island a row belongs to: ``new`` says that a row begins one
    (it may use F.lag over the window of key and order, given as ``w``)."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn(out, F.sum(F.when(new, 1).otherwise(0)).over(w))


def merge_capped(df: DataFrame, key: str, start: str, end: str, pad: float = 0.3, gap: float = 0.5, cap: float = 15.0, least: float = 2.0) -> DataFrame:
    """Speech segments of each key: padded, merged while the gap is under ``gap`` and the whole
    at most ``cap`` long, shorter than ``least`` dropped, longer than ``cap`` split evenly.

    The cap makes merging path-dependent. Rows are sorted by key and start and streamed, so
    memory is one segment and no key is gathered."""
    import math

    import pandas as pd

    rows = df.select(F.col(key).alias("key"), F.col(start).cast("double").alias("s"), F.col(end).cast("double").alias("e"))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def finish(key_, s, e):
        if e - s < least:
            return
        parts = max(1, math.ceil((e - s) / cap - 1e-9))
        step = (e - s) / parts
        for i in range(parts):
            yield key_, s + i * step, s + (i + 1) * step

    def run(batches):
        now = None
        for pdf in batches:
            out = []
            for k, s, e in zip(pdf["key"], pdf["s"], pdf["e"], strict=True):
                s, e = max(0.0, s - pad), e + pad
                if now and now[0] == k and s - now[2] < gap and max(e, now[2]) - now[1] <= cap:
                    now = (k, now[1], max(e, now[2]))
                else:
                    if now:
                        out.extend(finish(*now))
                    now = (k, s, e)
            yield pd.DataFrame(out, columns=["key", "s", "e"])
        if now:
            yield pd.DataFrame(list(finish(*now)), columns=["key", "s", "e"])

    kind = dict(df.dtypes)[key]
    return rows.repartition(n, "key").sortWithinPartitions("key", "s", "e").mapInPandas(run, f"key {kind}, s double, e double")


def suppress_near(df: DataFrame, key: str, order: str, hash_: str, memory: int = 20, distance: int = 8) -> DataFrame:
    """Rows whose 64-bit hash is further than ``distance`` bits from the last ``memory`` hashes that
    passed, by key in order. Path-dependent, so sorted rows are streamed with that much state."""
    from collections import deque

    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        now, passed = None, deque(maxlen=memory)
        for pdf in batches:
            keep = []
            for k, h in zip(pdf[key], pdf[hash_], strict=True):
                if k != now:
                    now, passed = k, deque(maxlen=memory)
                h = int(h) & (2**64 - 1)
                fresh = all((h ^ p).bit_count() > distance for p in passed)
                if fresh:
                    passed.append(h)
                keep.append(fresh)
            yield pdf[keep]

    return df.repartition(n, key).sortWithinPartitions(key, order).mapInPandas(run, df.schema)
