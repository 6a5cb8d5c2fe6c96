"""Reproducible samples and splits: random order is the order of a hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import saved


def hash_order(key: str) -> Column:
    return F.md5(F.col(key).cast("string"))


def stratified(df: DataFrame, stratum: str, targets: dict[str, float], n: int, key: str) -> DataFrame:
    """n rows: int(n * share) of each stratum, what is missing filled from the other rows.

    Each pass takes the least hashes of a stratum; a window with a row_number limit
    is pruned before its shuffle, so no stratum is gathered whole."""
    h = hash_order(key)
    quota = F.create_map(*[F.lit(x) for k, s in targets.items() for x in (k, int(n * s))])
    w = Window.partitionBy(stratum).orderBy(h, key)
    top = max(int(n * s) for s in targets.values())
    ranked = df.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n)
    chosen = ranked.where((F.col("__r") <= top) & (F.col("__r") <= F.try_element_at(quota, F.col(stratum)))).drop("__r")
    short = n - chosen.count()
    rest = df.join(chosen.select(key), key, "left_anti").orderBy(h, key).limit(max(short, 0))
    return chosen.unionByName(rest.select(*chosen.columns))


def split(df: DataFrame, key: str, shares: list[tuple[str, float]]) -> DataFrame:
    """df with ``split``: a row's place in (0, 1) is its hash, so splits are stable as rows come and go."""
    place = F.conv(F.substring(hash_order(key), 1, 8), 16, 10).cast("double") / 2**32
    out, edge = None, 0.0
    for name, share in shares[:-1]:
        edge += share
        out = F.when(place < edge, name) if out is None else out.when(place < edge, name)
    return df.withColumn("split", out.otherwise(shares[-1][0]))


def per_group(df: DataFrame, group: str, n: int, key: str) -> DataFrame:
    """At most n rows of each group, by least hash."""
    w = Window.partitionBy(group).orderBy(hash_order(key), key)
    return df.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n).drop("__r")


def next_in_ring(df: DataFrame, key: str, n: int) -> DataFrame:
    """(key, other): for each row the next n rows in the order of a hash, the first ones
    after the last; distinct keys. Rows get their numbers by ranges, with the totals of the
    ranges before added, and meet by number: nothing is crossed or gathered."""
    rows = saved(df.select(key).distinct().withColumn("__h", hash_order(key)).repartitionByRange("__h", key).withColumn("__p", F.spark_partition_id()))
    before, total = [], 0
    for r in sorted(rows.groupBy("__p").agg(F.count("*").alias("n")).collect()):  # a row for each partition
        before.append((r[0], total))
        total += r["n"]
    offsets = F.broadcast(df.sparkSession.createDataFrame(before, "__p int, __b long"))
    own = F.row_number().over(Window.partitionBy("__p").orderBy("__h", key)) - 1
    numbered = saved(rows.withColumn("__o", own).join(offsets, "__p").select(key, (F.col("__o") + F.col("__b")).alias("__r")))
    steps = F.explode(F.sequence(F.lit(1), F.lit(n)))
    asked = numbered.select(F.col(key), steps.alias("__s"), "__r").select(key, F.pmod(F.col("__r") + F.col("__s"), F.lit(max(total, 1))).alias("__r"))
    return asked.join(numbered.withColumnRenamed(key, "other"), "__r").where(F.col("other") != F.col(key)).select(key, "other").distinct()
