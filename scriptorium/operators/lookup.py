"""Lookup joins: tiers of keys, last-wins builds, upserts, paging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def last_wins(df: DataFrame, key: str, order: str) -> DataFrame:
    """Of rows with one key the last in order, by an aggregation."""
    others = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*others), order).alias("__m")).select(key, *(F.col(f"__m.{c}").alias(c) for c in others))


def tiered(df: DataFrame, dim: DataFrame, tiers: list[tuple[str, Column, Column]], value: str) -> DataFrame:
    """df with ``value`` and ``tier``: the first tier (name, key of df, key of dim) that finds one.

    All tiers go through one equi-join: a row has a key for each tier, and the least tier
    found wins. Keys of dim are made unique first (the first value in order)."""
    keyed = None
    for i, (name, _, key) in enumerate(tiers):
        part = dim.groupBy(F.concat(F.lit(f"{i}:"), key).alias("__k")).agg(F.min(value).alias("__v")).withColumn("__t", F.lit(name)).withColumn("__i", F.lit(i))
        keyed = part if keyed is None else keyed.unionByName(part)
    ids = F.array(*(F.concat(F.lit(f"{i}:"), key) for i, (_, key, _) in enumerate(tiers)))
    rows = df.withColumns({"__id": F.xxhash64(F.struct(*df.columns)), "__id2": F.xxhash64(F.lit(2), F.struct(*df.columns))})
    found = rows.select("__id", "__id2", F.explode(ids).alias("__k")).join(keyed, "__k").groupBy("__id", "__id2").agg(F.min_by(F.struct("__v", "__t"), "__i").alias("__m"))
    return rows.join(found, ["__id", "__id2"], "left").select(*df.columns, F.col("__m.__v").alias(value), F.coalesce("__m.__t", F.lit("none")).alias("tier"))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New values over old ones by key; nulls of new rows leave old values; new keys are added."""
    values = [c for c in old.columns if c != key]
    o, n = old.alias("o"), new.alias("n")
    joined = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full")
    return joined.select(F.coalesce(f"n.{key}", f"o.{key}").alias(key), *(F.coalesce(f"n.{c}", f"o.{c}").alias(c) if c in new.columns else F.col(f"o.{c}") for c in values))


def page(df: DataFrame, order: list, number: int, size: int) -> DataFrame:
    """A page of rows, the number clamped to the pages there are."""
    pages = max(1, -(-df.count() // size))
    number = min(max(1, number), pages)
    return df.orderBy(*order).offset((number - 1) * size).limit(size)
