"""Deduplication operators that keep the source's order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import saved


def first_wins(df: DataFrame, key: Column, order: str) -> DataFrame:
    """Of the rows with one key the first in order. An aggregation with map-side
    combining, so a key with a third of all rows is no hot window. Rows are chosen
    by the key's digest and the order's value; both are narrow. Rows that tie on both all stay."""
    marked = df.withColumn("__k", F.sha2(F.coalesce(key.cast("string"), F.lit("\x00")), 256))
    first = marked.groupBy("__k").agg(F.min(order).alias("__first"))
    return marked.join(first, (marked["__k"] == first["__k"]) & marked[order].eqNullSafe(first["__first"]), "left_semi").drop("__k")


def char_set(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.split(text, ""), lambda c: c != "")))


def greedy_clusters(df: DataFrame, text: str, order: str, threshold: float = 0.85) -> DataFrame:
    """(text, seed): greedy clusters by the Jaccard similarity of character sets, each text
    compared with seeds only, in first-seen order.

    Texts of equal character sets fall together and are grouped first. Similar sets meet
    by a prefix of their characters in order of rarity (the prefix filter of set joins)
    under a size band. Greedy seeds are the first maximal independent set in order, found
    in parallel rounds: a set is a seed once no earlier neighbour may still be one."""
    rows = df.select(F.col(text).alias("text"), F.col(order).alias("ord")).where(F.length(text) > 0).withColumn("chars", char_set(F.col("text")))
    sets = rows.groupBy("chars").agg(F.min(F.struct("ord", "text")).alias("f")).select("chars", F.col("f.ord").alias("ord"), F.size("chars").alias("n"))
    sets = saved(sets)
    rarity = sets.select(F.explode("chars").alias("c")).groupBy("c").agg(F.count("*").alias("df"))
    ranked = sets.select("ord", "n", F.explode("chars").alias("c")).join(rarity, "c")
    ordered = ranked.groupBy("ord", "n").agg(F.array_sort(F.collect_list(F.struct("df", "c"))).alias("s"))
    keep = (F.col("n") - F.ceil(F.col("n") * threshold) + 1).cast("int")
    prefix = ordered.select("ord", "n", F.explode(F.slice("s", 1, keep)).alias("p")).select("ord", "n", F.col("p.c").alias("c"))
    a, b = prefix.alias("a"), prefix.alias("b")
    band = (F.col("a.ord") < F.col("b.ord")) & (F.least("a.n", "b.n") >= threshold * F.greatest("a.n", "b.n"))
    near = a.join(b, (F.col("a.c") == F.col("b.c")) & band).select(F.col("a.ord").alias("i"), F.col("b.ord").alias("j")).distinct()
    own = sets.select("ord", "chars")
    near = near.join(own.withColumnsRenamed({"ord": "i", "chars": "x"}), "i").join(own.withColumnsRenamed({"ord": "j", "chars": "y"}), "j")
    edges = saved(near.where(F.size(F.array_intersect("x", "y")) / F.size(F.array_union("x", "y")) >= threshold).select("i", "j"))
    state = saved(sets.select("ord", F.lit(None).cast("long").alias("seed")))
    while True:  # each round settles the first open set in order at least
        open_ = state.where("seed is null").select("ord")
        if not open_.limit(1).count():
            break
        seeds = state.where("seed = ord").select(F.col("ord").alias("i"))
        joined = edges.join(seeds, "i").groupBy("j").agg(F.min("i").alias("least"))
        blocked = edges.join(open_.withColumnRenamed("ord", "i"), "i").groupBy("j").agg(F.min("i").alias("wait"))
        new = state.join(joined, state["ord"] == joined["j"], "left").drop("j").join(blocked, state["ord"] == blocked["j"], "left").drop("j")
        # taken once its least seed is before every open neighbour; a seed if nothing earlier is open or a seed
        taken = F.when(F.col("least").isNotNull() & (F.col("wait").isNull() | (F.col("least") < F.col("wait"))), F.col("least"))
        alone = F.when(F.col("least").isNull() & F.col("wait").isNull(), F.col("ord"))
        state = saved(new.select("ord", F.coalesce("seed", taken, alone).alias("seed")))
    seeds = sets.select("ord", "chars").join(state, "ord")
    return rows.join(seeds.select("chars", "seed"), "chars").select("text", "ord", "seed")
