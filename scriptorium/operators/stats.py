"""Statistics of paired samples, as one aggregation each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import saved


def normal_tail(z: Column) -> Column:
    """Two-sided p of a normal z: a rational approximation of the error function
    (absolute error under 1.5e-7; fixed values of its coefficients)."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return poly * F.exp(-x * x)


def paired(df: DataFrame, a: str, b: str) -> DataFrame:
    """n, pearson, mean difference, t (standard error 1e-10 for no variance), p (normal), signs."""
    d = F.col(a) - F.col(b)
    out = df.agg(
        F.count("*").alias("n"), F.corr(a, b).alias("pearson"), F.avg(d).alias("mean_diff"), F.stddev_samp(d).alias("__sd"),
        F.count_if(d > 0).alias("wins"), F.count_if(d < 0).alias("losses"), F.count_if(d == 0).alias("ties"),
    )
    se = F.when(F.col("__sd") > 0, F.col("__sd") / F.sqrt("n")).otherwise(F.lit(1e-10))
    return out.withColumn("t", F.col("mean_diff") / se).withColumn("p", normal_tail(F.col("t"))).drop("__sd")


def average_rank(df: DataFrame, column: str, out: str) -> DataFrame:
    """df with the average rank of a column. Values are counted first and the counts
    accumulated over values, so no window holds all rows; ranges of values run in
    parallel with the totals of the ranges before added."""
    counts = df.groupBy(column).agg(F.count("*").alias("__n"))
    ranges = counts.repartitionByRange(column).withColumn("__p", F.spark_partition_id())
    ranges = saved(ranges)
    totals = ranges.groupBy("__p").agg(F.sum("__n").alias("__t"))  # a row for each partition
    before = totals.withColumn("__b", F.coalesce(F.sum("__t").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__t")
    run = F.sum("__n").over(Window.partitionBy("__p").orderBy(column).rowsBetween(Window.unboundedPreceding, -1))
    ranked = ranges.withColumn("__r", F.coalesce(run, F.lit(0))).join(F.broadcast(before), "__p")
    rank = F.col("__b") + F.col("__r") + (F.col("__n") + 1) / 2
    return df.join(ranked.select(F.col(column).alias("__v"), rank.alias(out)), df[column].eqNullSafe(F.col("__v"))).drop("__v")


def at_places(df: DataFrame, group: str, value: str, places: DataFrame) -> DataFrame:
    """(group, place, value): the values at places (group, place; from 0) of each group's
    ascending order, places being few. Values are counted, the counts go to ranges of
    (group, value), and what a range holds of a group is accumulated there, after the totals
    of the ranges before; so a group of any size is spread over ranges."""
    counts = df.groupBy(group, value).agg(F.count("*").alias("__n"))
    ranges = saved(counts.repartitionByRange(group, value).withColumn("__p", F.spark_partition_id()))
    totals = ranges.groupBy(group, "__p").agg(F.sum("__n").alias("__t"))  # a row for each group and range
    before = totals.withColumn("__b", F.coalesce(F.sum("__t").over(Window.partitionBy(group).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__t")
    run = F.sum("__n").over(Window.partitionBy("__p", group).orderBy(value))
    placed = ranges.withColumn("__r", run).join(F.broadcast(before), [group, "__p"]).withColumn("__to", F.col("__b") + F.col("__r"))
    met = placed.join(F.broadcast(places), group)
    return met.where((F.col("place") < F.col("__to")) & (F.col("place") >= F.col("__to") - F.col("__n"))).select(group, "place", value)


#: Cumulative probabilities of a Poisson count of mean 1. Fixed values.
POISSON = (0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582)


def bootstrap(df: DataFrame, value: str, groups: list[str], key: str, times: int = 200, seed: int = 7) -> DataFrame:
    """Confidence interval (2.5 and 97.5 %) of a mean by the Poisson bootstrap: each row
    counts k times in each replicate, k from a hash of the row's key and the replicate, so
    replicates are sums that combine on the map side; rows are never resampled in one place."""
    u = F.conv(F.substring(F.md5(F.concat_ws("-", F.lit(str(seed)), F.col(key).cast("string"), F.col("__b").cast("string"))), 1, 8), 16, 10).cast("double") / 2**32
    k = None
    for n, edge in enumerate(POISSON):
        k = F.when(u < edge, n) if k is None else k.when(u < edge, n)
    each = df.withColumn("__b", F.explode(F.sequence(F.lit(1), F.lit(times)))).withColumn("__k", k.otherwise(len(POISSON)))
    means = each.groupBy(*groups, "__b").agg((F.sum(F.col(value) * F.col("__k")) / F.sum("__k")).alias("m"))
    return means.groupBy(*groups).agg(F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high"))
