"""Incremental jobs on Structured Streaming.

Each job takes a streaming DataFrame and writes with a checkpoint, so a restarted
job goes on where it stopped and writes nothing twice.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def files(spark: SparkSession, path: str, schema, *, per_batch: int | None = None, clean: bool = False, kind: str = "parquet") -> DataFrame:
    """New files of a folder; ``per_batch`` bounds a batch, ``clean`` removes what is done."""
    reader = spark.readStream.schema(schema).format(kind)
    if per_batch:
        reader = reader.option("maxFilesPerTrigger", per_batch)
    if clean:
        reader = reader.option("cleanSource", "delete")
    return reader.load(path)


def drain(df: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, *, mode: str = "append", every: str | None = None):
    """Runs each(batch, number) over what there is, or every interval; returns the query."""
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(each)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    query = writer.start()
    if not every:
        query.awaitTermination()
    return query


def to_table(df: DataFrame, path: str, checkpoint: str, *, mode: str = "append") -> None:
    """The stream's rows as a Parquet table. Batches are written to folders by number, so one
    that is done again replaces itself; in complete mode the table is the last result."""

    def write(batch: DataFrame, number: int) -> None:
        target = path if mode == "complete" else f"{path}/batch={number}"
        batch.write.mode("overwrite").parquet(target)

    drain(df, write, checkpoint, mode=mode)


def daily_counts(events: DataFrame, *, late: str = "1 day") -> DataFrame:
    """Counts and sums by day and type, late rows accepted for ``late``."""
    at = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return at.groupBy(F.window("at", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def available(events: DataFrame, static: DataFrame, key: str) -> DataFrame:
    """Stream rows whose key is in a table."""
    return events.join(static.select(key).distinct(), key, "left_semi")


def suppress_near(rows: DataFrame, key: str, order: str, hash_: str, *, memory: int = 20, distance: int = 8) -> DataFrame:
    """Rows whose hash is further than ``distance`` bits from the last ``memory`` that passed, with
    those kept as the key's state. Rows of a batch are taken in ``order``."""

    def step(k, pdfs, state: GroupState):
        passed = list(state.get[0]) if state.exists else []
        frames = [p for p in pdfs if len(p)]
        if not frames:
            return
        pdf = pd.concat(frames).sort_values(order)
        keep = []
        for h in pdf[hash_]:
            h = int(h) & (2**64 - 1)
            fresh = all((h ^ (p & (2**64 - 1))).bit_count() > distance for p in passed)
            if fresh:
                passed = [*passed, h if h < 2**63 else h - 2**64][-memory:]
            keep.append(fresh)
        state.update((passed,))
        yield pdf[keep]

    return rows.groupBy(key).applyInPandasWithState(step, rows.schema, "passed array<long>", "append", GroupStateTimeout.NoTimeout)


def admit(rows: DataFrame, key: str, order: str, cost: str, budget: float) -> DataFrame:
    """Rows admitted while the key's summed cost stays within the budget; the sum is state."""

    def step(k, pdfs, state: GroupState):
        spent = state.get[0] if state.exists else 0.0
        frames = [p for p in pdfs if len(p)]
        if not frames:
            return
        pdf = pd.concat(frames).sort_values(order)
        total = spent + pdf[cost].cumsum()
        state.update((float(total.iloc[-1]),))
        yield pdf[(total <= budget).to_numpy()]

    return rows.groupBy(key).applyInPandasWithState(step, rows.schema, "spent double", "append", GroupStateTimeout.NoTimeout)
