"""Sinks: manifests, appends, fan-out, progress, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def manifests(df: DataFrame, path: str, split: str = "split") -> None:
    """JSON lines by split, in UTF-8."""
    df.write.mode("overwrite").partitionBy(split).json(path)


def append(df: DataFrame, path: str) -> None:
    """Rows appended; columns that are null throughout a row are not written by JSON."""
    df.write.mode("append").option("ignoreNullFields", True).json(path)


def fan_out(frames: DataFrame, key: str, path: str) -> dict[str, DataFrame]:
    """Source rows with derived counters, and their frames and detections, as three tables."""
    counts = frames.groupBy(key).agg(F.count("*").alias("frames"), F.count_if("has_text").alias("frames_with_text"))
    tables = {"sources": counts, "frames": frames.drop("detections"), "detections": frames.select(key, F.explode("detections").alias("d")).select(key, "d.*")}
    for name, t in tables.items():
        t.write.mode("append").parquet(f"{path}/{name}")
    return tables


def progress(events: DataFrame) -> DataFrame:
    """Counters of runs from their log: increments are summed, absolute values keep the latest."""
    return events.groupBy("run_id").agg(F.sum("increment").alias("total"), F.max_by("absolute", "at").alias("latest"), F.count("*").alias("events"))


def triples(df: DataFrame, subject: str, columns: list[str]) -> DataFrame:
    """(subject, predicate, object) rows of a table's columns that are not null."""
    each = F.array(*(F.struct(F.lit(c).alias("predicate"), F.col(c).cast("string").alias("object")) for c in columns))
    return df.select(F.col(subject).cast("string").alias("subject"), F.explode(each).alias("t")).select("subject", "t.*").where("object is not null")


def markdown(df: DataFrame, title: str, limit: int = 1000) -> str:
    """A small report table; more rows than ``limit`` are an error, not cut."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"a report has at most {limit} rows")
    lines = [f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join([*lines, *("| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows)]) + "\n"


def report(df: DataFrame, title: str, path: str, limit: int = 1000) -> None:
    """A small table as a report: JSON rows under ``json`` and a Markdown page under ``markdown``."""
    text = markdown(df, title, limit)
    df.coalesce(1).write.mode("overwrite").json(f"{path}/json")
    df.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/markdown")
