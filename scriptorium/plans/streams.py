"""Streaming jobs run to the end of what there is; results equal those of a batch."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..shared import folder
from ..streaming import jobs
from ._base import query, table
from .events import SUPPRESSED


def _stream(spark, d):
    # a pattern, for a source that is one file cannot be named as a folder
    return jobs.files(spark, f"{d}/event[s].parquet", table(spark, d, "events").schema)


def _result(spark, stream, mode="append"):
    base = folder(spark)
    jobs.to_table(stream, f"{base}/out", f"{base}/state", mode=mode)
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


@query("SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY day, event_type")
def stream_event_counters(spark, d):
    """STM01, STM04, AG28: windowed counters with a watermark."""
    out = _result(spark, jobs.daily_counts(_stream(spark, d)), "complete")
    return out.select(F.to_date("w.start").alias("day"), "event_type", "n", "total")


@query("SELECT event_id, user_id FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0)")
def stream_available(spark, d):
    """STM03: a stream against a table."""
    have = table(spark, d, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("user_id"))
    return _result(spark, jobs.available(_stream(spark, d).select("event_id", "user_id"), have, "user_id")).select("event_id", "user_id")


@query(SUPPRESSED)
def stream_hash_suppress(spark, d):
    """STM05, STM07: the state of each user is its last 20 hashes; equals event_hash_suppress."""
    h = F.conv(F.substring(F.md5("props"), 1, 8), 16, 10).cast("long")
    rows = _stream(spark, d).select("user_id", "event_id", h.alias("h"))
    return _result(spark, jobs.suppress_near(rows, "user_id", "event_id", "h")).select("user_id", "event_id")


@query("SELECT event_id, user_id FROM (SELECT event_id, user_id, sum(CAST(round(abs(value)) AS DOUBLE)) OVER (PARTITION BY user_id ORDER BY event_id) AS spent FROM events) WHERE spent <= 500")
def stream_budget(spark, d):
    """STM06: admission under a budget as state."""
    rows = _stream(spark, d).select("user_id", "event_id", F.round(F.abs("value")).alias("cost"))
    return _result(spark, jobs.admit(rows, "user_id", "event_id", "cost", 500.0)).select("event_id", "user_id")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def stream_drop_folder(spark, d):
    """STM02: a folder of dropped files, some for each batch, removed when done."""
    base = folder(spark)
    e = table(spark, d, "events").select("event_id", "event_type")
    e.repartition(4, "event_id").write.parquet(f"{base}/in")
    stream = jobs.files(spark, f"{base}/in", e.schema, per_batch=2, clean=True)
    jobs.to_table(stream, f"{base}/out", f"{base}/state")
    return spark.read.schema(e.schema).parquet(f"{base}/out").groupBy("event_type").agg(F.count("*").alias("n"))
