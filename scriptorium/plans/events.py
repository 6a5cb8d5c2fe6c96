"""Queries over events: counters, budgets, intervals, islands, statistics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import intervals, stats
from ._base import query, table


def events(spark, d):
    return table(spark, d, "events")


SECONDS = "CAST(floor(epoch(ts)) AS BIGINT)"


def seconds():
    return F.unix_timestamp(F.col("ts").cast("timestamp"))


@query("SELECT CAST(ts AS DATE) AS day, count(*) AS n, count(*) FILTER (event_type = 'error') AS failed, round(sum(value), 4) AS cost, round(sum(value) / count(*), 6) AS mean_cost FROM events GROUP BY day")
def event_daily_counters(spark, d):
    """AG19, AG29, AG30."""
    v = F.sum("value")
    return events(spark, d).groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("failed"), F.round(v, 4).alias("cost"), F.round(v / F.count("*"), 6).alias("mean_cost"))


@query("SELECT CAST(ts AS DATE) AS day, count(*) AS n, round(sum(value), 4) AS cost FROM events GROUP BY day ORDER BY day DESC LIMIT 7")
def event_latest_days(spark, d):
    """TK07."""
    return events(spark, d).groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("cost")).orderBy(F.desc("day")).limit(7)


@query("SELECT event_id FROM (SELECT event_id, sum(CAST(round(greatest(value, 0) * 100) AS BIGINT)) OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS spent FROM events) WHERE spent <= 10000")
def event_budget_admission(spark, d):
    """STM06: a daily budget for each user, in cents."""
    w = Window.partitionBy("user_id", F.to_date("ts")).orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    cents = F.round(F.greatest("value", F.lit(0.0)) * 100).cast("long")
    return events(spark, d).select("event_id", F.sum(cents).over(w).alias("spent")).where("spent <= 10000").select("event_id")


@query("SELECT event_type, origin, CAST(grouping(event_type) AS BIGINT) AS g, count(*) AS n FROM (SELECT event_type, CAST(user_id % 5 AS BIGINT) AS origin FROM events) GROUP BY GROUPING SETS ((event_type), (origin))")
def event_status_grouping_sets(spark, d):
    """AG18."""
    e = events(spark, d).select("event_type", F.pmod("user_id", F.lit(5)).cast("long").alias("origin"))
    sets = e.groupingSets([[F.col("event_type")], [F.col("origin")]], F.col("event_type"), F.col("origin"))
    return sets.agg(F.grouping("event_type").cast("long").alias("g"), F.count("*").alias("n"))


@query(f"""SELECT user_id, CAST(island AS BIGINT) AS island, count(*) AS n, min(s) AS start, max(s) AS stop, round(min(value), 6) AS confidence FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY s, event_id) AS island FROM (SELECT *, CASE WHEN event_type = lag(event_type) OVER w AND s - lag(s) OVER w < 86400 THEN 0 ELSE 1 END AS fresh FROM (SELECT event_id, user_id, event_type, value, {SECONDS} AS s FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY s, event_id))) GROUP BY user_id, island""")
def event_merge_turns(spark, d):
    """WN05, AG26: consecutive events of one type, not a day apart, of a user."""
    e = events(spark, d).select("event_id", "user_id", "event_type", "value", seconds().alias("s"))
    w = Window.partitionBy("user_id").orderBy("s", "event_id")
    fresh = ~((F.col("event_type") == F.lag("event_type").over(w)) & (F.col("s") - F.lag("s").over(w) < 86400))
    marked = e.withColumn("fresh", F.coalesce(fresh, F.lit(True)))
    out = intervals.islands(marked, "user_id", ["s", "event_id"], F.col("fresh"), "island")
    return out.groupBy("user_id", "island").agg(F.count("*").alias("n"), F.min("s").alias("start"), F.max("s").alias("stop"), F.round(F.min("value"), 6).alias("confidence"))


SPANS = f"SELECT user_id, event_id AS span_id, {SECONDS} AS start, {SECONDS} + 36000 AS stop FROM events WHERE event_type = 'purchase'"


def spans(spark, d):
    return events(spark, d).where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("span_id"), seconds().alias("start"), (seconds() + 36000).alias("stop"))


@query(f"""WITH s AS ({SPANS}), j AS (SELECT e.event_id, s.span_id, {SECONDS} AS moment, row_number() OVER (PARTITION BY e.event_id ORDER BY s.start, s.span_id) AS r FROM events e JOIN s ON e.user_id = s.user_id AND s.start <= {SECONDS} AND {SECONDS} < s.stop WHERE event_type = 'view'),
  f AS (SELECT * FROM j WHERE r = 1) SELECT span_id, max(moment) AS last_at, count(*) AS frames FROM f GROUP BY span_id""")
def event_point_in_interval(spark, d):
    """JN06: the first interval of each point, the last point of each interval."""
    p = events(spark, d).where("event_type = 'view'").select("user_id", "event_id", seconds().alias("at"))
    j = intervals.points_in(p, spans(spark, d), "user_id", "at", "start", "stop", 36000)
    first = j.groupBy("event_id", "at").agg(F.min(F.struct("start", "span_id")).alias("s"))
    return first.groupBy(F.col("s.span_id").alias("span_id")).agg(F.max("at").alias("last_at"), F.count("*").alias("frames"))


@query(f"""WITH s AS ({SPANS}), l AS (SELECT user_id, event_id, {SECONDS} AS a, {SECONDS} + 7200 AS b FROM events WHERE event_type = 'click'),
  j AS (SELECT l.user_id, event_id, span_id, least(b, stop) - greatest(a, start) AS overlap, (least(b, stop) - greatest(a, start)) / (b - a) AS confidence, row_number() OVER (PARTITION BY event_id ORDER BY least(b, stop) - greatest(a, start) DESC, span_id) AS r FROM l JOIN s ON l.user_id = s.user_id AND a < stop AND start < b)
  SELECT user_id, event_id, span_id, overlap, confidence FROM j WHERE r = 1""")
def event_max_overlap(spark, d):
    """JN07."""
    left = events(spark, d).where("event_type = 'click'").select("user_id", "event_id", seconds().alias("a"), (seconds() + 7200).alias("b"))
    return intervals.best_overlap(left, spans(spark, d), "user_id", ("a", "b"), ("start", "stop"), "event_id", "span_id", 36000)


_OPEN = "STRUCT(s DOUBLE, e DOUBLE)[]"
_HASH = "CAST('0x' || substr(md5(props), 1, 8) AS BIGINT)"
#: Near-duplicate suppression as a fold over a user's rows in order: the last 20 hashes that passed, and the rows that did.
SUPPRESSED = f"""SELECT user_id, unnest(s.k) AS event_id FROM (SELECT user_id, list_reduce(a, lambda s, x: CASE WHEN len(list_filter(s.p, lambda q: bit_count(xor(q, x.h)) <= 8)) = 0
    THEN {{'p': list_append(s.p, x.h)[-20:], 'k': list_append(s.k, x.i)}} ELSE s END, {{'p': []::BIGINT[], 'k': []::BIGINT[]}}) AS s
  FROM (SELECT user_id, list({{'h': {_HASH}, 'i': event_id}} ORDER BY event_id) AS a FROM events GROUP BY user_id))"""


@query(
    f"""WITH r AS (SELECT user_id, CAST({SECONDS} % 86400 AS DOUBLE) AS s, abs(value) % 20 AS w FROM events), a AS (SELECT user_id, list({{'s': greatest(0.0::DOUBLE, s - 0.3::DOUBLE), 'e': s + w + 0.3::DOUBLE}} ORDER BY s, s + w) AS a FROM r GROUP BY user_id),
  m AS (SELECT user_id, list_reduce(a[2:], lambda c, x: CASE WHEN x.s - c.e < 0.5::DOUBLE AND greatest(x.e, c.e) - c.s <= 15 THEN {{'o': c.o, 's': c.s, 'e': greatest(x.e, c.e)}} ELSE {{'o': list_append(c.o, {{'s': c.s, 'e': c.e}}), 's': x.s, 'e': x.e}} END,
    {{'o': []::{_OPEN}, 's': a[1].s, 'e': a[1].e}}) AS c FROM a),
  g AS (SELECT user_id, unnest(list_append(c.o, {{'s': c.s, 'e': c.e}})) AS g FROM m), n AS (SELECT user_id, g.s AS s, g.e AS e, greatest(1, CAST(ceil((g.e - g.s) / 15.0::DOUBLE - 1e-9::DOUBLE) AS BIGINT)) AS n FROM g WHERE g.e - g.s >= 2)
  SELECT user_id AS key, s + i * ((e - s) / n) AS s, s + (i + 1) * ((e - s) / n) AS e FROM (SELECT *, unnest(range(n)) AS i FROM n)"""
)
def event_segments_capped(spark, d):
    """WN04: segments with padding, gaps, a cap and even splits."""
    e = events(spark, d).select("user_id", (seconds() % 86400).alias("s"), F.abs("value").alias("v"))
    return intervals.merge_capped(e.withColumn("e", F.col("s") + F.col("v") % 20), "user_id", "s", "e")


@query(SUPPRESSED)
def event_hash_suppress(spark, d):
    """WN06, FEA09: near-duplicate suppression over a 64-bit hash of the properties."""
    h = F.conv(F.substring(F.md5("props"), 1, 8), 16, 10).cast("long")
    e = events(spark, d).select("user_id", "event_id", h.alias("h"))
    return intervals.suppress_near(e, "user_id", "event_id", "h").select("user_id", "event_id")


@query("SELECT user_id, array_agg(event_type ORDER BY ts, event_id) FILTER (event_type <> 'view') AS kept FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE before IS NULL OR before <> event_type GROUP BY user_id HAVING count(*) FILTER (event_type <> 'view') > 0")
def event_collapse(spark, d):
    """WN07: repeats in a row are dropped, then the blank (views)."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = events(spark, d).withColumn("before", F.lag("event_type").over(w)).where("(before IS NULL OR before <> event_type) AND event_type <> 'view'")
    return e.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))), lambda x: x["event_type"]).alias("kept"))


@query("SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) % 10 AS k, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY event_type, k")
def event_props(spark, d):
    """STR26, SRC01: fields of a JSON column."""
    k = F.from_json("props", "k long")["k"]
    return events(spark, d).groupBy("event_type", (k % 10).alias("k")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query("SELECT CASE WHEN event_type = 'error' AND user_id % 3 = 0 THEN 'permanent' WHEN event_type = 'error' THEN 'retryable' ELSE 'none' END AS kind, CASE WHEN date_part('hour', ts) < 1 THEN 'intro' WHEN date_part('hour', ts) >= 23 THEN 'credits' ELSE 'content' END AS part, count(*) AS n FROM events GROUP BY kind, part")
def event_classify(spark, d):
    """FLT09, FLT17."""
    kind = F.when((F.col("event_type") == "error") & (F.col("user_id") % 3 == 0), "permanent").when(F.col("event_type") == "error", "retryable").otherwise("none")
    part = F.when(F.hour("ts") < 1, "intro").when(F.hour("ts") >= 23, "credits").otherwise("content")
    return events(spark, d).groupBy(kind.alias("kind"), part.alias("part")).agg(F.count("*").alias("n"))


@query("SELECT * FROM (PIVOT (SELECT event_type, user_id % 10 AS bucket, value FROM events) ON event_type IN ('click', 'error', 'purchase', 'signup', 'view') USING round(sum(value), 4) GROUP BY bucket)")
def event_pivot_heatmap(spark, d):
    """AG15."""
    e = events(spark, d).select("event_type", F.pmod("user_id", F.lit(10)).alias("bucket"), "value")
    return e.groupBy("bucket").pivot("event_type", ["click", "error", "purchase", "signup", "view"]).agg(F.round(F.sum("value"), 4))


DAILY = "SELECT CAST(ts AS DATE) AS day, avg(value) FILTER (event_type = 'click') AS a, avg(value) FILTER (event_type = 'view') AS b FROM events GROUP BY day"


_T = "abs(avg(a - b) / (stddev_samp(a - b) / sqrt(count(*)))) / sqrt(2)"
_U = f"(1 / (1 + 0.3275911::DOUBLE * {_T}))"
_TAIL = f"round({_U} * (0.254829592::DOUBLE + {_U} * (-0.284496736::DOUBLE + {_U} * (1.421413741::DOUBLE + {_U} * (-1.453152027::DOUBLE + {_U} * 1.061405429::DOUBLE)))) * exp(-({_T}) * ({_T})), 9)"


@query(f"""SELECT count(*) AS n, corr(a, b) AS pearson, avg(a - b) AS mean_diff, avg(a - b) / (stddev_samp(a - b) / sqrt(count(*))) AS t, count(*) FILTER (a > b) AS wins, count(*) FILTER (a < b) AS losses, count(*) FILTER (a = b) AS ties, {_TAIL} AS p FROM ({DAILY}) WHERE a IS NOT NULL AND b IS NOT NULL""")
def event_paired_stats(spark, d):
    """AG23: Pearson, paired t, sign test."""
    e = events(spark, d)
    daily = e.groupBy(F.to_date("ts").alias("day")).agg(F.avg(F.when(F.col("event_type") == "click", F.col("value"))).alias("a"), F.avg(F.when(F.col("event_type") == "view", F.col("value"))).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    return stats.paired(daily, "a", "b").withColumn("p", F.round("p", 9))


@query("WITH r AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2 AS x, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2 AS y FROM lineitem) SELECT round(corr(x, y), 9) AS spearman, count(*) AS n FROM r")
def lineitem_spearman(spark, d):
    """AG23: rank correlation with average ranks, without a window over all rows."""
    x = table(spark, d, "lineitem").select("l_quantity", "l_extendedprice")
    r = stats.average_rank(stats.average_rank(x, "l_quantity", "x"), "l_extendedprice", "y")
    return r.agg(F.round(F.corr("x", "y"), 9).alias("spearman"), F.count("*").alias("n"))


_TIMES = "CASE " + " ".join(f"WHEN u < {e} THEN {k}" for k, e in enumerate(stats.POISSON)) + f" ELSE {len(stats.POISSON)} END"


@query(
    f"""SELECT event_type, round(quantile_cont(m, 0.025), 9) AS low, round(quantile_cont(m, 0.975), 9) AS high FROM (SELECT event_type, b, sum(value * k) / sum(k) AS m FROM (SELECT event_type, value, b, {_TIMES} AS k
  FROM (SELECT event_type, value, b, CAST('0x' || substr(md5('7-' || event_id || '-' || b), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS u FROM events, range(1, 201) t(b))) GROUP BY event_type, b) GROUP BY event_type"""
)
def event_bootstrap(spark, d):
    """AG23: bootstrap confidence interval of the mean by event type."""
    b = stats.bootstrap(events(spark, d).select("event_id", "event_type", "value"), "value", ["event_type"], "event_id")
    return b.select("event_type", F.round("low", 9).alias("low"), F.round("high", 9).alias("high"))


@query("SELECT event_type, count(*) AS n, avg(value) AS mean, min(value) AS least, max(value) AS most, stddev_pop(value) AS std, quantile_cont(value, 0.5) AS median, list_sort(list(value))[len(list(value)) // 2 + 1] AS upper_median, count(*) FILTER (value >= 99) AS perfect, count(*) FILTER (value < 1) AS zero FROM events GROUP BY event_type")
def event_summary(spark, d):
    """AG08, AG09, AG10, AG12: both medians, moments, extremes. Medians come from ranges of
    counted values, so no group is collected or ordered in one place."""
    e = events(spark, d)
    base = e.groupBy("event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.min("value").alias("least"), F.max("value").alias("most"), F.stddev_pop("value").alias("std"), F.count_if(F.col("value") >= 99).alias("perfect"), F.count_if(F.col("value") < 1).alias("zero"))
    places = F.array(F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2))
    found = stats.at_places(e, "event_type", "value", base.select("event_type", F.explode(F.array_distinct(places)).alias("place")))
    medians = found.groupBy("event_type").agg(F.avg("value").alias("median"), F.max_by("value", "place").alias("upper_median"))
    return base.join(medians, "event_type")
