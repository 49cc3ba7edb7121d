"""Event-time windows over the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from geospan.functions import numeric as N
from geospan.plans.registry import query, r6, table
from geospan.streaming import events as E

c = F.col


@query("stream_tumbling", f"SELECT strftime(time_bucket(INTERVAL '6 hours', ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, {r6('avg(value)')} AS mean FROM events GROUP BY ALL")
def stream_tumbling(spark, sf_dir):
    out = E.tumbling(table(spark, sf_dir, "events"), "6 hours", ["event_type"])
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", N.rounded(c("mean")).alias("mean"))


@query(
    "stream_sliding",
    f"""SELECT strftime(s, '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, {r6("avg(value)")} AS mean FROM (SELECT *, unnest([time_bucket(INTERVAL '6 hours', ts), time_bucket(INTERVAL '6 hours', ts) - INTERVAL '6 hours']) AS s FROM events) GROUP BY ALL""",
)
def stream_sliding(spark, sf_dir):
    out = E.sliding(table(spark, sf_dir, "events"), "12 hours", "6 hours", ["event_type"])
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", N.rounded(c("mean")).alias("mean"))


@query(
    "stream_sessions",
    """WITH e AS (SELECT user_id, ts, coalesce(ts >= lag(ts) OVER w + INTERVAL '8 hours', true) AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(CAST(new AS INTEGER)) OVER (PARTITION BY user_id ORDER BY ts, new DESC ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, k""",
)
def stream_sessions(spark, sf_dir):
    return E.sessions(table(spark, sf_dir, "events"), "8 hours", "user_id").select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")
