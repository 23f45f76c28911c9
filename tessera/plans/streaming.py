"""Registered streaming queries: event-time windows over landed events, run over all that is available."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.plans.registry import query
from tessera.streaming import events as S


@query("q_stream_windows", "SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_windows(spark, sf_dir):
    stream = S.tumbling(S.read_events(spark, f"{sf_dir}/events.parquet"), "6 hours")
    return S.run_available(stream, "windows").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query(
    "q_stream_sliding",
    "SELECT start, event_type, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01'), time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') - INTERVAL 6 HOUR]) AS start FROM events) GROUP BY 1, 2",
)
def stream_sliding(spark, sf_dir):
    stream = S.sliding(S.read_events(spark, f"{sf_dir}/events.parquet"), "12 hours", "6 hours")
    return S.run_available(stream, "sliding").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query(
    "q_stream_sessions",
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 4 HOUR THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, session""",
)
def stream_sessions(spark, sf_dir):
    stream = S.sessions(S.read_events(spark, f"{sf_dir}/events.parquet"), "4 hours")
    return S.run_available(stream, "sessions").select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("q_stream_first_seen", "SELECT event_id FROM events")
def stream_first_seen(spark, sf_dir):
    stream = S.first_seen(S.read_events(spark, f"{sf_dir}/events.parquet"), ["event_id"])
    return S.run_available(stream.select("event_id"), "first_seen", "append")
