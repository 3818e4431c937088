"""Streaming queries: the events table read as a file stream."""

from __future__ import annotations

from quernstone.streaming import windows as w
from quernstone.sources.tables import table


def _stream(spark, base):
    schema = table(spark, base, "events").schema
    return w.event_stream(spark, f"{base}/events.parquet*", schema)


def stream_window_counts(spark, base):
    return w.drain(w.window_counts(_stream(spark, base)), "complete")


def stream_sessions(spark, base):
    return w.drain(w.sessions(_stream(spark, base)), "complete")


QUERIES = {
    "stream_window_counts": (stream_window_counts, "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL"),
    "stream_sessions": (stream_sessions, "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT user_id, CAST(min(ts) AS VARCHAR) AS start, count(*) AS n FROM s GROUP BY user_id, s"),
}
