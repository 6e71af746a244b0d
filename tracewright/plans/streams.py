"""Streaming sessions, once over a table and once as a stream read to its end."""

from tracewright.plans.base import query
from tracewright.streaming import sessions as S


@query("batch_sessions", S.SESSIONS_SQL)
def _(spark, sf):
    return S.session_counts(spark.read.parquet(f"{sf}/events.parquet"))


@query("stream_sessions", S.SESSIONS_SQL)
def _(spark, sf):
    return S.stream_events(spark, sf)
