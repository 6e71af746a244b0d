"""Registration of queries with their SQL oracles."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracewright.sources import tables as T

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, *views: str) -> Callable[[Query], Query]:
    """Register a query; ``views`` are WITH entries put before its SQL."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            body = sql.strip()
            more = bool(re.match(r"\w+ AS \(", body))
            ORACLES[name] = (f"WITH {', '.join(views)}{',' if more else ''} " if views else "WITH " if more else "") + body
        return f

    return add


def _gradient(v: str, t: str = "t", w: str = "w") -> str:
    n, p = f"lead({v}) OVER {w}", f"lag({v}) OVER {w}"
    hs, hd = f"({t} - lag({t}) OVER {w})", f"(lead({t}) OVER {w} - {t})"
    return (
        f"CASE WHEN {p} IS NULL AND {n} IS NULL THEN CAST(0 AS DOUBLE) WHEN {p} IS NULL THEN ({n} - {v}) / {hd} WHEN {n} IS NULL THEN ({v} - {p}) / {hs} "
        f"ELSE ({hs} * {hs} * {n} + ({hd} * {hd} - {hs} * {hs}) * {v} - {hd} * {hd} * {p}) / ({hs} * {hd} * ({hs} + {hd})) END"
    )


def kinematic_views(source: str) -> str:
    """WITH entries that end in ``kin``, the kinematics of ``source``."""
    win = "WINDOW w AS (PARTITION BY video_id, track_id ORDER BY frame)"
    return (
        f"kv AS (SELECT *, {_gradient('x')} AS vx, {_gradient('y')} AS vy FROM {source} {win}), "
        f"ka AS (SELECT *, sqrt(vx * vx + vy * vy) AS speed, {_gradient('vx')} AS ax, {_gradient('vy')} AS ay FROM kv {win}), "
        f"kb AS (SELECT *, sqrt(ax * ax + ay * ay) AS accel FROM ka), "
        f"kin AS (SELECT *, abs({_gradient('accel')}) AS jerk FROM kb {win})"
    )


KIN = kinematic_views("obs")
GKIN = kinematic_views("grid")


def mad_sql(source: str, col: str, keys: str, out: str, strict: bool = True) -> str:
    """WITH entries that end in ``mz``: ``source`` with a robust z-score."""
    if strict:
        z = f"CASE WHEN 1.4826::DOUBLE * mad >= 1e-9 THEN ({col} - m) / (1.4826::DOUBLE * mad) WHEN s >= 1e-9 THEN ({col} - m) / s ELSE 0 END"
    else:
        z = f"({col} - m) / (CASE WHEN mad > 0 THEN mad WHEN s > 0 THEN s ELSE 1 END + 1e-9)"
    return (
        f"m1 AS (SELECT *, median({col}) OVER (PARTITION BY {keys}) AS m FROM {source}), "
        f"m2 AS (SELECT *, median(abs({col} - m)) OVER (PARTITION BY {keys}) AS mad, stddev_pop({col}) OVER (PARTITION BY {keys}) AS s FROM m1), "
        f"mz AS (SELECT *, {z} AS {out} FROM m2)"
    )


__all__ = ["GKIN", "KIN", "ORACLES", "QUERIES", "T", "kinematic_views", "mad_sql", "query"]
