"""Smoothing of series of any length, short ones included."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracewright.functions import kinematics as K
from tracewright.plans.base import T, query

#: Series by user, type of event and five values: mostly under ten samples.
SHORT = """short AS (SELECT user_id AS track_id, event_type AS kind, event_id % 5 AS part, event_id, value AS x, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY user_id, event_type, event_id % 5) AS n FROM events WINDOW w AS (PARTITION BY user_id, event_type, event_id % 5 ORDER BY event_id))"""
KEYS = ["track_id", "kind", "part"]
ORDER = "OVER (PARTITION BY track_id, kind, part ORDER BY i)"


def short(spark, sf):
    e = T.table(spark, sf, "events").select(F.col("user_id").alias("track_id"), F.col("event_type").alias("kind"), (F.col("event_id") % 5).alias("part"), "event_id", F.col("value").alias("x"))
    p = Window.partitionBy(*KEYS)
    return e.withColumns({"i": F.row_number().over(p.orderBy("event_id")) - 1, "n": F.count("*").over(p)})


def _savgol_sql(window: int) -> str:
    """Closed forms of the least squares: width 3 changes nothing, 5 and 7 by their integer weights."""

    def at(weights, first, over):
        cell = lambda d: "x" if d == 0 else f"lead(x, {d}) {ORDER}" if d > 0 else f"lag(x, {-d}) {ORDER}"
        return "(" + " + ".join(f"{float(c)!r}::DOUBLE * {cell(first + k)}" for k, c in enumerate(weights)) + f") / {over}"

    def series(table, w, over):
        ends = " ".join(f"WHEN i = {k} THEN {at(table[k], -k, over)} WHEN i = n - {1 + k} THEN {at(table[k][::-1], k - w + 1, over)}" for k in range(w // 2))
        return f"CASE {ends} ELSE {at(table[w // 2], -(w // 2), over)} END"

    return f"CASE WHEN n < 5 THEN x WHEN n < 7 THEN {series(K.SAVGOL5, 5, 35)} ELSE {series(K.SAVGOL7, 7, 42)} END"


@query("smooth_short", f"SELECT track_id, kind, part, i, n, round({_savgol_sql(7)}, 6) AS sx FROM short", SHORT)
def _(spark, sf):
    """Window 7 where the series has so many samples, else the largest odd width that fits."""
    w = Window.partitionBy(*KEYS).orderBy("i")
    return short(spark, sf).select(*KEYS, F.col("i").cast("long").alias("i"), "n", F.round(K.savgol(F.col("x"), w, F.col("i"), F.col("n"), 7), 6).alias("sx"))


def _box_sql() -> str:
    cell = lambda d: "x" if d == 0 else f"coalesce(lead(x, {d}) {ORDER}, last_x)" if d > 0 else f"coalesce(lag(x, {-d}) {ORDER}, first_x)"
    mean = lambda w: "(" + " + ".join(cell(d) for d in range(-(w // 2), w // 2 + 1)) + f") / {w}"
    return f"CASE WHEN n < 3 THEN x WHEN n < 5 THEN {mean(3)} WHEN n < 7 THEN {mean(5)} ELSE {mean(7)} END"


@query("smooth_short_mean", f"SELECT track_id, kind, part, i, round({_box_sql()}, 6) AS sx FROM (SELECT *, first_value(x) OVER w AS first_x, last_value(x) OVER w AS last_x FROM short WINDOW w AS (PARTITION BY track_id, kind, part ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))", SHORT)
def _(spark, sf):
    """The mean of as wide a window, end samples repeated."""
    w = Window.partitionBy(*KEYS).orderBy("i")
    return short(spark, sf).select(*KEYS, F.col("i").cast("long").alias("i"), F.round(K.boxcar(F.col("x"), w, F.col("n"), 7), 6).alias("sx"))
