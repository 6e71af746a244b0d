"""Sampling, geometry, kinematics, smoothing and robust flags."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracewright.functions import geometry as G
from tracewright.functions import kinematics as K
from tracewright.functions import parsing as P
from tracewright.functions import stats as S
from tracewright.operators import joins as J
from tracewright.plans.base import GKIN, KIN, mad_sql, query
from tracewright.sources import tables as T

TW = "OVER (PARTITION BY video_id, track_id ORDER BY frame)"
PW = "OVER (PARTITION BY video_id, track_id)"


@query("scan_project_filter", "SELECT event_id, user_id, value FROM events WHERE value > 50 AND event_type = 'purchase'")
def _(spark, sf):
    return T.table(spark, sf, "events").where("value > 50 AND event_type = 'purchase'").select("event_id", "user_id", "value")


@query("allowlist_ext_pages", r"SELECT page_id, url FROM pages WHERE lower(regexp_extract(url, '\.([A-Za-z0-9]+)$', 1)) IN ('html', 'htm', 'mp4', 'mov', 'gif', 'webm')")
def _(spark, sf):
    return T.table(spark, sf, "pages").where(P.allowed_extension(F.col("url"), ("html", "htm", "mp4", "mov", "gif", "webm"))).select("page_id", "url")


@query("content_hash", "SELECT page_id, substr(sha1(encode(CAST(octet_length(encode(html)) AS VARCHAR)) || encode(html)), 1, 16) AS digest FROM pages")
def _(spark, sf):
    return T.table(spark, sf, "pages").select("page_id", P.fingerprint(F.encode("html", "UTF-8")).alias("digest"))


@query("uniform_sample_linspace", f"""n AS (SELECT *, count(*) {PW} AS n FROM obs), k AS (SELECT CAST(unnest(range(8)) AS BIGINT) AS i)
SELECT DISTINCT video_id, track_id, frame, x FROM n, k WHERE frame = CASE WHEN n <= 8 THEN frame WHEN i = 7 THEN n - 1 ELSE CAST(trunc(i * ((n - 1)::DOUBLE / 7)) AS BIGINT) END
""", T.OBS)  # fmt: skip
def _(spark, sf):
    """Eight evenly spaced rows of each track, by truncated steps; the last is the last row."""
    o = T.observations(spark, sf).withColumn("n", F.count("*").over(T.track()))
    step = (F.col("n") - 1).cast("double") / 7
    picks = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.when(i == 7, F.col("n") - 1).otherwise((i * step).cast("long")))
    return o.where((F.col("n") <= 8) | F.array_contains(picks, F.col("frame"))).select("video_id", "track_id", "frame", "x")


@query("stride_sample", "SELECT video_id, track_id, frame, x FROM obs WHERE frame % 5 = 0", T.OBS)
def _(spark, sf):
    return T.observations(spark, sf).where("frame % 5 = 0").select("video_id", "track_id", "frame", "x")


@query("stratified_sample", """
r AS (SELECT doc_id, quality, row_number() OVER (ORDER BY quality, doc_id) - 1 AS i, count(*) OVER () AS n FROM labels)
SELECT doc_id, quality FROM r WHERE n <= 60 OR i IN (SELECT CASE WHEN k = 59 THEN n - 1 ELSE CAST(trunc(k * ((n - 1)::DOUBLE / 59)) AS BIGINT) END FROM (SELECT count(*) AS n FROM labels), (SELECT unnest(range(60)) AS k))
""".strip())  # fmt: skip
def _(spark, sf):
    """60 rows evenly spaced over the order of (quality, id), as truncated steps; the order is told by ranges, so
    no task holds all rows."""
    placed = S.numbered(T.table(spark, sf, "labels").select("doc_id", "quality"), ["quality", "doc_id"], "i", "n").withColumn("i", F.col("i") - 1)
    step = (F.col("n") - 1).cast("double") / 59
    picks = F.transform(F.sequence(F.lit(0), F.lit(59)), lambda k: F.when(k == 59, F.col("n") - 1).otherwise((k * step).cast("long")))
    return placed.where((F.col("n") <= 60) | F.array_contains(picks, F.col("i"))).select("doc_id", "quality")


@query("time_grid_remap", "SELECT video_id, track_id, frame, greatest(0, least(CAST(round_even((t - t0) * 30, 0) AS BIGINT), 299)) AS grid_frame FROM (SELECT *, min(t) OVER (PARTITION BY video_id, track_id) AS t0 FROM obs)", T.OBS)
def _(spark, sf):
    o = T.observations(spark, sf).withColumn("t0", F.min("t").over(T.track()))
    g = F.greatest(F.lit(0), F.least(F.bround((F.col("t") - F.col("t0")) * 30).cast("long"), F.lit(299)))
    return o.select("video_id", "track_id", "frame", g.alias("grid_frame"))


@query("box_from_points", """
b AS (SELECT video_id, track_id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM obs GROUP BY ALL),
c AS (SELECT *, CASE WHEN x1 - x0 < 12 THEN (12 - (x1 - x0)) / 2 ELSE 0 END + 0.1::DOUBLE * greatest(x1 - x0, 12) AS px,
  CASE WHEN y1 - y0 < 12 THEN (12 - (y1 - y0)) / 2 ELSE 0 END + 0.1::DOUBLE * greatest(y1 - y0, 12) AS py FROM b)
SELECT video_id, track_id, greatest(x0 - px, 0) AS x0, greatest(y0 - py, 0) AS y0, least(x1 + px, 100) AS x1, least(y1 + py, 100) AS y1 FROM c
""".strip(), T.OBS)  # fmt: skip
def _(spark, sf):
    b = T.observations(spark, sf).groupBy(*T.TRACK).agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    pad = lambda lo, hi: F.when(hi - lo < 12, (12 - (hi - lo)) / 2).otherwise(F.lit(0.0)) + 0.1 * F.greatest(hi - lo, F.lit(12.0))
    px, py = pad(F.col("x0"), F.col("x1")), pad(F.col("y0"), F.col("y1"))
    zero = F.lit(0.0)
    return b.select(*T.TRACK, F.greatest(F.col("x0") - px, zero).alias("x0"), F.greatest(F.col("y0") - py, zero).alias("y0"), F.least(F.col("x1") + px, F.lit(T.WIDTH)).alias("x1"), F.least(F.col("y1") + py, F.lit(T.HEIGHT)).alias("y1"))


PAIRS = """pairs AS (SELECT a.video_id, a.frame, a.track_id AS track_a, b.track_id AS track_b, a.x AS xa, a.y AS ya, b.x AS xb, b.y AS yb, abs(a.x - b.x) AS dx, abs(a.y - b.y) AS dy
  FROM grid a JOIN grid b ON a.video_id = b.video_id AND a.frame = b.frame AND a.track_id < b.track_id)"""
IOU = """iou AS (SELECT *, greatest(least(xa + 5, xb + 5) - greatest(xa - 5, xb - 5), 0) * greatest(least(ya + 5, yb + 5) - greatest(ya - 5, yb - 5), 0) AS inter,
  ((xa + 5) - (xa - 5)) * ((ya + 5) - (ya - 5)) + ((xb + 5) - (xb - 5)) * ((yb + 5) - (yb - 5)) AS areas,
  greatest(greatest(xa - 5, xb - 5) - least(xa + 5, xb + 5), 0) AS gx, greatest(greatest(ya - 5, yb - 5) - least(ya + 5, yb + 5), 0) AS gy FROM pairs)"""


def pairs(spark, sf):
    return J.track_pairs(T.grid(spark, sf), ["x", "y"])


def _boxes():
    return G.box_around(F.col("x_a"), F.col("y_a")), G.box_around(F.col("x_b"), F.col("y_b"))


@query("pair_box_iou", "SELECT video_id, frame, track_a, track_b, CASE WHEN areas - inter > 1e-6 THEN inter / (areas - inter) ELSE 0 END AS iou FROM iou", T.OBS, T.GRID, PAIRS, IOU)
def _(spark, sf):
    return pairs(spark, sf).select("video_id", "frame", "track_a", "track_b", G.box_iou(*_boxes()).alias("iou"))


@query("pair_box_gap", "SELECT video_id, frame, track_a, track_b, sqrt(gx * gx + gy * gy) AS gap FROM iou", T.OBS, T.GRID, PAIRS, IOU)
def _(spark, sf):
    return pairs(spark, sf).select("video_id", "frame", "track_a", "track_b", G.box_gap(*_boxes()).alias("gap"))


@query("padded_adjacency", "SELECT video_id, frame, track_a, track_b FROM pairs WHERE xa - 5 - 4 < xb + 5 AND xb - 5 - 4 < xa + 5 AND ya - 5 - 4 < yb + 5 AND yb - 5 - 4 < ya + 5", T.OBS, T.GRID, PAIRS)
def _(spark, sf):
    return pairs(spark, sf).where(G.boxes_adjacent(*_boxes(), 4.0)).select("video_id", "frame", "track_a", "track_b")


@query("border_predicates", "SELECT video_id, track_id, frame, x < 3 OR x > 97 OR y < 3 OR y > 97 AS at_border, y < 90 AS off_floor, y > 50 AS ground FROM obs", T.OBS)
def _(spark, sf):
    o = T.observations(spark, sf)
    return o.select(*T.TRACK, "frame", G.at_border(F.col("x"), F.col("y"), 100, 100).alias("at_border"), (F.col("y") < 90).alias("off_floor"), (F.col("y") > 50).alias("ground"))


STEPS = f"steps AS (SELECT *, x - lag(x) {TW} AS dx, y - lag(y) {TW} AS dy FROM obs)"


def steps(spark, sf):
    w = T.track_window()
    return T.observations(spark, sf).withColumns({"dx": F.col("x") - F.lag("x").over(w), "dy": F.col("y") - F.lag("y").over(w)})


@query("flow_vectors", "SELECT video_id, track_id, frame, sqrt(dx * dx + dy * dy) AS mag, round(atan2(dy, dx), 9) AS angle FROM steps WHERE dx IS NOT NULL", T.OBS, STEPS)
def _(spark, sf):
    return steps(spark, sf).where("dx IS NOT NULL").select(*T.TRACK, "frame", K.norm(F.col("dx"), F.col("dy")).alias("mag"), F.round(F.atan2("dy", "dx"), 9).alias("angle"))


@query("direction_consistency", "SELECT video_id, frame, round(sqrt(pow(avg(cos(atan2(dy, dx))), 2) + pow(avg(sin(atan2(dy, dx))), 2)), 9) AS consistency, count(*) AS n FROM steps WHERE dx IS NOT NULL GROUP BY video_id, frame", T.OBS, STEPS)
def _(spark, sf):
    a = steps(spark, sf).where("dx IS NOT NULL").withColumn("a", F.atan2("dy", "dx"))
    g = a.groupBy("video_id", "frame").agg(F.avg(F.cos("a")).alias("c"), F.avg(F.sin("a")).alias("s"), F.count("*").alias("n"))
    return g.select("video_id", "frame", F.round(K.norm(F.col("c"), F.col("s")), 9).alias("consistency"), "n")


ZONE = "CAST((CASE WHEN y >= 66 THEN 2 WHEN y >= 33 THEN 1 ELSE 0 END) * 3 + (CASE WHEN x >= 66 THEN 2 WHEN x >= 33 THEN 1 ELSE 0 END) AS BIGINT)"


@query("zone_grid_stats", f"SELECT video_id, frame, {ZONE} AS zone, count(*) AS n, round(avg(sqrt(dx * dx + dy * dy)), 9) AS mean_mag FROM steps WHERE dx IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) >= 2", T.OBS, STEPS)
def _(spark, sf):
    s = steps(spark, sf).where("dx IS NOT NULL")
    g = s.groupBy("video_id", "frame", G.zone(F.col("x"), F.col("y"), 100, 100, 3).alias("zone")).agg(F.count("*").alias("n"), F.round(F.avg(K.norm(F.col("dx"), F.col("dy"))), 9).alias("mean_mag"))
    return g.where("n >= 2")


@query("zone_residuals", f"""
z AS (SELECT video_id, frame, {ZONE} AS zone, count(*) AS n, avg(sqrt(dx * dx + dy * dy)) AS m FROM steps WHERE dx IS NOT NULL GROUP BY 1, 2, 3),
f AS (SELECT video_id, count(DISTINCT frame) AS frames FROM steps WHERE dx IS NOT NULL GROUP BY 1)
SELECT z.video_id, zone, round(least(greatest(sum(CASE WHEN n >= 2 THEN m ELSE 0 END) / any_value(frames) / 100, 0), 1), 9) AS score FROM z JOIN f USING (video_id) GROUP BY 1, 2
""".strip(), T.OBS, STEPS)  # fmt: skip
def _(spark, sf):
    s = steps(spark, sf).where("dx IS NOT NULL")
    z = s.groupBy("video_id", "frame", G.zone(F.col("x"), F.col("y"), 100, 100, 3).alias("zone")).agg(F.count("*").alias("n"), F.avg(K.norm(F.col("dx"), F.col("dy"))).alias("m"))
    f = s.groupBy("video_id").agg(F.count_distinct("frame").alias("frames"))
    mean = F.sum(F.when(F.col("n") >= 2, F.col("m")).otherwise(F.lit(0.0))) / F.first("frames") / 100
    return z.join(f, "video_id").groupBy("video_id", "zone").agg(F.round(F.least(F.greatest(mean, F.lit(0.0)), F.lit(1.0)), 9).alias("score"))


@query("track_velocity_accel", f"""
v AS (SELECT *, (x - lag(x) {TW}) * 30 AS vx, (y - lag(y) {TW}) * 30 AS vy FROM obs),
a AS (SELECT *, (vx - lag(vx) {TW}) * 30 AS ax, (vy - lag(vy) {TW}) * 30 AS ay FROM v)
SELECT video_id, track_id, frame, vx, vy, sqrt(ax * ax + ay * ay) AS accel, sqrt(ax * ax + ay * ay) > 40000 AS flagged FROM a WHERE ax IS NOT NULL
""".strip(), T.OBS)  # fmt: skip
def _(spark, sf):
    w, fps = T.track_window(), 30
    v = T.observations(spark, sf).withColumns({"vx": (F.col("x") - F.lag("x").over(w)) * fps, "vy": (F.col("y") - F.lag("y").over(w)) * fps})
    a = v.withColumns({"ax": (F.col("vx") - F.lag("vx").over(w)) * fps, "ay": (F.col("vy") - F.lag("vy").over(w)) * fps}).where("ax IS NOT NULL")
    return a.withColumn("accel", K.norm(F.col("ax"), F.col("ay"))).select(*T.TRACK, "frame", "vx", "vy", "accel", (F.col("accel") > 40000).alias("flagged"))


def kin(spark, sf):
    return K.kinematics(T.observations(spark, sf), T.track_window())


@query("gradient_uneven", "SELECT video_id, track_id, frame, vx, vy, speed FROM kin", T.OBS, KIN)
def _(spark, sf):
    return kin(spark, sf).select(*T.TRACK, "frame", "vx", "vy", "speed")


@query("jerk_series", "SELECT video_id, track_id, frame, accel, jerk FROM kin", T.OBS, KIN)
def _(spark, sf):
    return kin(spark, sf).select(*T.TRACK, "frame", "accel", "jerk")


ASPECT = "asp AS (SELECT video_id, track_id, frame, t, (abs(x) + 1) / (abs(y) + 1) AS x, y FROM obs)"


@query("aspect_rate", "SELECT video_id, track_id, frame, vx AS aspect_rate FROM kin", T.OBS, ASPECT, KIN.replace("FROM obs", "FROM asp"))
def _(spark, sf):
    o = T.observations(spark, sf).withColumn("a", (F.abs("x") + 1) / (F.abs("y") + 1))
    return o.select(*T.TRACK, "frame", K.gradient(F.col("a"), F.col("t"), T.track_window()).alias("aspect_rate"))


@query("smooth_box3_zero", f"SELECT video_id, track_id, frame, (coalesce(lag(x) {TW}, 0) + x + coalesce(lead(x) {TW}, 0)) / 3 AS sx FROM obs", T.OBS)
def _(spark, sf):
    return T.observations(spark, sf).select(*T.TRACK, "frame", K.box3(F.col("x"), T.track_window(), "zero").alias("sx"))


@query("smooth_box3_edge", f"SELECT video_id, track_id, frame, (coalesce(lag(x) {TW}, x) + x + coalesce(lead(x) {TW}, x)) / 3 AS sx FROM obs", T.OBS)
def _(spark, sf):
    return T.observations(spark, sf).select(*T.TRACK, "frame", K.box3(F.col("x"), T.track_window()).alias("sx"))


def _savgol_sql() -> str:
    def at(weights, first, over=42):
        return "(" + " + ".join(f"{c} * " + ("x" if first + k == 0 else f"lead(x, {first + k}) {TW}" if first + k > 0 else f"lag(x, {-first - k}) {TW}") for k, c in enumerate(weights)) + f") / {over}"

    five = " ".join(f"WHEN n < 7 AND frame = {k} THEN {at(K.SAVGOL5[k], -k, 35)} WHEN n < 7 AND frame = n - {1 + k} THEN {at(K.SAVGOL5[k][::-1], k - 4, 35)}" for k in range(2))
    ends = " ".join(f"WHEN frame = {k} THEN {at(K.SAVGOL7[k], -k)} WHEN frame = n - {1 + k} THEN {at(K.SAVGOL7[k][::-1], k - 6)}" for k in range(3))
    return f"SELECT video_id, track_id, frame, CASE WHEN n < 5 THEN x {five} WHEN n < 7 THEN {at(K.SAVGOL5[2], -2, 35)} {ends} ELSE {at(K.SAVGOL7[3], -3)} END AS sx FROM (SELECT *, count(*) {PW} AS n FROM obs)"


@query("smooth_savgol7", _savgol_sql(), T.OBS)
def _(spark, sf):
    o = T.observations(spark, sf).withColumn("n", F.count("*").over(T.track()))
    return o.select(*T.TRACK, "frame", K.savgol7(F.col("x"), T.track_window(), F.col("frame"), F.col("n")).alias("sx"))


def _gauss_sql(col: str, window: int) -> str:
    half, out = window // 2, []
    for k, c in zip(range(-half, half + 1), K.gaussian_weights(window)):
        v = col if k == 0 else f"coalesce(lead({col}, {k}) {TW}, last_{col})" if k > 0 else f"coalesce(lag({col}, {-k}) {TW}, first_{col})"
        out.append(f"CAST({c!r} AS DOUBLE) * {v}")
    return " + ".join(out)


def _ends(col: str) -> str:
    whole = "OVER (PARTITION BY video_id, track_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
    return f"first_value({col}) {whole} AS first_{col}, last_value({col}) {whole} AS last_{col}"


@query("smooth_gaussian", f"SELECT video_id, track_id, frame, {_gauss_sql('x', 9)} AS sx FROM (SELECT *, {_ends('x')} FROM obs)", T.OBS)
def _(spark, sf):
    return T.observations(spark, sf).select(*T.TRACK, "frame", K.gaussian(F.col("x"), T.track_window(), 9, T.TRACK).alias("sx"))


def _drop() -> str:
    return "CASE WHEN frame = 0 OR event_type = 'error' THEN NULL ELSE x END"


HELD = f"""held AS (SELECT *, CASE WHEN frame = 0 THEN coalesce(lead(h) {TW}, h) ELSE h END AS vel FROM (
  SELECT *, coalesce(last_value({_drop()} IGNORE NULLS) OVER (PARTITION BY video_id, track_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS h FROM obs))"""


def held(spark, sf):
    v = F.when((F.col("frame") != 0) & (F.col("event_type") != "error"), F.col("x"))
    return T.observations(spark, sf).withColumn("v", v).withColumn("vel", K.hold_last(F.col("v"), T.track_window()))


@query("hold_last_velocity", "SELECT video_id, track_id, frame, vel FROM held", T.OBS, HELD)
def _(spark, sf):
    return held(spark, sf).select(*T.TRACK, "frame", "vel")


JIT = f"jit AS (SELECT *, {_gauss_sql('vel', 9)} AS sv FROM (SELECT *, {_ends('vel')} FROM held))"
SCORE = "least(greatest(greatest(abs(vel - sv) - 0.3::DOUBLE, 0) / (30 * (1 + 0.15::DOUBLE * abs(sv))), 0), 1)"


def jitter(spark, sf):
    h = held(spark, sf).withColumn("sv", K.gaussian(F.col("vel"), T.track_window(), 9, T.TRACK))
    raw = F.greatest(F.abs(F.col("vel") - F.col("sv")) - 0.3, F.lit(0.0)) / (30 * (1 + 0.15 * F.abs(F.col("sv"))))
    return h.withColumn("score", F.least(F.greatest(raw, F.lit(0.0)), F.lit(1.0)))


@query("jitter_score", f"SELECT video_id, track_id, frame, {SCORE} AS score FROM jit", T.OBS, HELD, JIT)
def _(spark, sf):
    return jitter(spark, sf).select(*T.TRACK, "frame", "score")


@query("robust_z_strict", "SELECT video_id, track_id, frame, z FROM mz", T.OBS, mad_sql("obs", "x", "video_id, track_id", "z"))
def _(spark, sf):
    return S.mad_z(T.observations(spark, sf), "x", T.TRACK, "z").select(*T.TRACK, "frame", "z")


@query("robust_z_eps", "SELECT video_id, track_id, frame, z FROM mz", T.OBS, mad_sql("obs", "x", "video_id, track_id", "z", False))
def _(spark, sf):
    return S.mad_z(T.observations(spark, sf), "x", T.TRACK, "z", strict=False).select(*T.TRACK, "frame", "z")


FLOOR = f"fl AS (SELECT *, greatest(1.0, 0.15::DOUBLE * quantile_cont(speed, 0.75) {PW}) AS speed_floor, greatest(1.0, median(accel) {PW}) AS accel_floor FROM mz)"
FLAGS = f"""flags AS (SELECT *, z > 3.5 AND accel > accel_floor AS acc,
  coalesce((sign(vx) * sign(lag(vx) {TW}) < 0 AND abs(vx) > speed_floor AND abs(lag(vx) {TW}) > speed_floor)
    OR (sign(vy) * sign(lag(vy) {TW}) < 0 AND abs(vy) > speed_floor AND abs(lag(vy) {TW}) > speed_floor), false) AS rev FROM fl)"""
FLAG_VIEWS = (T.OBS, KIN, mad_sql("kin", "accel", "video_id, track_id", "z"), FLOOR, FLAGS)


def flags(spark, sf):
    """Kinematics with robust acceleration flags (``acc``) and reversals (``rev``)."""
    w, p = T.track_window(), T.track()
    k = S.mad_z(kin(spark, sf), "accel", T.TRACK, "z")
    k = k.withColumns({"speed_floor": F.greatest(F.lit(1.0), 0.15 * F.percentile("speed", 0.75).over(p)), "accel_floor": F.greatest(F.lit(1.0), F.median("accel").over(p))})

    def flip(c):
        v, b = F.col(c), F.lag(c).over(w)
        return (F.sign(v) * F.sign(b) < 0) & (F.abs(v) > F.col("speed_floor")) & (F.abs(b) > F.col("speed_floor"))

    return k.withColumns({"acc": (F.col("z") > 3.5) & (F.col("accel") > F.col("accel_floor")), "rev": F.coalesce(flip("vx") | flip("vy"), F.lit(False))})


@query("p75_floor", "SELECT DISTINCT video_id, track_id, round(speed_floor, 6) AS speed_floor, round(accel_floor, 6) AS accel_floor FROM fl", *FLAG_VIEWS)
def _(spark, sf):
    return flags(spark, sf).select(*T.TRACK, F.round("speed_floor", 6).alias("speed_floor"), F.round("accel_floor", 6).alias("accel_floor")).distinct()


@query("accel_flags", "SELECT video_id, track_id, frame, least(z / 3.5::DOUBLE, 3) AS score FROM flags WHERE acc", *FLAG_VIEWS)
def _(spark, sf):
    return flags(spark, sf).where("acc").select(*T.TRACK, "frame", F.least(F.col("z") / 3.5, F.lit(3.0)).alias("score"))


@query("velocity_reversals", "SELECT video_id, track_id, frame, round(least(speed / speed_floor, 3), 6) AS score FROM flags WHERE rev", *FLAG_VIEWS)
def _(spark, sf):
    return flags(spark, sf).where("rev").select(*T.TRACK, "frame", F.round(F.least(F.col("speed") / F.col("speed_floor"), F.lit(3.0)), 6).alias("score"))


NEAR = "OVER (PARTITION BY video_id, track_id ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)"
RECON = f"recon AS (SELECT *, bool_or(acc) {NEAR} AS near_acc, bool_or(rev) {NEAR} AS near_rev FROM flags)"


def reconciled(spark, sf):
    """Flags as impacts (both kinds within two samples) or unexplained ones; a frame, not a join, as
    positions are dense."""
    near = T.track_window().rowsBetween(-2, 2)
    return flags(spark, sf).withColumns({"near_acc": F.max("acc").over(near), "near_rev": F.max("rev").over(near)})


@query("impact_reconcile", "SELECT video_id, track_id, frame, (acc OR rev) AND near_acc AND near_rev AS impact, acc AND NOT near_rev AS acc_flag, rev AND NOT near_acc AS rev_flag FROM recon WHERE acc OR rev", *FLAG_VIEWS, RECON)
def _(spark, sf):
    r = reconciled(spark, sf).where("acc OR rev")
    return r.select(*T.TRACK, "frame", ((F.col("acc") | F.col("rev")) & F.col("near_acc") & F.col("near_rev")).alias("impact"), (F.col("acc") & ~F.col("near_rev")).alias("acc_flag"), (F.col("rev") & ~F.col("near_acc")).alias("rev_flag"))


@query("static_track_filter", """
e AS (SELECT video_id, track_id, greatest(max(x) - min(x), max(y) - min(y)) AS extent FROM obs GROUP BY ALL),
r AS (SELECT *, max(extent) OVER (PARTITION BY video_id) AS top, row_number() OVER (PARTITION BY video_id ORDER BY extent DESC, track_id) AS rn FROM e)
SELECT video_id, track_id, extent FROM r WHERE extent >= 95 OR (top < 95 AND rn = 1)
""".strip(), T.OBS)  # fmt: skip
def _(spark, sf):
    """Tracks that move; if none of a video does, its most moving one."""
    e = T.observations(spark, sf).groupBy(*T.TRACK).agg(F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y")).alias("extent"))
    v = Window.partitionBy("video_id")
    r = e.withColumns({"top": F.max("extent").over(v), "rn": F.row_number().over(v.orderBy(F.desc("extent"), "track_id"))})
    return r.where("extent >= 95 OR (top < 95 AND rn = 1)").select(*T.TRACK, "extent")


@query("short_track_filter", "SELECT video_id, track_id, count(*) AS n FROM obs GROUP BY ALL HAVING count(*) >= 60", T.OBS)
def _(spark, sf):
    return T.observations(spark, sf).groupBy(*T.TRACK).agg(F.count("*").alias("n")).where("n >= 60")


@query("significance_gate", """
s AS (SELECT signal_type, CASE WHEN signal_type = 'view' THEN NULL ELSE least(CAST(trunc(sum(CASE WHEN score > 1 THEN 1 ELSE 0 END) * 300.0::DOUBLE / count(*)) AS BIGINT), 100) END AS severity FROM sig GROUP BY 1)
SELECT video_id, signal_type, count(*) AS n FROM sig JOIN s USING (signal_type) WHERE severity IS NULL OR severity >= 40 GROUP BY 1, 2
""".strip(), T.OBS, T.SIG)  # fmt: skip
def _(spark, sf):
    s = T.signals(spark, sf)
    sev = F.least((F.sum((F.col("score") > 1).cast("long")) * 300.0 / F.count("*")).cast("long"), F.lit(100))
    severity = s.groupBy("signal_type").agg(sev.alias("v")).select("signal_type", F.when(F.col("signal_type") != "view", F.col("v")).alias("severity"))
    return s.join(severity, "signal_type").where("severity IS NULL OR severity >= 40").groupBy("video_id", "signal_type").agg(F.count("*").alias("n"))


@query("signal_scores", "SELECT video_id, track_id, frame, accel / 100 AS acc_score, 1 - least(speed / (speed + 1), 1) AS chaos, least(z / 3.5::DOUBLE, 3) AS z_score FROM mz WHERE accel > 100", T.OBS, KIN, mad_sql("kin", "accel", "video_id, track_id", "z"))
def _(spark, sf):
    k = S.mad_z(kin(spark, sf), "accel", T.TRACK, "z").where("accel > 100")
    return k.select(*T.TRACK, "frame", (F.col("accel") / 100).alias("acc_score"), (1 - F.least(F.col("speed") / (F.col("speed") + 1), F.lit(1.0))).alias("chaos"), F.least(F.col("z") / 3.5, F.lit(3.0)).alias("z_score"))


@query("grid_kinematics", "SELECT video_id, track_id, frame, speed, accel FROM kin", T.OBS, T.GRID, GKIN)
def _(spark, sf):
    return K.kinematics(T.grid(spark, sf), T.track_window()).select(*T.TRACK, "frame", "speed", "accel")
