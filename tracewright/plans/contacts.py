"""Sessions, runs, contacts, range and nearest joins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracewright.functions import geometry as G
from tracewright.functions import kinematics as K
from tracewright.operators import joins as J
from tracewright.operators import sessions as N
from tracewright.plans import motion as M
from tracewright.plans.base import query
from tracewright.sources import tables as T

LANES = ["purchase", "signup", "click", "view", "error"]
#: Signals of a type at most this many frames apart are one marker.
MERGE = 30


def lane(c: str = "signal_type"):
    out = F.lit(len(LANES))
    for i, name in enumerate(LANES):
        out = F.when(F.col(c) == name, i).otherwise(out)
    return out.cast("long")


LANE = "CAST(CASE signal_type " + " ".join(f"WHEN '{n}' THEN {i}" for i, n in enumerate(LANES)) + f" ELSE {len(LANES)} END AS BIGINT)"
SESS = f"""sess AS (SELECT *, sum(new) OVER (PARTITION BY video_id, signal_type ORDER BY frame RANGE UNBOUNDED PRECEDING) AS session FROM (
  SELECT *, CASE WHEN frame - lag(frame) OVER (PARTITION BY video_id, signal_type ORDER BY frame) > {MERGE} THEN 1 ELSE 0 END AS new FROM sig))"""
MARK = f"""mark AS (SELECT video_id, signal_type, {LANE} AS lane, min(frame) AS frame_start, max(frame) AS frame_end, min(t) AS t_start, max(t) AS t_end,
  count(*) AS n_signals, max(score) AS peak, CAST(trunc(least(100, 20 + 12 * count(*) + 25 * least(max(score), 2))) AS BIGINT) AS severity
  FROM sess GROUP BY video_id, signal_type, session)"""
MARK_VIEWS = (T.OBS, T.SIG, SESS, MARK)


def markers(spark, sf, merge_frames=MERGE):
    """Signals of one type merged into event windows with a severity."""
    s = N.sessionize(T.signals(spark, sf), ["video_id", "signal_type"], "frame", F.lit(merge_frames))
    severity = F.least(F.lit(100.0), 20 + 12 * F.count("*") + 25 * F.least(F.max("score"), F.lit(2.0))).cast("long")
    return s.groupBy("video_id", "signal_type", "session").agg(
        F.min("frame").alias("frame_start"), F.max("frame").alias("frame_end"), F.min("t").alias("t_start"), F.max("t").alias("t_end"),
        F.count("*").alias("n_signals"), F.max("score").alias("peak"), severity.alias("severity"),
    ).withColumn("lane", lane()).drop("session")


@query("event_markers", "SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY t_start, lane, frame_start) - 1 AS id, signal_type, lane, frame_start, frame_end, t_start, t_end, n_signals, peak, severity FROM mark", *MARK_VIEWS)
def _(spark, sf, merge_frames=MERGE):
    w = Window.partitionBy("video_id").orderBy("t_start", "lane", "frame_start")
    return markers(spark, sf, merge_frames).withColumn("id", (F.row_number().over(w) - 1).cast("long")).select("video_id", "id", "signal_type", "lane", "frame_start", "frame_end", "t_start", "t_end", "n_signals", "peak", "severity")


@query("lane_order", "SELECT signal_type, lane, count(*) AS n FROM mark GROUP BY 1, 2", *MARK_VIEWS)
def _(spark, sf):
    return markers(spark, sf).groupBy("signal_type", "lane").agg(F.count("*").alias("n"))


@query("localization_summary", """
SELECT m.video_id, count(*) AS n_markers, least(sum(frame_end - frame_start + 1) / any_value(span), 1) AS coverage,
  CAST(trunc(least(100, 0.6::DOUBLE * max(severity) + least(count(*), 12) / 12.0::DOUBLE * 40)) AS BIGINT) AS overall
FROM mark m JOIN (SELECT video_id, CAST(max(frame) - min(frame) + 1 AS DOUBLE) AS span FROM sig GROUP BY 1) s ON s.video_id = m.video_id GROUP BY m.video_id
""", *MARK_VIEWS)  # fmt: skip
def _(spark, sf):
    span = T.signals(spark, sf).groupBy("video_id").agg((F.max("frame") - F.min("frame") + 1).cast("double").alias("span"))
    overall = F.least(F.lit(100.0), 0.6 * F.max("severity") + F.least(F.count("*"), F.lit(12)) / 12.0 * 40).cast("long")
    return markers(spark, sf).join(span, "video_id").groupBy("video_id").agg(F.count("*").alias("n_markers"), F.least(F.sum(F.col("frame_end") - F.col("frame_start") + 1) / F.first("span"), F.lit(1.0)).alias("coverage"), overall.alias("overall"))


@query("presence_gaps", """
g AS (SELECT *, frame - lag(frame) OVER (PARTITION BY track_id ORDER BY frame) AS gap, lag(frame) OVER (PARTITION BY track_id ORDER BY frame) AS before FROM grid)
SELECT video_id, track_id, before AS f_before, frame AS f_after, gap, least(1, gap / 48.0::DOUBLE) AS score FROM g WHERE gap > 24
""", T.OBS, T.GRID)  # fmt: skip
def _(spark, sf):
    w = T.track_window()
    g = T.grid(spark, sf).withColumn("f_before", F.lag("frame").over(w)).withColumn("gap", F.col("frame") - F.col("f_before")).where("gap > 24")
    return g.select(*T.TRACK, "f_before", F.col("frame").alias("f_after"), "gap", F.least(F.lit(1.0), F.col("gap") / 48.0).alias("score"))


ISL = "isl AS (SELECT *, frame - row_number() OVER (PARTITION BY track_id ORDER BY frame) AS run FROM obs WHERE x > 60)"


@query("threshold_intervals", "SELECT video_id, track_id, min(frame) AS f_start, max(frame) + 1 AS f_end, max(x) / 60 AS score, arg_max(frame, (x, -frame)) AS peak_frame FROM isl GROUP BY video_id, track_id, run", T.OBS, ISL)
def _(spark, sf):
    r = N.islands(T.observations(spark, sf), T.TRACK, F.col("x") > 60)
    return r.groupBy(*T.TRACK, "run").agg(F.min("frame").alias("f_start"), (F.max("frame") + 1).alias("f_end"), (F.max("x") / 60).alias("score"), F.max_by("frame", F.struct("x", -F.col("frame"))).alias("peak_frame")).drop("run")


@query("true_runs", "SELECT video_id, track_id, min(frame) AS f0, max(frame) AS f1, count(*) AS n FROM isl GROUP BY video_id, track_id, run HAVING count(*) >= 2", T.OBS, ISL)
def _(spark, sf):
    r = N.islands(T.observations(spark, sf), T.TRACK, F.col("x") > 60)
    return r.groupBy(*T.TRACK, "run").agg(F.min("frame").alias("f0"), F.max("frame").alias("f1"), F.count("*").alias("n")).where("n >= 2").drop("run")


@query("longest_run", """
r AS (SELECT video_id, track_id, min(frame) AS f0, max(frame) AS f1, count(*) AS n FROM isl GROUP BY video_id, track_id, run)
SELECT video_id, track_id, f0, f1, n FROM r QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY n DESC, f0) = 1
""", T.OBS, ISL)  # fmt: skip
def _(spark, sf):
    r = N.islands(T.observations(spark, sf), T.TRACK, F.col("x") > 60).groupBy(*T.TRACK, "run").agg(F.min("frame").alias("f0"), F.max("frame").alias("f1"), F.count("*").alias("n"))
    best = r.groupBy(*T.TRACK).agg(F.max_by(F.struct("f0", "f1", "n"), F.struct("n", -F.col("f0"))).alias("b"))
    return best.select(*T.TRACK, "b.*")


COAST = """brk AS (SELECT *, sum(CASE WHEN valid THEN 0 ELSE 1 END + CASE WHEN gap > 48 THEN 1 ELSE 0 END) OVER (PARTITION BY track_id ORDER BY frame) AS run FROM (
  SELECT *, NOT (x < 3 OR x > 97 OR y < 3 OR y > 97) AS valid, coalesce(frame - lag(frame) OVER (PARTITION BY track_id ORDER BY frame), 0) AS gap FROM kin))"""
COAST_VIEWS = (T.OBS, T.GRID, M.GKIN, COAST)


@T.view("kin")
def grid_kin(spark, sf):
    return K.kinematics(T.grid(spark, sf), T.track_window())


def coasts(spark, sf):
    """Rows of the coast runs: away from the border, unbroken by gaps."""
    return N.broken_runs(grid_kin(spark, sf), T.TRACK, ~G.at_border(F.col("x"), F.col("y"), 100, 100), "frame", F.lit(48))


@query("coast_segments", "SELECT video_id, track_id, min(frame) AS f0, max(frame) AS f1, count(*) AS n, round(avg(speed), 6) AS avg_speed, avg(y) > 50 AS ground FROM brk WHERE valid GROUP BY video_id, track_id, run HAVING count(*) >= 5", *COAST_VIEWS)
def _(spark, sf):
    g = coasts(spark, sf).groupBy(*T.TRACK, "run").agg(F.min("frame").alias("f0"), F.max("frame").alias("f1"), F.count("*").alias("n"), F.round(F.avg("speed"), 6).alias("avg_speed"), (F.avg("y") > 50).alias("ground"))
    return g.where("n >= 5").drop("run")


TOUCH = "touch AS (SELECT *, CASE WHEN areas - inter > 1e-6 THEN inter / (areas - inter) ELSE 0 END AS iou FROM iou WHERE inter > 0 OR sqrt(gx * gx + gy * gy) <= 6)"
EDGE = """ranks AS (SELECT video_id, frame, row_number() OVER (PARTITION BY video_id ORDER BY frame) AS r FROM (SELECT DISTINCT video_id, frame FROM grid)),
edge AS (SELECT * FROM (SELECT touch.*, r, lag(r) OVER (PARTITION BY touch.video_id, track_a, track_b ORDER BY touch.frame) AS p FROM touch JOIN ranks ON touch.video_id = ranks.video_id AND touch.frame = ranks.frame) WHERE p IS NULL OR p != r - 1)"""
EDGE_VIEWS = (T.OBS, T.GRID, M.PAIRS, M.IOU, TOUCH, EDGE)


@T.view("touching")
def touching(spark, sf, points=None, keep=(), near_px=6.0):
    """Pairs of boxes that overlap or lie within ``near_px``; ``points`` (default: the grid) may carry more columns."""
    p = J.track_pairs(T.grid(spark, sf) if points is None else points, ["x", "y", *keep])
    p = p.withColumns({"iou": G.box_iou(*M._boxes()), "gap": G.box_gap(*M._boxes())})
    return p.where((F.col("iou") > 0) | (F.col("gap") <= near_px))


@T.view("contacts")
def contacts(spark, sf, near_px=6.0):
    return N.rising_edges(touching(spark, sf, near_px=near_px), T.grid(spark, sf), "video_id", ["track_a", "track_b"])


@query("contact_rising_edges", "SELECT video_id, frame, track_a, track_b, iou FROM edge", *EDGE_VIEWS)
def _(spark, sf, near_px=6.0):
    return contacts(spark, sf, near_px).select("video_id", "frame", "track_a", "track_b", "iou")


@query("proximity_contacts", """
near AS (SELECT * FROM pairs WHERE sqrt(dx * dx + dy * dy) <= 24)
SELECT video_id, frame, track_a, track_b FROM (SELECT n.video_id, n.frame, track_a, track_b, r, lag(r) OVER (PARTITION BY n.video_id, track_a, track_b ORDER BY n.frame) AS p FROM near n
  JOIN (SELECT video_id, frame, row_number() OVER (PARTITION BY video_id ORDER BY frame) AS r FROM (SELECT DISTINCT video_id, frame FROM grid)) k ON n.video_id = k.video_id AND n.frame = k.frame) WHERE p IS NULL OR p != r - 1
""", T.OBS, T.GRID, M.PAIRS)  # fmt: skip
def _(spark, sf):
    p = M.pairs(spark, sf).where(K.norm(F.col("x_a") - F.col("x_b"), F.col("y_a") - F.col("y_b")) <= 24)
    return N.rising_edges(p, T.grid(spark, sf), "video_id", ["track_a", "track_b"]).select("video_id", "frame", "track_a", "track_b")


EPI = """epi AS (SELECT video_id, track_a, track_b, min(frame) AS f_start, max(frame) AS f_end, count(*) AS n, max(iou) AS peak, arg_max(frame, (iou, -frame)) AS peak_frame FROM (
  SELECT *, sum(new) OVER (PARTITION BY video_id, track_a, track_b ORDER BY frame) AS s FROM (
    SELECT *, CASE WHEN frame - lag(frame) OVER (PARTITION BY video_id, track_a, track_b ORDER BY frame) > 48 THEN 1 ELSE 0 END AS new FROM touch)) GROUP BY video_id, track_a, track_b, s)"""
EPI_VIEWS = (T.OBS, T.GRID, M.PAIRS, M.IOU, TOUCH, EPI)


def contact_episodes(spark, sf):
    return N.episodes(touching(spark, sf), ["video_id", "track_a", "track_b"], "iou", F.lit(48))


@query("contact_episodes", "SELECT * FROM epi", *EPI_VIEWS)
def _(spark, sf):
    return contact_episodes(spark, sf)


PART = """part_epi AS (SELECT video_id, track_a AS track_id, track_b AS partner_id, f_start, f_end FROM epi UNION ALL SELECT video_id, track_b, track_a, f_start, f_end FROM epi)"""
GFLAG = """gz AS (SELECT * FROM kin WHERE accel > 40)"""


def participants(spark, sf):
    """Each episode once for either of its tracks."""
    side = lambda a, b: F.struct(F.col(a).alias("track_id"), F.col(b).alias("partner_id"), "f_start", "f_end")
    return contact_episodes(spark, sf).select("video_id", F.inline(F.array(side("track_a", "track_b"), side("track_b", "track_a"))))


def jolts(spark, sf):
    return grid_kin(spark, sf).where("accel > 40").select(*T.TRACK, "frame", "accel")


NEARBY = "EXISTS (SELECT 1 FROM part_epi e WHERE e.track_id = g.track_id AND g.frame BETWEEN e.f_start - 72 AND e.f_end + 72)"


@query("near_event_semi", f"SELECT video_id, track_id, frame, accel FROM gz g WHERE {NEARBY}", *EPI_VIEWS, PART, M.GKIN, GFLAG)
def _(spark, sf):
    return J.near_events(jolts(spark, sf), participants(spark, sf), T.TRACK, 72, "left_semi")


@query("near_event_anti", f"SELECT video_id, track_id, frame, accel FROM gz g WHERE NOT {NEARBY}", *EPI_VIEWS, PART, M.GKIN, GFLAG)
def _(spark, sf):
    return J.near_events(jolts(spark, sf), participants(spark, sf), T.TRACK, 72, "left_anti")


@query("contact_gating", f"SELECT video_id, track_id, frame, {NEARBY} AS explained FROM gz g", *EPI_VIEWS, PART, M.GKIN, GFLAG)
def _(spark, sf):
    """Flags on a contact turn into impacts, the rest stay: one join answers both."""
    return J.flag_near_events(jolts(spark, sf), participants(spark, sf), T.TRACK, 72, "explained").select(*T.TRACK, "frame", "explained")


@query("nearest_impactor", """
spike AS (SELECT video_id, track_id, frame FROM gz), hit AS (SELECT DISTINCT video_id, frame FROM edge)
SELECT s.video_id, s.track_id, s.frame, arg_min(h.frame, abs(h.frame - s.frame) * 2 + CASE WHEN h.frame > s.frame THEN 1 ELSE 0 END) AS near_frame
FROM spike s LEFT JOIN hit h ON h.video_id = s.video_id AND abs(h.frame - s.frame) <= 12 GROUP BY ALL
""", *EDGE_VIEWS, M.GKIN, GFLAG)  # fmt: skip
def _(spark, sf):
    spikes = jolts(spark, sf).withColumn("pid", F.struct("track_id", "frame"))
    return J.nearest(spikes, contacts(spark, sf).select("video_id", "frame"), ["video_id"], 12, "pid").select(*T.TRACK, "frame", "near_frame")


@query("window_membership", "SELECT m.video_id, m.signal_type, m.frame_start, count(g.frame) AS n_in FROM mark m JOIN (SELECT video_id, CAST(floor(t * 60) AS BIGINT) AS frame FROM obs WHERE x > 90) g ON g.video_id = m.video_id AND g.frame BETWEEN m.frame_start AND m.frame_end GROUP BY ALL", *MARK_VIEWS)
def _(spark, sf):
    """Strong observations inside each marker: a range join by video and hour."""
    block = 60
    m = J.in_blocks(markers(spark, sf).select("video_id", "signal_type", "frame_start", "frame_end"), F.col("frame_start"), F.col("frame_end"), block)
    p = T.signals(spark, sf).where("score > 0.9").select("video_id", "frame", F.floor(F.col("frame") / block).cast("long").alias("__block"))
    hit = m.join(p, ["video_id", "__block"]).where("frame BETWEEN frame_start AND frame_end")
    return hit.groupBy("video_id", "signal_type", "frame_start").agg(F.count("frame").alias("n_in"))


@query("source_fallback", """
a AS (SELECT video_id, track_id, frame, 'tracker' AS source FROM obs WHERE event_type = 'purchase' AND video_id % 2 = 0), b AS (SELECT video_id, track_id, frame, 'flow' AS source FROM obs WHERE event_type = 'purchase')
SELECT * FROM a UNION ALL SELECT * FROM b WHERE video_id NOT IN (SELECT video_id FROM a)
""", T.OBS)  # fmt: skip
def _(spark, sf):
    o = T.observations(spark, sf).where("event_type = 'purchase'")
    a = o.where("video_id % 2 = 0").select(*T.TRACK, "frame", F.lit("tracker").alias("source"))
    return J.prefer(a, o.select(*T.TRACK, "frame", F.lit("flow").alias("source")), "video_id")


@query("grid_step", """
d AS (SELECT video_id, track_id, frame - lag(frame) OVER (PARTITION BY track_id ORDER BY frame) AS d FROM grid)
SELECT video_id, track_id, greatest(CAST(floor(coalesce(median(d), 1)) AS BIGINT), 1) AS grid_step FROM d GROUP BY 1, 2
""", T.OBS, T.GRID)  # fmt: skip
def _(spark, sf):
    return N.grid_step(T.grid(spark, sf), T.TRACK)


@query("common_frames", "SELECT DISTINCT a.frame FROM grid a WHERE a.track_id = 0 AND a.frame IN (SELECT frame FROM grid WHERE track_id = 1)", T.OBS, T.GRID)
def _(spark, sf):
    g = T.grid(spark, sf)
    return g.where("track_id = 0").select("frame").intersect(g.where("track_id = 1").select("frame"))


@query("violation_dedupe", """
r AS (SELECT track_id, frame, x AS score, row_number() OVER (PARTITION BY track_id ORDER BY frame) AS i FROM obs WHERE x > 70),
c AS (SELECT track_id, i, frame AS kf, score AS ks, 0 AS slot FROM r WHERE i = 1
  UNION ALL SELECT r.track_id, r.i, CASE WHEN r.frame - kf <= 3 AND r.score <= ks THEN kf ELSE r.frame END,
    CASE WHEN r.frame - kf <= 3 AND r.score <= ks THEN ks ELSE r.score END, CASE WHEN r.frame - kf <= 3 THEN slot ELSE slot + 1 END
  FROM c JOIN r ON r.track_id = c.track_id AND r.i = c.i + 1)
SELECT track_id, arg_max(kf, i) AS frame, arg_max(ks, i) AS score FROM c GROUP BY track_id, slot
""", "RECURSIVE " + T.OBS)  # fmt: skip
def _(spark, sf):
    v = T.observations(spark, sf).where("x > 70").select("track_id", "frame", F.col("x").alias("score"))
    return N.chain_dedupe(v, ["track_id"], 3)
