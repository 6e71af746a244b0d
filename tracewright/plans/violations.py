"""Scores of gravity, momentum, friction and fluid checks, their caps, corroboration and order."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracewright.functions import kinematics as K
from tracewright.functions import stats as S
from tracewright.operators import joins as J
from tracewright.operators import sessions as N
from tracewright.plans import contacts as C
from tracewright.plans import extras as X
from tracewright.plans import motion as M
from tracewright.plans import physics as P
from tracewright.plans.base import query
from tracewright.sources import tables as T
from tracewright.sources.bindings import Derived
from tracewright.sources.scratch import dealt

SEG = [*T.TRACK, "run"]
RATIO = 2.0


def ratio_score(r):
    return F.least(F.lit(1.0), 0.4 + (r - RATIO) / (2 * RATIO))


FALLING = """gk AS (SELECT f.*, v.vy FROM fitr f JOIN kin v ON v.track_id = f.track_id AND v.frame = f.frame WHERE f.a > 0 AND f.a * (f.t1 - f.t0) * (f.t1 - f.t0) / 8 >= 2),
gn AS (SELECT *, lead(vy) OVER (PARTITION BY video_id, track_id, run ORDER BY k) AS nvy FROM gk),
ga AS (SELECT *, min(CASE WHEN k >= 3 AND k <= size - 5 AND vy < 0 AND nvy >= 0 THEN k END) OVER (PARTITION BY video_id, track_id, run) AS apex FROM gn)"""
FALL_VIEWS = (*P.FIT_VIEWS, M.GKIN, FALLING)


def falling(spark, sf):
    """Rows of the segments that curve downward measurably, with the place of their apex (null if none)."""
    f = S.parabola_rows(P.flights(spark, sf), SEG).where("a > 0 AND a * (t1 - t0) * (t1 - t0) / 8 >= 2")
    g = f.join(C.grid_kin(spark, sf).select(*T.TRACK, "frame", "vy"), [*T.TRACK, "frame"])
    w = Window.partitionBy(*SEG)
    g = g.withColumn("nvy", F.lead("vy").over(w.orderBy("k")))
    top = (F.col("k") >= 3) & (F.col("k") <= F.col("size") - 5) & (F.col("vy") < 0) & (F.col("nvy") >= 0)
    return g.withColumn("apex", F.min(F.when(top, F.col("k"))).over(w)).select(*SEG, "k", "size", "t", "y", "apex")


@query("apex_asymmetry", """
leg AS (SELECT video_id, track_id, run * 2 + CASE WHEN k <= apex THEN 0 ELSE 1 END AS run, t, y FROM ga WHERE apex IS NOT NULL),
z AS (SELECT g.video_id, g.track_id, g.run, any_value(apex) AS apex_k, greatest(max(CASE WHEN k = apex THEN t END) - min(t), 1e-6) AS up, greatest(max(t) - max(CASE WHEN k = apex THEN t END), 1e-6) AS dn FROM ga g WHERE apex IS NOT NULL GROUP BY 1, 2, 3),
j AS (SELECT z.*, coalesce(u.a, 0) AS a_up, coalesce(d.a, 0) AS a_down, 16 / (up * up) AS fu, 16 / (dn * dn) AS fd FROM z LEFT JOIN lf u ON u.video_id = z.video_id AND u.track_id = z.track_id AND u.run = 2 * z.run LEFT JOIN lf d ON d.video_id = z.video_id AND d.track_id = z.track_id AND d.run = 2 * z.run + 1)
SELECT video_id, track_id, apex_k, round(a_up, 6) AS a_up, round(a_down, 6) AS a_down, round(CASE WHEN a_up < -fu OR a_down < -fd THEN 0.8::DOUBLE
  WHEN a_up >= fu AND a_down >= fd AND greatest(a_up, a_down) / least(a_up, a_down) > 2 THEN least(1, 0.4::DOUBLE + (greatest(a_up, a_down) / least(a_up, a_down) - 2) / 4) ELSE 0 END, 6) AS score FROM j
""".replace("z AS (", P.parabola_sql("leg", "lf") + ",\nz AS (", 1), *FALL_VIEWS)  # fmt: skip
def _(spark, sf):
    """Both legs of an arc bend downward by the same acceleration; a leg counts if its bend is measurable."""
    g = falling(spark, sf).where("apex IS NOT NULL")
    legs = S.parabola_fit(g.withColumn("leg", (F.col("k") > F.col("apex")).cast("int")), [*SEG, "leg"]).groupBy(*SEG).agg(*[F.coalesce(F.max(F.when(F.col("leg") == i, F.col("a"))), F.lit(0.0)).alias(n) for i, n in enumerate(("a_up", "a_down"))])
    at = F.max(F.when(F.col("k") == F.col("apex"), F.col("t")))
    z = g.groupBy(*SEG).agg(F.first("apex").alias("apex_k"), F.greatest(at - F.min("t"), F.lit(1e-6)).alias("up"), F.greatest(F.max("t") - at, F.lit(1e-6)).alias("dn"))
    u, d = F.col("a_up"), F.col("a_down")
    fu, fd = (8 * P.FLAT / (F.col(c) * F.col(c)) for c in ("up", "dn"))
    ratio = F.greatest(u, d) / F.least(u, d)
    score = F.when((u < -fu) | (d < -fd), 0.8).when((u >= fu) & (d >= fd) & (ratio > RATIO), ratio_score(ratio)).otherwise(F.lit(0.0))
    return z.join(legs, SEG).select(*T.TRACK, "apex_k", F.round(u, 6).alias("a_up"), F.round(d, 6).alias("a_down"), F.round(score, 6).alias("score"))


@query("inconsistent_accel", f"""
hv AS (SELECT video_id, track_id, run * 2 + CASE WHEN k < size // 2 THEN 0 ELSE 1 END AS run, t, y FROM ga WHERE apex IS NULL AND size >= 8),
{P.parabola_sql("hv", "hf")},
h AS (SELECT video_id, track_id, run // 2 AS r, coalesce(max(CASE WHEN run % 2 = 0 THEN a END), 0) AS a1, coalesce(max(CASE WHEN run % 2 = 1 THEN a END), 0) AS a2, max(r2) AS r2 FROM hf GROUP BY 1, 2, 3),
s AS (SELECT *, CASE WHEN least(a1, a2) <= 0 AND r2 >= 0.5 THEN 0.8::DOUBLE WHEN least(a1, a2) > 0 AND greatest(a1, a2) / least(a1, a2) > 2 THEN least(1, 0.4::DOUBLE + (greatest(a1, a2) / least(a1, a2) - 2) / 4) END AS score FROM h)
SELECT video_id, track_id, round(a1, 6) AS a1, round(a2, 6) AS a2, round(score, 6) AS score FROM s WHERE score IS NOT NULL
""", *FALL_VIEWS)  # fmt: skip
def _(spark, sf):
    """Without an apex the two halves of a fall share their acceleration."""
    g = falling(spark, sf).where("apex IS NULL AND size >= 8").withColumn("half", (F.col("k") >= F.floor(F.col("size") / 2)).cast("int"))
    h = S.parabola_fit(g, [*SEG, "half"]).where("a IS NOT NULL").groupBy(*SEG).agg(*[F.coalesce(F.max(F.when(F.col("half") == i, F.col("a"))), F.lit(0.0)).alias(n) for i, n in enumerate(("a1", "a2"))], F.max("r2").alias("r2"))
    low, ratio = F.least("a1", "a2"), F.greatest("a1", "a2") / F.least("a1", "a2")
    score = F.when((low <= 0) & (F.col("r2") >= 0.5), 0.8).when((low > 0) & (ratio > RATIO), ratio_score(ratio))
    return h.withColumn("score", F.round(score, 6)).where("score IS NOT NULL").select(*T.TRACK, F.round("a1", 6).alias("a1"), F.round("a2", 6).alias("a2"), "score")


@query("hover", """
h AS (SELECT *, speed > greatest(1, 0.15::DOUBLE * quantile_cont(speed, 0.75) OVER (PARTITION BY video_id, track_id)) AS moving, row_number() OVER (PARTITION BY video_id, track_id ORDER BY frame) AS pos FROM kin WHERE track_id % 2 = 0),
r AS (SELECT *, pos - row_number() OVER (PARTITION BY video_id, track_id ORDER BY frame) AS run FROM h WHERE NOT moving AND y < 90)
SELECT video_id, track_id, min(t) AS t0, max(t) AS t1, round(least(0.85, 0.45::DOUBLE + 0.15::DOUBLE * (max(t) - min(t)) / 24), 6) AS score FROM r GROUP BY video_id, track_id, run HAVING count(*) >= 4 AND max(t) - min(t) >= 24
""", T.OBS, T.GRID, M.GKIN)  # fmt: skip
def _(spark, sf):
    """Named tracks (even ids here) that stay put off the floor for long: four samples or more no faster than a
    share of the speed that three quarters of the samples stay under."""
    k = C.grid_kin(spark, sf).where("track_id % 2 = 0").withColumn("moving", F.col("speed") > F.greatest(F.lit(1.0), 0.15 * F.percentile("speed", 0.75).over(T.track())))
    r = N.islands(k, T.TRACK, ~F.col("moving") & (F.col("y") < 90)).groupBy(*SEG).agg(F.min("t").alias("t0"), F.max("t").alias("t1"), F.count("*").alias("n")).where("n >= 4 AND t1 - t0 >= 24")
    return r.select(*T.TRACK, "t0", "t1", F.round(F.least(F.lit(0.85), 0.45 + 0.15 * (F.col("t1") - F.col("t0")) / P.HOVER), 6).alias("score"))


@query("corroboration", """
u AS (SELECT track_id, t FROM gz UNION ALL SELECT track_id, t FROM rev)
SELECT f.video_id, f.track_id, f.t0, count(*) AS n_flags, round(least(1, f.score + 0.1::DOUBLE), 3) AS score FROM fv f JOIN u g ON g.track_id = f.track_id AND g.t BETWEEN f.t0 AND f.t1 WHERE f.score > 0 AND verdict != 'float' GROUP BY f.video_id, f.track_id, f.t0, f.score
""", *P.FIT_VIEWS, P.VERDICT, M.GKIN, C.GFLAG, P.SELF, P.SELF_Z, P.REVS)  # fmt: skip
def _(spark, sf):
    """Flags of acceleration or reversal inside a segment with a violation (a float is none yet) lift its own
    score once; they meet by track and day."""
    f = P.flight_verdict(P.flight_fits(spark, sf)).where("score > 0 AND verdict != 'float'").select(*T.TRACK, "t0", "t1", "score")
    f = J.in_blocks(f, F.col("t0"), F.col("t1"), 24)
    g = C.grid_kin(spark, sf).where("accel > 40").select(*T.TRACK, "t").unionByName(P.reversals(spark, sf).select(*T.TRACK, "t")).withColumn("__block", F.floor(F.col("t") / 24).cast("long"))
    j = f.join(g, [*T.TRACK, "__block"]).where("t BETWEEN t0 AND t1")
    return j.groupBy(*T.TRACK, "t0", "score").agg(F.count("*").alias("n_flags")).select(*T.TRACK, "t0", "n_flags", F.round(F.least(F.lit(1.0), F.col("score") + 0.1), 3).alias("score"))


@query("severity_caps", f"""
{X.VERD},
g AS (SELECT f.video_id, CAST(round_even(round(100 * max(f.score), 6), 0) AS BIGINT) AS raw, bool_or(coalesce(verd.v = 0, false)) AS confirmed FROM fv f LEFT JOIN verd ON verd.track_id = f.track_id GROUP BY 1),
n AS (SELECT video_id, count(DISTINCT track_id) AS tracks FROM grid GROUP BY 1)
SELECT g.video_id, raw, confirmed, CASE WHEN coherence > 0.75 AND tracks >= 3 THEN least(CASE WHEN confirmed THEN raw ELSE least(raw, 70) END, 50) WHEN NOT confirmed THEN least(raw, 70) ELSE raw END AS severity FROM g JOIN n USING (video_id) LEFT JOIN coh USING (video_id)
""", *P.FIT_VIEWS, P.VERDICT, M.GKIN, P.COHERENCE)  # fmt: skip
def _(spark, sf):
    """A video's gravity severity: 70 at most with nothing confirmed, 50 where all tracks move as one."""
    f = P.flight_verdict(P.flight_fits(spark, sf)).select(*T.TRACK, "score").join(X.verdicts(spark, sf).select("track_id", "v"), "track_id", "left")
    g = f.groupBy("video_id").agg(F.bround(F.round(100 * F.max("score"), 6)).cast("long").alias("raw"), F.max(F.coalesce(F.col("v") == 0, F.lit(False))).alias("confirmed"))
    n = T.grid(spark, sf).groupBy("video_id").agg(F.count_distinct("track_id").alias("tracks"))
    j = g.join(n, "video_id").join(P.coherence(spark, sf).select("video_id", "coherence"), "video_id", "left")
    capped = F.when(F.col("confirmed"), F.col("raw")).otherwise(F.least("raw", F.lit(70)))
    return j.select("video_id", "raw", "confirmed", F.when((F.col("coherence") > 0.75) & (F.col("tracks") >= 3), F.least(capped, F.lit(50))).otherwise(capped).cast("long").alias("severity"))


@query("verification_order", """
w AS (SELECT video_id, arg_max(t_start, (severity, -t_start)) - 0.5 AS lo, arg_max(t_end, (severity, -t_start)) + 0.5 AS hi FROM mark GROUP BY 1),
q AS (SELECT f.video_id, f.track_id, (f.t0 + f.t1) / 2 AS t, f.score, coalesce((f.t0 + f.t1) / 2 BETWEEN lo AND hi, false) AS inside FROM fv f LEFT JOIN w ON w.video_id = f.video_id WHERE f.score > 0)
SELECT video_id, track_id, round(t, 6) AS t, inside, CAST(row_number() OVER (PARTITION BY video_id ORDER BY inside DESC, score DESC, t, track_id) AS BIGINT) AS place FROM q QUALIFY place <= 4
""", T.OBS, T.GRID, P.FLIGHT, P.FIT, P.VERDICT, T.SIG, C.SESS, C.MARK)  # fmt: skip
def _(spark, sf):
    """What is checked first: candidates inside the suspected window, then by score."""
    worst = F.struct("severity", -F.col("t_start"))
    w = C.markers(spark, sf).groupBy("video_id").agg((F.max_by("t_start", worst) - 0.5).alias("lo"), (F.max_by("t_end", worst) + 0.5).alias("hi"))
    f = P.flight_verdict(P.flight_fits(spark, sf)).where("score > 0").select(*T.TRACK, ((F.col("t0") + F.col("t1")) / 2).alias("t"), "score").join(w, "video_id", "left")
    f = f.withColumn("inside", F.coalesce(F.col("t").between(F.col("lo"), F.col("hi")), F.lit(False)))
    order = Window.partitionBy("video_id").orderBy(F.desc("inside"), F.desc("score"), "t", "track_id")
    return f.withColumn("place", F.row_number().over(order).cast("long")).where("place <= 4").select(*T.TRACK, F.round("t", 6).alias("t"), "inside", "place")


@query("gravity_findings", f"""
{X.VERD}
SELECT video_id, track_id, verdict AS kind, t0 AS t, round(score, 6) AS score FROM fv WHERE verdict IN ('anti_gravity', 'non_parabolic_fall')
UNION ALL SELECT f.video_id, f.track_id, 'float', t0, round(score, 6) FROM fv f JOIN verd ON verd.track_id = f.track_id WHERE verdict = 'float' AND v = 0
UNION ALL SELECT video_id, track_id, 'vanish_gap', CAST(before AS DOUBLE), round(least(1, gap / 48.0::DOUBLE), 6) FROM (SELECT *, frame - lag(frame) OVER (PARTITION BY track_id ORDER BY frame) AS gap, lag(frame) OVER (PARTITION BY track_id ORDER BY frame) AS before FROM grid) WHERE gap > 24
""", *P.FIT_VIEWS, P.VERDICT)  # fmt: skip
def _(spark, sf):
    """Violations as they are, floats only if confirmed, and gaps in presence."""
    f = P.flight_verdict(P.flight_fits(spark, sf)).select(*T.TRACK, F.col("verdict").alias("kind"), F.col("t0").alias("t"), F.round("score", 6).alias("score"))
    floats = f.where("kind = 'float'").join(X.verdicts(spark, sf).where("v = 0").select("track_id"), "track_id", "left_semi").select(f.columns)
    g = T.grid(spark, sf).withColumn("before", F.lag("frame").over(T.track_window())).withColumn("gap", F.col("frame") - F.col("before")).where("gap > 24")
    gaps = g.select(*T.TRACK, F.lit("vanish_gap").alias("kind"), F.col("before").cast("double").alias("t"), F.round(F.least(F.lit(1.0), F.col("gap") / 48.0), 6).alias("score"))
    return f.where("kind IN ('anti_gravity', 'non_parabolic_fall')").unionByName(floats).unionByName(gaps)


def clip_sql(x: str) -> str:
    return f"least(greatest({x}, 0), 1)"


@query("momentum_score", f"""
SELECT f.video_id, f.track_id, CAST(round_even(round(100 * (0.30::DOUBLE * {clip_sql('vmax / 150')} + 0.20::DOUBLE * {clip_sql('vavg / 50')} + 0.15::DOUBLE * {clip_sql('weight / 3')} + 0.15::DOUBLE * {clip_sql('amax / 800')}
  + 0.10::DOUBLE * {clip_sql('path / 300')} + 0.05::DOUBLE * {clip_sql('curvature / 45')} + 0.05::DOUBLE * smoothness), 6), 0) AS BIGINT) AS score FROM fp f JOIN mass m ON m.track_id = f.track_id
""", T.OBS, M.KIN, P.FINGER, T.GRID, X.PIX, X.SHAPE, X.MASS)  # fmt: skip
def _(spark, sf):
    f, c = F.col, P.clip01
    s = 0.30 * c(f("vmax") / 150) + 0.20 * c(f("vavg") / 50) + 0.15 * c(f("weight") / 3) + 0.15 * c(f("amax") / 800) + 0.10 * c(f("path") / 300) + 0.05 * c(f("curvature") / 45) + 0.05 * f("smoothness")
    return P.fingerprints(spark, sf).join(X.mass_weights(spark, sf), T.TRACK).select(*T.TRACK, F.bround(F.round(100 * s, 6)).cast("long").alias("score"))


@query("friction_score", """
SELECT video_id, track_id, count(*) AS n_segments, CAST(sum(CASE WHEN expected = 'decelerate' THEN 1 ELSE 0 END) AS BIGINT) AS n_decel, round(avg(-slope), 6) AS avg_decel,
  coalesce(CAST(round_even(round(100 * avg(CASE WHEN expected = 'decelerate' AND slope <= 0 THEN r2 END), 6), 0) AS BIGINT), 50) AS friction_score FROM seg GROUP BY 1, 2
""", *P.SEG_VIEWS)  # fmt: skip
def _(spark, sf):
    """How well speed falls in a line where it should fall; 50 if nothing says."""
    r2 = F.avg(F.when((F.col("expected") == "decelerate") & (F.col("slope") <= 0), F.col("r2")))
    return P.segments(spark, sf).groupBy(*T.TRACK).agg(F.count("*").alias("n_segments"), F.sum((F.col("expected") == "decelerate").cast("long")).alias("n_decel"), F.round(F.avg(-F.col("slope")), 6).alias("avg_decel"), F.coalesce(F.bround(F.round(100 * r2, 6)).cast("long"), F.lit(50)).alias("friction_score"))


FLOWCHECK = """fc0 AS (SELECT video_id, track_id, run, frame, t, x, y, row_number() OVER (PARTITION BY video_id, track_id, run ORDER BY frame) - 1 AS i, count(*) OVER (PARTITION BY video_id, track_id, run) AS m FROM brk WHERE valid),
fc1 AS (SELECT video_id, track_id, run, m, max(x) - min(x) AS ex, max(y) - min(y) AS ey, arg_min(t, i) AS ta, arg_min(x, i) AS xa, arg_min(y, i) AS ya, max(CASE WHEN i = m // 2 THEN t END) AS tm, max(CASE WHEN i = m // 2 THEN x END) AS xm, max(CASE WHEN i = m // 2 THEN y END) AS ym, arg_max(t, i) AS tb, arg_max(x, i) AS xb, arg_max(y, i) AS yb FROM fc0 GROUP BY 1, 2, 3, 4),
fc AS (SELECT video_id, track_id, run, CASE WHEN m >= 3 AND ex >= 8 AND ey >= 8 THEN sqrt((xb-xm)*(xb-xm) + (yb-ym)*(yb-ym)) / (tb - tm) - sqrt((xm-xa)*(xm-xa) + (ym-ya)*(ym-ya)) / (tm - ta) END AS flow_slope FROM fc1)"""


def flow_slopes(spark, sf):
    """Of each coast run the change of speed between its halves, as flow between first, middle and last
    frame would show it; null with fewer than three frames or under 8 px of room."""
    w = Window.partitionBy(*SEG)
    g = C.coasts(spark, sf).withColumns({"i": F.row_number().over(w.orderBy("frame")) - 1, "m": F.count("*").over(w)})
    at = lambda c, cond: F.max(F.when(cond, F.col(c)))
    ends = {s: (F.col("i") == 0, F.col("i") == F.floor(F.col("m") / 2), F.col("i") == F.col("m") - 1)[k] for k, s in enumerate("amb")}
    a = g.groupBy(*SEG, "m").agg((F.max("x") - F.min("x")).alias("ex"), (F.max("y") - F.min("y")).alias("ey"), *[at(c, cond).alias(c + s) for s, cond in ends.items() for c in "txy"])
    speed = lambda p, q: K.norm(F.col("x" + q) - F.col("x" + p), F.col("y" + q) - F.col("y" + p)) / (F.col("t" + q) - F.col("t" + p))
    return a.select(*SEG, F.when((F.col("m") >= 3) & (F.col("ex") >= 8) & (F.col("ey") >= 8), speed("m", "b") - speed("a", "m")).alias("flow_slope"))


@query("flow_corroboration", """
v AS (SELECT * FROM seg WHERE expected != 'accelerate' AND slope_norm > 0.01),
j AS (SELECT v.*, (flow_slope <= 0) = (slope <= 0) AS agree, least(greatest(slope_norm / 0.02, 0), 1) * 0.85::DOUBLE AS s FROM v LEFT JOIN fc ON fc.video_id = v.video_id AND fc.track_id = v.track_id AND fc.run = v.run)
SELECT video_id, track_id, f0, f1, agree, round(CASE WHEN agree IS NOT DISTINCT FROM false THEN s * 0.6::DOUBLE ELSE s END, 6) AS score FROM j
""", *P.SEG_VIEWS, FLOWCHECK)  # fmt: skip
def _(spark, sf):
    """Self-acceleration joined to its segment's flow: disagreement takes two fifths off, silence nothing."""
    v = P.segments(spark, sf).where("expected != 'accelerate' AND slope_norm > 0.01").join(flow_slopes(spark, sf), SEG, "left")
    agree, s = (F.col("flow_slope") <= 0) == (F.col("slope") <= 0), 0.85 * P.clip01(F.col("slope_norm") / 0.02)
    return v.select(*T.TRACK, "f0", "f1", agree.alias("agree"), F.round(F.when(agree.eqNullSafe(F.lit(False)), s * 0.6).otherwise(s), 6).alias("score"))


PHASES = """ph AS (SELECT user_id AS track_id, event_id, least(greatest(value / 100 - 0.2, 0), 1) AS s0, least(greatest(value / 100 + CAST(regexp_extract(props, '[0-9]+') AS DOUBLE) / 100 - 0.3, 0), 1) AS s1,
  lower(trim(CASE event_type WHEN 'click' THEN ' Accelerate' WHEN 'view' THEN 'DECELERATE ' WHEN 'purchase' THEN 'constant' ELSE event_type END)) AS expected FROM events WHERE event_id % 7 < 2),
pk AS (SELECT * FROM ph WHERE expected IN ('accelerate', 'decelerate', 'constant') AND s1 > s0)"""


@query("phase_profile", """
r AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY s0, event_id) AS i, count(*) OVER (PARTITION BY track_id) AS n FROM pk)
SELECT track_id, i, CASE WHEN i = 1 THEN 0 ELSE s0 END AS start_frac, CASE WHEN i = n THEN 1 ELSE s1 END AS end_frac, expected FROM r
""", PHASES)  # fmt: skip
def _(spark, sf):
    """A told profile made usable: shares clipped, unknown and empty phases dropped, sorted, first and last
    stretched to the ends; a track without a phase left has no profile."""
    e = T.table(spark, sf, "events").where("event_id % 7 < 2")
    k = F.regexp_extract("props", "[0-9]+", 0).cast("double")
    name = F.when(F.col("event_type") == "click", " Accelerate").when(F.col("event_type") == "view", "DECELERATE ").when(F.col("event_type") == "purchase", "constant").otherwise(F.col("event_type"))
    p = e.select(F.col("user_id").alias("track_id"), "event_id", P.clip01(F.col("value") / 100 - 0.2).alias("s0"), P.clip01(F.col("value") / 100 + k / 100 - 0.3).alias("s1"), F.lower(F.trim(name)).alias("expected"))
    p = p.where("expected IN ('accelerate', 'decelerate', 'constant') AND s1 > s0")
    w = Window.partitionBy("track_id")
    p = p.withColumns({"i": F.row_number().over(w.orderBy("s0", "event_id")).cast("long"), "n": F.count("*").over(w)})
    return p.select("track_id", "i", F.when(F.col("i") == 1, F.lit(0.0)).otherwise(F.col("s0")).alias("start_frac"), F.when(F.col("i") == F.col("n"), F.lit(1.0)).otherwise(F.col("s1")).alias("end_frac"), "expected")


#: Cells of the velocity field.
CELL = 20


def _slope_sql(v: str, over: str, at: str) -> str:
    """The difference of neighbouring cells: central where both are there, one-sided, or 0."""
    low, high = f"lag({at}) OVER {over} = {at} - 1", f"lead({at}) OVER {over} = {at} + 1"
    return f"CASE WHEN {low} AND {high} THEN (lead({v}) OVER {over} - lag({v}) OVER {over}) / 2 WHEN {high} THEN lead({v}) OVER {over} - {v} WHEN {low} THEN {v} - lag({v}) OVER {over} ELSE 0 END"


#: Bulk flow of a video's tracked pixels, hour by hour: the means of the velocity field by cell and of its divergence.
REGION = f"""fcell AS (SELECT video_id, frame, CAST(floor(least(greatest(x, 0), 99) / {CELL}) AS BIGINT) AS cx, CAST(floor(least(greatest(y, 0), 99) / {CELL}) AS BIGINT) AS cy, avg(vx) AS u, avg(vy) AS v FROM kin GROUP BY 1, 2, 3, 4),
fgrad AS (SELECT *, {_slope_sql('u', 'r', 'cx')} + {_slope_sql('v', 'c', 'cy')} AS d FROM fcell WINDOW r AS (PARTITION BY video_id, frame, cy ORDER BY cx), c AS (PARTITION BY video_id, frame, cx ORDER BY cy)),
rg AS (SELECT video_id, frame, avg(sqrt(u * u + v * v)) AS speed, avg(u) AS u, avg(v) AS v, avg(abs(d)) / greatest(avg(sqrt(u * u + v * v)), 0.05) AS div FROM fgrad GROUP BY 1, 2),
rj AS (SELECT *, median(speed) OVER (PARTITION BY video_id) AS base, CASE WHEN frame - lag(frame) OVER (PARTITION BY video_id ORDER BY frame) = 1 THEN sqrt(pow(u - lag(u) OVER (PARTITION BY video_id ORDER BY frame), 2) + pow(v - lag(v) OVER (PARTITION BY video_id ORDER BY frame), 2)) / greatest(speed, 0.05) ELSE 0 END AS jump FROM rg),
splash AS (SELECT * FROM rj WHERE speed > 3 * greatest(base, 0.15) AND speed > 0.3),
imp AS (SELECT DISTINCT video_id, frame FROM edge)"""
REGION_VIEWS = (*C.EDGE_VIEWS, M.GKIN, REGION)


def slope(value: str, at: str, over: Window):
    """The difference of ``value`` between neighbouring cells along ``at``: central where both neighbours are
    there, one-sided where one is, else 0."""
    low, high = F.lag(at).over(over) == F.col(at) - 1, F.lead(at).over(over) == F.col(at) + 1
    before, after = F.lag(value).over(over), F.lead(value).over(over)
    return F.when(low & high, (after - before) / 2).when(high, after - F.col(value)).when(low, F.col(value) - before).otherwise(F.lit(0.0))


def velocity_field(kin, rows=None):
    """``video_id, frame, cx, cy, u, v, d``: each cell's mean velocity and the field's divergence there.

    Dealt by video once, a written table of ``rows`` rows in as many partitions as that asks for; cells, differences
    along rows and columns, and whatever is grouped by frame or ordered in a video afterwards stay in that partitioning."""
    at = lambda c: F.floor(F.least(F.greatest(F.col(c), F.lit(0.0)), F.lit(99.0)) / CELL).cast("long")
    points = kin.select("video_id", "frame", at("x").alias("cx"), at("y").alias("cy"), "vx", "vy")
    cells = (dealt(points, ["video_id"], rows) if rows is not None else points.repartition("video_id")).groupBy("video_id", "frame", "cx", "cy").agg(F.avg("vx").alias("u"), F.avg("vy").alias("v"))
    row, column = Window.partitionBy("video_id", "frame", "cy").orderBy("cx"), Window.partitionBy("video_id", "frame", "cx").orderBy("cy")
    return cells.withColumn("d", slope("u", "cx", row) + slope("v", "cy", column))


def region(spark, sf):
    """Mean speed, mean vector, divergence and jump of the bulk flow; a gap resets the jump."""
    kin = C.grid_kin(spark, sf)
    rows = kin.count() if isinstance(sf, Derived) and "kin" in sf.views else None  # written: its footers are counted
    k = velocity_field(kin, rows).groupBy("video_id", "frame").agg(F.avg(K.norm(F.col("u"), F.col("v"))).alias("speed"), F.avg("u").alias("u"), F.avg("v").alias("v"), F.avg(F.abs("d")).alias("d"))
    v, w = Window.partitionBy("video_id"), Window.partitionBy("video_id").orderBy("frame")
    floor = F.greatest("speed", F.lit(0.05))
    jump = F.when(F.col("frame") - F.lag("frame").over(w) == 1, K.norm(F.col("u") - F.lag("u").over(w), F.col("v") - F.lag("v").over(w)) / floor).otherwise(F.lit(0.0))
    return k.withColumns({"div": F.col("d") / floor, "jump": jump, "base": F.median("speed").over(v)}).drop("d")


def splashes(r):
    return r.where((F.col("speed") > 3 * F.greatest("base", F.lit(0.15))) & (F.col("speed") > 0.3))


@query("region_flow", "SELECT video_id, frame, round(speed, 6) AS speed, round(u, 6) AS u, round(v, 6) AS v, round(div, 6) AS div, round(jump, 6) AS jump FROM rj", T.OBS, T.GRID, M.GKIN, REGION.split(",\nsplash")[0])
def _(spark, sf):
    return region(spark, sf).select("video_id", "frame", *[F.round(c, 6).alias(c) for c in ("speed", "u", "v", "div", "jump")])


@query("incompressibility", f"SELECT video_id, frame, round(0.85::DOUBLE * {clip_sql('div / 4')}, 6) AS score FROM rj WHERE div > 2", T.OBS, T.GRID, M.GKIN, REGION.split(",\nsplash")[0])
def _(spark, sf):
    return region(spark, sf).where("div > 2").select("video_id", "frame", F.round(0.85 * P.clip01(F.col("div") / 4), 6).alias("score"))


@query("splash_timing", """
n AS (SELECT s.video_id, s.frame, arg_min(i.frame, abs(i.frame - s.frame) * 2 + CASE WHEN i.frame > s.frame THEN 1 ELSE 0 END) AS near FROM splash s LEFT JOIN imp i ON i.video_id = s.video_id AND abs(i.frame - s.frame) <= 6 GROUP BY 1, 2)
SELECT video_id, frame, near, CASE WHEN near IS NULL THEN 0.6::DOUBLE ELSE 0.7::DOUBLE END AS score FROM n WHERE near IS NULL OR near - frame > 0.1
""", *REGION_VIEWS)  # fmt: skip
def _(spark, sf):
    """Bursts of the flow with nothing that hits the fluid near them, or only afterwards."""
    sf = P.shared(spark, sf)
    s = splashes(region(spark, sf)).select("video_id", "frame").withColumn("pid", F.col("frame"))
    n = J.nearest(s, C.contacts(spark, sf).select("video_id", "frame"), ["video_id"], 6, "pid").where("near_frame IS NULL OR near_frame - frame > 0.1")
    return n.select("video_id", "frame", F.col("near_frame").alias("near"), F.when(F.col("near_frame").isNull(), 0.6).otherwise(0.7).alias("score"))


@query("flow_discontinuity", f"""
SELECT video_id, frame, round(0.75::DOUBLE * {clip_sql('jump / 4')}, 6) AS score FROM rj r WHERE jump > 2
  AND NOT EXISTS (SELECT 1 FROM splash s WHERE s.video_id = r.video_id AND abs(s.frame - r.frame) <= 6) AND NOT EXISTS (SELECT 1 FROM imp i WHERE i.video_id = r.video_id AND i.frame = r.frame)
""", *REGION_VIEWS)  # fmt: skip
def _(spark, sf, tolerance=2.0):
    """Jumps of the bulk flow that no splash nearby and no contact at the time explains."""
    sf = P.shared(spark, sf)
    r = region(spark, sf)
    at = lambda df: df.select("video_id", F.col("frame").alias("f_start"), F.col("frame").alias("f_end"))
    free = J.near_events(r.where(F.col("jump") > tolerance), at(splashes(r)), ["video_id"], 6, "left_anti")
    return free.join(C.contacts(spark, sf).select("video_id", "frame"), ["video_id", "frame"], "left_anti").select("video_id", "frame", F.round(0.75 * P.clip01(F.col("jump") / (2 * tolerance)), 6).alias("score"))


@query("ballistic_arc", f"""
l AS (SELECT video_id, track_id, run FROM (SELECT DISTINCT video_id, track_id, run, size, min(frame) OVER (PARTITION BY video_id, track_id, run) AS f0 FROM flight) QUALIFY row_number() OVER (PARTITION BY video_id, track_id ORDER BY size DESC, f0) = 1),
s AS (SELECT fit.*, 0.5::DOUBLE * {clip_sql('(0.6::DOUBLE - r2) / 0.6::DOUBLE')} + CASE WHEN a < -2 THEN 0.5::DOUBLE ELSE 0 END AS s FROM fit JOIN l USING (video_id, track_id, run) WHERE r2 < 0.6 OR a < -2)
SELECT video_id, track_id, t0, t1, round(r2, 6) AS r2, round(least(s, 1), 6) AS score FROM s
""", *P.FIT_VIEWS)  # fmt: skip
def _(spark, sf):
    """The longest airborne run of each path that fits no parabola or bends upward."""
    f = P.flights(spark, sf)
    best = f.groupBy(*SEG).agg(F.first("size").alias("size"), F.min("frame").alias("f0")).groupBy(*T.TRACK).agg(F.max_by("run", F.struct("size", -F.col("f0"))).alias("run"))
    fit = S.parabola_quality(f, SEG).join(best, SEG, "left_semi").where("r2 < 0.6 OR a < -2")
    score = 0.5 * P.clip01((0.6 - F.col("r2")) / 0.6) + F.when(F.col("a") < -2, 0.5).otherwise(F.lit(0.0))
    return fit.select(*T.TRACK, "t0", "t1", F.round("r2", 6).alias("r2"), F.round(F.least(score, F.lit(1.0)), 6).alias("score"))
