"""Fits and physical plausibility checks: gravity, collision, momentum, friction, causality."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracewright.functions import kinematics as K
from tracewright.functions import stats as S
from tracewright.operators import joins as J
from tracewright.operators import sessions as N
from tracewright.plans import contacts as C
from tracewright.plans import motion as M
from tracewright.plans.base import mad_sql, query
from tracewright.sources import tables as T
from tracewright.sources.bindings import Derived
from tracewright.sources.scratch import written

GP = "OVER (PARTITION BY video_id, track_id)"
GW = "OVER (PARTITION BY video_id, track_id ORDER BY frame)"


@query("linear_fit", """
f AS (SELECT track_id, count(*) AS n, max(t) - min(t) AS span, regr_slope(speed, t) AS s, regr_r2(speed, t) AS r FROM series GROUP BY 1)
SELECT track_id, n, CASE WHEN n >= 3 AND span > 1e-9 THEN round(s, 9) ELSE 0 END AS slope, CASE WHEN n >= 3 AND span > 1e-9 THEN round(greatest(0, least(1, coalesce(r, 0))), 9) ELSE 0 END AS r2 FROM f
""", T.SERIES)  # fmt: skip
def _(spark, sf):
    f = S.line_fit(T.series(spark, sf), ["track_id"], "t", "speed")
    return f.select("track_id", "n", F.round("slope", 9).alias("slope"), F.round("r2", 9).alias("r2"))


#: Free flight: runs of grid rows off the floor, of five rows at least.
FLIGHT = """fl0 AS (SELECT *, frame - 0 AS f, row_number() OVER (PARTITION BY video_id, track_id ORDER BY frame) AS pos FROM grid),
flight AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY video_id, track_id, run) AS size, row_number() OVER (PARTITION BY video_id, track_id, run ORDER BY frame) - 1 AS k FROM (
  SELECT *, pos - row_number() OVER (PARTITION BY video_id, track_id ORDER BY frame) AS run FROM fl0 WHERE y < 90)) WHERE size >= 5)"""


def parabola_sql(source: str, name: str, keys: str = "video_id, track_id, run") -> str:
    return f"""{name}0 AS (SELECT *, t - min(t) OVER (PARTITION BY {keys}) AS u, y - avg(y) OVER (PARTITION BY {keys}) AS yc FROM {source}),
{name}1 AS (SELECT {keys}, CAST(count(*) AS DOUBLE) AS n, min(t) AS t0, max(t) AS t1, sum(u) AS s1, sum(u*u) AS s2, sum(u*u*u) AS s3, sum(u*u*u*u) AS s4, sum(yc) AS y0, sum(u*yc) AS y1, sum(u*u*yc) AS y2, sum(yc*yc) AS yy FROM {name}0 GROUP BY {keys}),
{name}2 AS (SELECT *, n*(s2*s4-s3*s3) - s1*(s1*s4-s2*s3) + s2*(s1*s3-s2*s2) AS det FROM {name}1),
{name}3 AS (SELECT *, (y0*(s2*s4-s3*s3) - s1*(y1*s4-y2*s3) + s2*(y1*s3-y2*s2))/det AS c0, (n*(y1*s4-y2*s3) - y0*(s1*s4-s2*s3) + s2*(s1*y2-s2*y1))/det AS c1, (n*(s2*y2-s3*y1) - s1*(s1*y2-s2*y1) + y0*(s1*s3-s2*s2))/det AS c2 FROM {name}2 WHERE n >= 3 AND abs(det) > 1e-12),
{name}4 AS (SELECT *, greatest(yy - c0*y0 - c1*y1 - c2*y2, 0) AS res FROM {name}3),
{name} AS (SELECT {keys}, CAST(n AS BIGINT) AS n, t0, t1, 2*c2 AS a, CASE WHEN yy > 1e-9 THEN 1 - res/yy WHEN res < 1e-6 THEN 1 ELSE 0 END AS r2, sqrt(res/n) AS rms FROM {name}4)"""


def quality_sql(source: str, name: str, keys: str = "video_id, track_id, run") -> str:
    """``parabola_sql`` with the residuals' terms: ``{name}r`` has the rows, ``{name}`` the segments."""
    k = f"OVER (PARTITION BY {keys})"
    return f"""{name}0 AS (SELECT *, t - min(t) {k} AS u, y - avg(y) {k} AS yc FROM {source}),
{name}1 AS (SELECT *, CAST(count(*) {k} AS DOUBLE) AS n, min(t) {k} AS t0, max(t) {k} AS t1, greatest(max(y) {k} - min(y) {k}, 1) AS vspan, sum(u) {k} AS s1, sum(u*u) {k} AS s2, sum(u*u*u) {k} AS s3, sum(u*u*u*u) {k} AS s4, sum(yc) {k} AS y0, sum(u*yc) {k} AS y1, sum(u*u*yc) {k} AS y2, sum(yc*yc) {k} AS yy FROM {name}0),
{name}2 AS (SELECT *, n*(s2*s4-s3*s3) - s1*(s1*s4-s2*s3) + s2*(s1*s3-s2*s2) AS det FROM {name}1),
{name}3 AS (SELECT *, (y0*(s2*s4-s3*s3) - s1*(y1*s4-y2*s3) + s2*(y1*s3-y2*s2))/det AS c0, (n*(y1*s4-y2*s3) - y0*(s1*s4-s2*s3) + s2*(s1*y2-s2*y1))/det AS c1, (n*(s2*y2-s3*y1) - s1*(s1*y2-s2*y1) + y0*(s1*s3-s2*s2))/det AS c2 FROM {name}2 WHERE n >= 3 AND abs(det) > 1e-12),
{name}4 AS (SELECT *, yc - c0 - c1*u - c2*u*u AS res FROM {name}3),
{name}5 AS (SELECT *, sum(res*res) {k} AS sq, abs(res - lag(res) OVER (PARTITION BY {keys} ORDER BY t)) AS res_step FROM {name}4),
{name}r AS (SELECT *, 2*c2 AS a, CASE WHEN yy > 1e-9 THEN 1 - sq/yy WHEN sq < 1e-6 THEN 1 ELSE 0 END AS r2, sqrt(sq/n) AS rms FROM {name}5),
{name} AS (SELECT {keys}, CAST(any_value(n) AS BIGINT) AS n, any_value(t0) AS t0, any_value(t1) AS t1, any_value(a) AS a, any_value(r2) AS r2, any_value(rms) AS rms, any_value(rms) / any_value(vspan) AS rms_frac, coalesce(max(res_step), 0) / any_value(vspan) AS jump_frac, arg_max(t, (round(abs(res), 9), -t)) AS t_worst FROM {name}r GROUP BY {keys})"""


FIT = quality_sql("flight", "fit")
FIT_VIEWS = (T.OBS, T.GRID, FLIGHT, FIT)


def flights(spark, sf):
    r = N.islands(T.grid(spark, sf), T.TRACK, F.col("y") < 90)
    w = Window.partitionBy(*T.TRACK, "run")
    return r.withColumns({"size": F.count("*").over(w), "k": (F.row_number().over(w.orderBy("frame")) - 1).cast("long")}).where("size >= 5")


def flight_fits(spark, sf):
    return S.parabola_quality(flights(spark, sf), [*T.TRACK, "run"])


@query("parabola_fit", "SELECT video_id, track_id, n, t0, t1, round(a, 6) AS a, round(r2, 6) AS r2, round(rms, 6) AS rms, round(rms_frac, 6) AS rms_frac, round(jump_frac, 6) AS jump_frac, t_worst FROM fit", *FIT_VIEWS)
def _(spark, sf):
    f = flight_fits(spark, sf)
    return f.select(*T.TRACK, "n", "t0", "t1", *[F.round(c, 6).alias(c) for c in ("a", "r2", "rms", "rms_frac", "jump_frac")], "t_worst")


#: Curvature under FLAT over a segment says nothing; see the rules in ``flight_verdict``.
FLAT, R2_MIN, HOVER = 2.0, 0.6, 24.0


def flight_verdict(f, r2_min=R2_MIN):
    """Score of a free-flight segment: upward curvature that is clear and fits well is anti-gravity, no or
    weak curvature over a long time a float, downward curvature whose fit, residuals or largest residual
    step are bad not a parabola. ``ballistic``: it falls, and fits, whatever its residuals."""
    span = F.col("t1") - F.col("t0")
    f = f.withColumn("curv", F.abs("a") * span * span / 8)
    q = F.greatest((F.lit(r2_min) - F.col("r2")) / 0.25, (F.col("rms_frac") - 0.06) / 0.1, (F.col("jump_frac") - 0.08) / 0.1)
    floaty = F.least(F.lit(0.85), 0.45 + 0.15 * span / HOVER)
    kind = (
        F.when((F.col("curv") < FLAT) & (span >= HOVER), "float").when(F.col("curv") < FLAT, "none")
        .when((F.col("a") < 0) & (F.col("curv") >= 3 * FLAT) & (F.col("r2") >= 0.7), "anti_gravity")
        .when((F.col("a") < 0) & (span >= HOVER), "float").when(F.col("a") < 0, "none")
        .when(q > 0.05, "non_parabolic_fall").otherwise("ballistic")
    )
    score = F.when(kind == "float", floaty).when(kind == "anti_gravity", F.lit(0.85)).when(kind == "non_parabolic_fall", F.least(F.lit(1.0), q)).otherwise(F.lit(0.0))
    return f.withColumns({"verdict": kind, "score": score, "ballistic": (F.col("curv") >= FLAT) & (F.col("a") > 0) & (F.col("r2") >= r2_min)})


VERDICT = """fv0 AS (SELECT *, t1 - t0 AS span, abs(a) * (t1 - t0) * (t1 - t0) / 8 AS curv, greatest((0.6::DOUBLE - r2) / 0.25::DOUBLE, (rms_frac - 0.06::DOUBLE) / 0.1::DOUBLE, (jump_frac - 0.08::DOUBLE) / 0.1::DOUBLE) AS q FROM fit),
fv1 AS (SELECT *, CASE WHEN curv < 2 AND span >= 24 THEN 'float' WHEN curv < 2 THEN 'none' WHEN a < 0 AND curv >= 6 AND r2 >= 0.7 THEN 'anti_gravity'
  WHEN a < 0 AND span >= 24 THEN 'float' WHEN a < 0 THEN 'none' WHEN q > 0.05 THEN 'non_parabolic_fall' ELSE 'ballistic' END AS verdict, curv >= 2 AND a > 0 AND r2 >= 0.6 AS ballistic FROM fv0),
fv AS (SELECT *, CASE verdict WHEN 'float' THEN least(0.85, 0.45::DOUBLE + 0.15::DOUBLE * span / 24) WHEN 'anti_gravity' THEN 0.85 WHEN 'non_parabolic_fall' THEN least(1, q) ELSE 0 END::DOUBLE AS score FROM fv1)"""


@query("free_flight_checks", "SELECT video_id, track_id, t0, t1, verdict, round(score, 6) AS score FROM fv", *FIT_VIEWS, VERDICT)
def _(spark, sf, r2_min=R2_MIN):
    return flight_verdict(flight_fits(spark, sf), r2_min).select(*T.TRACK, "t0", "t1", "verdict", F.round("score", 6).alias("score"))


HALF = "half AS (SELECT video_id, track_id, run * 2 + CASE WHEN k < size // 2 THEN 0 ELSE 1 END AS run, t, y FROM flight WHERE size >= 8)"


@query("halves_check", """
h AS (SELECT video_id, track_id, run // 2 AS r, max(CASE WHEN run % 2 = 0 THEN a END) AS a1, max(CASE WHEN run % 2 = 1 THEN a END) AS a2, max(r2) AS r2 FROM hfit GROUP BY 1, 2, 3)
SELECT video_id, track_id, round(a1, 6) AS a1, round(a2, 6) AS a2, CASE WHEN least(a1, a2) <= 0 AND r2 >= 0.5 THEN 'sign_flip' WHEN least(a1, a2) > 0 AND greatest(a1, a2) / least(a1, a2) > 2 THEN 'ratio' ELSE 'none' END AS verdict
FROM h WHERE a1 IS NOT NULL AND a2 IS NOT NULL
""", T.OBS, T.GRID, FLIGHT, HALF, parabola_sql("half", "hfit"))  # fmt: skip
def _(spark, sf):
    h = flights(spark, sf).where("size >= 8").withColumn("half", (F.col("k") >= F.floor(F.col("size") / 2)).cast("int"))
    f = S.parabola_fit(h, [*T.TRACK, "run", "half"]).where("a IS NOT NULL")
    p = f.groupBy(*T.TRACK, "run").agg(F.max(F.when(F.col("half") == 0, F.col("a"))).alias("a1"), F.max(F.when(F.col("half") == 1, F.col("a"))).alias("a2"), F.max("r2").alias("r2")).where("a1 IS NOT NULL AND a2 IS NOT NULL")
    low, high = F.least("a1", "a2"), F.greatest("a1", "a2")
    verdict = F.when((low <= 0) & (F.col("r2") >= 0.5), "sign_flip").when((low > 0) & (high / low > 2), "ratio").otherwise("none")
    return p.select(*T.TRACK, F.round("a1", 6).alias("a1"), F.round("a2", 6).alias("a2"), verdict.alias("verdict"))


APEX = f"""gk AS (SELECT f.video_id, f.track_id, f.run, f.k, f.size, f.t, f.y, v.vy, lead(v.vy) OVER (PARTITION BY f.video_id, f.track_id, f.run ORDER BY f.k) AS nvy FROM flight f JOIN kin v ON v.track_id = f.track_id AND v.frame = f.frame),
apex AS (SELECT video_id, track_id, run, min(k) AS apex FROM gk WHERE k >= 3 AND k <= size - 5 AND vy < 0 AND nvy >= 0 GROUP BY 1, 2, 3)"""


@query("apex_legs", "SELECT g.video_id, g.track_id, any_value(apex) AS apex_k, round(max(CASE WHEN k = apex THEN t END) - min(t), 9) AS rise, round(max(t) - max(CASE WHEN k = apex THEN t END), 9) AS fall FROM gk g JOIN apex a ON g.track_id = a.track_id AND g.run = a.run GROUP BY g.video_id, g.track_id, g.run", T.OBS, T.GRID, FLIGHT, M.GKIN, APEX)
def _(spark, sf):
    w = Window.partitionBy(*T.TRACK, "run").orderBy("k")
    g = flights(spark, sf).join(C.grid_kin(spark, sf).select(*T.TRACK, "frame", "vy"), [*T.TRACK, "frame"]).withColumn("nvy", F.lead("vy").over(w))
    top = (F.col("k") >= 3) & (F.col("k") <= F.col("size") - 5) & (F.col("vy") < 0) & (F.col("nvy") >= 0)
    a = g.groupBy(*T.TRACK, "run").agg(F.min(F.when(top, F.col("k"))).alias("apex_k"), F.min_by(F.col("t"), F.when(top, F.col("k"))).alias("ta"), F.min("t").alias("t0"), F.max("t").alias("t1")).where("apex_k IS NOT NULL")
    return a.select(*T.TRACK, "apex_k", F.round(F.col("ta") - F.col("t0"), 9).alias("rise"), F.round(F.col("t1") - F.col("ta"), 9).alias("fall"))


@query("galileo_pairs", """
b AS (SELECT * FROM fv WHERE ballistic)
SELECT p.video_id, p.track_id AS track_a, q.track_id AS track_b, round(greatest(p.a, q.a) / least(p.a, q.a), 6) AS ratio, round(least(1, 0.3::DOUBLE + 0.7::DOUBLE * (greatest(p.a, q.a) / least(p.a, q.a) - 1.5) / 3), 6) AS score FROM b p JOIN b q ON p.video_id = q.video_id AND p.track_id < q.track_id
  AND least(p.t1, q.t1) - greatest(p.t0, q.t0) >= 0.25 WHERE least(p.a, q.a) > 0 AND greatest(p.a, q.a) / least(p.a, q.a) > 1.5
""", *FIT_VIEWS, VERDICT)  # fmt: skip
def _(spark, sf):
    """Two falls at once must share their acceleration; overlapping pairs meet by video and day."""
    day = 24
    b = flight_verdict(flight_fits(spark, sf)).where("ballistic").select(*T.TRACK, "t0", "t1", "a")
    s = J.in_blocks(b, F.col("t0"), F.col("t1"), day)
    p, q = (s.select("video_id", "__block", *[F.col(c).alias(f"{c}_{x}") for c in ("track_id", "t0", "t1", "a")]) for x in "pq")
    overlap = F.least("t1_p", "t1_q") - F.greatest("t0_p", "t0_q")
    j = p.join(q, ["video_id", "__block"]).where((F.col("track_id_p") < F.col("track_id_q")) & (overlap >= 0.25))
    j = j.where(F.floor(F.greatest("t0_p", "t0_q") / day) == F.col("__block"))  # each pair in its first common block only
    ratio = F.greatest("a_p", "a_q") / F.least("a_p", "a_q")
    return j.where(ratio > 1.5).select("video_id", F.col("track_id_p").alias("track_a"), F.col("track_id_q").alias("track_b"), F.round(ratio, 6).alias("ratio"), F.round(F.least(F.lit(1.0), 0.3 + 0.7 * (ratio - 1.5) / 3), 6).alias("score"))


COHERENCE = """cp AS (SELECT a.video_id, a.track_id AS ta, b.track_id AS tb, a.vx AS xa, b.vx AS xb, a.vy AS ya, b.vy AS yb FROM kin a JOIN kin b ON a.video_id = b.video_id AND a.frame = b.frame AND a.track_id < b.track_id),
cs AS (SELECT video_id, ta, tb, xa AS u, xb AS v FROM cp UNION ALL SELECT video_id, ta, tb, ya, yb FROM cp),
cc AS (SELECT video_id, ta, tb, corr(u, v) AS r FROM cs GROUP BY 1, 2, 3 HAVING count(*) >= 12 AND stddev_pop(u) > 1e-6 AND stddev_pop(v) > 1e-6),
coh AS (SELECT video_id, median(r) AS coherence, count(*) AS n FROM cc GROUP BY 1)"""


def coherence(spark, sf):
    """The median over pairs of tracks of the correlation of their velocities (x and y as one series)."""
    p = J.track_pairs(C.grid_kin(spark, sf), ["vx", "vy"])  # grid and kinematics once, a frame's tracks paired in place
    s = p.select("video_id", "track_a", "track_b", F.inline(F.array(F.struct(F.col("vx_a").alias("u"), F.col("vx_b").alias("v")), F.struct(F.col("vy_a").alias("u"), F.col("vy_b").alias("v")))))
    c = s.groupBy("video_id", "track_a", "track_b").agg(F.corr("u", "v").alias("r"), F.count("*").alias("m"), F.stddev_pop("u").alias("su"), F.stddev_pop("v").alias("sv")).where("m >= 12 AND su > 1e-6 AND sv > 1e-6")
    return c.groupBy("video_id").agg(F.median("r").alias("coherence"), F.count("*").alias("n"))


@query("coherence_corr", "SELECT video_id, round(coherence, 9) AS coherence, n FROM coh", T.OBS, T.GRID, M.GKIN, COHERENCE)
def _(spark, sf):
    return coherence(spark, sf).withColumn("coherence", F.round("coherence", 9))


PREPOST = """side AS (SELECT e.video_id, e.track_id, e.partner_id, e.f_start, e.f_end, k.frame < e.f_start AS pre, k.vx, k.vy,
  row_number() OVER (PARTITION BY e.track_id, e.partner_id, e.f_start, k.frame < e.f_start ORDER BY CASE WHEN k.frame < e.f_start THEN -k.frame ELSE k.frame END) AS rn
  FROM part_epi e JOIN kin k ON k.track_id = e.track_id AND (k.frame < e.f_start OR k.frame > e.f_end)),
pp AS (SELECT video_id, track_id, partner_id, f_start, f_end, median(vx) FILTER (pre) AS vx_in, median(vy) FILTER (pre) AS vy_in, median(vx) FILTER (NOT pre) AS vx_out, median(vy) FILTER (NOT pre) AS vy_out FROM side WHERE rn <= 3 GROUP BY ALL HAVING bool_or(pre) AND bool_or(NOT pre))"""
PP_VIEWS = (*C.EPI_VIEWS, C.PART, M.GKIN, PREPOST)


def around(kin):
    """``kin`` with the velocities of the three samples before each (``pre``) and after it (``post``)."""
    w = T.track_window()
    return kin.withColumns({"pre": F.collect_list(F.struct("vx", "vy")).over(w.rowsBetween(-3, -1)), "post": F.collect_list(F.struct("vx", "vy")).over(w.rowsBetween(1, 3))})


@T.view("touching")
def moving_touches(spark, sf):
    """Touching pairs with the velocities around each."""
    return C.touching(spark, sf, around(C.grid_kin(spark, sf)).select(*T.TRACK, "frame", "x", "y", "pre", "post"), ("pre", "post"))


def shared(spark, sf):
    """``sf`` with its kinematics, contacts and model answers computed and written once, for plans of many
    branches: one table of all that is ordered by track, one of touching pairs, one of contacts, one of answers."""
    if isinstance(sf, Derived):
        return sf
    g = T.with_gaps(spark, sf)
    kin = written(K.kinematics(turning(moving(g)), T.track_window()), "kinematics")
    b = Derived(sf, {"kin": kin, "self": kin, "grid": kin.select(*T.TRACK, "frame", "t", "x", "y")})
    b.views["touching"] = written(C.touching(spark, b, around(kin).select(*T.TRACK, "frame", "x", "y", "pre", "post"), ("pre", "post")), "touching")
    b.views["contacts"] = written(C.contacts(spark, b), "contacts")
    b.views["answers"] = written(T.answers(spark, sf), "answers")
    b.views["videos"] = kin.select("video_id")
    return b


def before_after(spark, sf):
    """Median velocities of the last three samples before and the first three after each episode.

    Each grid sample carries the three before and after it into the pairs, and an episode takes those of
    its first and last frame: grid and kinematics are computed once and nothing is joined back."""
    s = N.sessionize(moving_touches(spark, sf), ["video_id", "track_a", "track_b"], "frame", F.lit(48))
    first, last = (lambda c: F.min_by(c, "frame").alias(c)), (lambda c: F.max_by(c, "frame").alias(c))
    e = s.groupBy("video_id", "track_a", "track_b", "session").agg(F.min("frame").alias("f_start"), F.max("frame").alias("f_end"), first("pre_a"), last("post_a"), first("pre_b"), last("post_b"))
    side = lambda x, y: F.struct(F.col(f"track_{x}").alias("track_id"), F.col(f"track_{y}").alias("partner_id"), "f_start", "f_end", F.col(f"pre_{x}").alias("pre"), F.col(f"post_{x}").alias("post"))
    j = e.select("video_id", F.inline(F.array(side("a", "b"), side("b", "a")))).where((F.size("pre") > 0) & (F.size("post") > 0))

    def mid(col: str, part: str):
        v = F.array_sort(F.transform(F.col(col), lambda s: s[part]))
        n = F.size(v)
        return (F.get(v, F.floor((n - 1) / 2).cast("int")) + F.get(v, F.floor(n / 2).cast("int"))) / 2

    return j.select(*T.TRACK, "partner_id", "f_start", "f_end", mid("pre", "vx").alias("vx_in"), mid("pre", "vy").alias("vy_in"), mid("post", "vx").alias("vx_out"), mid("post", "vy").alias("vy_out"))


@query("pre_post_medians", "SELECT * FROM pp", *PP_VIEWS)
def _(spark, sf):
    return before_after(spark, sf)


@query("restitution", "SELECT video_id, track_id, partner_id, f_start, abs(vy_out) / greatest(abs(vy_in), 1e-6) AS e, abs(vy_out) / greatest(abs(vy_in), 1e-6) > 1.1 AS energy_gain, least(1, abs(vy_out) / greatest(abs(vy_in), 1e-6) - 1) AS score FROM pp WHERE vy_in >= 2 AND vy_out <= -0.4", *PP_VIEWS)
def _(spark, sf, restitution_max=1.1):
    e = F.abs("vy_out") / F.greatest(F.abs("vy_in"), F.lit(1e-6))
    return before_after(spark, sf).where("vy_in >= 2 AND vy_out <= -0.4").select(*T.TRACK, "partner_id", "f_start", e.alias("e"), (e > restitution_max).alias("energy_gain"), F.least(F.lit(1.0), e - 1).alias("score"))


@query("phantom_bounce", f"""
b AS (SELECT * FROM (SELECT *, lag(vy) {GW} AS bvy FROM kin) WHERE bvy > 2 AND vy < -2 AND y < 93)
SELECT video_id, track_id, frame, 0.8::DOUBLE AS score FROM b g WHERE NOT {C.NEARBY}
""", *C.EPI_VIEWS, C.PART, M.GKIN)  # fmt: skip
def _(spark, sf):
    k = C.grid_kin(spark, sf).withColumn("bvy", F.lag("vy").over(T.track_window())).where("bvy > 2 AND vy < -2 AND y < 93")
    return J.near_events(k, C.participants(spark, sf), T.TRACK, 72, "left_anti").select(*T.TRACK, "frame", F.lit(0.8).alias("score"))


FINGER = """fp0 AS (SELECT *, x - lag(x) OVER (PARTITION BY video_id, track_id ORDER BY frame) AS dx, y - lag(y) OVER (PARTITION BY video_id, track_id ORDER BY frame) AS dy FROM kin),
fp1 AS (SELECT *, sqrt(dx*dx + dy*dy) AS step, atan2(dy, dx) - lag(atan2(dy, dx)) OVER (PARTITION BY video_id, track_id ORDER BY frame) AS dh FROM fp0),
fp2 AS (SELECT *, abs(degrees(dh - 2 * pi() * floor((dh + pi()) / (2 * pi())))) AS turn FROM fp1),
fp AS (SELECT video_id, track_id, max(speed) AS vmax, avg(speed) AS vavg, max(accel) AS amax, sum(step) AS path,
  sqrt(pow(arg_max(x, frame) - arg_min(x, frame), 2) + pow(arg_max(y, frame) - arg_min(y, frame), 2)) AS net, max(y) - min(y) AS arc_height, max(x) - min(x) AS arc_range,
  arg_min(t, (y, frame)) - min(t) AS rise, max(t) - arg_min(t, (y, frame)) AS fall, coalesce(avg(turn) FILTER (step > 1), 0) AS curvature, 1 / (1 + sqrt(avg(jerk * jerk)) / 800) AS smoothness FROM fp2 GROUP BY 1, 2)"""


def fingerprints(spark, sf):
    """The motion signature of each track."""
    w = T.track_window()
    k = M.kin(spark, sf).withColumns({"dx": F.col("x") - F.lag("x").over(w), "dy": F.col("y") - F.lag("y").over(w)})
    k = k.withColumns({"step": K.norm(F.col("dx"), F.col("dy")), "h": F.atan2("dy", "dx")})
    d = F.col("h") - F.lag("h").over(w)
    turn = F.abs(F.degrees(F.col("dh") - 2 * F.pi() * F.floor((F.col("dh") + F.pi()) / (2 * F.pi()))))
    k = k.withColumn("dh", d).withColumn("turn", turn)
    end = lambda c: F.max_by(c, "frame") - F.min_by(c, "frame")
    top = F.min_by("t", F.struct("y", "frame"))
    return k.groupBy(*T.TRACK).agg(
        F.max("speed").alias("vmax"), F.avg("speed").alias("vavg"), F.max("accel").alias("amax"), F.sum("step").alias("path"), K.norm(end("x"), end("y")).alias("net"),
        (F.max("y") - F.min("y")).alias("arc_height"), (F.max("x") - F.min("x")).alias("arc_range"), (top - F.min("t")).alias("rise"), (F.max("t") - top).alias("fall"),
        F.coalesce(F.avg(F.when(F.col("step") > 1, F.col("turn"))), F.lit(0.0)).alias("curvature"), (1 / (1 + F.sqrt(F.avg(F.col("jerk") * F.col("jerk"))) / 800)).alias("smoothness"),
    )


SYM = "CASE WHEN least(rise, fall) > 0 THEN least(rise, fall) / greatest(rise, fall) ELSE 0 END"


@query("momentum_fingerprint", f"SELECT video_id, track_id, round(vmax, 4) AS vmax, round(vavg, 4) AS vavg, round(path, 4) AS path, round(net / greatest(path, 1e-6), 6) AS straightness, arc_height, arc_range, round({SYM}, 6) AS arc_symmetry, round(curvature, 5) AS curvature, round(smoothness, 6) AS smoothness FROM fp", T.OBS, M.KIN, FINGER)
def _(spark, sf):
    sym = F.when(F.least("rise", "fall") > 0, F.least("rise", "fall") / F.greatest("rise", "fall")).otherwise(F.lit(0.0))
    return fingerprints(spark, sf).select(*T.TRACK, F.round("vmax", 4).alias("vmax"), F.round("vavg", 4).alias("vavg"), F.round("path", 4).alias("path"), F.round(F.col("net") / F.greatest("path", F.lit(1e-6)), 6).alias("straightness"), "arc_height", "arc_range", F.round(sym, 6).alias("arc_symmetry"), F.round("curvature", 5).alias("curvature"), F.round("smoothness", 6).alias("smoothness"))


def clip01(x):
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def _c(x: str) -> str:
    return f"least(greatest({x}, 0), 1)"


JUMP = f"""mj AS (SELECT *, row_number() {GW} - 1 AS i, count(*) {GP} AS n, abs(speed - lag(speed) {GW}) / greatest(median(speed) {GP}, 0.15::DOUBLE * max(speed) {GP}, 2) AS jump, lag(vy) {GW} AS bvy FROM kin)"""
INNER = "i >= 2 AND i < n - 1 AND NOT (x < 3 OR x > 97 OR y < 3 OR y > 97)"


@query("momentum_jump", f"SELECT video_id, track_id, frame, jump, 0.8::DOUBLE * {_c('jump / 1.2')} AS score FROM mj g WHERE jump > 0.6 AND {INNER} AND NOT (vy > 2 AND vy >= bvy AND bvy > 0) AND NOT {C.NEARBY}", *C.EPI_VIEWS, C.PART, M.GKIN, JUMP)
def _(spark, sf, tolerance=0.6):
    w, p = T.track_window(), T.track()
    k = C.grid_kin(spark, sf).withColumns({
        "i": F.row_number().over(w) - 1, "n": F.count("*").over(p), "bvy": F.lag("vy").over(w),
        "jump": F.abs(F.col("speed") - F.lag("speed").over(w)) / F.greatest(F.median("speed").over(p), 0.15 * F.max("speed").over(p), F.lit(2.0)),
    }).where(f"jump > {float(tolerance)}D AND {INNER} AND NOT (vy > 2 AND vy >= bvy AND bvy > 0)")
    return J.near_events(k, C.participants(spark, sf), T.TRACK, 72, "left_anti").select(*T.TRACK, "frame", "jump", (0.8 * clip01(F.col("jump") / (2 * tolerance))).alias("score"))


@query("abrupt_stop", f"""
st AS (SELECT *, row_number() {GW} - 1 AS i, count(*) {GP} AS n, (lag(speed) {GW} - speed) / greatest(lag(speed) {GW}, 2) AS dropped FROM kin)
SELECT video_id, track_id, frame, dropped, 0.85::DOUBLE * {_c('dropped / 1.2')} AS score FROM st g WHERE dropped > 0.6 AND {INNER} AND NOT {C.NEARBY}
""", *C.EPI_VIEWS, C.PART, M.GKIN)  # fmt: skip
def _(spark, sf):
    w, p = T.track_window(), T.track()
    before = F.lag("speed").over(w)
    k = C.grid_kin(spark, sf).withColumns({"i": F.row_number().over(w) - 1, "n": F.count("*").over(p), "dropped": (before - F.col("speed")) / F.greatest(before, F.lit(2.0))}).where(f"dropped > 0.6 AND {INNER}")
    return J.near_events(k, C.participants(spark, sf), T.TRACK, 72, "left_anti").select(*T.TRACK, "frame", "dropped", (0.85 * clip01(F.col("dropped") / 1.2)).alias("score"))


@query("transfer_residual", """
a AS (SELECT * FROM pp WHERE track_id < partner_id), b AS (SELECT * FROM pp WHERE track_id > partner_id),
j AS (SELECT a.video_id, a.track_id AS track_a, a.partner_id AS track_b, a.f_start, a.vx_out - a.vx_in AS ax, a.vy_out - a.vy_in AS ay, b.vx_out - b.vx_in AS bx, b.vy_out - b.vy_in AS by_,
  sqrt(a.vx_in*a.vx_in + a.vy_in*a.vy_in) AS pa, sqrt(b.vx_in*b.vx_in + b.vy_in*b.vy_in) AS pb FROM a JOIN b ON a.track_id = b.partner_id AND a.partner_id = b.track_id AND a.f_start = b.f_start),
r AS (SELECT *, greatest(pa, pb, 2) AS scale FROM j),
m AS (SELECT *, sqrt((ax+bx)*(ax+bx) + (ay+by_)*(ay+by_)) / scale AS residual, sqrt(ax*ax + ay*ay) / scale AS ma, sqrt(bx*bx + by_*by_) / scale AS mb, greatest(pa, pb) / scale AS fast FROM r)
SELECT video_id, track_a, track_b, f_start, residual, fast > 0.6 AND greatest(ma, mb) > 0.8 AND least(ma, mb) < 0.15::DOUBLE * greatest(ma, mb) AS one_sided,
  0.9::DOUBLE * least(greatest(greatest(residual, ma, mb) / 1.6, 0), 1) AS score FROM m
""", *PP_VIEWS)  # fmt: skip
def _(spark, sf):
    p = before_after(spark, sf)
    side = lambda s, a, b: p.where("track_id < partner_id" if s == "a" else "track_id > partner_id").select("video_id", F.col(a).alias("track_a"), F.col(b).alias("track_b"), "f_start", (F.col("vx_out") - F.col("vx_in")).alias(f"{s}x"), (F.col("vy_out") - F.col("vy_in")).alias(f"{s}y"), K.norm(F.col("vx_in"), F.col("vy_in")).alias(f"p{s}"))
    j = side("a", "track_id", "partner_id").join(side("b", "partner_id", "track_id"), ["video_id", "track_a", "track_b", "f_start"])
    j = j.withColumn("scale", F.greatest("pa", "pb", F.lit(2.0)))
    j = j.withColumns({"residual": K.norm(F.col("ax") + F.col("bx"), F.col("ay") + F.col("by")) / F.col("scale"), "ma": K.norm(F.col("ax"), F.col("ay")) / F.col("scale"), "mb": K.norm(F.col("bx"), F.col("by")) / F.col("scale"), "fast": F.greatest("pa", "pb") / F.col("scale")})
    big, small = F.greatest("ma", "mb"), F.least("ma", "mb")
    one = (F.col("fast") > 0.6) & (big > 0.8) & (small < 0.15 * big)
    return j.select("video_id", "track_a", "track_b", "f_start", "residual", one.alias("one_sided"), (0.9 * clip01(F.greatest("residual", "ma", "mb") / 1.6)).alias("score"))


SEG = f"""seg0 AS (SELECT video_id, track_id, run, min(frame) AS f0, max(frame) AS f1, min(t) AS t0, max(t) AS t1, count(*) AS n, avg(speed) AS avg_speed, avg(y) AS avg_y, avg(vy) AS avg_vy, arg_max(vy, frame) >= arg_min(vy, frame) AS rising,
  CASE WHEN max(t) - min(t) > 1e-9 THEN regr_slope(speed, t) ELSE 0 END AS slope, CASE WHEN max(t) - min(t) > 1e-9 THEN greatest(0, least(1, coalesce(regr_r2(speed, t), 0))) ELSE 0 END::DOUBLE AS r2 FROM brk WHERE valid GROUP BY 1, 2, 3 HAVING count(*) >= 5 AND avg(speed) >= 2),
seg AS (SELECT *, slope / greatest(avg_speed, 2) AS slope_norm, CASE WHEN avg_vy > 2 AND rising THEN 'accelerate' WHEN avg_y > 50 THEN 'decelerate' ELSE 'constant' END AS expected FROM seg0)"""
SEG_VIEWS = (*C.COAST_VIEWS, SEG)


def segments(spark, sf):
    """Coast segments with their speed trend and what motion is expected of them."""
    g = C.coasts(spark, sf).groupBy(*T.TRACK, "run").agg(
        F.min("frame").alias("f0"), F.max("frame").alias("f1"), F.min("t").alias("t0"), F.max("t").alias("t1"), F.count("*").alias("n"), F.avg("speed").alias("avg_speed"), F.avg("y").alias("avg_y"),
        F.avg("vy").alias("avg_vy"), (F.max_by("vy", "frame") >= F.min_by("vy", "frame")).alias("rising"), F.when(F.max("t") - F.min("t") > 1e-9, F.regr_slope("speed", "t")).otherwise(F.lit(0.0)).alias("slope"),
        F.when(F.max("t") - F.min("t") > 1e-9, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.regr_r2("speed", "t"), F.lit(0.0))))).otherwise(F.lit(0.0)).alias("r2"),
    ).where("n >= 5 AND avg_speed >= 2")
    expected = F.when((F.col("avg_vy") > 2) & F.col("rising"), "accelerate").when(F.col("avg_y") > 50, "decelerate").otherwise("constant")
    return g.withColumns({"slope_norm": F.col("slope") / F.greatest("avg_speed", F.lit(2.0)), "expected": expected})


@query("expected_motion", "SELECT video_id, track_id, f0, f1, expected, round(slope_norm, 6) AS slope_norm FROM seg", *SEG_VIEWS)
def _(spark, sf):
    return segments(spark, sf).select(*T.TRACK, "f0", "f1", "expected", F.round("slope_norm", 6).alias("slope_norm"))


@query("no_friction", f"SELECT * FROM (SELECT video_id, track_id, f0, f1, round(0.8::DOUBLE * {_c('1 - abs(slope_norm) / 0.1')} * {_c('(t1 - t0) / 1')} * {_c('avg_speed / 6')}, 6) AS score FROM seg WHERE expected = 'decelerate' AND abs(slope_norm) < 0.1 AND avg_speed >= 6) WHERE score >= 0.12", *SEG_VIEWS)
def _(spark, sf, tolerance=0.1):
    s = segments(spark, sf).where(f"expected = 'decelerate' AND abs(slope_norm) < {float(tolerance)}D AND avg_speed >= 6")
    score = 0.8 * clip01(1 - F.abs("slope_norm") / tolerance) * clip01(F.col("t1") - F.col("t0")) * clip01(F.col("avg_speed") / 6)
    return s.select(*T.TRACK, "f0", "f1", F.round(score, 6).alias("score")).where("score >= 0.12")


@query("self_acceleration", f"SELECT * FROM (SELECT video_id, track_id, f0, f1, round(0.85::DOUBLE * {_c('slope_norm / 0.02')} * {_c('(t1 - t0) / 0.6')}, 6) AS score FROM seg WHERE expected != 'accelerate' AND slope_norm > 0.01) WHERE score >= 0.1275", *SEG_VIEWS)
def _(spark, sf):
    s = segments(spark, sf).where("expected != 'accelerate' AND slope_norm > 0.01")
    score = 0.85 * clip01(F.col("slope_norm") / 0.02) * clip01((F.col("t1") - F.col("t0")) / 0.6)
    return s.select(*T.TRACK, "f0", "f1", F.round(score, 6).alias("score")).where("score >= 0.1275")


PHASES = [(0.0, 0.3, "accelerate"), (0.25, 0.7, "constant"), (0.7, 1.0, "decelerate")]


@query("expected_phase", f"""
ph AS (SELECT * FROM (VALUES {', '.join(f"({a}::DOUBLE, {b}::DOUBLE, '{c}')" for a, b, c in PHASES)}) v(p0, p1, phase)),
fr AS (SELECT *, (t - min(t) OVER (PARTITION BY track_id)) / (max(t) OVER (PARTITION BY track_id) - min(t) OVER (PARTITION BY track_id)) AS frac FROM obs)
SELECT video_id, track_id, frame, arg_min(phase, p0) AS phase FROM fr JOIN ph ON frac BETWEEN p0 AND p1 GROUP BY 1, 2, 3
""", T.OBS)  # fmt: skip
def _(spark, sf):
    """The first phase of a profile that holds each sample's share of its track's time; the profile is a
    handful of constants, so it is an expression, not a join."""
    p = T.track()
    frac = (F.col("t") - F.min("t").over(p)) / (F.max("t").over(p) - F.min("t").over(p))
    phase = F.lit(None).cast("string")
    for a, b, name in reversed(PHASES):
        phase = F.when(F.col("frac").between(a, b), name).otherwise(phase)
    return T.observations(spark, sf).withColumn("frac", frac).select(*T.TRACK, "frame", phase.alias("phase")).where("phase IS NOT NULL")


@query("burst_onset", f"SELECT video_id, track_id, frame FROM (SELECT *, median(speed) {GP} AS m FROM kin) WHERE speed > 3 * greatest(m, 0.15) AND speed > 0.3", T.OBS, M.KIN)
def _(spark, sf):
    k = M.kin(spark, sf).withColumn("m", F.median("speed").over(T.track()))
    return k.where((F.col("speed") > 3 * F.greatest("m", F.lit(0.15))) & (F.col("speed") > 0.3)).select(*T.TRACK, "frame")


@query("flow_jump", f"""
r AS (SELECT *, CASE WHEN event_type != 'error' THEN vx END AS fx, CASE WHEN event_type != 'error' THEN vy END AS fy FROM kin),
j AS (SELECT *, sqrt(pow(fx - lag(fx) {GW}, 2) + pow(fy - lag(fy) {GW}, 2)) / greatest(speed, 0.05) AS jump FROM r)
SELECT video_id, track_id, frame, round(jump, 6) AS jump, round(0.75::DOUBLE * {_c('jump / 4')}, 6) AS score FROM j WHERE jump > 2
""", T.OBS, M.KIN)  # fmt: skip
def _(spark, sf):
    """Jumps of bulk flow against speed; a sample without a region resets the comparison."""
    w = T.track_window()
    k = M.kin(spark, sf).withColumns({"fx": F.when(F.col("event_type") != "error", F.col("vx")), "fy": F.when(F.col("event_type") != "error", F.col("vy"))})
    k = k.withColumn("jump", K.norm(F.col("fx") - F.lag("fx").over(w), F.col("fy") - F.lag("fy").over(w)) / F.greatest("speed", F.lit(0.05))).where("jump > 2")
    return k.select(*T.TRACK, "frame", F.round("jump", 6).alias("jump"), F.round(0.75 * clip01(F.col("jump") / 4), 6).alias("score"))


@query("divergence_spikes", f"SELECT video_id, track_id, frame, round(0.85::DOUBLE * {_c('d / 8')}, 6) AS score FROM (SELECT *, abs(ax + ay) / greatest(speed, 0.05) AS d FROM kin) WHERE d > 4", T.OBS, M.KIN)
def _(spark, sf):
    k = M.kin(spark, sf).withColumn("d", F.abs(F.col("ax") + F.col("ay")) / F.greatest("speed", F.lit(0.05))).where("d > 4")
    return k.select(*T.TRACK, "frame", F.round(0.85 * clip01(F.col("d") / 8), 6).alias("score"))


SELF = f"""sv AS (SELECT *, coalesce(x - lag(x) {GW}, 0) AS sx, coalesce(y - lag(y) {GW}, 0) AS sy FROM grid),
sa AS (SELECT *, sqrt(sx*sx + sy*sy) AS sp, coalesce(abs(sqrt(sx*sx + sy*sy) - lag(sqrt(sx*sx + sy*sy)) {GW}), 0) AS dv FROM sv)"""
SELF_Z = mad_sql("sa", "dv", "video_id, track_id", "z", False)
SPIKE_VIEWS = (T.OBS, T.GRID, SELF, SELF_Z)


def moving(g):
    """Step velocities, the change of their size and its robust z-score."""
    w = T.track_window()
    g = g.withColumns({"sx": F.coalesce(F.col("x") - F.lag("x").over(w), F.lit(0.0)), "sy": F.coalesce(F.col("y") - F.lag("y").over(w), F.lit(0.0))})
    g = g.withColumn("sp", K.norm(F.col("sx"), F.col("sy"))).withColumn("dv", F.coalesce(F.abs(F.col("sp") - F.lag("sp").over(w)), F.lit(0.0)))
    return S.mad_z(g, "dv", T.TRACK, "z", strict=False)


@T.view("self")
def self_motion(spark, sf):
    return moving(T.grid(spark, sf))


@query("self_motion_signals", "SELECT video_id, track_id, frame, z FROM mz WHERE z > 3.5", *SPIKE_VIEWS)
def _(spark, sf, z_threshold=3.5):
    return self_motion(spark, sf).where(F.col("z") > z_threshold).select(*T.TRACK, "frame", "z")


REVS = f"""rev AS (SELECT * FROM (SELECT *, sx * lag(sx) {GW} + sy * lag(sy) {GW} AS d, lag(sp) {GW} AS bsp, greatest(1, 0.4::DOUBLE * coalesce(median(CASE WHEN sp > 0 THEN sp END) {GP}, 0)) AS fl FROM mz) WHERE d < 0 AND sp > fl AND bsp > fl)"""


def turning(g):
    """What a reversal is told by: the product with the step before, that one's size, and the least size."""
    w, p = T.track_window(), T.track()
    return g.withColumns({"d": F.col("sx") * F.lag("sx").over(w) + F.col("sy") * F.lag("sy").over(w), "bsp": F.lag("sp").over(w), "fl": F.greatest(F.lit(1.0), 0.4 * F.coalesce(F.median(F.when(F.col("sp") > 0, F.col("sp"))).over(p), F.lit(0.0)))})


REVERSES = "d < 0 AND sp > fl AND bsp > fl"


def reversals(spark, sf):
    g = self_motion(spark, sf)
    return (g if "bsp" in g.columns else turning(g)).where(REVERSES)


@query("dot_reversals", "SELECT video_id, track_id, frame FROM rev", *SPIKE_VIEWS, REVS)
def _(spark, sf):
    return reversals(spark, sf).select(*T.TRACK, "frame")


EBC = """con AS (SELECT video_id, frame, track_a AS track_id FROM edge UNION ALL SELECT video_id, frame, track_b FROM edge),
ebc AS (SELECT c.video_id, c.track_id, c.frame, arg_min(s.frame, abs(s.frame - c.frame) * 2 + CASE WHEN s.frame > c.frame THEN 1 ELSE 0 END) AS near FROM con c JOIN mz s ON s.track_id = c.track_id AND s.z > 3.5 AND abs(s.frame - c.frame) <= 12 GROUP BY ALL)"""
EBC_VIEWS = (*C.EDGE_VIEWS, SELF, SELF_Z, EBC)


def effects_before_causes(spark, sf):
    """Contacts whose nearest acceleration spike within 12 frames leads by more than 3."""
    e = C.contacts(spark, sf)
    c = e.select("video_id", "frame", F.explode(F.array("track_a", "track_b")).alias("track_id"))
    n = J.nearest(c.withColumn("pid", F.col("frame")), self_motion(spark, sf).where("z > 3.5"), T.TRACK, 12, "pid")
    return n.where(F.col("near_frame") - F.col("frame") < -3)


@query("effect_before_cause", "SELECT video_id, track_id, frame, near AS spike_frame FROM ebc WHERE near - frame < -3", *EBC_VIEWS)
def _(spark, sf):
    return effects_before_causes(spark, shared(spark, sf)).select(*T.TRACK, "frame", F.col("near_frame").alias("spike_frame"))


SYNC = """act AS (SELECT video_id, frame, count(*) AS n FROM grid GROUP BY 1, 2),
syn AS (SELECT r.video_id, r.frame, count(*) AS n_rev, any_value(a.n) AS n_act FROM rev r JOIN act a ON a.video_id = r.video_id AND a.frame = r.frame GROUP BY 1, 2),
sync AS (SELECT * FROM syn s WHERE n_rev >= 2 AND n_rev / n_act >= 0.6 AND NOT EXISTS (SELECT 1 FROM edge e WHERE e.video_id = s.video_id AND abs(e.frame - s.frame) <= 4))"""


def sync_reversals(spark, sf):
    """Frames where most tracks reverse at once with no contact within four frames."""
    g = self_motion(spark, sf)
    g = g if "bsp" in g.columns else turning(g)
    r = g.groupBy("video_id", "frame").agg(F.count_if(F.expr(REVERSES)).alias("n_rev"), F.count("*").alias("n_act")).where("n_rev >= 2 AND n_rev / n_act >= 0.6")
    hits = C.contacts(spark, sf).select("video_id", F.col("frame").alias("f_start"), F.col("frame").alias("f_end"))
    return J.near_events(r, hits, ["video_id"], 4, "left_anti")


@query("sync_reversal", "SELECT video_id, frame, n_rev, n_act FROM sync", *C.EDGE_VIEWS, SELF, SELF_Z, REVS, SYNC)
def _(spark, sf):
    return sync_reversals(spark, shared(spark, sf)).select("video_id", "frame", "n_rev", "n_act")


#: Rules in order: the type of event that stands for a model's answer, whether geometry answers too.
CAUSAL = [("effect_before_cause", "error", "ebc"), ("time_reversal", "click", "sync"), ("temporal_discontinuity", "signup", None), ("cause_without_effect", "purchase", None), ("spontaneous_change", "view", None)]
ANSWERS = "answers AS (SELECT user_id // 10 AS video_id, event_type, least(arg_max(value, event_id) / 100, 1) AS p FROM events GROUP BY 1, 2)"
RULES_FIRED = f"""cr AS (SELECT * FROM (VALUES {", ".join(f"('{r}', '{e}', '{g or 'none'}')" for r, e, g in CAUSAL)}) v(rule, event_type, geom)),
cg AS (SELECT video_id, 'ebc' AS geom, count(*) AS g FROM ebc WHERE near - frame < -3 GROUP BY 1 UNION ALL SELECT video_id, 'sync', count(*) FROM sync GROUP BY 1),
cf AS (SELECT v.video_id, cr.rule, p, coalesce(g, 0) AS g, greatest(coalesce(p, 0), CASE WHEN g > 0 THEN 0.6::DOUBLE + least(0.35, 0.1::DOUBLE * g) ELSE 0 END) AS score, coalesce(p >= 0.5, false) AS said, coalesce(g > 0, false) AS seen
  FROM (SELECT DISTINCT video_id FROM grid) v JOIN cr ON true LEFT JOIN answers a ON a.video_id = v.video_id AND a.event_type = cr.event_type LEFT JOIN cg ON cg.video_id = v.video_id AND cg.geom = cr.geom)"""
CAUSAL_VIEWS = (*EBC_VIEWS, REVS, SYNC, ANSWERS, RULES_FIRED)


def causal_rules(spark, sf, fire_threshold=0.5):
    """Every rule of every video: a model's probability, the geometric events, the score and what fired."""
    sf = shared(spark, sf)
    none = F.lit(None)
    row = lambda df, event=none, p=none, geom=none: df.select("video_id", event.cast("string").alias("event_type"), p.cast("double").alias("p"), geom.cast("string").alias("geom"))
    rows = row(T.videos(spark, sf)).unionByName(row(T.answers(spark, sf), F.col("event_type"), F.col("p")))
    rows = rows.unionByName(row(effects_before_causes(spark, sf), geom=F.lit("ebc"))).unionByName(row(sync_reversals(spark, sf), geom=F.lit("sync")))
    # Everything about a video meets in one grouping; a rule picks its answer and its count from it.
    counts = {geom: F.count_if(F.col("geom") == geom) for _, _, geom in CAUSAL if geom}
    rules = [F.struct(F.lit(r).alias("rule"), F.max(F.when(F.col("event_type") == t, F.col("p"))).alias("p"), (counts[g] if g else F.lit(0).cast("long")).alias("g")) for r, t, g in CAUSAL]
    v = rows.groupBy("video_id").agg(F.array(*rules).alias("rules")).select("video_id", F.inline("rules"))
    g = F.col("g")
    score = F.greatest(F.coalesce("p", F.lit(0.0)), F.when(g > 0, 0.6 + F.least(F.lit(0.35), 0.1 * g)).otherwise(F.lit(0.0)))
    return v.select("video_id", "rule", "p", g.alias("g"), score.alias("score"), F.coalesce(F.col("p") >= fire_threshold, F.lit(False)).alias("said"), (g > 0).alias("seen"))


@query("causality_rules", "SELECT video_id, rule, p, g, round(score, 6) AS score, said, seen FROM cf", *CAUSAL_VIEWS)
def _(spark, sf):
    return causal_rules(spark, sf).withColumn("score", F.round("score", 6))


@query("causality_severity", """
w AS (SELECT video_id, sum(CASE WHEN said OR seen THEN least(1, score * CASE WHEN said AND seen THEN 1.15::DOUBLE ELSE 1 END) ELSE 0 END) AS weight, bool_or(said OR seen) AS fired, max(score) AS top FROM cf GROUP BY 1),
s AS (SELECT *, CAST(trunc(round(least(100, CASE WHEN fired THEN 100 * weight / (0.8::DOUBLE * 5) ELSE 100 * top * 0.4::DOUBLE END), 6)) AS BIGINT) AS severity FROM w)
SELECT video_id, severity, CASE WHEN severity >= 50 THEN 'confirmed' WHEN severity >= 25 THEN 'suspected' ELSE 'rejected' END AS verdict FROM s
""", *CAUSAL_VIEWS)  # fmt: skip
def _(spark, sf, fire_threshold=0.5):
    """Fired rules' scores over four fifths of all rules (x1.15 where model and geometry agree, 1 at most);
    with none fired, two fifths of the largest."""
    hit = F.col("said") | F.col("seen")
    one = F.least(F.lit(1.0), F.col("score") * F.when(F.col("said") & F.col("seen"), 1.15).otherwise(F.lit(1.0)))
    w = causal_rules(spark, sf, fire_threshold).groupBy("video_id").agg(F.sum(F.when(hit, one).otherwise(F.lit(0.0))).alias("weight"), F.max(hit).alias("fired"), F.max("score").alias("top"))
    raw = F.when(F.col("fired"), 100 * F.col("weight") / (0.8 * len(CAUSAL))).otherwise(100 * F.col("top") * 0.4)
    s = w.withColumn("severity", F.round(F.least(F.lit(100.0), raw), 6).cast("long"))
    return s.select("video_id", "severity", F.when(F.col("severity") >= 50, "confirmed").when(F.col("severity") >= 25, "suspected").otherwise("rejected").alias("verdict"))
