"""Embeddings, replies, rank statistics, hypotheses, severities, reports and evidence."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracewright.functions import parsing as P
from tracewright.functions import stats as S
from tracewright.functions import vectors as V
from tracewright.operators import clustering as L
from tracewright.plans import contacts as C
from tracewright.plans import motion as M
from tracewright.plans.base import query
from tracewright.sources import tables as T

CW = "OVER (PARTITION BY clip ORDER BY frame)"


def _clip():
    return Window.partitionBy("clip").orderBy("frame")


def _dot(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda p: p[1] * p[2]))"


def _l2diff(a: str, b: str) -> str:
    return f"sqrt(list_sum(list_transform(list_zip({a}, {b}), lambda p: (p[1] - p[2]) * (p[1] - p[2]))))"


@query("l2_normalize", f"SELECT clip, frame, round(list_sum(list_transform(z, lambda x: x / CASE WHEN n < 1e-8 THEN 1 ELSE n END)), 6) AS total, round(n, 6) AS norm FROM (SELECT *, sqrt({_dot('z', 'z')}) AS n FROM descr)", T.DESC)
def _(spark, sf):
    d = T.descriptors(spark, sf)
    return d.select("clip", "frame", F.round(F.aggregate(V.normalize(F.col("z")), F.lit(0.0), lambda a, x: a + x), 6).alias("total"), F.round(V.l2(F.col("z")), 6).alias("norm"))


@query("latent_velocity", f"SELECT clip, frame, round({_l2diff('z', 'p')}, 9) AS velocity FROM (SELECT *, lag(z) {CW} AS p FROM descr) WHERE p IS NOT NULL", T.DESC)
def _(spark, sf):
    d = T.descriptors(spark, sf).withColumn("p", F.lag("z").over(_clip())).where("p IS NOT NULL")
    return d.select("clip", "frame", F.round(V.l2(V.minus(F.col("z"), F.col("p"))), 9).alias("velocity"))


@query("latent_accel_flags", """
d AS (SELECT clip, frame, CASE WHEN p IS NOT NULL THEN list_transform(list_zip(z, p), lambda q: q[1] - q[2]) END AS v FROM (SELECT *, lag(z) OVER (PARTITION BY clip ORDER BY frame) AS p FROM descr)),
a AS (SELECT clip, frame, v, lag(v) OVER (PARTITION BY clip ORDER BY frame) AS pv FROM d)
SELECT clip, frame, round(sqrt(list_sum(list_transform(list_zip(v, pv), lambda q: (q[1] - q[2]) * (q[1] - q[2])))), 9) AS accel FROM a WHERE pv IS NOT NULL AND sqrt(list_sum(list_transform(list_zip(v, pv), lambda q: (q[1] - q[2]) * (q[1] - q[2])))) > 2.4
""", T.DESC)  # fmt: skip
def _(spark, sf, threshold=2.4):
    w = _clip()
    d = T.descriptors(spark, sf).withColumn("p", F.lag("z").over(w)).withColumn("v", F.when(F.col("p").isNotNull(), V.minus(F.col("z"), F.col("p"))))
    a = d.withColumn("pv", F.lag("v").over(w)).where("pv IS NOT NULL").withColumn("accel", V.l2(V.minus(F.col("v"), F.col("pv"))))
    return a.where(F.col("accel") > threshold).select("clip", "frame", F.round("accel", 9).alias("accel"))


DRIFT = f"""drift AS (SELECT clip, frame, CASE WHEN p IS NULL THEN 0 ELSE 1 - {_dot('z', 'p')} END AS step_drift, 1 - {_dot('z', 'f')} AS ref_drift FROM (
  SELECT *, lag(z) {CW} AS p, first_value(z) {CW} AS f FROM descr))"""


def drifts(spark, sf):
    w = _clip()
    d = T.descriptors(spark, sf).withColumns({"p": F.lag("z").over(w), "f": F.first("z").over(w.rowsBetween(Window.unboundedPreceding, 0))})
    return d.select("clip", "frame", F.when(F.col("p").isNull(), F.lit(0.0)).otherwise(1 - V.dot(F.col("z"), F.col("p"))).alias("step_drift"), (1 - V.dot(F.col("z"), F.col("f"))).alias("ref_drift"))


@query("consecutive_drift", "SELECT clip, frame, round(step_drift, 9) AS drift FROM drift", T.DESC, DRIFT)
def _(spark, sf):
    return drifts(spark, sf).select("clip", "frame", F.round("step_drift", 9).alias("drift"))


@query("reference_drift", "SELECT clip, frame, round(ref_drift, 9) AS drift FROM drift", T.DESC, DRIFT)
def _(spark, sf):
    return drifts(spark, sf).select("clip", "frame", F.round("ref_drift", 9).alias("drift"))


@query("change_points", """
s AS (SELECT clip, frame FROM drift WHERE step_drift > 1.25),
r AS (SELECT clip, arg_max(frame, (ref_drift, -frame)) AS frame FROM drift GROUP BY clip HAVING max(ref_drift) > 0.9)
SELECT clip, frame FROM s UNION ALL SELECT clip, frame FROM r WHERE clip NOT IN (SELECT clip FROM s)
""", T.DESC, DRIFT)  # fmt: skip
def _(spark, sf, spike=1.25):
    """All spikes of step drift; for a clip without one the largest drift from its start, if large."""
    d = drifts(spark, sf)
    spikes = d.where(F.col("step_drift") > spike).select("clip", "frame")
    top = d.groupBy("clip").agg(F.max_by("frame", F.struct("ref_drift", -F.col("frame"))).alias("frame"), F.max("ref_drift").alias("m")).where("m > 0.9").select("clip", "frame")
    return spikes.unionByName(top.join(spikes.select("clip").distinct(), "clip", "left_anti"))


@query("drift_profile_gap", """
n AS (SELECT clip, count(*) AS n FROM drift GROUP BY 1),
g AS (SELECT clip, unnest(range(50)) AS i, n FROM n), q AS (SELECT clip, i, i * ((n - 1) / 49.0::DOUBLE) AS pos FROM g),
v AS (SELECT q.clip, q.i, a.ref_drift + (coalesce(b.ref_drift, a.ref_drift) - a.ref_drift) * (pos - floor(pos)) AS v FROM q JOIN drift a ON a.clip = q.clip AND a.frame = CAST(floor(pos) AS BIGINT) LEFT JOIN drift b ON b.clip = q.clip AND b.frame = CAST(floor(pos) AS BIGINT) + 1)
SELECT a.clip AS clip_a, b.clip AS clip_b, round(avg(abs(a.v - b.v)), 6) AS gap, round((1 - avg(abs(a.v - b.v)) / 0.3) * 100, 4) AS score FROM v a JOIN v b ON a.i = b.i AND b.clip = a.clip + 1 GROUP BY 1, 2
""", T.DESC, DRIFT)  # fmt: skip
def _(spark, sf):
    """Mean gap of neighbouring clips' drift profiles, linearly resampled to 50 shared points."""
    d = drifts(spark, sf)
    n = d.groupBy("clip").agg(F.count("*").alias("n"))
    pos = F.col("i") * ((F.col("n") - 1) / 49.0)
    q = n.select("clip", "n", F.explode(F.sequence(F.lit(0), F.lit(49))).alias("i")).withColumn("pos", pos)
    nxt = d.select("clip", "frame", "ref_drift", F.lead("ref_drift").over(_clip()).alias("next"))
    at = q.withColumn("frame", F.floor("pos").cast("long")).join(nxt, ["clip", "frame"])
    v = at.select("clip", "i", (F.col("ref_drift") + (F.coalesce("next", "ref_drift") - F.col("ref_drift")) * (F.col("pos") - F.floor("pos"))).alias("v"))
    b = v.select((F.col("clip") - 1).alias("clip"), "i", F.col("v").alias("vb"))
    g = v.join(b, ["clip", "i"]).groupBy("clip").agg(F.avg(F.abs(F.col("v") - F.col("vb"))).alias("g"))
    return g.select(F.col("clip").alias("clip_a"), (F.col("clip") + 1).alias("clip_b"), F.round("g", 6).alias("gap"), F.round((1 - F.col("g") / 0.3) * 100, 4).alias("score"))


@query("deformation_severity", "SELECT clip, round(max(CASE WHEN step_drift > 1.25 THEN 0.85::DOUBLE * least(step_drift / 2, 1) ELSE 0 END) * 100, 6) AS severity FROM drift GROUP BY 1", T.DESC, DRIFT)
def _(spark, sf):
    s = F.when(F.col("step_drift") > 1.25, 0.85 * F.least(F.col("step_drift") / 2, F.lit(1.0))).otherwise(F.lit(0.0))
    return drifts(spark, sf).groupBy("clip").agg(F.round(F.max(s) * 100, 6).alias("severity"))


@query("parse_reply_json", r"""
SELECT event_id, TRY_CAST(nullif(regexp_extract(raw, '"suspicion_score"\s*:\s*(-?[0-9]+[.]?[0-9]*)', 1), '') AS DOUBLE) AS suspicion_score,
  nullif(regexp_extract(raw, '"suspected_failure"\s*:\s*"([^"]*)"', 1), '') AS suspected_failure, coalesce(TRY_CAST(nullif(regexp_extract(raw, '"confidence"\s*:\s*(-?[0-9]+[.]?[0-9]*)', 1), '') AS DOUBLE), 0) AS confidence FROM replies
""", T.REPLIES)  # fmt: skip
def _(spark, sf):
    return P.parse_reply(T.replies(spark, sf)).select("event_id", "suspicion_score", "suspected_failure", "confidence")


@query("recover_truncated", r"""SELECT event_id, TRY_CAST(regexp_extract(raw, '"suspicion_score"\s*:\s*([0-9.]+)', 1) AS DOUBLE) AS suspicion_score, CAST(0 AS DOUBLE) AS confidence FROM replies WHERE raw NOT LIKE '%}%'""", T.REPLIES)
def _(spark, sf):
    r = T.replies(spark, sf)
    return P.parse_reply(r.where(~F.col("raw").contains("}"))).select("event_id", "suspicion_score", "confidence")


METRIC = "CASE WHEN l_orderkey % 3 = 0 THEN CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || '%' WHEN l_orderkey % 3 = 1 THEN CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) ELSE 'n/a' END"


@query("coerce_metrics", f"SELECT l_suppkey AS suppkey, count(v) AS n, max(v) AS top FROM (SELECT l_suppkey, TRY_CAST(replace(trim({METRIC}), '%', '') AS DOUBLE) AS v FROM lineitem) GROUP BY 1")
def _(spark, sf):
    whole = F.col("l_quantity").cast("long").cast("string")
    raw = F.when(F.col("l_orderkey") % 3 == 0, F.concat(whole, F.lit("%"))).when(F.col("l_orderkey") % 3 == 1, whole).otherwise(F.lit("n/a"))
    v = T.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("suppkey"), P.percent(raw).alias("v"))
    return v.groupBy("suppkey").agg(F.count("v").alias("n"), F.max("v").alias("top"))


@query("name_list_cleanup", """
w AS (SELECT p_partkey, string_split(lower(p_type), ' ') AS w FROM part)
SELECT p_partkey, array_to_string(list_filter(w, lambda x, i: list_position(w, x) = i)[1:3], ',') AS names FROM w
""")  # fmt: skip
def _(spark, sf):
    return T.table(spark, sf, "part").select("p_partkey", F.array_join(F.slice(F.array_distinct(F.split(F.lower("p_type"), " ")), 1, 3), ",").alias("names"))


@query("det_box_grammar", r"""
r AS (SELECT event_id, '<box>' || CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) || ',' || k || ',' || CAST(CAST(floor(value) AS BIGINT) + 200 AS VARCHAR) || ',' || CAST(CAST(k AS BIGINT) + 300 AS VARCHAR) || '</box>' AS raw FROM (SELECT *, regexp_extract(props, '[0-9]+') AS k FROM events)),
n AS (SELECT event_id, CAST(regexp_extract(raw, '<box>(\d+),(\d+),(\d+),(\d+)</box>', 1) AS BIGINT) AS a, CAST(regexp_extract(raw, '<box>(\d+),(\d+),(\d+),(\d+)</box>', 2) AS BIGINT) AS b, CAST(regexp_extract(raw, '<box>(\d+),(\d+),(\d+),(\d+)</box>', 3) AS BIGINT) AS c, CAST(regexp_extract(raw, '<box>(\d+),(\d+),(\d+),(\d+)</box>', 4) AS BIGINT) AS d FROM r)
SELECT event_id, CAST(trunc(a / 1000.0::DOUBLE * 640) AS BIGINT) AS x0, CAST(trunc(b / 1000.0::DOUBLE * 480) AS BIGINT) AS y0, CAST(trunc(c / 1000.0::DOUBLE * 640) AS BIGINT) AS x1, CAST(trunc(d / 1000.0::DOUBLE * 480) AS BIGINT) AS y1 FROM n
""")  # fmt: skip
def _(spark, sf):
    e = T.table(spark, sf, "events").select("event_id", F.floor("value").cast("long").alias("v"), F.regexp_extract("props", "[0-9]+", 0).cast("long").alias("k"))
    raw = F.format_string("<box>%d,%d,%d,%d</box>", "v", "k", F.col("v") + 200, F.col("k") + 300)
    part = lambda i, size: (F.regexp_extract("raw", r"<box>(\d+),(\d+),(\d+),(\d+)</box>", i).cast("long") / 1000.0 * size).cast("long")
    return e.withColumn("raw", raw).select("event_id", part(1, 640).alias("x0"), part(2, 480).alias("y0"), part(3, 640).alias("x1"), part(4, 480).alias("y1"))


AUC = "c AS (SELECT score, sum(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS p, sum(CASE WHEN toxic = 1 THEN 0 ELSE 1 END) AS q FROM scored GROUP BY 1), w AS (SELECT p, q, p * (coalesce(sum(q) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + q / 2.0::DOUBLE) AS win FROM c)"


@query("rank_auc", "SELECT round(CAST(sum(win) AS DOUBLE) / (sum(p) * sum(q)), 9) AS auc, CAST(sum(p) AS BIGINT) AS n_pos, CAST(sum(q) AS BIGINT) AS n_neg FROM w", T.SCORED, AUC)
def _(spark, sf):
    a = S.rank_auc(T.scored(spark, sf), "score", F.col("toxic") == 1)
    return a.select(F.round("auc", 9).alias("auc"), "n_pos", "n_neg")


@query("median_split_auc", """
m AS (SELECT median(score) AS m FROM scored), s AS (SELECT CAST(doc_id % 97 AS DOUBLE) AS model, score > m AS high FROM scored, m)
SELECT round(sum(CASE WHEN a.model > b.model THEN 1 WHEN a.model = b.model THEN 0.5 ELSE 0 END)::DOUBLE / count(*), 9) AS auc FROM s a, s b WHERE a.high AND NOT b.high
""", T.SCORED)  # fmt: skip
def _(spark, sf):
    s = T.scored(spark, sf)
    a = S.rank_auc(s.withColumn("model", (F.col("doc_id") % 97).cast("double")), "model", F.col("score") > S.median_of(s, "score"))
    return a.select(F.round("auc", 9).alias("auc"))


@query("spearman", """
r AS (SELECT score, CAST(doc_id % 97 AS DOUBLE) AS model FROM scored),
k AS (SELECT rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE AS ra, rank() OVER (ORDER BY model) + (count(*) OVER (PARTITION BY model) - 1) / 2.0::DOUBLE AS rb FROM r)
SELECT round(corr(ra, rb), 9) AS rho, count(*) AS n FROM k
""", T.SCORED)  # fmt: skip
def _(spark, sf):
    s = S.spearman(T.scored(spark, sf).withColumn("model", (F.col("doc_id") % 97).cast("double")), "score", "model")
    return s.select(F.round("rho", 9).alias("rho"), "n")


@query("label_means", "SELECT toxic, round(avg(score), 6) AS mean_score, count(score) AS n_parsed FROM scored GROUP BY 1", T.SCORED)
def _(spark, sf):
    return T.scored(spark, sf).groupBy("toxic").agg(F.round(F.avg("score"), 6).alias("mean_score"), F.count("score").alias("n_parsed"))


@query("histogram_density", """
r AS (SELECT event_type, value, min(value) OVER (PARTITION BY event_type) AS lo, max(value) OVER (PARTITION BY event_type) AS hi, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, CAST(least(floor((value - lo) / ((hi - lo) / 40)), 39) AS BIGINT) AS bin, count(*) AS n, round(count(*) / (any_value(r.n) * any_value((hi - lo) / 40)), 9) AS density FROM r WHERE hi > lo GROUP BY 1, 2
""")  # fmt: skip
def _(spark, sf):
    h = S.histogram(T.table(spark, sf, "events"), "value", 40, ["event_type"])
    return h.select("event_type", "bin", "n", F.round("density", 9).alias("density"))


@query("flow_similarity", """
s AS (SELECT video_id, avg(sqrt(dx*dx + dy*dy)) AS m, stddev_pop(atan2(dy, dx)) AS a FROM steps WHERE dx IS NOT NULL GROUP BY 1)
SELECT p.video_id AS gt, q.video_id AS ai, round(60 * greatest(0, 1 - abs(p.m - q.m) / greatest(p.m, 1e-6)) + 40 * greatest(0, 1 - abs(p.a - q.a) / greatest(p.a, 1e-6)), 4) AS score FROM s p JOIN s q ON q.video_id = p.video_id + 1
""", T.OBS, M.STEPS)  # fmt: skip
def _(spark, sf):
    """Each video against the next: 60 points for mean speed, 40 for spread of direction."""
    from tracewright.functions.kinematics import norm

    s = M.steps(spark, sf).where("dx IS NOT NULL").groupBy("video_id").agg(F.avg(norm(F.col("dx"), F.col("dy"))).alias("m"), F.stddev_pop(F.atan2("dy", "dx")).alias("a"))
    q = s.select((F.col("video_id") - 1).alias("video_id"), F.col("m").alias("mq"), F.col("a").alias("aq"))
    near = lambda x, y: F.greatest(F.lit(0.0), 1 - F.abs(F.col(x) - F.col(y)) / F.greatest(F.col(x), F.lit(1e-6)))
    return s.join(q, "video_id").select(F.col("video_id").alias("gt"), (F.col("video_id") + 1).alias("ai"), F.round(60 * near("m", "mq") + 40 * near("a", "aq"), 4).alias("score"))


@query("severity_by_type", "SELECT video_id, signal_type, CAST(round_even(100 * least(max(score), 1), 0) AS BIGINT) AS severity, count(*) AS n FROM sig GROUP BY 1, 2", T.OBS, T.SIG)
def _(spark, sf):
    return T.signals(spark, sf).groupBy("video_id", "signal_type").agg(F.bround(100 * F.least(F.max("score"), F.lit(1.0))).cast("long").alias("severity"), F.count("*").alias("n"))


#: (evidence type, least count, specialist, prior)
RULES = [
    ("purchase", 1, "collision", 0.55), ("purchase", 1, "deformation", 0.3), ("click", 3, "collision", 0.5), ("click", 3, "causality", 0.35), ("error", 2, "causality", 0.5),
    ("error", 2, "gravity", 0.4), ("signup", 1, "deformation", 0.6), ("view", 1, "causality", 0.45), ("view", 5, "collision", 0.4), ("view", 5, "gravity", 0.3),
]
RULE_SQL = "rules AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', {b}, '{c}', {d}::DOUBLE)" for a, b, c, d in RULES) + ") v(signal_type, least_n, specialist, prior))"
PRIOR = "prior AS (SELECT m.video_id, specialist, max(prior) AS prior FROM (SELECT video_id, signal_type, count(*) AS n FROM mark GROUP BY 1, 2) m JOIN rules r ON m.signal_type = r.signal_type AND m.n >= r.least_n GROUP BY 1, 2)"


def priors(spark, sf):
    """The largest rule constant for each specialist; the rules are a constant expression."""
    n = C.markers(spark, sf).groupBy("video_id", "signal_type").agg(F.count("*").alias("n"))
    hits = F.array_compact(F.array(*[F.when((F.col("signal_type") == a) & (F.col("n") >= b), F.struct(F.lit(c).alias("specialist"), F.lit(d).alias("prior"))) for a, b, c, d in RULES]))
    return n.select("video_id", F.inline(hits)).groupBy("video_id", "specialist").agg(F.max("prior").alias("prior"))


@query("heuristic_priors", "SELECT video_id, specialist, prior FROM prior", *C.MARK_VIEWS, RULE_SQL, PRIOR)
def _(spark, sf):
    return priors(spark, sf)


HYPO = """told AS (SELECT user_id // 10 AS video_id, CASE event_type WHEN 'error' THEN 'fluid' WHEN 'click' THEN 'gravity' ELSE 'collision' END AS specialist, least(max(value) / 300, 0.95) AS conf FROM events WHERE event_type != 'view' GROUP BY 1, 2),
hyp AS (SELECT coalesce(p.video_id, t.video_id) AS video_id, coalesce(p.specialist, t.specialist) AS specialist, greatest(coalesce(prior, 0), coalesce(conf, 0)) AS confidence, CASE WHEN prior IS NULL THEN 'model' WHEN conf IS NULL THEN 'rules' ELSE 'both' END AS source FROM prior p FULL JOIN told t ON p.video_id = t.video_id AND p.specialist = t.specialist)"""
HYPO_VIEWS = (*C.MARK_VIEWS, RULE_SQL, PRIOR, HYPO)


def hypotheses(spark, sf):
    e = T.observations(spark, sf).where("event_type != 'view'")
    spec = F.when(F.col("event_type") == "error", "fluid").when(F.col("event_type") == "click", "gravity").otherwise("collision")
    told = e.groupBy("video_id", spec.alias("specialist")).agg(F.least(F.max("x") / 300, F.lit(0.95)).alias("conf"))
    j = priors(spark, sf).join(told, ["video_id", "specialist"], "full_outer")
    source = F.when(F.col("prior").isNull(), "model").when(F.col("conf").isNull(), "rules").otherwise("both")
    zero = F.lit(0.0)
    return j.select("video_id", "specialist", F.greatest(F.coalesce("prior", zero), F.coalesce("conf", zero)).alias("confidence"), source.alias("source"))


@query("hypothesis_merge", "SELECT video_id, specialist, confidence, source, CAST(row_number() OVER (PARTITION BY video_id ORDER BY confidence DESC, specialist) AS BIGINT) AS place FROM hyp QUALIFY place <= 3", *HYPO_VIEWS)
def _(spark, sf, top=3):
    w = Window.partitionBy("video_id").orderBy(F.desc("confidence"), "specialist")
    return hypotheses(spark, sf).withColumn("place", F.row_number().over(w).cast("long")).where(F.col("place") <= top)


@query("keyframe_times", """
r AS (SELECT video_id, round((t_start + t_end) / 2, 2) AS t, row_number() OVER (PARTITION BY video_id ORDER BY severity DESC, frame_start, lane) AS rn FROM mark)
SELECT DISTINCT video_id, t FROM r WHERE rn <= 5
""", *C.MARK_VIEWS)  # fmt: skip
def _(spark, sf):
    w = Window.partitionBy("video_id").orderBy(F.desc("severity"), "frame_start", "lane")
    return C.markers(spark, sf).withColumn("rn", F.row_number().over(w)).where("rn <= 5").select("video_id", F.round((F.col("t_start") + F.col("t_end")) / 2, 2).alias("t")).distinct()


@query("status_counts_rollup", "SELECT stage, status, count(*) AS n FROM tests WHERE NOT excluded GROUP BY GROUPING SETS ((stage, status), (status))", T.TESTS)
def _(spark, sf):
    return T.tests(spark, sf).where("NOT excluded").groupingSets([["stage", "status"], ["status"]], "stage", "status").agg(F.count("*").alias("n"))


LABELLED = "CASE WHEN s >= 75 THEN 'critical' WHEN s >= 50 THEN 'high' WHEN s >= 25 THEN 'medium' ELSE 'low' END"


@query("global_score", f"""
a AS (SELECT avg(CASE status WHEN 'done' THEN 1.0 WHEN 'error' THEN 0.0 ELSE 0.5 END::DOUBLE) AS status, avg(severity) AS s FROM tests WHERE NOT excluded)
SELECT round(greatest(0, least(100, 100 * status - 0.35::DOUBLE * s)), 2) AS score, round(s, 4) AS avg_severity, {LABELLED} AS level FROM a
""", T.TESTS)  # fmt: skip
def _(spark, sf):
    st = F.when(F.col("status") == "done", 1.0).when(F.col("status") == "error", 0.0).otherwise(0.5)
    a = T.tests(spark, sf).where("NOT excluded").agg(F.avg(st).alias("status"), F.avg("severity").alias("s"))
    return a.select(F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 * F.col("status") - 0.35 * F.col("s"))), 2).alias("score"), F.round("s", 4).alias("avg_severity"), F.expr(LABELLED).alias("level"))


@query("local_report", f"SELECT test, n, n_error, round(s, 6) AS max_severity, {LABELLED} AS level FROM (SELECT test, count(*) AS n, CAST(sum(CASE WHEN status = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS n_error, max(severity) AS s FROM tests WHERE NOT excluded GROUP BY 1)", T.TESTS)
def _(spark, sf):
    g = T.tests(spark, sf).where("NOT excluded").groupBy("test").agg(F.count("*").alias("n"), F.sum((F.col("status") == "error").cast("long")).alias("n_error"), F.max("severity").alias("s"))
    return g.select("test", "n", "n_error", F.round("s", 6).alias("max_severity"), F.expr(LABELLED).alias("level"))


FINDINGS = """find AS (
  SELECT video_id, 'motion' AS source, t, score, CAST(NULL AS BOOLEAN) AS confirmed FROM sig WHERE signal_type = 'error' AND score > 1
  UNION ALL SELECT video_id, 'marker', t_start, peak, severity > 60 FROM mark WHERE n_signals > 1
  UNION ALL SELECT video_id, 'hypothesis', CAST(NULL AS DOUBLE), confidence, source = 'both' FROM hyp)"""


@query("findings_timeline", "SELECT video_id, source, t, score, coalesce(confirmed, true) AS flagged, row_number() OVER (PARTITION BY video_id ORDER BY t NULLS LAST, source, score, coalesce(confirmed, true)) AS place FROM find", *HYPO_VIEWS, FINDINGS)
def _(spark, sf):
    """Findings of three conventions as one timeline; unconfirmed counts as flagged, no time goes last."""
    a = T.signals(spark, sf).where("signal_type = 'error' AND score > 1").select("video_id", F.lit("motion").alias("source"), "t", "score")
    b = C.markers(spark, sf).where("n_signals > 1").select("video_id", F.lit("marker").alias("source"), F.col("t_start").alias("t"), F.col("peak").alias("score"), (F.col("severity") > 60).alias("confirmed"))
    c = hypotheses(spark, sf).select("video_id", F.lit("hypothesis").alias("source"), F.col("confidence").alias("score"), (F.col("source") == "both").alias("confirmed"))
    u = a.unionByName(b, allowMissingColumns=True).unionByName(c, allowMissingColumns=True)
    w = Window.partitionBy("video_id").orderBy(F.asc_nulls_last("t"), "source", "score", "flagged")
    u = u.withColumn("flagged", F.coalesce("confirmed", F.lit(True)))
    return u.select("video_id", "source", "t", "score", "flagged", F.row_number().over(w).cast("long").alias("place"))


@query("followups", """
g AS (SELECT video_id, count(*) AS n, max(confidence) AS top FROM hyp GROUP BY 1)
SELECT video_id, CASE WHEN n >= 4 THEN 'high' WHEN n >= 2 THEN 'medium' ELSE 'low' END AS level,
  array_to_string(list_filter([CASE WHEN top >= 0.6 THEN 'review' END, CASE WHEN n >= 4 THEN 'cross_check' END, CASE WHEN top < 0.5 THEN 'rescreen' END], lambda x: x IS NOT NULL), ',') AS actions FROM g
""", *HYPO_VIEWS)  # fmt: skip
def _(spark, sf):
    g = hypotheses(spark, sf).groupBy("video_id").agg(F.count("*").alias("n"), F.max("confidence").alias("top"))
    acts = F.array_compact(F.array(F.when(F.col("top") >= 0.6, "review"), F.when(F.col("n") >= 4, "cross_check"), F.when(F.col("top") < 0.5, "rescreen")))
    return g.select("video_id", F.when(F.col("n") >= 4, "high").when(F.col("n") >= 2, "medium").otherwise("low").alias("level"), F.array_join(acts, ",").alias("actions"))


NEEDS = [("object_tracker", 0), ("trajectory_extractor", 1), ("event_localizer", 2)]
HAVE = "CASE event_type WHEN 'click' THEN 'object_tracker' WHEN 'view' THEN 'trajectory_extractor' WHEN 'purchase' THEN 'event_localizer' ELSE 'other' END"


@query("missing_dependencies", f"""
need AS (SELECT * FROM (VALUES {', '.join(f"('{a}', {b})" for a, b in NEEDS)}) v(stage_id, place)),
have AS (SELECT DISTINCT user_id AS video, {HAVE} AS stage_id FROM events WHERE value > 90)
SELECT u.video, n.stage_id, CAST(place AS BIGINT) AS place FROM (SELECT DISTINCT user_id AS video FROM events) u, need n WHERE NOT EXISTS (SELECT 1 FROM have h WHERE h.video = u.video AND h.stage_id = n.stage_id)
""")  # fmt: skip
def _(spark, sf):
    """Producers a video lacks, in dependency order: an anti join against what is on the bus."""
    e = T.table(spark, sf, "events")
    need = F.array(*[F.struct(F.lit(a).alias("stage_id"), F.lit(b).cast("long").alias("place")) for a, b in NEEDS])
    wanted = e.select(F.col("user_id").alias("video")).distinct().select("video", F.inline(need))
    have = e.where("value > 90").select(F.col("user_id").alias("video"), F.expr(HAVE).alias("stage_id"))
    return wanted.join(have, ["video", "stage_id"], "left_anti")


@query("latest_evidence", "SELECT user_id AS video, event_type AS stage_id, arg_max(value, event_id) AS payload, max(event_id) AS seq FROM events GROUP BY 1, 2")
def _(spark, sf):
    return T.table(spark, sf, "events").groupBy(F.col("user_id").alias("video"), F.col("event_type").alias("stage_id")).agg(F.max_by("value", "event_id").alias("payload"), F.max("event_id").alias("seq"))


@query("lru_retention", "SELECT video, last_put FROM (SELECT user_id AS video, max(event_id) AS last_put FROM events GROUP BY 1) ORDER BY last_put DESC LIMIT 16")
def _(spark, sf):
    """The 16 videos put last; the limit is the store's size."""
    return T.table(spark, sf, "events").groupBy(F.col("user_id").alias("video")).agg(F.max("event_id").alias("last_put")).orderBy(F.desc("last_put")).limit(16)


@query("label_numbering", "SELECT p_partkey, CASE WHEN count(*) OVER (PARTITION BY p_brand, p_type) > 1 THEN p_type || ' #' || CAST(row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_partkey) AS VARCHAR) ELSE p_type END AS numbered FROM part")
def _(spark, sf):
    return L.number_labels(T.table(spark, sf, "part"), "p_brand", "p_type", "p_partkey").select("p_partkey", "numbered")


@query("leader_clusters", """
r AS (SELECT *, row_number() OVER (PARTITION BY video_id, frame ORDER BY track_id) AS i FROM grid),
c AS (SELECT video_id, frame, i, track_id, [{'x': x, 'y': y}] AS seeds, CAST(0 AS BIGINT) AS cluster FROM r WHERE i = 1
  UNION ALL SELECT video_id, frame, i, track_id, CASE WHEN met > 0 THEN seeds ELSE list_append(seeds, {'x': x, 'y': y}) END, CASE WHEN met > 0 THEN met - 1 ELSE len(seeds) END FROM (
    SELECT r.*, c.seeds, coalesce(list_position(list_transform(c.seeds, lambda s: (r.x - s.x) * (r.x - s.x) + (r.y - s.y) * (r.y - s.y) < 1600), true), 0) AS met
    FROM c JOIN r ON r.video_id = c.video_id AND r.frame = c.frame AND r.i = c.i + 1))
SELECT video_id, frame, track_id, CAST(cluster AS BIGINT) AS cluster FROM c
""", "RECURSIVE " + T.OBS, T.GRID)  # fmt: skip
def _(spark, sf):
    return L.leader_clusters(T.grid(spark, sf), ["video_id", "frame"], 40.0)


@query("greedy_nms", """
r AS (SELECT *, row_number() OVER (PARTITION BY video_id, frame ORDER BY x DESC, track_id) AS i FROM grid),
c AS (SELECT video_id, frame, i, track_id, true AS ok, [{'x': x, 'y': y}] AS kept FROM r WHERE i = 1
  UNION ALL SELECT video_id, frame, i, track_id, n = 0, CASE WHEN n = 0 THEN list_append(kept, {'x': x, 'y': y}) ELSE kept END FROM (
    SELECT r.*, c.kept, len(list_filter(c.kept, lambda k: greatest(30 - abs(r.x - k.x), 0) * greatest(30 - abs(r.y - k.y), 0) / (1800 - greatest(30 - abs(r.x - k.x), 0) * greatest(30 - abs(r.y - k.y), 0)) >= 0.6)) AS n
    FROM c JOIN r ON r.video_id = c.video_id AND r.frame = c.frame AND r.i = c.i + 1))
SELECT video_id, frame, track_id FROM c WHERE ok
""", "RECURSIVE " + T.OBS, T.GRID)  # fmt: skip
def _(spark, sf):
    boxes = T.grid(spark, sf).select("video_id", "frame", "track_id", F.col("x").alias("score"), "x", "y", F.lit(30.0).alias("w"), F.lit(30.0).alias("h"))
    return L.greedy_nms(boxes, ["video_id", "frame"])


@query("match_labels", """
d AS (SELECT video_id, frame, track_id AS det, x + 2 AS x, y + 2 AS y, event_type FROM (SELECT g.*, o.event_type FROM grid g JOIN obs o ON o.track_id = g.track_id AND o.t = g.t)),
p AS (SELECT g.video_id, g.frame, g.track_id, d.event_type AS label, d.det, greatest(least(g.x, d.x) - greatest(g.x, d.x) + 10, 0) * greatest(least(g.y, d.y) - greatest(g.y, d.y) + 10, 0) AS inter FROM grid g JOIN d ON g.video_id = d.video_id AND g.frame = d.frame)
SELECT video_id, frame, track_id, arg_max(label, (inter / (200 - inter), -det)) AS label FROM p WHERE inter / (200 - inter) > 0.15 GROUP BY 1, 2, 3
""", T.OBS, T.GRID)  # fmt: skip
def _(spark, sf):
    """The label of the detection that overlaps each track's box best, above 0.15."""
    g = T.grid(spark, sf)
    o = T.observations(spark, sf).select("track_id", "t", F.col("event_type").alias("label"))
    d = g.join(o, ["track_id", "t"]).select("video_id", "frame", F.col("track_id").alias("det"), (F.col("x") + 2).alias("dx"), (F.col("y") + 2).alias("dy"), "label")
    side = lambda a, b: F.greatest(F.least(a, b) - F.greatest(a, b) + 10, F.lit(0.0))
    p = g.join(d, ["video_id", "frame"]).withColumn("inter", side(F.col("x"), F.col("dx")) * side(F.col("y"), F.col("dy")))
    p = p.withColumn("iou", F.col("inter") / (200 - F.col("inter"))).where("iou > 0.15")
    return p.groupBy("video_id", "frame", "track_id").agg(F.max_by("label", F.struct("iou", -F.col("det"))).alias("label"))
