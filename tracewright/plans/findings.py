"""Replies, payloads and plans as text, findings of all specialists, reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracewright.functions import parsing as PA
from tracewright.plans import contacts as C
from tracewright.plans import physics as P
from tracewright.plans import reporting as R
from tracewright.plans import violations as V
from tracewright.plans.base import query
from tracewright.sources import tables as T
from tracewright.sources.bindings import Derived
from tracewright.sources.scratch import dealt

#: Replies in six shapes: whole, fenced, in prose, cut after a field, cut inside a string, without JSON.
REPLIES = """rp AS (SELECT event_id, '{"suspicion_score": .' || k || ', "suspected_failure": "' || event_type || '", "explanation": "it ' || event_type || 's twice", "confidence": 0.5}' AS body, '{"suspicion_score": .' || k || ', "explanation": "the object ' || event_type AS cut, '{"suspicion_score": 0.' || k || ', "confidence": .25, "expl' AS early
  FROM (SELECT *, lpad(regexp_extract(props, '[0-9]+'), 2, '0') AS k FROM events)),
rs AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN replace(body, ': .', ': 0.') WHEN 1 THEN '```json' || chr(10) || replace(body, ': .', ': 0.') || chr(10) || '```' WHEN 2 THEN 'I looked. ' || body || ' That is all.' WHEN 3 THEN early WHEN 4 THEN cut ELSE 'I cannot say.' END AS raw FROM rp)"""


def replies(spark, sf):
    e = T.table(spark, sf, "events")
    k, kind = F.lpad(F.regexp_extract("props", "[0-9]+", 0), 2, "0"), F.col("event_type")
    body = lambda dot: F.concat(F.lit('{"suspicion_score": ' + dot), k, F.lit(', "suspected_failure": "'), kind, F.lit('", "explanation": "it '), kind, F.lit('s twice", "confidence": 0.5}'))
    shape = F.col("event_id") % 6
    raw = (
        F.when(shape == 0, body("0.")).when(shape == 1, F.concat(F.lit("```json\n"), body("0."), F.lit("\n```"))).when(shape == 2, F.concat(F.lit("I looked. "), body("."), F.lit(" That is all.")))
        .when(shape == 3, F.concat(F.lit('{"suspicion_score": 0.'), k, F.lit(', "confidence": .25, "expl'))).when(shape == 4, F.concat(F.lit('{"suspicion_score": .'), k, F.lit(', "explanation": "the object '), kind)).otherwise("I cannot say.")
    )
    return e.select("event_id", raw.alias("raw"))


SCORE = r"""TRY_CAST(nullif(regexp_extract(raw, '"suspicion_score"\s*:\s*(-?[0-9]*[.]?[0-9]+)', 1), '') AS DOUBLE)"""


def _text_sql(name: str) -> str:
    return f"""coalesce(nullif(regexp_extract(raw, '"{name}"\\s*:\\s*"([^"]*)"', 1), ''), nullif(trim(regexp_extract(raw, '"{name}"\\s*:\\s*"([^"]+)$', 1)), ''))"""


@query("reply_fields", rf"""
SELECT event_id, {SCORE} AS suspicion_score, {_text_sql('suspected_failure')} AS suspected_failure,
  coalesce({_text_sql('explanation')}, CASE WHEN {SCORE} IS NOT NULL THEN 'recovered from truncated reply' ELSE 'unparseable: ' || left(raw, 120) END) AS explanation, coalesce(TRY_CAST(nullif(regexp_extract(raw, '"confidence"\s*:\s*(-?[0-9]*[.]?[0-9]+)', 1), '') AS DOUBLE), 0) AS confidence FROM rs
""", REPLIES)  # fmt: skip
def _(spark, sf):
    return PA.parse_reply(replies(spark, sf)).select("event_id", "suspicion_score", "suspected_failure", "explanation", "confidence")


#: Signals as a flat list, a list of envelopes, or a map of source to envelope.
PAYLOAD = """pl AS (SELECT event_id, event_type, CASE event_id % 3 WHEN 0 THEN '[' || s || ',' || s2 || ']' WHEN 1 THEN '[{"source":"list","fps":30,"severity":7,"signals":[' || s || ']}]' ELSE '{"map":{"fps":10,"signals":[' || s2 || ']}}' END AS raw
  FROM (SELECT *, '{"frame":' || k || ',"signal_type":"' || event_type || '","score":0.5}' AS s, '{"t":' || k || '.5}' AS s2 FROM (SELECT *, CAST(CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS VARCHAR) AS k FROM events)))"""
SIGNAL = "struct<frame:double,t:double,signal_type:string,score:double>"
ENVELOPE = f"struct<source:string,fps:double,severity:double,signals:array<{SIGNAL}>>"


@query("signal_payloads", """
k AS (SELECT event_id, event_type, CAST(regexp_extract(props, '[0-9]+') AS DOUBLE) AS k FROM events),
s AS (SELECT event_id, 'Stage 1 test' AS source, k / 30 AS t, event_type AS signal_type, 0.5::DOUBLE AS score, CAST(NULL AS DOUBLE) AS severity FROM k WHERE event_id % 3 = 0 UNION ALL SELECT event_id, 'Stage 1 test', k + 0.5, 'anomaly', 1, NULL FROM k WHERE event_id % 3 = 0
  UNION ALL SELECT event_id, 'list', k / 30, event_type, 0.5, 7 FROM k WHERE event_id % 3 = 1 UNION ALL SELECT event_id, 'map', k + 0.5, 'anomaly', 1, NULL FROM k WHERE event_id % 3 = 2)
SELECT event_id, source, round(t, 9) AS t, greatest(0, least(CAST(round_even(round(t * 30, 6), 0) AS BIGINT), 2999)) AS frame, signal_type, score, severity FROM s
""")  # fmt: skip
def _(spark, sf):
    """Payloads of three shapes as one table of signals with defaults for what they leave out."""
    e = T.table(spark, sf, "events")
    k = F.regexp_extract("props", "[0-9]+", 0).cast("long").cast("string")
    s = F.concat(F.lit('{"frame":'), k, F.lit(',"signal_type":"'), "event_type", F.lit('","score":0.5}'))
    s2 = F.concat(F.lit('{"t":'), k, F.lit(".5}"))
    shape = F.col("event_id") % 3
    raw = F.when(shape == 0, F.concat(F.lit("["), s, F.lit(","), s2, F.lit("]"))).when(shape == 1, F.concat(F.lit('[{"source":"list","fps":30,"severity":7,"signals":['), s, F.lit("]}]"))).otherwise(F.concat(F.lit('{"map":{"fps":10,"signals":['), s2, F.lit("]}}")))
    return PA.signal_payload(e.select("event_id", raw.alias("raw")), fps=30.0, frames=3000)


PLAN = """pn AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN '{"sufficient": true, "run": ["object_tracker"]}' WHEN 1 THEN '{"run": ["event_localizer", "' || event_type || '", "object_tracker", "object_tracker"]}' WHEN 2 THEN '{"run": "object_tracker"}' ELSE 'nothing to run' END AS raw FROM events)"""
TOOLS = ["object_tracker", "trajectory_extractor", "event_localizer", "physics_hypothesis_generator"]


@query("plan_sanitised", """SELECT event_id, event_id % 4 < 2 AS usable, CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'object_tracker,event_localizer' END AS run FROM events""")
def _(spark, sf):
    """A told plan as known tools in the order of their dependencies, three at most; enough evidence means
    none, an unreadable reply no plan at all."""
    e = T.table(spark, sf, "events")
    shape = F.col("event_id") % 4
    raw = F.when(shape == 0, '{"sufficient": true, "run": ["object_tracker"]}').when(shape == 1, F.concat(F.lit('{"run": ["event_localizer", "'), "event_type", F.lit('", "object_tracker", "object_tracker"]}'))).when(shape == 2, '{"run": "object_tracker"}').otherwise("nothing to run")
    p = e.select("event_id", PA.sanitised_plan(raw, TOOLS, 3).alias("plan"))
    return p.select("event_id", F.col("plan").isNotNull().alias("usable"), F.array_join("plan", ",").alias("run"))


@query("prompt_payload", """SELECT event_id, '{"model":"default","seed":42,"temperature":0,"frames":' || CAST(CAST(regexp_extract(props, '[0-9]+') AS BIGINT) % 8 + 1 AS VARCHAR) || ',"question":"Is this ' || event_type || ' plausible?"}' AS payload FROM events""")
def _(spark, sf):
    e = T.table(spark, sf, "events")
    frames = F.regexp_extract("props", "[0-9]+", 0).cast("long") % 8 + 1
    return e.select("event_id", F.to_json(F.struct(F.lit("default").alias("model"), F.lit(42).alias("seed"), F.lit(0).alias("temperature"), frames.alias("frames"), F.concat(F.lit("Is this "), "event_type", F.lit(" plausible?")).alias("question"))).alias("payload"))


@query("ref_boxes", r"""
r AS (SELECT event_id, '<ref>' || event_type || '</ref><box>' || k || ',1,' || k || ',9</box> and <ref>other</ref><box>5,6,7,8</box>' AS raw FROM (SELECT *, CAST(CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS VARCHAR) AS k FROM events WHERE event_id % 5 = 0)),
u AS (SELECT event_id, unnest(regexp_extract_all(raw, '<ref>([^<]*)</ref>', 1)) AS label, unnest(regexp_extract_all(raw, '<box>([^<]*)</box>', 1)) AS box FROM r)
SELECT event_id, label, count(*) AS n, min(box) AS box FROM u GROUP BY 1, 2
""")  # fmt: skip
def _(spark, sf):
    """Named boxes of a grounding reply, grouped by the name before them."""
    e = T.table(spark, sf, "events").where("event_id % 5 = 0")
    k = F.regexp_extract("props", "[0-9]+", 0).cast("long").cast("string")
    raw = e.select("event_id", F.concat(F.lit("<ref>"), "event_type", F.lit("</ref><box>"), k, F.lit(",1,"), k, F.lit(",9</box> and <ref>other</ref><box>5,6,7,8</box>")).alias("raw"))
    both = F.arrays_zip(F.regexp_extract_all("raw", F.lit("<ref>([^<]*)</ref>"), F.lit(1)).alias("label"), F.regexp_extract_all("raw", F.lit("<box>([^<]*)</box>"), F.lit(1)).alias("box"))
    return raw.select("event_id", F.inline(both).alias("label", "box")).groupBy("event_id", "label").agg(F.count("*").alias("n"), F.min("box").alias("box"))


NORM = """nf AS (SELECT event_id, user_id // 10 AS video_id, event_type, CASE WHEN event_id % 3 = 0 THEN value / 100 END AS vlm_confidence, CASE WHEN event_id % 4 = 0 THEN value / 200 END AS confidence, CASE WHEN event_id % 5 != 0 THEN value / 50 END AS score, event_id % 7 AS t,
  CASE WHEN event_id % 2 = 0 THEN event_id % 7 + 1 END AS t_end, CASE WHEN event_id % 3 = 1 THEN 'seen ' || event_type WHEN event_id % 6 = 2 THEN '' END AS explanation, CASE WHEN event_id % 3 = 2 THEN 'a ' || event_type END AS descr,
  CASE WHEN event_type = 'error' THEN 'consistent' WHEN event_type = 'click' THEN 'changed' END AS verdict, CASE event_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS confirmed FROM events)"""


def raw_findings(spark, sf):
    e = T.table(spark, sf, "events")
    m = lambda k: F.col("event_id") % k
    return e.select(
        "event_id", F.floor(F.col("user_id") / 10).cast("long").alias("video_id"), "event_type", F.when(m(3) == 0, F.col("value") / 100).alias("vlm_confidence"), F.when(m(4) == 0, F.col("value") / 200).alias("confidence"),
        F.when(m(5) != 0, F.col("value") / 50).alias("score"), m(7).alias("t"), F.when(m(2) == 0, m(7) + 1).alias("t_end"), F.when(m(3) == 1, F.concat(F.lit("seen "), "event_type")).when(m(6) == 2, "").alias("explanation"), F.when(m(3) == 2, F.concat(F.lit("a "), "event_type")).alias("descr"),
        F.when(F.col("event_type") == "error", "consistent").when(F.col("event_type") == "click", "changed").alias("verdict"), F.when(m(3) == 0, True).when(m(3) == 1, False).alias("confirmed"),
    )


@query("finding_fields", """SELECT event_id, coalesce(verdict, event_type) AS kind, CASE WHEN verdict IS NOT NULL THEN verdict != 'consistent' ELSE coalesce(confirmed, true) END AS flagged, round(coalesce(vlm_confidence, confidence, score), 6) AS confidence,
  t, coalesce(t_end, t) AS t_end, coalesce(nullif(explanation, ''), descr, '') AS explanation FROM nf""", NORM)  # fmt: skip
def _(spark, sf):
    """One form for findings of two conventions: a verdict counts unless it is consistent, a violation unless
    it was rejected; the surest confidence there is, the end defaults to the start, an empty explanation to the
    description."""
    f = raw_findings(spark, sf)
    flagged = F.when(F.col("verdict").isNotNull(), F.col("verdict") != "consistent").otherwise(F.coalesce("confirmed", F.lit(True)))
    return f.select("event_id", F.coalesce("verdict", "event_type").alias("kind"), flagged.alias("flagged"), F.round(F.coalesce("vlm_confidence", "confidence", "score"), 6).alias("confidence"), "t", F.coalesce("t_end", "t").alias("t_end"), F.coalesce(F.nullif("explanation", F.lit("")), "descr", F.lit("")).alias("explanation"))


SEVEN = """se AS (SELECT video_id, 'gravity' AS source, verdict AS kind, track_id, t0 AS t, round(score, 6) AS confidence FROM fv WHERE score > 0 AND verdict != 'float'
  UNION ALL SELECT video_id, 'deformation', 'vanish_gap', track_id, CAST(before AS DOUBLE), round(least(1, gap / 48.0::DOUBLE), 6) FROM (SELECT *, frame - lag(frame) OVER (PARTITION BY track_id ORDER BY frame) AS gap, lag(frame) OVER (PARTITION BY track_id ORDER BY frame) AS before FROM grid) WHERE gap > 24
  UNION ALL SELECT video_id, 'collision', 'energy_gain', track_id, CAST(f_start AS DOUBLE), round(least(1, abs(vy_out) / greatest(abs(vy_in), 1e-6) - 1), 6) FROM pp WHERE vy_in >= 2 AND vy_out <= -0.4 AND abs(vy_out) / greatest(abs(vy_in), 1e-6) > 1.1
  UNION ALL SELECT video_id, 'momentum', 'jolt', track_id, CAST(frame AS DOUBLE), round(least(1, accel / 200), 6) FROM kin WHERE accel > 100
  UNION ALL SELECT video_id, 'friction', 'self_acceleration', track_id, t0, round(least(greatest(slope_norm / 0.02, 0), 1) * 0.85::DOUBLE, 6) FROM seg WHERE expected != 'accelerate' AND slope_norm > 0.01
  UNION ALL SELECT video_id, 'fluid', 'incompressibility', CAST(NULL AS BIGINT), CAST(frame AS DOUBLE), round(0.85::DOUBLE * least(greatest(div / 4, 0), 1), 6) FROM rj WHERE div > 2
  UNION ALL SELECT video_id, 'causality', rule, NULL, NULL, round(score, 6) FROM cf WHERE said OR seen)"""
SEVEN_VIEWS = tuple(dict.fromkeys((*P.PP_VIEWS, P.FLIGHT, P.FIT, P.VERDICT, C.COAST, P.SEG, V.REGION.split(",\nsplash")[0], C.EDGE, P.SELF, P.SELF_Z, P.EBC, P.REVS, P.SYNC, P.ANSWERS, P.RULES_FIRED, SEVEN)))


def findings(spark, sf):
    """``video_id, source, kind, t, confidence``: the findings of all seven specialists, whole-clip ones without
    a time. Kinematics, contacts and self motion are computed and written once; all else reads them, ordered work
    in partitions of some rows each."""
    b = P.shared(spark, sf)
    kin, touching = b.views["kin"], b.views["touching"]
    by_track = dealt(kin, T.TRACK, kin.count())
    o = Derived(sf, {**b.views, "kin": by_track, "grid": by_track.select(*T.TRACK, "frame", "t", "x", "y"), "touching": dealt(touching, ["video_id", "track_a", "track_b"], touching.count())})
    cols = lambda df, source, kind, t, score: df.select("video_id", F.lit(source).alias("source"), kind.alias("kind"), t.cast("double").alias("t"), F.round(score, 6).alias("confidence"))
    f = P.flight_verdict(P.flight_fits(spark, o)).where("score > 0 AND verdict != 'float'")
    g = T.with_gaps(spark, b).where("gap > 24")
    e = F.abs("vy_out") / F.greatest(F.abs("vy_in"), F.lit(1e-6))
    p = P.before_after(spark, o).where("vy_in >= 2 AND vy_out <= -0.4").withColumn("e", e).where("e > 1.1")
    k = C.grid_kin(spark, b).where("accel > 100")
    s = P.segments(spark, o).where("expected != 'accelerate' AND slope_norm > 0.01")
    r = V.region(spark, b).where("div > 2")
    c = P.causal_rules(spark, b).where("said OR seen")
    parts = [
        cols(f, "gravity", F.col("verdict"), F.col("t0"), F.col("score")), cols(g, "deformation", F.lit("vanish_gap"), F.col("before"), F.least(F.lit(1.0), F.col("gap") / 48.0)),
        cols(p, "collision", F.lit("energy_gain"), F.col("f_start"), F.least(F.lit(1.0), F.col("e") - 1)), cols(k, "momentum", F.lit("jolt"), F.col("frame"), F.least(F.lit(1.0), F.col("accel") / 200)),
        cols(s, "friction", F.lit("self_acceleration"), F.col("t0"), P.clip01(F.col("slope_norm") / 0.02) * 0.85), cols(r, "fluid", F.lit("incompressibility"), F.col("frame"), 0.85 * P.clip01(F.col("div") / 4)),
        cols(c, "causality", F.col("rule"), F.lit(None), F.col("score")),
    ]
    u = parts[0]
    for part in parts[1:]:
        u = u.unionByName(part)
    return u


@query("semantic_timeline", "SELECT video_id, source, count(*) AS n, count(t) AS timed, min(t) AS first_t, max(confidence) AS top, count(DISTINCT kind) AS kinds FROM se GROUP BY 1, 2", *SEVEN_VIEWS)
def _(spark, sf):
    """Findings of all seven specialists in one table; here by source."""
    return findings(spark, sf).groupBy("video_id", "source").agg(F.count("*").alias("n"), F.count("t").alias("timed"), F.min("t").alias("first_t"), F.max("confidence").alias("top"), F.count_distinct("kind").alias("kinds"))


LOGS = """lg AS (SELECT test, run_id, CASE WHEN status = 'running' THEN 'warn' WHEN status = 'error' THEN 'error' ELSE 'info' END AS level, 'run ' || CAST(run_id AS VARCHAR) AS text FROM tests WHERE NOT excluded)"""


@query("first_messages", """
r AS (SELECT *, row_number() OVER (PARTITION BY test, level ORDER BY run_id, text) AS i FROM lg)
SELECT test, CAST(sum(CASE WHEN level = 'warn' THEN 1 ELSE 0 END) AS BIGINT) AS num_warnings, CAST(sum(CASE WHEN level = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS num_errors, coalesce(string_agg(CASE WHEN level = 'warn' AND i <= 5 THEN text END, '; ' ORDER BY i), '') AS warnings, coalesce(string_agg(CASE WHEN level = 'error' AND i <= 5 THEN text END, '; ' ORDER BY i), '') AS errors FROM r GROUP BY 1
""", T.TESTS, LOGS)  # fmt: skip
def _(spark, sf):
    """The first five warnings and errors of each test, and how many there are."""
    t = T.tests(spark, sf).where("NOT excluded")
    level = F.when(F.col("status") == "running", "warn").when(F.col("status") == "error", "error").otherwise("info")
    lg = t.select("test", "run_id", level.alias("level"), F.concat(F.lit("run "), F.col("run_id").cast("string")).alias("text"))
    r = lg.withColumn("i", F.row_number().over(Window.partitionBy("test", "level").orderBy("run_id", "text")))
    first = lambda name: F.array_join(F.transform(F.array_sort(F.collect_list(F.when((F.col("level") == name) & (F.col("i") <= 5), F.struct("i", "text")))), lambda x: x["text"]), "; ")
    n = lambda name: F.sum((F.col("level") == name).cast("long"))
    return r.groupBy("test").agg(n("warn").alias("num_warnings"), n("error").alias("num_errors"), first("warn").alias("warnings"), first("error").alias("errors"))


NULLABLE = """nt AS (SELECT test, status, CASE WHEN run_id % 3 = 0 AND test >= 'F' THEN severity END AS severity, excluded OR test > 'R' AS excluded FROM tests)"""


@query("score_null_rules", """
a AS (SELECT test, avg(CASE WHEN excluded THEN NULL WHEN status = 'done' THEN 1.0 WHEN status = 'error' THEN 0.0 ELSE 0.5 END::DOUBLE) AS s, avg(CASE WHEN NOT excluded THEN severity END) AS v FROM nt GROUP BY 1)
SELECT test, CASE WHEN s IS NULL THEN NULL WHEN v IS NULL THEN round(s * 100, 2) ELSE round(greatest(0, least(100, 100 * s - 0.35::DOUBLE * v)), 2) END AS score FROM a
""", T.TESTS, NULLABLE)  # fmt: skip
def _(spark, sf):
    """No included run: no score; no severity: the status alone; else both."""
    t = T.tests(spark, sf).select("test", "status", F.when((F.col("run_id") % 3 == 0) & (F.col("test") >= "F"), F.col("severity")).alias("severity"), (F.col("excluded") | (F.col("test") > "R")).alias("excluded"))
    st = F.when(F.col("excluded"), F.lit(None)).when(F.col("status") == "done", 1.0).when(F.col("status") == "error", 0.0).otherwise(0.5)
    a = t.groupBy("test").agg(F.avg(st).alias("s"), F.avg(F.when(~F.col("excluded"), F.col("severity"))).alias("v"))
    both = F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 * F.col("s") - 0.35 * F.col("v"))), 2)
    return a.select("test", F.when(F.col("s").isNull(), F.lit(None).cast("double")).when(F.col("v").isNull(), F.round(F.col("s") * 100, 2)).otherwise(both).alias("score"))


COUNTS = """sc AS (SELECT stage, '{' || string_agg('"' || status || '":' || CAST(n AS VARCHAR), ',' ORDER BY status) || '}' AS counts FROM (SELECT stage, status, count(*) AS n FROM tests WHERE NOT excluded GROUP BY GROUPING SETS ((stage, status), (status))) GROUP BY 1)"""


def status_maps(spark, sf):
    n = T.tests(spark, sf).where("NOT excluded").groupingSets([["stage", "status"], ["status"]], "stage", "status").agg(F.count("*").alias("n"))
    return n.groupBy("stage").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", "n")))).alias("counts"))


@query("status_maps", "SELECT stage, counts FROM sc", T.TESTS, COUNTS)
def _(spark, sf):
    """Counts by status as a map, for every stage and for all."""
    return status_maps(spark, sf).select("stage", F.to_json("counts").alias("counts"))


@query("counts_with_defaults", """
n AS (SELECT test, status, count(*) AS n FROM tests GROUP BY 1, 2)
SELECT test, coalesce(max(CASE WHEN status = 'done' THEN n END), 0) AS done, coalesce(max(CASE WHEN status = 'error' THEN n END), 0) AS error, CAST(0 AS BIGINT) AS skipped FROM n GROUP BY 1
""", T.TESTS)  # fmt: skip
def _(spark, sf):
    """A map of counts laid over a map of defaults, and a key that neither has."""
    n = T.tests(spark, sf).groupBy("test", "status").agg(F.count("*").alias("n")).groupBy("test").agg(F.map_from_entries(F.collect_list(F.struct("status", "n"))).alias("given"))
    defaults = F.create_map(*[x for s in ("done", "error") for x in (F.lit(s), F.lit(0).cast("long"))])
    merged = F.map_concat(F.map_filter(defaults, lambda k, v: ~F.map_contains_key("given", k)), F.col("given"))
    at = lambda k: F.coalesce(F.element_at("m", k), F.lit(0).cast("long"))
    return n.select("test", merged.alias("m")).select("test", at("done").alias("done"), at("error").alias("error"), at("skipped").alias("skipped"))


@query("report_json", """
t AS (SELECT stage, test, count(*) AS n, CAST(sum(CASE WHEN status = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS n_error, CAST(trunc(max(severity)) AS BIGINT) AS top FROM tests WHERE NOT excluded GROUP BY 1, 2),
a AS (SELECT stage, '[' || string_agg('{"test":"' || test || '","runs":' || CAST(n AS VARCHAR) || ',"errors":' || CAST(n_error AS VARCHAR) || ',"max_severity":' || CAST(top AS VARCHAR) || '}', ',' ORDER BY test) || ']' AS local FROM t GROUP BY 1)
SELECT a.stage, '{"stage":"' || a.stage || '","status_counts":' || counts || ',"local_reports":' || local || '}' AS report FROM a JOIN sc ON sc.stage = a.stage
""", T.TESTS, COUNTS)  # fmt: skip
def _(spark, sf):
    """The nested report of each stage as JSON."""
    t = T.tests(spark, sf).where("NOT excluded").groupBy("stage", "test").agg(F.count("*").alias("runs"), F.sum((F.col("status") == "error").cast("long")).alias("errors"), F.max("severity").cast("long").alias("max_severity"))
    local = t.groupBy("stage").agg(F.array_sort(F.collect_list(F.struct("test", "runs", "errors", "max_severity"))).alias("local_reports"))
    j = local.join(status_maps(spark, sf).where("stage IS NOT NULL"), "stage")
    return j.select("stage", F.to_json(F.struct("stage", F.col("counts").alias("status_counts"), "local_reports")).alias("report"))


@query("report_prompt", """
a AS (SELECT stage, count(*) AS n, CAST(sum(CASE WHEN status = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS e, CAST(trunc(max(severity)) AS BIGINT) AS top FROM tests WHERE NOT excluded GROUP BY 1)
SELECT stage, 'Stage ' || stage || ': ' || CAST(n AS VARCHAR) || ' runs, ' || CAST(e AS VARCHAR) || ' failed, worst severity ' || CAST(top AS VARCHAR) || '. Summarise what is physically implausible in at most three sentences.' AS prompt FROM a
""", T.TESTS)  # fmt: skip
def _(spark, sf):
    a = T.tests(spark, sf).where("NOT excluded").groupBy("stage").agg(F.count("*").alias("n"), F.sum((F.col("status") == "error").cast("long")).alias("e"), F.max("severity").cast("long").alias("top"))
    return a.select("stage", F.format_string("Stage %s: %d runs, %d failed, worst severity %d. Summarise what is physically implausible in at most three sentences.", "stage", "n", "e", "top").alias("prompt"))


@query("evidence_summary", """
t AS (SELECT video_id, count(*) AS n_tracks, string_agg(CASE WHEN i <= 6 THEN label END, ',' ORDER BY i) AS labels FROM (SELECT video_id, track_id, label, row_number() OVER (PARTITION BY video_id ORDER BY track_id) AS i FROM (SELECT video_id, track_id, arg_min(event_type, frame) AS label FROM obs GROUP BY 1, 2)) GROUP BY 1),
m AS (SELECT video_id, count(*) AS n_markers FROM mark GROUP BY 1), c AS (SELECT video_id, count(*) AS n_contacts FROM edge GROUP BY 1),
h AS (SELECT video_id, string_agg(specialist, ',' ORDER BY i) AS top FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY confidence DESC, specialist) AS i FROM hyp) WHERE i <= 4 GROUP BY 1)
SELECT t.video_id, n_tracks, labels, coalesce(n_markers, 0) AS n_markers, coalesce(n_contacts, 0) AS n_contacts, top FROM t LEFT JOIN m USING (video_id) LEFT JOIN c USING (video_id) LEFT JOIN h USING (video_id)
""", *dict.fromkeys((*R.HYPO_VIEWS, *C.EDGE_VIEWS)))  # fmt: skip
def _(spark, sf):
    """What the bus holds of a video: tracks with the first six labels, markers, contacts, the top four hypotheses."""
    join = lambda rows: F.array_join(F.transform(F.array_sort(F.collect_list(rows)), lambda x: x["v"]), ",")
    v = Window.partitionBy("video_id")
    o = T.observations(spark, sf).groupBy(*T.TRACK).agg(F.min_by("event_type", "frame").alias("v")).withColumn("i", F.row_number().over(v.orderBy("track_id")))
    t = o.groupBy("video_id").agg(F.count("*").alias("n_tracks"), join(F.when(F.col("i") <= 6, F.struct("i", "v"))).alias("labels"))
    h = R.hypotheses(spark, sf).withColumn("i", F.row_number().over(v.orderBy(F.desc("confidence"), "specialist"))).where("i <= 4").groupBy("video_id").agg(join(F.struct("i", F.col("specialist").alias("v"))).alias("top"))
    n = lambda df, name: df.groupBy("video_id").agg(F.count("*").alias(name))
    j = t.join(n(C.markers(spark, sf), "n_markers"), "video_id", "left").join(n(C.contacts(spark, sf), "n_contacts"), "video_id", "left").join(h, "video_id", "left")
    return j.select("video_id", "n_tracks", "labels", F.coalesce("n_markers", F.lit(0)).alias("n_markers"), F.coalesce("n_contacts", F.lit(0)).alias("n_contacts"), "top")


#: Tests of a video by type of event: those whose severity reaches 97 are included, an error may be among them.
INCLUDED = """vt AS (SELECT user_id // 10 AS video_id, event_type AS test, max(value) / 2 AS severity, event_type = 'error' AS failed FROM events GROUP BY 1, 2),
vi AS (SELECT v.video_id, count(test) AS included, coalesce(bool_or(failed), false) AS errors, max(severity) AS worst FROM (SELECT DISTINCT user_id // 10 AS video_id FROM events) v LEFT JOIN vt ON vt.video_id = v.video_id AND severity >= 49.2 GROUP BY 1)"""
SPECIALISTS = ("deformation", "collision", "momentum", "friction", "fluid", "gravity", "causality")


def included_tests(spark, sf):
    e = T.table(spark, sf, "events").select(F.floor(F.col("user_id") / 10).cast("long").alias("video_id"), "event_type", "value").repartition("video_id")
    t = e.groupBy("video_id", "event_type").agg((F.max("value") / 2).alias("severity"))
    kept = F.col("severity") >= 49.2
    return t.groupBy("video_id").agg(F.count_if(kept).alias("included"), F.max(kept & (F.col("event_type") == "error")).alias("errors"), F.max(F.when(kept, F.col("severity"))).alias("worst"))


def report_rules(tests, findings):
    """``level`` and ``actions`` of each video from its included tests (``included, errors, worst``) and the
    sources of its specialists' ``findings``.

    With findings the level is high from two specialists on, else medium; without, medium from two tests on,
    else low. Five rules say what to do next: run a test, look into errors, look around severe events, run
    more tests, run the specialists that have found nothing yet if none has.
    """
    f = findings.groupBy("video_id").agg(F.size(F.collect_set("source")).alias("specialists"))
    j = tests.join(f, "video_id", "left").withColumn("specialists", F.coalesce(F.col("specialists").cast("long"), F.lit(0).cast("long")))
    none, some = F.col("specialists") == 0, F.col("included")
    acts = F.array_compact(F.array(
        F.when(some == 0, "run_a_test"), F.when(F.col("errors"), "inspect_errors"), F.when(F.col("worst") >= 50, "look_around_events"), F.when(some < 2, "run_more_tests"),
        F.when(none, "run_specialists:" + ",".join(SPECIALISTS)),
    ))
    level = F.when(~none, F.when(F.col("specialists") >= 2, "high").otherwise("medium")).when(some < 2, "low").otherwise("medium")
    return j.select("video_id", "included", "specialists", level.alias("level"), F.array_join(acts, ";").alias("actions"))


@query("report_followups", f"""
s AS (SELECT video_id, count(DISTINCT source) AS n FROM se WHERE confidence >= 0.9 GROUP BY 1), j AS (SELECT vi.*, coalesce(n, 0) AS n FROM vi LEFT JOIN s USING (video_id))
SELECT video_id, included, n AS specialists, CASE WHEN n >= 2 THEN 'high' WHEN n = 1 THEN 'medium' WHEN included < 2 THEN 'low' ELSE 'medium' END AS level,
  array_to_string(list_filter([CASE WHEN included = 0 THEN 'run_a_test' END, CASE WHEN errors THEN 'inspect_errors' END, CASE WHEN worst >= 50 THEN 'look_around_events' END, CASE WHEN included < 2 THEN 'run_more_tests' END, CASE WHEN n = 0 THEN 'run_specialists:{','.join(SPECIALISTS)}' END], lambda x: x IS NOT NULL), ';') AS actions FROM j
""", *SEVEN_VIEWS, INCLUDED)  # fmt: skip
def _(spark, sf):
    """How sure a video's report is and what to do next, by its tests and its specialists' sure findings."""
    sure = findings(spark, sf).where("confidence >= 0.9").select("video_id", "source")
    return report_rules(included_tests(spark, sf), sure)
