"""Frames to show around events, and what becomes of an object's shape between them."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from tracewright.plans import contacts as C
from tracewright.plans import reporting as R
from tracewright.plans.base import T, query

FPS, CONTEXT, TARGET, CLIP, STRIP = 30, 1.5, 10.0, 60, 300


def spread(n: Column, most: int) -> Column:
    """Indices of ``most`` evenly spaced ones of ``n`` (truncated steps, the last one kept), all if they are few."""
    step = (n - 1).cast("double") / (most - 1)
    return F.when(n <= most, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.transform(F.sequence(F.lit(0).cast("long"), F.lit(most - 1).cast("long")), lambda k: F.when(k == most - 1, n - 1).otherwise((k * step).cast("long"))))


def clip_frames(lo: Column, hi: Column, n: Column) -> Column:
    """Frames of an event's clip: its window and the context around it inside the video, thinned to the target
    rate, the centre frame always among them, and of more than ``CLIP`` an even choice."""
    context, pace = round(CONTEXT * FPS), max(1, round(FPS / TARGET))
    every = F.sequence(F.greatest(F.lit(0), lo - context), F.least(n - 1, hi + context), F.lit(pace).cast("long"))
    centre = F.floor((lo + hi) / 2).cast("long")
    whole = F.array_sort(F.array_union(every, F.array(centre)))
    return F.transform(spread(F.size(whole).cast("long"), CLIP), lambda i: F.get(whole, i.cast("int")))


_LAST = "CASE WHEN k = m - 1 THEN len(seg) - 1 ELSE CAST(trunc(k * ((len(seg) - 1)::DOUBLE / (m - 1))) AS BIGINT) END"


@query("event_clip_index", f"""
v AS (SELECT video_id, max(frame) + 1 AS n FROM sig GROUP BY 1),
s AS (SELECT m.video_id, signal_type, frame_start, list_sort(list_distinct(list_append(range(greatest(0, frame_start - 45), least(n - 1, frame_end + 45) + 1, 3), (frame_start + frame_end) // 2))) AS seg FROM mark m JOIN v USING (video_id)),
p AS (SELECT *, 60 AS m FROM s)
SELECT video_id, signal_type, frame_start, CAST(k AS BIGINT) AS place, seg[1 + CASE WHEN len(seg) <= m THEN k ELSE {_LAST} END] AS frame FROM (SELECT *, unnest(range(least(len(seg), m))) AS k FROM p)
""", *C.MARK_VIEWS)  # fmt: skip
def _(spark, sf):
    """The frames of every marker's clip, in order."""
    n = T.signals(spark, sf).groupBy("video_id").agg((F.max("frame") + 1).alias("n"))
    m = C.markers(spark, sf).join(n, "video_id")
    f = m.select("video_id", "signal_type", "frame_start", F.posexplode(clip_frames(F.col("frame_start"), F.col("frame_end"), F.col("n"))).alias("place", "frame"))
    return f.withColumn("place", F.col("place").cast("long"))


@query("overview_strip", f"""
v AS (SELECT video_id, range(max(frame) + 1) AS seg FROM sig GROUP BY 1), p AS (SELECT *, 300 AS m FROM v)
SELECT video_id, CAST(k AS BIGINT) AS place, seg[1 + CASE WHEN len(seg) <= m THEN k ELSE {_LAST} END] AS frame FROM (SELECT *, unnest(range(least(len(seg), m))) AS k FROM p)
""", T.OBS, T.SIG)  # fmt: skip
def _(spark, sf):
    """At most 300 frames over the whole of each video."""
    n = T.signals(spark, sf).groupBy("video_id").agg((F.max("frame") + 1).alias("n"))
    return n.select("video_id", F.posexplode(spread(F.col("n"), STRIP)).alias("place", "frame")).withColumn("place", F.col("place").cast("long"))


#: Change points with a judge's verdict, and gaps in an object's presence; weights of the verdicts.
SPIKE, GAP, WEIGHT = 1.25, 12, {"changed": 0.85, "vanished": 1.0}
FORM = f"""chg AS (SELECT clip, frame, CASE frame % 3 WHEN 0 THEN 'consistent' WHEN 1 THEN 'changed' ELSE 'vanished' END AS verdict, round(least(1, step_drift / {2 * SPIKE}::DOUBLE), 3) AS confidence FROM drift WHERE step_drift > {SPIKE}),
gp AS (SELECT clip, before, score FROM (SELECT CAST(label AS BIGINT) AS clip, row_number() OVER w - 2 AS before, round(least(1, (vec_id - lag(vec_id) OVER w) / 24.0::DOUBLE / 0.5), 3) AS score, vec_id - lag(vec_id) OVER w AS gap FROM embeddings WINDOW w AS (PARTITION BY label ORDER BY vec_id)) WHERE gap > {GAP}),
fm AS (SELECT clip, before AS frame, 'object_vanish' AS type, 'gap' AS source, score, score AS weighed FROM gp
  UNION ALL SELECT clip, frame, CASE verdict WHEN 'changed' THEN 'object_morph' ELSE 'object_vanish' END, 'verdict', confidence, CASE verdict WHEN 'changed' THEN 0.85::DOUBLE ELSE 1 END * confidence FROM chg WHERE verdict != 'consistent')"""


def forms(spark, sf):
    """Morphs and vanishings: of a change the judge's verdict with its confidence, of a gap in presence its length
    over half a second."""
    d = R.drifts(spark, sf).where(F.col("step_drift") > SPIKE)
    verdict = F.when(F.col("frame") % 3 == 0, "consistent").when(F.col("frame") % 3 == 1, "changed").otherwise("vanished")
    d = d.select("clip", "frame", verdict.alias("verdict"), F.round(F.least(F.lit(1.0), F.col("step_drift") / (2 * SPIKE)), 3).alias("score")).where("verdict != 'consistent'")
    changed = F.col("verdict") == "changed"
    d = d.select("clip", "frame", F.when(changed, "object_morph").otherwise("object_vanish").alias("type"), F.lit("verdict").alias("source"), "score", (F.when(changed, WEIGHT["changed"]).otherwise(WEIGHT["vanished"]) * F.col("score")).alias("weighed"))
    w = Window.partitionBy("label").orderBy("vec_id")
    e = T.table(spark, sf, "embeddings").select("label", "vec_id", (F.row_number().over(w) - 2).cast("long").alias("frame"), (F.col("vec_id") - F.lag("vec_id").over(w)).alias("gap")).where(F.col("gap") > GAP)
    gap = F.round(F.least(F.lit(1.0), F.col("gap") / 24.0 / 0.5), 3)
    return e.select(F.col("label").cast("long").alias("clip"), "frame", F.lit("object_vanish").alias("type"), F.lit("gap").alias("source"), gap.alias("score"), gap.alias("weighed")).unionByName(d)


FORM_VIEWS = (T.DESC, R.DRIFT, FORM)


@query("deformation_findings", "SELECT clip, frame, type, source, score FROM fm", *FORM_VIEWS)
def _(spark, sf):
    return forms(spark, sf).drop("weighed")


@query("form_severity", "SELECT d.clip, CAST(round_even(round(100 * coalesce(max(weighed), 0), 6), 0) AS BIGINT) AS severity, count(type) AS n FROM (SELECT DISTINCT clip FROM drift) d LEFT JOIN fm USING (clip) GROUP BY 1", *FORM_VIEWS)
def _(spark, sf):
    """A clip's severity: the largest of its weighed verdicts and gaps."""
    clips = T.descriptors(spark, sf).select("clip").distinct()
    worst = F.coalesce(F.max("weighed"), F.lit(0.0))
    return clips.join(forms(spark, sf), "clip", "left").groupBy("clip").agg(F.bround(F.round(100 * worst, 6)).cast("long").alias("severity"), F.count("type").alias("n"))
