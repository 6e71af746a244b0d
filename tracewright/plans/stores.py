"""What stores keep: evidence with clearing and eviction, results merged by key, headers of fetched files."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.functions import parsing as PA
from tracewright.operators import evidence_table as E
from tracewright.operators import planner as N
from tracewright.operators import results as R
from tracewright.operators import shelf as H
from tracewright.plans.base import query
from tracewright.sources import fetch
from tracewright.sources import tables as T
from tracewright.sources.scratch import scratch

#: Operations on the store of a group of users: errors clear their video, most else puts.
OPS = """ops AS (SELECT CAST(user_id // 50 AS VARCHAR) AS store, event_id AS seq, CASE WHEN event_type = 'error' AND value > 80 THEN 'clear_all' WHEN event_type = 'error' THEN 'clear' ELSE 'put' END AS op,
  CAST(user_id AS VARCHAR) AS video_id, CASE WHEN event_type != 'error' THEN event_type END AS stage_id, CASE WHEN event_type != 'error' THEN CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) END AS payload FROM events)"""
SHELF = 12


def operations(spark, sf):
    e, error = T.table(spark, sf, "events"), F.col("event_type") == "error"
    op = F.when(error & (F.col("value") > 80), "clear_all").when(error, "clear").otherwise("put")
    return e.select(F.floor(F.col("user_id") / 50).cast("long").cast("string").alias("store"), F.col("event_id").alias("seq"), op.alias("op"), F.col("user_id").cast("string").alias("video_id"), F.when(~error, F.col("event_type")).alias("stage_id"), F.when(~error, F.floor("value").cast("long").cast("string")).alias("payload"))


@query("evidence_shelf", f"""
q AS (SELECT *, row_number() OVER (PARTITION BY store ORDER BY seq) AS i FROM ops),
r AS (SELECT DISTINCT store, 0::BIGINT AS i, CAST([] AS STRUCT(video VARCHAR, stage VARCHAR, seq BIGINT, payload VARCHAR)[]) AS held, CAST([] AS VARCHAR[]) AS ranks FROM q
  UNION ALL
  SELECT store, i, list_filter(held, lambda h: list_contains(list_slice(ranks, -{SHELF}, -1), h.video)), list_slice(ranks, -{SHELF}, -1) FROM (
    SELECT q.store, q.i,
      CASE q.op WHEN 'clear_all' THEN [] WHEN 'clear' THEN list_filter(r.held, lambda h: h.video != q.video_id) ELSE list_append(list_filter(r.held, lambda h: h.video != q.video_id OR h.stage != q.stage_id), {{'video': q.video_id, 'stage': q.stage_id, 'seq': q.seq, 'payload': q.payload}}) END AS held,
      CASE q.op WHEN 'clear_all' THEN [] WHEN 'clear' THEN list_filter(r.ranks, lambda v: v != q.video_id) ELSE list_append(list_filter(r.ranks, lambda v: v != q.video_id), q.video_id) END AS ranks
    FROM r JOIN q ON q.store = r.store AND q.i = r.i + 1)),
l AS (SELECT store, arg_max(held, i) AS held FROM r GROUP BY 1)
SELECT store, h.video AS video_id, h.stage AS stage_id, h.seq AS seq, h.payload AS payload FROM (SELECT store, unnest(held) AS h FROM l)
""", "RECURSIVE " + OPS)  # fmt: skip
def _(spark, sf):
    """What each store holds after all operations, if it keeps the twelve videos put last and an evicted or
    cleared video starts anew."""
    return H.contents(H.changes(operations(spark, sf), SHELF))


HELD = """held AS (SELECT video_id, stage_id, max(seq) AS seq, arg_max(payload, seq) AS payload FROM ops WHERE op = 'put' GROUP BY 1, 2),
gone AS (SELECT video_id, max(seq) AS cleared FROM ops WHERE op = 'clear' GROUP BY 1),
kept AS (SELECT h.* FROM held h LEFT JOIN gone g USING (video_id) WHERE seq > coalesce(cleared, -1) AND seq > coalesce((SELECT max(seq) FROM ops WHERE op = 'clear_all'), -1))"""


def one_store(spark, sf):
    return operations(spark, sf).withColumnRenamed("seq", "version").drop("store")


@query("evidence_state", "SELECT video_id, stage_id, payload, seq AS version FROM kept", OPS, HELD)
def _(spark, sf):
    """The last payload of every stage whose video has not been cleared since, nor everything."""
    return E.held(one_store(spark, sf))


@query("evidence_has", "SELECT v.video_id, s.stage_id, k.payload IS NOT NULL AS has FROM (SELECT DISTINCT video_id FROM ops) v, (SELECT DISTINCT stage_id FROM ops WHERE stage_id IS NOT NULL) s LEFT JOIN kept k ON k.video_id = v.video_id AND k.stage_id = s.stage_id", OPS, HELD)
def _(spark, sf):
    """Which of the stages each video has evidence of, from a stored log and its snapshot."""
    rows = one_store(spark, sf)
    store = E.EvidenceTable(spark, scratch(spark, "evidence"))
    store.load(rows)
    store.compact()
    stages = F.array(*[F.lit(s) for s in ("click", "purchase", "signup", "view")])
    keys = rows.select("video_id").distinct().select("video_id", F.explode(stages).alias("stage_id"))
    return store.has(keys)


@query("results_upsert", """
t AS (SELECT test, count(*) AS n, max(severity) AS top FROM tests GROUP BY 1), e AS (SELECT test, count(*) AS n, max(severity) AS top FROM tests WHERE status = 'error' AND stage < 'B' GROUP BY 1)
SELECT t.test, coalesce(e.n, t.n) AS n, round(coalesce(e.top, t.top), 6) AS top, e.test IS NOT NULL AS renewed FROM t LEFT JOIN e USING (test)
""", T.TESTS)  # fmt: skip
def _(spark, sf):
    """Results of all tests stored, then those of one stage's failed runs laid over their own tests only."""
    t = T.tests(spark, sf)
    of = lambda df, renewed: df.groupBy("test").agg(F.count("*").alias("n"), F.round(F.max("severity"), 6).alias("top")).withColumn("renewed", F.lit(renewed))
    path = scratch(spark, "results")
    R.upsert(of(t, False), path, ["test"])
    R.upsert(of(t.where("status = 'error' AND stage < 'B'"), True), path, ["test"])
    return R.stored(spark, path, "n long, top double, renewed boolean, test string").select("test", "n", "top", "renewed")


@query("results_read", """
SELECT event_id % 5 AS model, CAST(sum(CASE WHEN event_id % 7 = 0 THEN 0 ELSE 1 END) AS BIGINT) AS n_ok, CAST(sum(CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_corrupt, round(sum(CASE WHEN event_id % 7 != 0 THEN value END), 4) AS total FROM events GROUP BY 1
""")  # fmt: skip
def _(spark, sf):
    """Results as JSON lines, every seventh cut off: whole ones are read, the others kept as they are."""
    e = T.table(spark, sf, "events")
    line = F.to_json(F.struct((F.col("event_id") % 5).alias("model"), "value"))
    path = scratch(spark, "result-lines")
    cut = F.when(F.col("event_id") % 7 == 0, F.concat(F.lit('{"cut": '), (F.col("event_id") % 5).cast("string"))).otherwise(line)
    e.select(cut.alias("value")).write.text(path)
    r = R.read(spark, path, "model long, value double")
    model = F.coalesce("model", F.regexp_extract(R.CORRUPT, "([0-9]+)$", 1).cast("long"))
    return r.groupBy(model.alias("model")).agg(F.count("value").alias("n_ok"), F.count(R.CORRUPT).alias("n_corrupt"), F.round(F.sum("value"), 4).alias("total"))


@query("frame_size", "SELECT event_id, CAST(event_id % 4000 + 1 AS INTEGER) AS width, CAST(user_id % 3000 + 1 AS INTEGER) AS height FROM events WHERE event_id % 4 != 3 UNION ALL SELECT event_id, NULL, NULL FROM events WHERE event_id % 4 = 3")
def _(spark, sf):
    """Width and height from the first bytes of PNG, GIF and BMP files; other files have none."""
    w, h = F.col("event_id") % 4000 + 1, F.col("user_id") % 3000 + 1
    big = lambda c, n: F.lpad(F.hex(c), 2 * n, "0")
    little = lambda c, n: F.concat(*[F.substring(big(c, n), 2 * k + 1, 2) for k in reversed(range(n))])
    png = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), big(w, 4), big(h, 4))
    gif = F.concat(F.lit("474946383961"), little(w, 2), little(h, 2))
    bmp = F.concat(F.lit("424D" + "00" * 16), little(w, 4), little(h, 4))
    kind = F.col("event_id") % 4
    e = T.table(spark, sf, "events").select("event_id", F.unhex(F.when(kind == 0, png).when(kind == 1, gif).when(kind == 2, bmp).otherwise(F.lit("FFD8FFE0"))).alias("content"))
    return fetch.sized(e).select("event_id", "width", "height")


@query("nested_reply_text", """
SELECT event_id, CASE event_id % 6 WHEN 0 THEN event_type WHEN 1 THEN event_type || '!' WHEN 2 THEN 'deep ' || event_type WHEN 3 THEN ' kept as it is ' ELSE '' END AS text FROM events
""".strip())  # fmt: skip
def _(spark, sf):
    """The text of a reply, wherever in it: at the top, behind a blank, deep inside, after an object without one,
    nowhere, or in no JSON at all."""
    kind = F.col("event_type")
    j = lambda before, value, after: F.concat(F.lit(before), value, F.lit(after))
    shapes = [
        j('{"answer": "', kind, '", "text": "later"}'), j('{"response": " ", "answer": 5, "output": "', kind, '!"}'), j('{"content": "no", "response": {"id": 7, "result": {"text": {"content": "deep ', kind, '"}}}}'),
        F.lit('{"response": {"other": "x", "list": ["a"]}, "result": " kept as it is "}'), F.lit('{"id": 1, "response": null, "answer": ["text"], "output": {}}'),
    ]
    raw = F.lit("no JSON: here")
    for i, s in enumerate(shapes):
        raw = F.when(F.col("event_id") % 6 == i, s).otherwise(raw)
    return T.table(spark, sf, "events").select("event_id", PA.reply_text(raw).alias("text"))


#: What each video has, and what a model said of it: enough, a list with strangers, no list, no JSON, nothing.
PLANS = """vid AS (SELECT DISTINCT user_id // 10 AS v FROM events),
have AS (SELECT DISTINCT user_id // 10 AS v, CASE event_type WHEN 'click' THEN 'object_tracker' WHEN 'view' THEN 'event_localizer' WHEN 'signup' THEN 'trajectory_extractor' ELSE event_type END AS stage FROM events WHERE value > 97),
need AS (SELECT * FROM (VALUES (1, 'object_tracker'), (2, 'trajectory_extractor'), (3, 'event_localizer')) t(i, stage)),
lack AS (SELECT v, string_agg(stage, ',' ORDER BY i) AS run FROM vid, need WHERE NOT EXISTS (SELECT 1 FROM have h WHERE h.v = vid.v AND h.stage = need.stage) GROUP BY 1)"""


@query("evidence_plans", "SELECT CAST(vid.v AS VARCHAR) AS video_id, CASE vid.v % 5 WHEN 0 THEN '' WHEN 1 THEN 'object_tracker,event_localizer' ELSE coalesce(run, '') END AS run, CASE vid.v % 5 WHEN 0 THEN 'sufficient' WHEN 1 THEN 'told' ELSE 'fallback' END AS how FROM vid LEFT JOIN lack ON lack.v = vid.v", PLANS)
def _(spark, sf):
    """What must run for each video, as a model said or by the rules."""
    e = T.table(spark, sf, "events").select(F.floor(F.col("user_id") / 10).cast("long").alias("v"), "event_type", "value")
    stage = F.when(F.col("event_type") == "click", "object_tracker").when(F.col("event_type") == "view", "event_localizer").when(F.col("event_type") == "signup", "trajectory_extractor").otherwise(F.col("event_type"))
    held = e.where("value > 97").select(F.col("v").cast("string").alias("video_id"), stage.alias("stage_id"))
    videos = e.select(F.col("v").cast("string").alias("video_id"), "v").distinct()
    shape = F.col("v") % 5
    raw = F.when(shape == 0, '{"sufficient": true, "run": ["object_tracker"]}').when(shape == 1, '{"run": ["event_localizer", "somebody", "object_tracker", "object_tracker"]}').when(shape == 2, '{"run": "object_tracker"}').when(shape == 3, "no idea")
    replies = videos.where(shape < 4).select("video_id", raw.alias("raw"))
    p = N.planned(videos, held, ["event_localizer", "object_tracker", "trajectory_extractor"], "agent", replies)
    return p.select("video_id", F.array_join("run", ",").alias("run"), "how")
