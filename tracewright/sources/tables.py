"""The engine's canonical views, over driver tables (a folder) or a user's own (``bindings.Bound``).

``observations``: a user's events are a track, ten users a video; ``x`` is the value, ``y`` the number
in ``props``; the frame is the place in time, ``t`` hours since the epoch.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewright.sources.bindings import Bound, Derived

TRACK = ["video_id", "track_id"]
#: Frame size of the observation space.
WIDTH = HEIGHT = 100.0


def plain(source):
    """The source behind a derived one."""
    return plain(source.source) if isinstance(source, Derived) else source


def view(name: str):
    """Marks a function of (spark, source, ...) as the view ``name``: a ``Derived`` source that holds it
    answers from there."""

    def mark(f):
        @wraps(f)
        def given(spark, source, *args, **kwargs):
            if isinstance(source, Derived):
                return source.views[name] if name in source.views else f(spark, source, *args, **kwargs)
            return f(spark, source, *args, **kwargs)

        return given

    return mark


def table(spark: SparkSession, sf_dir: str | Bound, name: str) -> DataFrame:
    sf_dir = plain(sf_dir)
    if isinstance(sf_dir, Bound):
        return sf_dir.table(name)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def track_window() -> Window:
    return Window.partitionBy(*TRACK).orderBy("frame")


def track() -> Window:
    return Window.partitionBy(*TRACK)


def hours(ts: str = "ts"):
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', CAST({ts} AS timestamp_ntz))") / F.lit(3.6e9)


@view("observations")
def observations(spark: SparkSession, sf_dir: str | Bound) -> DataFrame:
    """Partitioned by track, as all ordered work on it is: that work shuffles no more."""
    sf_dir = plain(sf_dir)
    if isinstance(sf_dir, Bound):
        return sf_dir.observations()
    e = table(spark, sf_dir, "events").select(F.floor(F.col("user_id") / 10).cast("long").alias("video_id"), F.col("user_id").alias("track_id"), "ts", "event_id", "value", "props", "event_type")
    return e.select(
        *TRACK, (F.row_number().over(Window.partitionBy(*TRACK).orderBy("ts", "event_id")) - 1).cast("long").alias("frame"),
        hours().alias("t"), F.col("value").alias("x"), F.regexp_extract("props", "[0-9]+", 0).cast("double").alias("y"), "event_type",
    )


OBS = """obs AS (
  SELECT user_id // 10 AS video_id, user_id AS track_id,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame,
    epoch_us(CAST(ts AS TIMESTAMP)) / CAST(3.6e9 AS DOUBLE) AS t, value AS x, CAST(regexp_extract(props, '[0-9]+') AS DOUBLE) AS y, event_type
  FROM events)"""


@view("grid")
def grid(spark: SparkSession, sf_dir: str | Bound) -> DataFrame:
    """One observation for each track and hour (the earliest), so that tracks share frames; a user's
    observations have shared frames, of which each track keeps its earliest row."""
    sf_dir = plain(sf_dir)
    if isinstance(sf_dir, Bound):
        before = F.lag("frame").over(Window.partitionBy(*TRACK).orderBy("frame", "t", "x", "y"))
        return sf_dir.observations().withColumn("before", before).where("before IS NULL OR before < frame").select(*TRACK, "frame", "t", "x", "y")
    o = observations(spark, sf_dir).withColumn("hour", F.floor("t").cast("long"))
    g = o.groupBy("video_id", "track_id", "hour").agg(F.min_by(F.struct("t", "x", "y"), "frame").alias("o"))
    return g.select("video_id", "track_id", F.col("hour").alias("frame"), "o.t", "o.x", "o.y")


def with_gaps(spark: SparkSession, sf_dir: str | Bound) -> DataFrame:
    """The grid with each row's frame ``before`` and the ``gap`` to it."""
    if isinstance(sf_dir, Derived) and "kin" in sf_dir.views:
        return sf_dir.views["kin"]
    return grid(spark, sf_dir).withColumn("before", F.lag("frame").over(track_window())).withColumn("gap", F.col("frame") - F.col("before"))


GRID = """grid AS (
  SELECT video_id, track_id, CAST(floor(t) AS BIGINT) AS frame, arg_min(t, frame) AS t, arg_min(x, frame) AS x, arg_min(y, frame) AS y
  FROM obs GROUP BY video_id, track_id, CAST(floor(t) AS BIGINT))"""


@view("signals")
def signals(spark: SparkSession, sf_dir: str | Bound) -> DataFrame:
    sf_dir = plain(sf_dir)
    if isinstance(sf_dir, Bound):
        return sf_dir.signals()
    o = observations(spark, sf_dir)
    return o.select("video_id", "track_id", F.col("event_type").alias("signal_type"), F.floor(F.col("t") * 60).cast("long").alias("frame"), "t", (F.col("x") / 100).alias("score"))


SIG = """sig AS (SELECT video_id, track_id, event_type AS signal_type, CAST(floor(t * 60) AS BIGINT) AS frame, t, x / 100 AS score FROM obs)"""


@view("answers")
def answers(spark: SparkSession, sf_dir: str | Bound) -> DataFrame:
    """``video_id, event_type, p``: a model's probability that a kind of event is in a video."""
    sf_dir = plain(sf_dir)
    if isinstance(sf_dir, Bound):
        return sf_dir.answers()
    e = table(spark, sf_dir, "events").withColumn("video_id", F.floor(F.col("user_id") / 10).cast("long"))
    return e.groupBy("video_id", "event_type").agg(F.least(F.max_by("value", "event_id") / 100, F.lit(1.0)).alias("p"))


@view("videos")
def videos(spark: SparkSession, sf_dir: str | Bound) -> DataFrame:
    """Every video with an observation."""
    sf_dir = plain(sf_dir)
    if isinstance(sf_dir, Bound):
        return sf_dir.observations().select("video_id").distinct()
    return table(spark, sf_dir, "events").select(F.floor(F.col("user_id") / 10).cast("long").alias("video_id")).distinct()


@view("descriptors")
def descriptors(spark: SparkSession, sf_dir: str | Bound) -> DataFrame:
    sf_dir = plain(sf_dir)
    if isinstance(sf_dir, Bound):
        return sf_dir.descriptors()
    e = table(spark, sf_dir, "embeddings")
    w = Window.partitionBy("label").orderBy("vec_id")
    return e.select(F.col("label").cast("long").alias("clip"), (F.row_number().over(w) - 1).cast("long").alias("frame"), F.col("embedding").cast("array<double>").alias("z"))


DESC = """descr AS (
  SELECT CAST(label AS BIGINT) AS clip, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame, CAST(embedding AS DOUBLE[]) AS z
  FROM embeddings)"""


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A speed-like series for each supplier: quantity shipped each day."""
    li = table(spark, sf_dir, "lineitem")
    day = F.date_diff(F.col("l_shipdate").cast("date"), F.lit("1992-01-01").cast("date")).cast("long")
    return li.groupBy(F.col("l_suppkey").alias("track_id"), day.alias("frame")).agg(F.sum("l_quantity").alias("speed")).withColumn("t", F.col("frame").cast("double"))


SERIES = """series AS (
  SELECT l_suppkey AS track_id, CAST(date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS BIGINT) AS frame,
    sum(l_quantity) AS speed, CAST(date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS DOUBLE) AS t
  FROM lineitem GROUP BY 1, 2, 4)"""


@view("tests")
def tests(spark: SparkSession, sf_dir: str | Bound) -> DataFrame:
    """Orders as test results: region is the stage, nation the test; of a user's own, those not said to be
    excluded are included."""
    sf_dir = plain(sf_dir)
    if isinstance(sf_dir, Bound):
        return sf_dir.table("tests").withColumn("excluded", F.coalesce("excluded", F.lit(False)))
    o, c, n, r = (table(spark, sf_dir, x) for x in ("orders", "customer", "nation", "region"))
    status = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "running").otherwise("error")
    j = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.select(
        F.col("o_orderkey").alias("run_id"), F.col("r_name").alias("stage"), F.col("n_name").alias("test"), status.alias("status"),
        (F.col("o_totalprice") / 5000).alias("severity"), (F.col("o_orderkey") % 10 == 0).alias("excluded"),
    )


TESTS = """tests AS (
  SELECT o_orderkey AS run_id, r_name AS stage, n_name AS test,
    CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'running' ELSE 'error' END AS status,
    o_totalprice / 5000 AS severity, o_orderkey % 10 = 0 AS excluded
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents: is the length a good score of the label?"""
    return table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id").select("doc_id", "quality", "toxic", F.col("n_chars").cast("double").alias("score"), "lang")


SCORED = """scored AS (SELECT doc_id, quality, toxic, CAST(n_chars AS DOUBLE) AS score, lang FROM labels JOIN documents USING (doc_id))"""


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw model replies in four shapes: plain, fenced, wrapped in prose, cut off."""
    e = table(spark, sf_dir, "events")
    k = F.regexp_extract("props", "[0-9]+", 0)
    body = F.concat(F.lit('{"suspicion_score": 0.'), F.lpad(k, 2, "0"), F.lit(', "suspected_failure": "'), F.col("event_type"), F.lit('", "confidence": 0.5}'))
    raw = (
        F.when(F.col("event_id") % 4 == 0, body)
        .when(F.col("event_id") % 4 == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .when(F.col("event_id") % 4 == 2, F.concat(F.lit("I looked closely. "), body, F.lit(" That is all.")))
        .otherwise(F.concat(F.lit('{"suspicion_score": 0.'), F.lpad(k, 2, "0"), F.lit(', "expl')))
    )
    return e.select("event_id", raw.alias("raw"))


REPLIES = """replies AS (
  SELECT event_id, CASE event_id % 4 WHEN 0 THEN body WHEN 1 THEN '```json' || chr(10) || body || chr(10) || '```'
    WHEN 2 THEN 'I looked closely. ' || body || ' That is all.' ELSE '{"suspicion_score": 0.' || k || ', "expl' END AS raw
  FROM (SELECT *, '{"suspicion_score": 0.' || k || ', "suspected_failure": "' || event_type || '", "confidence": 0.5}' AS body
    FROM (SELECT *, lpad(regexp_extract(props, '[0-9]+'), 2, '0') AS k FROM events)))"""
