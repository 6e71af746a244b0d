"""Particles carried by a flow field, frame after frame, inside each frame's mask, with re-seeding.

A frame's field and mask are one bounded row. Rows are dealt by video and sorted by frame, and a task folds
them as they come: its state is the particles now alive (``POINTS`` at most) and the last mask, a point of a
path is put out as soon as it is certain, and nothing else of a video is held, however long it is.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions import stats as S
from tracewright.plans.base import T, query
from tracewright.sources import tables

#: Cells of the field and of the mask, spacing of the seeds, particles kept alive, points of a path at least.
SIDE, MASK_SIDE, SPACING, POINTS, LEAST = 20, 10, 20, 12, 3
EXTENT = 100
SEEDS = [(float(x), float(y), y // MASK_SIDE * (EXTENT // MASK_SIDE) + x // MASK_SIDE) for y in range(0, EXTENT, SPACING) for x in range(0, EXTENT, SPACING)]


def cell(x: Column, y: Column) -> Column:
    """The field's cell at the nearest pixel, clamped to the frame."""
    at = lambda v: F.floor(F.least(F.greatest(F.bround(v, 0), F.lit(0.0)), F.lit(99.0)) / SIDE)
    return (at(y) * (EXTENT // SIDE) + at(x)).cast("int")


def frames(observations: DataFrame) -> DataFrame:
    """``video_id, frame, flow, mask``: the motion that leads to each frame, by the cell it starts from (of
    several tracks the first one's), and the cells of the mask: those of observed places, errors apart, and
    their neighbours."""
    w = tables.track_window()
    o = observations.select("*", F.lag("x").over(w).alias("px"), F.lag("y").over(w).alias("py"))
    n = EXTENT // MASK_SIDE
    at = lambda c: F.floor(F.least(F.greatest(F.col(c), F.lit(0.0)), F.lit(99.0)) / MASK_SIDE).cast("int")
    around = [(dx, dy) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
    near = F.array_compact(F.array(*[F.when((at("x") + dx).between(0, n - 1) & (at("y") + dy).between(0, n - 1), (at("y") + dy) * n + at("x") + dx) for dx, dy in around]))
    seen = F.when(~F.col("event_type").eqNullSafe("error"), near)
    moves = F.when(F.col("px").isNotNull(), F.struct(cell(F.col("px"), F.col("py")).alias("cell"), "track_id", (F.col("x") - F.col("px")).alias("dx"), (F.col("y") - F.col("py")).alias("dy")))
    return o.groupBy("video_id", "frame").agg(F.array_sort(F.collect_list(moves)).alias("flow"), F.array_distinct(F.flatten(F.collect_list(seen))).alias("mask"))


class Video:
    """The particles alive in one video; ``step`` moves them to the next frame."""

    def __init__(self) -> None:
        self.alive: list[tuple] = []  # id, first step, its first points until they are enough, x, y
        self.next, self.i, self.mask = 0, -1, None

    def seed(self, mask: set[int]) -> None:
        places = [(x, y) for x, y, c in SEEDS if c in mask]
        missing = POINTS - len(self.alive)
        if missing < len(places):
            pace = (len(places) - 1) / (missing - 1) if missing > 1 else 0.0
            places = [places[len(places) - 1 if j and j == missing - 1 else int(j * pace)] for j in range(missing)]
        for x, y in places:
            self.alive.append((self.next, [(self.i, x, y)], x, y))
            self.next += 1

    def step(self, flow: list[dict], mask: list[int]) -> Iterator[tuple[int, int, float, float]]:
        """The points (particle, step, x, y) that have become certain: those of paths of ``LEAST`` points."""
        own = set(mask) if mask else None
        region = own or self.mask
        self.i += 1
        field: dict[int, dict] = {}
        for f in flow:
            field.setdefault(f["cell"], f)
        kept = []
        for number, first, x, y in self.alive:
            moved = field.get(int(min(max(round(y), 0), EXTENT - 1)) // SIDE * (EXTENT // SIDE) + int(min(max(round(x), 0), EXTENT - 1)) // SIDE)
            if moved:
                x, y = x + moved["dx"], y + moved["dy"]
            if region and 0 <= x < EXTENT and 0 <= y < EXTENT and int(y) // MASK_SIDE * (EXTENT // MASK_SIDE) + int(x) // MASK_SIDE in region:
                if first is not None and len(first) + 1 >= LEAST:
                    yield from ((number, *p) for p in first)
                    first = None
                if first is None:
                    yield number, self.i, x, y
                else:
                    first = [*first, (self.i, x, y)]
                kept.append((number, first, x, y))
        self.alive, self.mask = kept, own
        if region and len(kept) < POINTS:
            self.seed(region)


def carried(batches: Iterator[pa.RecordBatch], most: int = 10_000) -> Iterator[pa.RecordBatch]:
    """Points of the paths of ``video_id, flow, mask``, rows of one video together and in order of frame."""
    names = ["video_id", "particle", "step", "x", "y"]
    video, state, out = None, Video(), []
    for b in batches:
        kind = b.schema.field(0).type
        for v, flow, mask in zip(*(c.to_pylist() for c in b.columns)):
            if v != video:
                video, state = v, Video()
            out += ((v, *p) for p in state.step(flow, mask))
            if len(out) >= most:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (kind, pa.int64(), pa.int64(), pa.float64(), pa.float64()))], names)
                out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (kind, pa.int64(), pa.int64(), pa.float64(), pa.float64()))], names)


def paths(observations: DataFrame) -> DataFrame:
    """``video_id, particle, step, x, y``: every point of every path of ``LEAST`` points or more.

    Null tracks' rows fold like others, a null video is none; a frame without a mask has the one before's,
    after that none: its particles end and no new ones come.
    """
    f = frames(observations.where("video_id IS NOT NULL")).repartition("video_id").sortWithinPartitions("video_id", "frame")
    kind = observations.schema["video_id"].dataType.simpleString()
    return f.select("video_id", "flow", "mask").mapInArrow(carried, f"video_id {kind}, particle long, step long, x double, y double")


def _cell_sql(x: str, y: str) -> str:
    at = lambda v: f"floor(least(greatest(round_even({v}, 0), 0), 99) / {SIDE})"
    return f"CAST({at(y)} * 5 + {at(x)} AS BIGINT)"


_INSIDE = "p.x >= 0 AND p.x < 100 AND p.y >= 0 AND p.y < 100 AND coalesce(list_contains(mask, CAST(floor(p.y / 10) * 10 + floor(p.x / 10) AS BIGINT)), false)"
def _seeds_sql(d: str, first: str) -> str:
    """``d`` particles at most, numbered from ``first``, at evenly spaced ones of ``pts``."""
    pick = f"pts[1 + CASE WHEN len(pts) <= {d} THEN j WHEN {d} = 1 THEN 0 WHEN j = {d} - 1 THEN len(pts) - 1 ELSE CAST(trunc(j * ((len(pts) - 1)::DOUBLE / ({d} - 1))) AS BIGINT) END]"
    return f"list_transform(range(least({d}, len(pts))), lambda j: {{'id': {first} + j, 'x': {pick}.x, 'y': {pick}.y}})"


PATHS = f"""po AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM obs WINDOW w AS (PARTITION BY video_id, track_id ORDER BY frame)),
fl AS (SELECT video_id, frame, {_cell_sql('px', 'py')} AS cell, min({{'track_id': track_id, 'dx': x - px, 'dy': y - py}}) AS f FROM po WHERE px IS NOT NULL GROUP BY 1, 2, 3),
fm AS (SELECT video_id, frame, map(list(cell), list(f)) AS flow FROM fl GROUP BY 1, 2),
mk AS (SELECT video_id, frame, CAST(floor(least(greatest(x, 0), 99) / 10) AS BIGINT) + a AS cx, CAST(floor(least(greatest(y, 0), 99) / 10) AS BIGINT) + b AS cy FROM obs, range(-1, 2) r(a), range(-1, 2) s(b) WHERE event_type != 'error'),
ms AS (SELECT video_id, frame, list(DISTINCT cy * 10 + cx) AS mask FROM mk WHERE cx BETWEEN 0 AND 9 AND cy BETWEEN 0 AND 9 GROUP BY 1, 2),
fr AS (SELECT o.video_id, row_number() OVER (PARTITION BY o.video_id ORDER BY o.frame) - 1 AS i, flow, coalesce(mask, lag(mask) OVER (PARTITION BY o.video_id ORDER BY o.frame)) AS mask
  FROM (SELECT DISTINCT video_id, frame FROM obs) o LEFT JOIN fm USING (video_id, frame) LEFT JOIN ms USING (video_id, frame)),
allpts AS (SELECT list({{'x': CAST(x * 20 AS DOUBLE), 'y': CAST(y * 20 AS DOUBLE), 'c': y * 20 + x * 2}} ORDER BY y, x) AS g FROM range(0, 5) a(x), range(0, 5) b(y)),
fs AS (SELECT fr.*, list_filter(g, lambda p: coalesce(list_contains(mask, p.c), false)) AS pts FROM fr, allpts),
r AS (SELECT video_id, 0::BIGINT AS i, {_seeds_sql('12', '0')} AS alive, CAST(least(12, len(pts)) AS BIGINT) AS next FROM fs WHERE i = 0
  UNION ALL
  SELECT video_id, i, list_concat(kept, {_seeds_sql('d', 'next')}), CAST(next + least(d, len(pts)) AS BIGINT)
  FROM (SELECT *, 12 - len(kept) AS d FROM (SELECT *, list_filter(moved, lambda p: {_INSIDE}) AS kept FROM (
    SELECT r.video_id, fs.i, r.next, fs.mask, fs.pts, list_transform(r.alive, lambda p: {{'id': p.id,
      'x': p.x + coalesce(flow[{_cell_sql('p.x', 'p.y')}].dx, 0), 'y': p.y + coalesce(flow[{_cell_sql('p.x', 'p.y')}].dy, 0)}}) AS moved
    FROM r JOIN fs ON fs.video_id = r.video_id AND fs.i = r.i + 1)))),
pth AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY video_id, particle) AS n FROM (SELECT video_id, p.id AS particle, i AS step, p.x AS x, p.y AS y FROM (SELECT video_id, i, unnest(alive) AS p FROM r))) WHERE n >= 3)"""
PATH_VIEWS = ("RECURSIVE " + T.OBS, PATHS)


@query("particle_points", "SELECT video_id, particle, step, round(x, 6) AS x, round(y, 6) AS y FROM pth", *PATH_VIEWS)
def _(spark, sf):
    """Every point of every particle's path."""
    return paths(T.observations(spark, sf)).select("video_id", "particle", "step", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("particle_paths", "SELECT video_id, particle, min(step) AS first_step, count(*) AS n, round(arg_min(x, step), 6) AS x0, round(arg_min(y, step), 6) AS y0, round(arg_max(x, step), 6) AS x1, round(arg_max(y, step), 6) AS y1 FROM pth GROUP BY 1, 2", *PATH_VIEWS)
def _(spark, sf):
    """Where each path begins and ends."""
    end = lambda f, c, name: F.round(f(c, "step"), 6).alias(name)
    p = paths(T.observations(spark, sf)).groupBy("video_id", "particle")
    return p.agg(F.min("step").alias("first_step"), F.count("*").alias("n"), end(F.min_by, "x", "x0"), end(F.min_by, "y", "y0"), end(F.max_by, "x", "x1"), end(F.max_by, "y", "y1"))


def _arc_sql() -> str:
    from tracewright.plans.physics import parabola_sql

    return parabola_sql("arcp", "pfit", "video_id, particle")


@query("particle_arcs", "SELECT video_id, particle, n, round(a, 6) AS a, round(r2, 6) AS r2, round(least(1, 0.5::DOUBLE * least(greatest((0.6::DOUBLE - r2) / 0.6::DOUBLE, 0), 1) + CASE WHEN a < -2 THEN 0.5 ELSE 0 END), 6) AS score FROM pfit WHERE n >= 5 AND (r2 < 0.6 OR a < -2)", *PATH_VIEWS, "arcp AS (SELECT video_id, particle, CAST(step AS DOUBLE) AS t, y FROM pth)", _arc_sql())
def _(spark, sf):
    """Paths of five points or more that fit no parabola or bend upward."""
    p = paths(T.observations(spark, sf)).select("video_id", "particle", F.col("step").cast("double").alias("t"), "y")
    f = S.parabola_fit(p, ["video_id", "particle"]).where("n >= 5 AND (r2 < 0.6 OR a < -2)")
    clip = F.least(F.greatest((0.6 - F.col("r2")) / 0.6, F.lit(0.0)), F.lit(1.0))
    score = F.least(F.lit(1.0), 0.5 * clip + F.when(F.col("a") < -2, 0.5).otherwise(F.lit(0.0)))
    return f.select("video_id", "particle", "n", F.round("a", 6).alias("a"), F.round("r2", 6).alias("r2"), F.round(score, 6).alias("score"))
