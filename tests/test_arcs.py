"""Fits of particles' paths on the threshold of their bend."""

from collections import defaultdict
from fractions import Fraction

import duckdb

from tracewright.plans import advection as A
from tracewright.plans import catalog
from tracewright.sources import tables as T

SF = "/root/testdata/sf0.1"


def bend(points):
    """Twice the quadratic coefficient of the parabola through ``(step, y)``, without rounding."""
    u = [s - min(points)[0] for s, _ in points]
    s0, s1, s2, s3, s4 = (sum(x**k for x in u) for k in range(5))
    y0, y1, y2 = (sum(x**k * Fraction(y) for x, (_, y) in zip(u, points)) for k in range(3))
    det = s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s2 * s3) + s2 * (s1 * s3 - s2 * s2)
    return 2 * (s0 * (s2 * y2 - s3 * y1) - s1 * (s1 * y2 - s2 * y1) + y0 * (s1 * s3 - s2 * s2)) / det


def test_arcs_differ_from_sql_only_where_the_bend_is_exactly_the_threshold(spark):
    """A path of whole numbers whose bend is exactly -2 falls to one side of ``a < -2`` by the noise of its sums. The
    SQL sums in whatever order its rows come, so its own runs differ there; everywhere else the rows are its."""
    db = duckdb.connect()
    db.execute(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    want = {tuple(r) for r in db.execute(catalog.ORACLES["particle_arcs"]).fetchall()}
    got = {tuple(r) for r in catalog.QUERIES["particle_arcs"](spark, SF).collect()}
    paths = defaultdict(list)
    for r in A.paths(T.observations(spark, SF)).collect():
        paths[r.video_id, r.particle].append((r.step, r.y))
    assert {bend(paths[r[:2]]) for r in got ^ want} <= {-2}
    assert len(got & want) > 3700
