"""The velocity field and the particles it carries."""

import tracemalloc

import pyarrow as pa
import pytest

from tracewright.plans import advection as A
from tracewright.plans import violations as V


def test_divergence_of_known_fields(spark):
    """u = 3 * cx, v = -cy on a full grid of cells: divergence 2 everywhere; a lone cell has none."""
    rows = [(1, 0, 20.0 * cx + 5, 20.0 * cy + 5, 3.0 * cx, -1.0 * cy) for cx in range(5) for cy in range(5)] + [(1, 1, 50.0, 50.0, 7.0, 7.0)]
    field = V.velocity_field(spark.createDataFrame(rows, "video_id long, frame long, x double, y double, vx double, vy double")).collect()
    assert {r.d for r in field if r.frame == 0} == {2.0} and [r.d for r in field if r.frame == 1] == [0.0]
    plan = V.velocity_field(spark.createDataFrame(rows, "video_id long, frame long, x double, y double, vx double, vy double"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_a_rotation_has_no_divergence(spark):
    rows = [(1, 0, 20.0 * cx + 5, 20.0 * cy + 5, -2.0 * cy, 2.0 * cx) for cx in range(5) for cy in range(5)]
    assert {r.d for r in V.velocity_field(spark.createDataFrame(rows, "video_id long, frame long, x double, y double, vx double, vy double")).collect()} == {0.0}


ALL = list(range(100))


def batches(n, video=1, flow=None, mask=ALL, size=100):
    for i in range(0, n, size):
        k = min(size, n - i)
        yield pa.RecordBatch.from_arrays([pa.array([video] * k), pa.array([flow or []] * k, pa.list_(pa.struct([("cell", pa.int32()), ("track_id", pa.int64()), ("dx", pa.float64()), ("dy", pa.float64())]))), pa.array([mask] * k, pa.list_(pa.int32()))], ["video_id", "flow", "mask"])


def points(it):
    return [tuple(r.values()) for b in it for r in b.to_pylist()]


def test_still_particles_live_on_and_seeds_are_even():
    got = points(A.carried(batches(5)))
    assert len({p[1] for p in got}) == A.POINTS and all(sum(q[1] == k for q in got) == 5 for k in range(A.POINTS))
    first = [p[3:] for p in got if p[2] == 0]
    places = [(x, y) for x, y, _ in A.SEEDS]
    assert first[0] == places[0] and first[-1] == places[-1] and first == sorted(first, key=lambda p: (p[1], p[0]))


def test_leaving_the_mask_ends_a_path_and_seeds_anew():
    """All drift 10 to the right; the mask is the two leftmost columns of cells: a seed at 0 lasts two frames."""
    left = [c for c in ALL if c % 10 < 3]
    flow = [{"cell": c, "track_id": 1, "dx": 10.0, "dy": 0.0} for c in range(25)]
    got = points(A.carried(batches(20, flow=flow, mask=left)))
    paths = {}
    for _, k, i, x, y in got:
        paths.setdefault(k, []).append((i, x, y))
    assert paths and all(len(p) == 3 for p in paths.values())  # x = 0, 10, 20; seeds at 20 last one frame and are no path
    assert all(x == 10.0 * j for p in paths.values() for j, (_, x, _) in enumerate(p))


def test_a_missing_mask_is_the_one_before_once():
    rows = [(ALL, 0), (None, 1), (ALL, 2), (None, 3), (None, 4), (ALL, 5), (ALL, 6), (ALL, 7)]
    state, out = A.Video(), []
    for mask, _ in rows:
        out += state.step([], mask or [])
    last = {k: max(i for n, i, *_ in out if n == k) for k, *_ in out}
    assert {last[k] for k in range(A.POINTS)} == {3} and max(last.values()) == 7 and len(last) == 2 * A.POINTS


@pytest.mark.parametrize("n", [30_000])
def test_a_long_video_needs_no_more_memory(n):
    """Frames come and points go; what is held does not grow with the video."""
    def peak(k):
        tracemalloc.start()
        rows = sum(b.num_rows for b in A.carried(batches(k), most=1000))
        top = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return rows, top

    few, many = peak(n // 10), peak(n)
    assert many[0] == 10 * few[0] == n * A.POINTS and many[1] < 1.3 * few[1]


def test_two_videos_and_empty_tables(spark):
    rows = [(v, 1, i, float(i), 50.0 + i, 50.0, "view") for v in (1, 2) for i in range(6)]
    o = spark.createDataFrame(rows, "video_id long, track_id long, frame long, t double, x double, y double, event_type string")
    p = A.paths(o).collect()
    one, two = ([tuple(r)[1:] for r in p if r.video_id == v] for v in (1, 2))
    assert one == two and one
    assert A.paths(o.limit(0)).count() == 0
