"""Contacts of grown masks against a plain count over sets of pixels."""

import random

import pytest

from tracewright.functions import masks as K

SCHEMA = "video_id long, track_id long, frame long, px long, py long"


def grown(mask, n, w, h):
    return {(x + i, y + j) for x, y in mask for i in range(-n, n + 1) for j in range(-n, n + 1) if 0 <= x + i < w and 0 <= y + j < h}


def brute(rows, w, h, n):
    by = {}
    for v, t, f, x, y in rows:
        by.setdefault((v, f), {}).setdefault(t, set()).add((x, y))
    out = {}
    for (v, f), tracks in by.items():
        for a in tracks:
            for b in tracks:
                near = len(grown(tracks[a], n, w, h) & grown(tracks[b], n, w, h))
                if a < b and near:
                    least = min(len(tracks[a]), len(tracks[b]))
                    out[v, f, a, b] = (near / least, len(tracks[a] & tracks[b]) / least)
    return out


@pytest.mark.parametrize("n", [1, 2])
def test_random_masks(spark, n):
    rnd = random.Random(5)
    rows = set()
    for v in range(3):
        for f in range(12):
            for t in range(rnd.randint(1, 6)):
                x, y, s = rnd.randrange(24), rnd.randrange(16), rnd.randint(1, 6)
                rows |= {(v, t, f, i, j) for i in range(x, min(24, x + s)) for j in range(y, min(16, y + s)) if rnd.random() < 0.8}
    got = K.mask_contacts(spark.createDataFrame(sorted(rows), SCHEMA), 24, 16, n).collect()
    assert {(r.video_id, r.frame, r.track_a, r.track_b): (r.contact, r.overlap) for r in got} == brute(rows, 24, 16, n)
    assert len(got) > 20 and any(r.overlap == 0 for r in got) and any(r.overlap > 0 for r in got)


def test_overlaps(spark):
    rnd = random.Random(6)
    rows = sorted({(v, t, f, x + i, y + j) for v in range(2) for f in range(12) for t in range(4) for x, y in [(rnd.randrange(12), rnd.randrange(12))] for i in range(5) for j in range(5) if rnd.random() < 0.8})
    want = {k: o for k, (_, o) in brute(rows, 99, 99, 0).items()}
    got = K.mask_overlap(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(r.video_id, r.frame, r.track_a, r.track_b): r.overlap for r in got} == want and len(want) > 10
    size = {}
    for v, t, f, _, _ in rows:
        size[v, f, t] = size.get((v, f, t), 0) + 1
    for r in got:
        a, b = size[r.video_id, r.frame, r.track_a], size[r.video_id, r.frame, r.track_b]
        assert r.iou == r.shared / (a + b - r.shared) and r.overlap == r.shared / min(a, b)


def test_touching_at_the_edge_and_apart(spark):
    rows = [(1, 1, 0, 0, 0), (1, 2, 0, 2, 0), (1, 3, 0, 5, 0), (1, 4, 1, 0, 0)]
    got = K.mask_contacts(spark.createDataFrame(rows, SCHEMA), 6, 6).collect()
    # Grown, 1 and 2 share the column between them (two pixels in the frame); 3 is one pixel too far.
    assert [(r.track_a, r.track_b, r.contact, r.overlap) for r in got] == [(1, 2, 2.0, 0.0)]


def test_no_masks(spark):
    assert K.mask_contacts(spark.createDataFrame([], SCHEMA), 6, 6).count() == 0


def test_surface_against_brute_force(spark):
    import statistics

    rnd = random.Random(7)
    rows = sorted({(v, t, 0, rnd.randrange(-2, 9), rnd.randrange(9)) for v in range(3) for t in range(5) for _ in range(12)})
    top = {}
    for v, t, f, x, y in rows:
        cols = top.setdefault((v, t, f), {})
        cols[x] = min(y, cols.get(x, y))
    got = K.surface_line(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(r.video_id, r.track_id, r.frame): r.surface for r in got} == {k: float(statistics.median(c.values())) for k, c in top.items()}


@pytest.mark.parametrize("name", ["dilated_contact", "interpenetration", "mask_overlap", "mean_mask_iou", "surface_line"])
def test_masks_stay_rows(spark, name):
    """No plan unfolds the pixels of all masks to rows: only masks that come near get them, inside their row."""
    from tracewright.plans import catalog

    plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "explode([-4" not in plan and "explode(sequence(-4" not in plan and "dx#" not in plan


def test_every_pair_of_tracks_has_a_mean(spark, tmp_path):
    """Two tracks of a video that are never in one frame are listed with 0."""
    from tracewright.plans import catalog

    e = spark.read.parquet("/root/testdata/sf0.1/events.parquet").where("user_id < 20 AND event_id < 8000")
    e.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got = catalog.QUERIES["mean_mask_iou"](spark, str(tmp_path)).collect()
    assert any(r.n_shared == 0 and r.iou == 0 for r in got) and any(r.n_shared > 0 for r in got)
    assert "iou_any" in catalog.QUERIES["box_border_predicates"](spark, str(tmp_path)).columns
