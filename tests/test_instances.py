"""Instances of a concept are kept as the reference keeps them (backend/tools/sam3.py, lines 50-112)."""

import random
from collections import defaultdict
from datetime import datetime, timedelta

import duckdb
import pytest

from tracewright.plans import catalog

FRAMES, TRACKS = 40, 20


def signals():
    """(track, frame, concept, value): two videos of 40 frames, tracks seen in 3 to 40 of them; views only
    in the first 20, half of the tracks unsure."""
    rng = random.Random(4)
    for track in range(TRACKS):
        seen = [3, 4, 5, 6, 6, 7, 8, 12, 20, 40][track % 10]
        for concept, sure, among in (("click", 60, FRAMES), ("view", 60 if track % 10 < 5 else 40, FRAMES // 2)):
            for frame in rng.sample(range(among), min(seen, among)):
                yield track, frame, concept, sure + rng.randint(-50, 50) / 10


def kept(rows, min_presence=0.15, min_score=0.45, max_instances=6):
    """The reference's rule: a share of all frames of the video, whatever the concept."""
    total, scores = defaultdict(set), defaultdict(list)
    for track, frame, concept, value in rows:
        total[track // 10].add(frame)
        scores[track // 10, concept, track].append(value / 100)
    found = defaultdict(list)
    for (video, concept, track), s in scores.items():
        mean = sum(s) / len(s)
        if not (len(s) < max(2, int(min_presence * len(total[video]))) or mean < min_score):
            found[video, concept].append((-len(s), -mean, track))
    return sorted((v, c, track, -n, round(-mean, 6)) for (v, c), i in found.items() for n, mean, track in sorted(i)[:max_instances])


@pytest.fixture
def folder(tmp_path):
    db = duckdb.connect()
    db.execute("CREATE TABLE events (event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type VARCHAR, value DOUBLE, props VARCHAR)")
    start = datetime(2024, 1, 1, 0, 0, 30)
    db.executemany("INSERT INTO events VALUES (?, ?, ?, ?, ?, '{\"k\": 1}')", [(i, start + timedelta(minutes=f), t, c, v) for i, (t, f, c, v) in enumerate(signals())])
    db.execute(f"COPY events TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    return str(tmp_path)


def test_instances_kept_by_the_reference(spark, folder):
    rows = list(signals())
    want = kept(rows)
    assert min(n for _, _, _, n, _ in want) == 6 and {"click", "view"} == {r[1] for r in want}
    assert len(want) < len(kept(rows, max_instances=99)) < len(kept(rows, min_presence=0.1, max_instances=99))
    assert sorted(map(tuple, catalog.QUERIES["instances_kept"](spark, folder).collect())) == want
    db = duckdb.connect()
    db.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
    assert sorted(db.execute(catalog.ORACLES["instances_kept"]).fetchall()) == want
