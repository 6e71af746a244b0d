"""Operators on a user's own tables: the registered queries over hand-built observations."""

import math

import pytest
from pyspark.sql import functions as F

from tracewright.__main__ import main
from tracewright.operators.registry import OPERATORS, Setting, find
from tracewright.sources import tables as T
from tracewright.sources.bindings import Bound

SF = "/root/testdata/sf0.01"
SCHEMA = "video_id string, track_id long, label string, frame long, t double, x double, y double"


def rows_of(df):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect()), key=str)


def track(video, track_id, place, n=60, start=0):
    return [(video, track_id, "thing", start + i, float(start + i), *map(float, place(i))) for i in range(n)]


@pytest.fixture(scope="module")
def clips(spark):
    """Clips of one event each, in canonical units."""
    rows = track("up", 1, lambda i: (50, 80 - 0.04 * i - 0.02 * i * i))  # falls upwards, ever faster
    rows += track("down", 1, lambda i: (50, 10 + 0.02 * i * i), 50)  # a clean fall
    rows += track("gain", 1, lambda i: (50, 20 + 2.5 * i if i < 20 else 70 - 4.5 * (i - 20)), 30) + track("gain", 2, lambda i: (52, 72) if 15 <= i <= 25 else (95, 5), 30)
    rows += track("ice", 1, lambda i: (5 + 7 * i, 80), 13)  # slides and does not slow down
    rows += track("early", 1, lambda i: (20 + (0.5 if i < 40 else 3) * (i if i < 40 else i - 40), 50)) + track("early", 2, lambda i: (90, 50))
    return spark.createDataFrame(rows, SCHEMA)


def test_gravity_on_own_tables(spark, clips):
    got = {r.video_id: r.verdict for r in find("gravity").run(spark, Bound({"observations": clips})).where("video_id IN ('up', 'down')").collect()}
    assert got == {"up": "anti_gravity", "down": "ballistic"}


def test_collision_on_own_tables(spark, clips):
    r = find("collision").run(spark, Bound({"observations": clips})).where("video_id = 'gain' AND track_id = 1").collect()
    assert len(r) == 1 and r[0].energy_gain and r[0].e == pytest.approx(4.5 / 2.5)
    strict = find("collision").run(spark, Bound({"observations": clips}), {"restitution_max": 2}).where("video_id = 'gain'").collect()
    assert not any(x.energy_gain for x in strict)


def test_friction_on_own_tables(spark, clips):
    r = find("friction").run(spark, Bound({"observations": clips})).where("video_id = 'ice'").collect()
    assert len(r) == 1 and r[0].score == pytest.approx(0.8)


def test_causality_on_own_tables(spark, clips):
    said = spark.createDataFrame([("early", "error", 0.9), ("early", "error", 0.3), ("ice", "view", 7.0)], "video_id string, event_type string, p double")
    got = {r.video_id: r for r in find("causality").run(spark, Bound({"observations": clips, "answers": said})).collect()}
    assert set(got) == {"up", "down", "gain", "ice", "early"}
    assert got["down"].severity == 0 and got["ice"].severity == 25 and got["early"].severity >= 22
    alone = {r.video_id: r.severity for r in find("causality").run(spark, Bound({"observations": clips})).collect()}
    assert alone["ice"] == 0


@pytest.mark.parametrize("name", ["gravity", "collision", "friction", "momentum", "trajectory_extractor", "object_tracker", "causality"])
def test_driver_tables_are_one_binding(spark, name):
    """The driver's grid, bound as a user's observations, gives the rows of the folder."""
    g = T.grid(spark, SF)
    own = Bound({"observations": g.withColumn("more", F.lit(1)), "answers": T.answers(spark, SF)})
    assert rows_of(find(name).run(spark, own)) == rows_of(find(name).run(spark, SF))


def test_units(spark, clips):
    """Pixels, seconds and frames of another rate give the rows of canonical units."""
    px = clips.select("video_id", "track_id", "label", (F.col("frame") * 2).alias("frame"), (F.col("t") / 24).alias("t"), (F.col("x") * 19.2).alias("x"), (F.col("y") * 10.8).alias("y"))
    own = Bound({"observations": px}, width=1920, height=1080, fps=48)
    plain = Bound({"observations": clips})
    for name in ("gravity", "friction", "collision"):
        a, b = rows_of(find(name).run(spark, own)), rows_of(find(name).run(spark, plain))
        assert len(a) == len(b) > 0
        for x, y in zip(a, b):
            assert all(math.isclose(p, q, rel_tol=1e-5, abs_tol=1e-5) if isinstance(p, float) else p == q for p, q in zip(x, y))


def test_odd_rows(spark, clips):
    """Null places are no observations, repeated rows count once, the table may be empty."""
    bad = spark.createDataFrame([("up", 1, "x", 5, None, 1.0, 1.0), ("up", None, "x", 5, 5.0, 1.0, 1.0), (None, 1, "x", 5, 5.0, 1.0, 1.0), ("up", 1, None, 5, 5.0, None, 1.0)], SCHEMA)
    own = Bound({"observations": clips.unionByName(clips).unionByName(bad)})
    for name in ("gravity", "collision", "causality"):
        assert rows_of(find(name).run(spark, own)) == rows_of(find(name).run(spark, Bound({"observations": clips})))
        assert find(name).run(spark, Bound({"observations": clips.limit(0)})).count() == 0


def test_checks(spark, clips):
    with pytest.raises(ValueError, match="x is missing; y is missing"):
        Bound({"observations": clips.drop("x", "y")})
    with pytest.raises(ValueError, match="frame is string, not bigint"):
        Bound({"observations": clips.withColumn("frame", F.lit("7"))})
    with pytest.raises(KeyError, match="signals"):
        find("event_localizer").run(spark, Bound({"observations": clips}))
    with pytest.raises(ValueError):
        Bound({"observations": clips}, fps=0)


def test_signals_and_tests(spark):
    s = spark.createDataFrame([("v", None, "jump", f, f / 24, 0.5) for f in (0, 10, 100, 101)], "video_id string, track_id long, signal_type string, frame long, t double, score double")
    m = find("event_localizer").run(spark, Bound({"signals": s})).collect()
    assert [(r.frame_start, r.frame_end, r.n_signals) for r in sorted(m, key=lambda r: r.frame_start)] == [(0, 10, 2), (100, 101, 2)]


def test_settings_of_choice():
    s = Setting("model", "str", "a", label="Model", options=("a", "b"))
    assert [s.read(v) for v in ("b", "c", None)] == ["b", "a", "a"]
    assert all(x.label for o in OPERATORS for x in o.settings) and all(o.reads for o in OPERATORS)


def test_command_line(spark, clips, tmp_path, capsys):
    clips.write.parquet(f"{tmp_path}/obs")
    main(["run", "gravity", "--table", f"observations={tmp_path}/obs", "--set", "r2_min=0.5", "--out", f"{tmp_path}/out"])
    assert spark.read.json(f"{tmp_path}/out/gravity").where("verdict = 'anti_gravity'").count() >= 1
    with pytest.raises(SystemExit):
        main(["run", "gravity"])
