"""Settings reach the queries, and the command line sets them."""

import inspect

import pytest

from tracewright.__main__ import main
from tracewright.operators.registry import OPERATORS, find
from tracewright.plans import catalog
from tracewright.plans.physics import flight_verdict

SF = "/root/testdata/sf0.001"


def test_every_setting_is_a_parameter_with_the_same_default():
    for o in OPERATORS:
        parameters = inspect.signature(catalog.QUERIES[o.query]).parameters
        assert {s.id: s.default for s in o.settings} == {k: p.default for k, p in parameters.items() if k not in ("spark", "sf")}, o.id


@pytest.mark.parametrize("name,given", [("event_localizer", {"merge_frames": "600"}), ("physics_hypothesis_generator", {"top": "1"}), ("temporal_smoothness", {"threshold": "1"}), ("optical_flow", {"spike": "20"}), ("trajectory_extractor", {"z_threshold": "1"}), ("object_tracker", {"near_px": "60"})])
def test_settings_change_the_rows(spark, name, given):
    assert find(name).run(spark, SF, given).count() != find(name).run(spark, SF).count()


def clip01(x):
    return min(max(x, 0.0), 1.0)


@pytest.mark.parametrize("tolerance", [0.3, 1.0, 2.0])
def test_momentum_follows_its_tolerance(spark, tolerance):
    rows = find("momentum").run(spark, SF, {"tolerance": tolerance}).collect()
    assert rows and all(r.jump > tolerance and r.score == pytest.approx(0.8 * clip01(r.jump / (2 * tolerance))) for r in rows)


@pytest.mark.parametrize("name,setting,values", [("collision", "restitution_max", (0.5, 3)), ("friction", "tolerance", (0.01, 1)), ("fluid", "tolerance", (0.5, 20)), ("causality", "fire_threshold", (0, 1)), ("deformation", "spike", (0.5, 2)), ("embedding_biomarkers", "threshold", (0.5, 10)), ("camera_motion", "min_inliers", (0, 1)), ("optical_flow", "floor", (0, 1))])
def test_every_other_setting_matters(spark, name, setting, values):
    low, high = (sorted(map(str, find(name).run(spark, "/root/testdata/sf0.01", {setting: v}).collect())) for v in values)
    assert low != high


@pytest.mark.parametrize("r2_min", [0.3, 0.6, 0.9])
def test_gravity_follows_its_fit(spark, r2_min):
    """A fall whose fit is worse than the least one by more than an eightieth is no parabola, scored by how much."""
    fits = spark.createDataFrame([(1.0, 0.0, 10.0, r / 20, 0.0, 0.0) for r in range(21)], "a double, t0 double, t1 double, r2 double, rms_frac double, jump_frac double")
    for r in flight_verdict(fits, r2_min).collect():
        q = (r2_min - r.r2) / 0.25
        assert r.verdict == ("non_parabolic_fall" if q > 0.05 else "ballistic") and r.score == pytest.approx(min(1.0, q) if q > 0.05 else 0.0)
        assert r.ballistic == (r.r2 >= r2_min)


def test_friction_follows_its_tolerance(spark):
    """A wider tolerance keeps what a narrower one finds and scores it higher."""
    few, many = ({(r.track_id, r.f0): r.score for r in find("friction").run(spark, SF, {"tolerance": t}).collect()} for t in (0.05, 0.2))
    assert set(few) <= set(many) and all(many[k] >= v - 1e-9 for k, v in few.items()) and len(many) >= len(few)


@pytest.mark.parametrize("limit", [0.6, 2.0])
def test_collision_follows_its_limit(spark, limit):
    assert all(r.energy_gain == (r.e > limit) and r.score == pytest.approx(min(1.0, r.e - 1)) for r in find("collision").run(spark, SF, {"restitution_max": limit}).collect())


def test_command_line(spark, tmp_path, capsys):
    main(["run", "physics_hypothesis_generator", SF, "--set", "top=1", "--prereq", "--out", str(tmp_path)])
    rows = spark.read.json(f"{tmp_path}/physics_hypothesis_generator")
    assert rows.count() == rows.select("video_id").distinct().count() > 0
    assert {p.name for p in tmp_path.iterdir()} >= {"object_tracker", "trajectory_extractor", "event_localizer"}
    with pytest.raises(KeyError):
        main(["run", "gravity", SF, "--set", "nothing=1"])
    main(["list"])
    assert "merge_frames=30" in capsys.readouterr().out
