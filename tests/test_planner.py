"""Plans of missing evidence and their running, with the caller's own producers and model."""

import pytest
from pyspark.sql import functions as F

from tracewright.operators import planner as N
from tracewright.operators.evidence_table import EvidenceTable

NEEDS = ["trajectory_extractor", "object_tracker"]


def made(name, calls):
    def run(videos):
        calls.append((name, sorted(r.video_id for r in videos.collect())))
        return videos.select("video_id", F.lit(f"{name} result").alias("payload"))

    return run


@pytest.fixture
def store(spark, tmp_path):
    t = EvidenceTable(spark, str(tmp_path))
    t.put(spark.createDataFrame([("a", "object_tracker", "{}"), ("b", "object_tracker", "{}"), ("b", "trajectory_extractor", "{}")], "video_id string, stage_id string, payload string"))
    return t


def videos(spark):
    return spark.createDataFrame([("a",), ("b",), ("c",), ("c",), (None,)], "video_id string")


def plans(df):
    return {r.video_id: (r.run, r.how) for r in df.collect()}


def test_modes(spark, store):
    v, held = videos(spark), store.get_all()
    assert plans(N.planned(v, held, NEEDS, "off")) == {k: ([], "off") for k in "abc"}
    assert plans(N.planned(v, held, NEEDS)) == {"a": (["trajectory_extractor"], "rules"), "b": ([], "rules"), "c": (["object_tracker", "trajectory_extractor"], "rules")}
    said = spark.createDataFrame([("a", '{"sufficient": true}'), ("c", '{"run": ["physics_hypothesis_generator", "x", "event_localizer", "trajectory_extractor", "object_tracker"]}')], "video_id string, raw string")
    assert plans(N.planned(v, held, NEEDS, "agent", said)) == {"a": ([], "sufficient"), "b": ([], "fallback"), "c": (["object_tracker", "trajectory_extractor", "event_localizer"], "told")}
    assert plans(N.planned(v, held, NEEDS, "agent"))["c"] == (["object_tracker", "trajectory_extractor"], "fallback")
    assert N.planned(v.limit(0), held, NEEDS).count() == 0 and plans(N.planned(v, held.limit(0), []))["a"] == ([], "rules")
    for bad in (dict(mode="maybe"), dict(needs=["nobody"])):
        with pytest.raises(ValueError):
            N.planned(v, held, **({"needs": NEEDS} | bad))


def test_each_producer_runs_once_for_all_its_videos(spark, store):
    calls = []
    events = N.ensure(store, videos(spark), NEEDS, {n: made(n, calls) for n in N.TOOLS})
    assert calls == [("object_tracker", ["c"]), ("trajectory_extractor", ["a", "c"])]
    assert events[-1] == {"type": "log", "level": "success", "text": "3 of 3 gained by object_tracker, trajectory_extractor"}
    assert N.ensure(store, videos(spark), NEEDS, {})[-1]["text"] == "nothing to run"


def test_a_failing_producer_stops_no_other(spark, store):
    def broken(_):
        raise RuntimeError("no GPU")

    calls = []
    events = N.ensure(store, videos(spark), NEEDS, {"object_tracker": broken, "trajectory_extractor": made("trajectory_extractor", calls)})
    assert calls == [("trajectory_extractor", ["a", "c"])] and any("no GPU" in e["text"] for e in events)
    assert events[-1]["text"].startswith("2 of 3 gained")
    assert N.ensure(store, videos(spark), ["event_localizer"], {})[-1]["level"] == "warn"


def test_a_model_is_asked_about_every_video(spark, store):
    seen, calls = [], []

    def ask(prompts):
        seen.extend(r.prompt for r in prompts.where("video_id = 'a'").collect())
        return prompts.select("video_id", F.lit('{"run": ["event_localizer"]}').alias("raw"))

    N.ensure(store, videos(spark).where("video_id IS NOT NULL"), NEEDS, {n: made(n, calls) for n in N.TOOLS}, "agent", ask)
    assert calls == [("event_localizer", ["a", "b", "c"])]
    assert len(seen) == 1 and "object_tracker. Producers" in seen[0] and all(t in seen[0] for t in N.TOOLS)

    def dead(_):
        raise TimeoutError("late")

    events = N.ensure(store, videos(spark), NEEDS, {n: made(n, calls) for n in N.TOOLS}, "agent", dead)
    assert "late" in events[0]["text"] and calls[-1] == ("trajectory_extractor", ["a", "c"])
    assert N.ensure(store, videos(spark), NEEDS, {}, "agent")[0]["text"] == "no model to ask: rules"
