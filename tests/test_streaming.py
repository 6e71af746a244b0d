"""Keyed state, the JSON sink, progress and costs of runs."""

import json
import random
import uuid

import pytest
from pyspark.sql import functions as F

from tracewright.operators import shelf as H
from tracewright.operators.registry import Operator, find
from tracewright.sources.bindings import Bound
from tracewright.streaming import sinks as K


def operations(n=300, seed=1):
    r = random.Random(seed)
    out = []
    for seq in range(n):
        op = r.choices(["put", "clear", "clear_all", "nothing"], [90, 8, 1, 1])[0]
        out.append((r.choice(["s1", "s2"]), seq, op, f"v{r.randrange(7)}", r.choice("abc") if op == "put" else None, f"p{seq}" if r.random() > 0.05 else None))
    return out


def slow(rows, most):
    """What each store holds at the end, by the letter of the rules."""
    held = {}
    for store, seq, op, v, stage, payload in sorted(rows, key=lambda r: r[1]):
        videos = held.setdefault(store, [])  # (video, {stage: (seq, payload)}), least recently put first
        at = next((i for i, (x, _) in enumerate(videos) if x == v), None)
        if op == "put":
            stages = videos.pop(at)[1] if at is not None else {}
            videos.append((v, {**stages, stage: (seq, payload)}))
            del videos[: max(0, len(videos) - most)]
        elif op == "clear" and at is not None:
            videos.pop(at)
        elif op == "clear_all":
            videos.clear()
    return sorted((s, v, stage, *x) for s, videos in held.items() for v, stages in videos for stage, x in stages.items())


def key(rows):
    return sorted((tuple(r) for r in rows), key=str)


@pytest.mark.parametrize("most", [1, 3, 16])
def test_batch_contents(spark, most):
    rows = operations()
    df = spark.createDataFrame([*rows, (None, 1, "put", "v", "a", "p"), ("s1", None, "put", "v", "a", "p"), ("s3", 1, "put", None, "a", "p")], H.OPERATIONS).repartition(3)
    got = H.contents(H.changes(df, most)).collect()
    assert key(got) == sorted(slow(rows, most), key=str)
    assert H.changes(df.limit(0)).count() == 0


def test_stream_and_batch_change_the_same(spark, tmp_path):
    for k, v in H.ROCKS.items():
        spark.conf.set(k, v)
    rows = operations(120)
    for i in range(4):  # four files, in order of seq
        spark.createDataFrame(rows[i * 30 : i * 30 + 30], H.OPERATIONS).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    paths = [f"{tmp_path}/in/{i}" for i in range(4)]
    whole = spark.read.parquet(*paths)
    stream = spark.readStream.schema(H.OPERATIONS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    q = H.streamed_changes(stream, 3).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert len([p for p in q.recentProgress if p.numInputRows]) == 4
    got, want = spark.read.parquet(f"{tmp_path}/out").collect(), H.changes(whole, 3).collect()
    assert key(got) == key(want) and len(want) > 100
    assert {r.change for r in want} == {"put", "evict", "clear"}
    assert key(H.contents(spark.read.parquet(f"{tmp_path}/out")).collect()) == sorted(slow(rows, 3), key=str)


EVENTS = "id long, kind string"


def test_killed_and_resumed_run_writes_each_event_once(spark, tmp_path, monkeypatch):
    for i in range(5):
        spark.range(i * 10, i * 10 + 10).select("id", F.lit("log").alias("kind")).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")

    def start():
        s = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
        return K.json_batches(s, f"{tmp_path}/out", f"{tmp_path}/state")

    from pyspark.sql.readwriter import DataFrameWriter

    real, calls = DataFrameWriter.json, []

    def dies_after_writing(self, path, **kw):
        real(self, path, **kw)
        calls.append(path)
        if len(calls) == 3:
            raise RuntimeError("killed")

    monkeypatch.setattr(DataFrameWriter, "json", dies_after_writing)
    with pytest.raises(Exception, match="killed"):
        start().awaitTermination()
    monkeypatch.setattr(DataFrameWriter, "json", real)
    assert K.read_batches(spark, f"{tmp_path}/out", EVENTS).count() == 30  # the third batch was written, not committed
    start().awaitTermination()
    rows = K.read_batches(spark, f"{tmp_path}/out", EVENTS).collect()
    assert sorted(r.id for r in rows) == list(range(50)) and {r.batch for r in rows} == set(range(5))
    assert K.read_batches(spark, f"{tmp_path}/none", EVENTS).count() == 0


def test_progress_of_a_finished_stream(spark, tmp_path):
    for i in range(3):
        spark.range(7).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    events, name = [], f"p{uuid.uuid4().hex}"
    listener = K.Progress(name, 21, events.append)
    spark.streams.addListener(listener)
    try:
        s = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
        q = s.writeStream.queryName(name).format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        q.awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        for _ in range(50):
            if events and events[-1]["type"] == "done":
                break
            import time

            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    assert events == [{"type": "progress", "done": d, "total": 21} for d in (7, 14, 21)] + [{"type": "done", "total": 21}]


def test_costs_come_before_done(spark, tmp_path):
    rows = [("up", 1, "x", i, float(i), 50.0, 80 - 0.02 * i * i) for i in range(60)]
    own = Bound({"observations": spark.createDataFrame(rows, "video_id string, track_id long, label string, frame long, t double, x double, y double")})
    ticks = iter([10.0, 12.5])
    events = K.run_with_costs(spark, find("gravity"), own, str(tmp_path), clock=lambda: next(ticks))
    kinds = [e["type"] for e in events]
    assert kinds == ["log", "timing", "metric", "metric", "done"]
    assert events[1] == {"type": "timing", "duration_ms": 2500, "rows_in": 60, "rows_out": spark.read.json(f"{tmp_path}/result").count(), "badge": "medium"}
    lines = [json.loads(line) for p in sorted((tmp_path / "events").glob("part-*")) for line in p.read_text().splitlines()]
    assert [e["type"] for e in lines] == kinds and lines[1]["rows_out"] == 1


def test_a_failed_run_ends_in_error(spark, tmp_path):
    events = K.run_with_costs(spark, Operator("broken", 1, "no_such_query"), "/root/testdata/sf0.001", str(tmp_path))
    assert [e["type"] for e in events] == ["log", "error"] and "no_such_query" in events[1]["text"]
