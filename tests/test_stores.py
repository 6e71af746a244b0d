"""The evidence table, results by key, fetching, replies and smoothing of short series."""

import struct

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tracewright.functions import kinematics as K
from tracewright.functions import parsing as P
from tracewright.functions import stats as S
from tracewright.operators import results as R
from tracewright.operators.evidence_table import EvidenceTable
from tracewright.sources import fetch

E = "video_id string, stage_id string, payload string"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_put_overwrite_get_has_clear_compact(spark, tmp_path):
    t = EvidenceTable(spark, f"file://{tmp_path}/evidence")
    assert t.version() == 0 and t.get_all().count() == 0
    assert t.put(spark.createDataFrame([("a", "tracks", "1"), ("a", "events", "2"), ("b", "tracks", "3"), (None, "tracks", "x"), ("b", None, "x")], E)) == 1
    t.put(spark.createDataFrame([("a", "tracks", "9"), ("c", "tracks", None)], E))
    want = [("a", "events", "2", 1), ("a", "tracks", "9", 2), ("b", "tracks", "3", 1), ("c", "tracks", None, 2)]
    assert rows(t.get_all()) == want
    keys = spark.createDataFrame([("a", "tracks"), ("a", "none"), ("c", "tracks")], "video_id string, stage_id string")
    assert rows(t.has(keys)) == [("a", "none", False), ("a", "tracks", True), ("c", "tracks", True)]
    assert rows(t.get(keys)) == [("a", "none", None), ("a", "tracks", "9"), ("c", "tracks", None)]
    t.clear(spark.createDataFrame([("a",), ("nobody",), (None,)], "video_id string"))
    assert [r[0] for r in rows(t.get_all())] == ["b", "c"]
    assert t.compact() == 3 and [r[0] for r in rows(t.get_all())] == ["b", "c"]
    t.put(spark.createDataFrame([("a", "tracks", "new")], E))
    assert rows(t.get_all()) == [("a", "tracks", "new", 4), ("b", "tracks", "3", 1), ("c", "tracks", None, 2)]
    assert rows(t.get_all(version=2)) == want and rows(EvidenceTable(spark, t.path).get_all()) == rows(t.get_all())
    t.clear()
    assert t.get_all().count() == 0 and t.version() == 5
    t.put(spark.createDataFrame([("d", "tracks", "4")], E))
    assert rows(t.get_all()) == [("d", "tracks", "4", 6)]


def test_a_version_that_was_not_committed_does_not_count(spark, tmp_path):
    t = EvidenceTable(spark, str(tmp_path))
    t.put(spark.createDataFrame([("a", "s", "1")], E))
    spark.createDataFrame([("a", "s", "half", "put", 2)], "video_id string, stage_id string, payload string, op string, version long").write.parquet(f"{tmp_path}/log/version=2")
    (tmp_path / "log" / "version=2" / "_SUCCESS").unlink()
    assert rows(t.get_all()) == [("a", "s", "1", 1)]
    assert t.put(spark.createDataFrame([("a", "s", "2")], E)) == 2 and rows(t.get_all()) == [("a", "s", "2", 2)]


def test_upsert_replaces_only_its_keys(spark, tmp_path):
    path, schema = f"{tmp_path}/results", "score double, model string"
    R.upsert(spark.createDataFrame([("a", 0.1), ("a", 0.2), ("b", 0.3)], "model string, score double"), path, ["model"])
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "results" / "model=b").iterdir()}
    R.upsert(spark.createDataFrame([("a", 0.9), ("c", 0.5)], "model string, score double"), path, ["model"])
    assert rows(R.stored(spark, path, schema)) == [(0.3, "b"), (0.5, "c"), (0.9, "a")]
    assert before == {p: p.stat().st_mtime_ns for p in (tmp_path / "results" / "model=b").iterdir()}
    R.upsert(spark.createDataFrame([], "model string, score double"), path, ["model"])
    assert R.stored(spark, path, schema).count() == 3


def png(w, h):
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", w, h)


def test_one_bad_file_of_ten(spark, tmp_path):
    """A listing is filtered, sorted and numbered; the client fails on one file, which stops no other."""
    names = [f"clips/{i}.mp4" for i in range(10)] + ["clips/readme.txt", "other/x.mp4", "clipsx/y.mp4", None, "clips/3.mp4"]
    for i in range(10):
        (tmp_path / f"{i}.mp4").write_bytes(png(i + 1, 2 * i + 1))
    (tmp_path / "4.mp4").unlink()
    base = str(tmp_path)

    def client(path):
        with open(f"{base}/{path.rpartition('/')[2]}", "rb") as f:
            return f.read()

    files = fetch.chosen(spark.createDataFrame([(n,) for n in names], "path string"), "/clips/")
    assert rows(files) == [(f"clips/{i}.mp4", i + 1, 10) for i in range(10)]
    got = {r["path"]: r for r in fetch.sized(fetch.fetched(files, client, parallel=3, at_once=2)).collect()}
    assert len(got) == 10 and [p for p, r in got.items() if r.error] == ["clips/4.mp4"]
    assert got["clips/4.mp4"].error.startswith("FileNotFoundError") and got["clips/4.mp4"].content is None and got["clips/4.mp4"].width is None
    assert all((r.width, r.height) == (r["index"], 2 * r["index"] - 1) for r in got.values() if not r.error)
    events = fetch.fetch_events(fetch.fetched(files, client)).orderBy("place").collect()
    assert [e.type for e in events].count("file") == 9 and [e.type for e in events].count("log") == 1 and events[-1].type == "done"
    assert [e.done for e in events if e.type == "progress"] == list(range(1, 11))
    assert fetch.chosen(spark.createDataFrame([(n,) for n in names], "path string"), most=2).count() == 2
    assert fetch.chosen(spark.createDataFrame([], "path string")).count() == 0


def test_numbering_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(S, "RANGE_ROWS", 50)
    df = spark.range(1000).selectExpr("concat('p', (id * 7919) % 1000) AS path", "id % 3 AS w").repartition(5)
    got = S.numbered(df, ["path"], "i", "n").collect()
    assert [r.path for r in sorted(got, key=lambda r: r.i)] == sorted(r.path for r in got) and {r.i for r in got} == set(range(1, 1001)) and got[0].n == 1000
    low = S.before(df.selectExpr("int(substr(path, 2)) AS v", "w"), "v", "w", "below").collect()
    total = 0
    for r in sorted(low, key=lambda r: r.v):
        assert r.below == total
        total += r.w
    assert spark.range(1).select(S.median_of(df.selectExpr("int(substr(path, 2)) AS v"), "v").alias("m")).first().m == 499.5
    s = df.selectExpr("int(substr(path, 2)) AS v", "-int(substr(path, 2)) AS u", "w")
    assert S.spearman(s, "v", "u").first().rho == pytest.approx(-1) and S.spearman(s.limit(0), "v", "u").first().n == 0


@pytest.mark.parametrize("raw,score,failure,said", [
    ('{"suspicion_score": 0.3, "confidence": 0.8}', 0.3, None, None), ('```json\n{"suspicion_score": 0.7}\n```', 0.7, None, None), ("the image looks fine", None, None, "unparseable: the image looks fine"),
    ('{"suspicion_score": 0.3, "suspected_failure": "gravity", "explanat', 0.3, "gravity", "recovered from truncated reply"), ('{"suspicion_score": 0.6, "explanation": "the ball passes through the floor and', 0.6, None, "the ball passes through the floor and"),
    ('{"explanation": "no score', None, None, 'unparseable: {"explanation": "no score'), (None, None, None, "unparseable: "), ("x" * 500, None, None, "unparseable: " + "x" * 120),
])
def test_replies(spark, raw, score, failure, said):
    r = P.parse_reply(spark.createDataFrame([(raw,)], "raw string")).first()
    assert (r.suspicion_score, r.suspected_failure, r.explanation) == (score, failure, said) and r.confidence in (0.0, 0.8)


def slow_text(data):
    for k in P.TEXT_KEYS:
        v = data.get(k)
        if isinstance(v, str) and v.strip():
            return v
        if isinstance(v, dict) and (inner := slow_text(v)):
            return inner
    return ""


def test_nested_reply_text(spark):
    import json
    import random

    r = random.Random(4)

    def value(depth):
        kind = r.randrange(6)
        if kind < 3 and depth < 5:
            return {k: value(depth + 1) for k in r.sample([*P.TEXT_KEYS, "id", "meta"], r.randrange(1, 4))}
        return [" ", "", "\n", r.random(), None, ["text"], f"t{r.randrange(99)}: {{x}}", True][r.randrange(8)]

    data = [{k: value(1) for k in r.sample([*P.TEXT_KEYS, "id"], 3)} for _ in range(300)]
    got = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(data)], "i int, raw string").select("i", P.reply_text(F.col("raw")).alias("t")).collect()
    assert {x.i: x.t for x in got} == {i: slow_text(d) for i, d in enumerate(data)} and any(slow_text(d) for d in data)
    odd = spark.createDataFrame([(None,), ("",), ("[1]",), ('"text"',), ("{broken",)], "raw string").select(P.reply_text(F.col("raw")).alias("t")).collect()
    assert {x.t for x in odd} == {""}


def slow_smooth(y, window):
    """The rule with numpy's own least squares."""
    n = len(y)
    w = min(window, n if n % 2 else n - 1)
    if n < 3 or w < 3:
        return list(y)
    out = []
    for i in range(n):
        a = min(max(i - w // 2, 0), n - w)
        out.append(np.polyval(np.polyfit(np.arange(w), y[a : a + w], min(2, w - 1)), i - a))
    return out


@pytest.mark.parametrize("window", [2, 3, 5, 7, 11])
def test_smoothing_of_short_series(spark, window):
    r = np.random.default_rng(window)
    data = [(n, i, float(v)) for n in range(1, 15) for i, v in enumerate(r.normal(size=n) * 10)]
    df = spark.createDataFrame(data, "n int, i int, y double")
    w = Window.partitionBy("n").orderBy("i")
    size = F.count("*").over(Window.partitionBy("n"))
    got = df.withColumn("size", size).select("n", "i", "y", K.savgol(F.col("y"), w, F.col("i"), F.col("size"), window).alias("s"), K.boxcar(F.col("y"), w, F.col("size"), window).alias("b")).collect()
    for n in range(1, 15):
        rows_ = sorted((x for x in got if x.n == n), key=lambda x: x.i)
        y = [x.y for x in rows_]
        assert np.allclose([x.s for x in rows_], slow_smooth(y, window), atol=1e-8)
        k = min(window, n if n % 2 else n - 1)
        want = np.convolve(np.pad(y, k // 2, mode="edge"), np.ones(k) / k, mode="valid") if n >= 3 and k >= 3 else y
        assert np.allclose([x.b for x in rows_], want)
