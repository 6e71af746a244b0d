import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from tracewright.llm import bytewords as B
from tracewright.llm import resampling

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = ["", None, " ", "a", "A b\nC", "é" * 700 + " ok", "x" * 300 + " y " + "x" * 300, "tab\tß٣ \x00z\x7fq 9-9", "日本語 テスト", "w " * 5000]


def grams(text, max_n):
    words = WORD.findall((text or "").translate(LOWER))
    return [" ".join(words[i : i + n]) for n in range(1, max_n + 1) for i in range(len(words) - n + 1)], len(words)


def slow(docs, target, percent, min_words, buckets, max_n, seed):
    def counts(texts):
        return Counter(zlib.crc32(g.encode()) % buckets for t in texts for g in grams(t, max_n)[0])

    s, t = counts(x for _, x in docs), counts(target)
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in range(buckets)]
    out = []
    for i, text in docs:
        g, words = grams(text, max_n)
        weight = sum(gain[zlib.crc32(x.encode()) % buckets] for x in g) // len(g) if g else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), words])
    able = sorted((r for r in out if r[4] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = able[: percent * len(able) // 100]
    return out, drawn


def test_query_against_brute_force_and_sql(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want, drawn = slow(docs, target, 10, 20, 10_000, 1, 2024)
    place = {r[0]: k for k, r in enumerate(drawn, 1)}
    names = ["doc_id", "n_features", "weight", "score", "rank"]
    got = sorted(tuple(r[n] for n in names) for r in resampling.op11_byte_automaton(spark, SF).collect())
    assert got == sorted((*r[:4], place.get(r[0])) for r in want) and len(drawn) > 50
    db = duckdb.connect()
    for t in ("documents", "benchmark"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    assert sorted(db.execute(f"SELECT {', '.join(names)} FROM ({resampling.OP11_SQL})").fetchall()) == got


@pytest.mark.parametrize("max_n", [1, 3])
def test_odd_rows_and_longer_runs(spark, max_n):
    docs = [(i, t) for i, t in enumerate(ODD)] + [(None, "b a c"), (None, "b a c"), (3, "a b"), (3, "a b"), *((50 + i, f"a b w{i % 7} tail") for i in range(60))]
    target = ["a b a b", None, "w3 TAIL é"]
    df = spark.createDataFrame([(*r, "x", 1, 2.0) for r in docs], "doc_id long, text string, rank string, at int, part double").repartition(3)
    tdf = spark.createDataFrame([(t,) for t in target], "text string")
    out = resampling.importance_resample(df, tdf, percent=40, min_words=2, buckets=64, max_n=max_n, seed=5)
    assert sorted(out.columns) == sorted(["doc_id", "text", "at", "part", "n_words", "n_features", "weight", "score", "rank"])
    rows = out.collect()
    want, drawn = slow(docs, target, 40, 2, 64, max_n, 5)
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(((r.doc_id, r.n_features, r.weight, r.score, r.n_words) for r in rows), key=key) == sorted(map(tuple, want), key=key)
    taken = sorted((r for r in rows if r["rank"]), key=lambda r: r["rank"])
    assert [r["rank"] for r in taken] == list(range(1, len(drawn) + 1))
    assert [(r.score, r.doc_id) for r in taken] == [(r[3], r[0]) for r in drawn]
    assert all(r.at == 1 and r.part == 2.0 for r in rows)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert resampling.importance_resample(none, some).count() == 0
    out = resampling.importance_resample(some, none, percent=100, min_words=1).collect()
    assert {(r.doc_id, r["rank"]) for r in out} == {(1, 1), (2, None)}


def test_one_key_is_dealt_over_partitions(spark):
    """A third of the rows under one id and one text, so of one score: the draw still has several partitions."""
    df = spark.range(9000).selectExpr("IF(id % 3 = 0, 7, id) AS doc_id", "IF(id % 3 = 0, 'same words here', concat('w', id, ' x y')) AS text")
    out = resampling.importance_resample(df, spark.createDataFrame([("same words",)], "text string"), percent=50, min_words=1)
    rows = [r for r in out.collect() if r["rank"]]
    assert sorted(r["rank"] for r in rows) == list(range(1, 4501))
    assert out.where("rank is not null").selectExpr("spark_partition_id() AS p").groupBy("p").count().count() > 2


def test_crcs_of_all_lengths():
    words = ["a" * n for n in range(1, 600, 7)] + ["zé"]
    data, at = B.terminated(pa.array([" ".join(words), None, "b"]))
    starts, ends = B.word_bounds(data, resampling.WORD)
    group = np.searchsorted(at, starts, "right") - 1
    (_, one), (first, two) = B.run_crcs(data, starts, ends, group, 2)
    assert one.tolist() == [zlib.crc32(w.encode()) for w in [*words, "b"]]
    assert two.tolist() == [zlib.crc32(f"{a} {b}".encode()) for a, b in zip(words, words[1:])] and len(first) == len(words) - 1
