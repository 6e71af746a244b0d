import hashlib
import math
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from tracewright.llm import mixing

SF = "/root/testdata/sf0.01"


def slow_count(mean, seed, key):
    parts = max(1, math.ceil(mean / 16))
    total = 0
    for j in range(1, parts + 1):
        u = int(hashlib.md5(f"{seed}:{key}:{j}".encode()).hexdigest()[:13], 16) / 2**52
        m, k = mean / parts, 0
        p = c = math.exp(-m)
        while c <= u and k < 80:
            k += 1
            p *= m / k
            c += p
        total += k
    return total


def test_query_against_brute_force_and_sql(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    units = Counter()
    for r in rows:
        units[r.source] += max(1, len(r.text or ""))
    w = {s: math.sqrt(n) for s, n in units.items()}
    rate = {s: w[s] / sum(w.values()) * sum(units.values()) / n for s, n in units.items()}
    want = Counter({r.doc_id: n for r in rows if (n := slow_count(rate[r.source], 7, r.doc_id))})
    got = mixing.op2_poisson_mixture(spark, SF).collect()
    assert Counter(r.doc_id for r in got) == want
    assert all(1 <= r.copy <= r.copies == want[r.doc_id] for r in got)
    keys = [r.position_key for r in got]
    assert keys == sorted(keys)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    names = ["doc_id", "source", "rate", "copies", "copy", "position_key", "lang", "n_chars", "text"]
    sql = db.execute(f"SELECT {', '.join(names)} FROM ({mixing.OP2_SQL})").fetchall()
    assert sorted(sql) == sorted(tuple(r[n] for n in names) for r in got)


@pytest.mark.parametrize("mean", [0.0, 0.2, 1.0, 9.0, 40.0])
def test_draws_are_poisson(spark, mean):
    df = spark.range(4000).select(mixing.poisson_count(F.lit(mean), F.lit(1), F.col("id")).alias("n"), "id")
    rows = df.collect()
    assert [r.n for r in rows[:50]] == [slow_count(mean, 1, r.id) for r in rows[:50]]
    avg = sum(r.n for r in rows) / 4000
    assert abs(avg - mean) < 5 * math.sqrt(mean / 4000) + 1e-9
    assert abs(sum((r.n - avg) ** 2 for r in rows) / 4000 - mean) < 0.15 * mean + 1e-9


def test_weights_and_odd_rows(spark):
    rows = [(i, "t" * 10, "a" if i < 3000 else "b", 0) for i in range(4000)] + [(None, None, None, 0), (5000, "", "c", 0), (5000, "", "c", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, mix_copies int")
    rates = mixing.source_rates(docs, {"a": 1, "b": 3, "c": 0, "": 0.5}, total=20_000)
    r = {x.source: x.rate for x in rates.collect()}
    assert r["c"] == 0 and r["b"] / r["a"] == pytest.approx(9) and r["a"] * 30_000 == pytest.approx(20_000 / 4.5)
    out = mixing.mix_sources(docs, rates)
    assert sorted(out.columns) == sorted(["doc_id", "text", "source", "mix_rate", "mix_copies", "mix_copy", "mix_key"])
    n = Counter(x.source for x in out.collect())
    assert abs(n["b"] / n["a"] - 3) < 0.5 and n["c"] == 0 and n[None] > 100
    assert mixing.mix_sources(docs.limit(0), mixing.source_rates(docs.limit(0))).count() == 0
    assert mixing.mix_sources(docs, rates, small_sources=1).count() == out.count()


def test_clashing_names_and_many_weights(spark):
    docs = spark.createDataFrame([(i, "t", "a", i, "x", 1.0) for i in range(300)], "doc_id long, text string, source string, source_name long, draw_key string, Mix_rate_ double")
    weights = {"a": 1.0} | {f"s{k}": 1.0 for k in range(3000)}
    out = mixing.mix_sources(docs, mixing.source_rates(docs, weights)).collect()
    assert len(out) > 200 and all(r.source_name == r.doc_id and r.draw_key == "x" for r in out)
    keys = [r.mix_key for r in out]
    assert keys == sorted(keys)


def test_no_sampling_pass(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plan = mixing.mix_sources(docs, mixing.source_rates(docs))._jdf.queryExecution().toString()
    assert "rangepartitioning" not in plan and plan.count("CartesianProduct") == 0
