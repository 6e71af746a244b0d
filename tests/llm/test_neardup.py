import re

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline as cp
from tracewright.llm import common
from tracewright.llm import neardup as nd

SF = "/root/testdata/sf0.01"


def slow(rows):
    """doc_id -> smallest id of its group, all pairs compared on their shingles."""
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    group = [i for i, _ in rows]
    for a in range(len(rows)):
        for b in range(a):
            x, y = len(sets[a]), len(sets[b])
            if group[a] != group[b] and min(x, y) >= 0.8 * max(x, y) and (s := len(sets[a] & sets[b])) >= 0.8 * (x + y - s) - 1e-9:
                group = [min(group[a], group[b]) if g in (group[a], group[b]) else g for g in group]
    return {i: g for (i, _), g in zip(rows, group)}


def test_stage_against_all_pairs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = slow([(r.doc_id, r.text) for r in docs.collect()])
    got = sorted(r.doc_id for r in cp.near_duplicates(spark, docs, SF).select("doc_id").collect())
    assert got == sorted(i for i, g in want.items() if i == g)
    assert not {255, 944, 875, 770} & set(got)  # 5 to 10 bits from their partners


def test_groups_of_odd_rows(spark):
    base = [f"w{k}" for k in range(60)]
    chain = [" ".join(base[:k] + [f"x{k}"] + base[k + 1 :]) for k in (5, 30)]
    rows = [(9, " ".join(base)), (4, chain[0]), (7, chain[1]), (3, " ".join(base).upper()), (2, "a b"), (1, "A  b\n"), (5, "a b c"), (11, None), (10, " "), (None, "a b"), (8, " ".join(reversed(base)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id or 0), r.component_id) for r in nd.similar_groups(docs).collect())
    assert got == [(0, 1), (1, 1), (2, 1), (3, 3), (4, 3), (5, 5), (7, 3), (8, 8), (9, 3), (10, 10), (11, 10)]
    assert nd.similar_groups(docs.limit(0)).count() == 0


def test_bucket_links_join_groups_met_apart():
    a, c = np.arange(0, 100, dtype=np.uint64), np.arange(20, 120, dtype=np.uint64)
    b = np.arange(10, 110, dtype=np.uint64)
    assert not nd.similar(a, c) and nd.similar(a, b) and nd.similar(b, c)
    assert sorted(nd.bucket_links([a, c, b])) == [(0, 2), (1, 2)]


def test_large_buckets_are_cut_in_blocks(spark):
    rng = np.random.default_rng(4)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for i in range(60):
        w = list(base)
        for k in rng.integers(0, 120, int(rng.integers(0, 6))):
            w[k] = f"x{i}y{k}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = slow(rows)
    assert {r.doc_id: r.component_id for r in nd.similar_groups(docs).collect()} == want
    assert {r.doc_id: r.component_id for r in nd.similar_groups(docs, bucket_bytes=4000).collect()} == want


def test_a_bitmap_rules_out_only_what_is_not_among_the_ids(spark):
    rows, ids = spark.range(-300, 300).withColumnRenamed("id", "k").withColumn("bits", F.lit("x")), spark.range(-300, 300, 7)
    got = common.likely(rows.union(spark.createDataFrame([(None, "x")], "k long, bits string")), "k", ids, "may")
    assert got.columns == ["k", "bits", "may"]
    said = {r.k: r.may for r in got.collect()}
    assert len(said) == 601 and not said[None] and all(said[k] for k in range(-300, 300, 7)) and sum(said.values()) < 100


def test_no_text_is_shuffled_but_of_copies(spark, monkeypatch):
    """Texts meet neither the nodes of buckets nor the rows that go by a shuffle: what is shuffled has been through the bitmap."""
    plans = []
    for module in (nd, common):
        monkeypatch.setattr(module, "written", lambda df, name, to=common.written: (plans.append(df._jdf.queryExecution().executedPlan().toString()), to(df, name))[1])
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = cp.near_duplicates(spark, docs, SF)
    last = kept._jdf.queryExecution().executedPlan().toString()
    (links,) = (p for p in plans if "shingles" in p and "places" in p and "MapInArrow" in p)
    for plan in (links, last):
        lines = plan.splitlines()
        for i, line in enumerate(lines):
            if "FileScan" in line and re.search(r"text#\d+[^\]]*\] Batched", line):
                under = next((x for x in reversed(lines[:i]) if "Exchange" in x or "Join" in x or "MapInArrow" in x or "Union" in x), "")
                assert "BroadcastHashJoin" in under, under
