import random

import pytest
import xxhash
from pyspark.sql import functions as F

from tracewright.llm import simhash

SCHEMA = "doc_id long, text string"


def slow_fingerprint(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(ids, fps, radius=3):
    label = list(ids)
    changed = True
    while changed:
        changed = False
        for i in range(len(ids)):
            for j in range(len(ids)):
                if (fps[i] ^ fps[j]).bit_count() <= radius and label[j] < label[i]:
                    label[i], changed = label[j], True
    return label


@pytest.mark.parametrize("text", [None, "", " \n\t", "a", "A b", "a b c", "É a\x0bb\x0cC d e", "x " * 500, "ﬀ a b\x00c d"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == slow_fingerprint(text)


@pytest.mark.parametrize("limit", [4096, 3])
def test_links_against_brute_force(spark, limit):
    rng = random.Random(5)
    fps = [0, (1 << 64) - 1]
    for _ in range(60):
        x = rng.getrandbits(64)
        fps.append(x)
        for _ in range(rng.randrange(6)):
            for _ in range(rng.randrange(1, 4)):
                x ^= 1 << rng.randrange(64)
            fps.append(x)
    fps = sorted(set(fps))
    ids = list(range(10, 10 + len(fps)))
    rng.shuffle(ids)
    rows = [(f - (1 << 64) if f >> 63 else f, i) for f, i in zip(fps, ids)]
    nodes = spark.createDataFrame(rows, "fp long, node long")
    got = {r[0]: r[1] for r in simhash.components(simhash.close_links(nodes, 3, limit)).collect()}
    assert [got.get(i, i) for i in ids] == slow_components(ids, fps)


def test_groups_with_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(3000))
    texts = [(5, None), (2, ""), (9, "  "), (7, "a b c d e"), (3, "A  b C d\te"), (3, "a b c d e"), (8, long), (1, long + " end"), (None, long), (4, "one")]
    docs = spark.createDataFrame([(i, t, "x", i) for i, t in texts], SCHEMA + ", fp string, component_id long")
    got = sorted(((r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in simhash.near_duplicate_groups(docs).collect()), key=str)
    fps = [slow_fingerprint(t) for _, t in texts]
    want = slow_components([i if i is not None else 99 for i, _ in texts], fps)
    assert got == sorted(((i, f, c) for (i, _), f, c in zip(texts, fps, want)), key=str)
    kept = simhash.keep_first_of_groups(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == sorted(set(want) - {99})
    assert simhash.near_duplicate_groups(docs.limit(0)).count() == 0


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    fps = [slow_fingerprint(r.text) for r in rows]
    want = slow_components([r.doc_id for r in rows], fps)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op4_simhash_bk_tree(spark, sf).collect()}
    assert got == {r.doc_id: (f"{f:016x}", c) for r, f, c in zip(rows, fps, want)}


def test_bk_tree_finds_all_within_radius():
    rng = random.Random(1)
    values = [rng.getrandbits(10) for _ in range(200)]
    tree = simhash.BKTree()
    for v in dict.fromkeys(values):
        tree.add(v)
    for q in range(0, 1024, 7):
        assert {tree.values[i] for i in tree.within(q, 3)} == {v for v in values if (v ^ q).bit_count() <= 3}
