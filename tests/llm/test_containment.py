import random

import duckdb
import numpy as np
import pytest

from tracewright.llm import containment as ct

SF = "/root/testdata/sf0.01"


def slow(docs, items, threshold=0.8):
    out = set()
    held = {i: ct.shingles_of((t or "").lower()) for i, t in docs}
    for k, t in items:
        s = ct.shingles_of((t or "").lower())
        if s:
            out |= {(i, k, len(s & h), len(s)) for i, h in held.items() if len(s & h) >= threshold * len(s) - 1e-9}
    return out


def test_hashes_follow_the_shingles():
    texts = [b"a b c d e f", b"", b" x\t\ty\x0b", b"a b c d e", b"b c d e f", b"x y", b"xy", b"a b c d", b"q " * 50]
    h, n = ct.shingle_hashes(texts)
    assert n.tolist() == [2, 0, 1, 1, 1, 1, 1, 1, 46]
    assert h[0] == h[3] and h[1] == h[4] and h[2] == h[5] and len(set(h[:8].tolist())) == 5
    assert len(set(h[8:].tolist())) == 1


def test_query_against_brute_force_and_sql(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = ct.op3_containment(spark, SF).collect()
    assert {tuple(r)[:4] for r in rows} == slow(docs, items) and rows
    db = duckdb.connect()
    for t in ("documents", "benchmark"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    assert sorted(db.execute(ct.OP3_SQL).fetchall()) == sorted(tuple(r) for r in rows)


@pytest.mark.parametrize("size", [1, 4, 5, 9, 21, 60, 130, 700])
def test_recall_in_long_documents(size):
    rng = random.Random(size)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    items = [(k, " ".join(word() for _ in range(size))) for k in range(30)]
    docs = []
    for k, t in items:
        w = t.split()
        keep = w[: max(5, int(len(w) * 0.87))] if size > 40 else w
        noise = [word() for _ in range(rng.choice([0, 30, 4000]))]
        at = rng.randrange(len(noise) + 1)
        docs.append((k, " ".join(noise[:at] + keep + noise[at:])))
    found = ct.ItemIndex(items).contained([t for _, t in docs])
    assert {(docs[t][0], k, a, b) for t, k, a, b in found} == slow(docs, items)


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(20_000))
    docs = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, long, 0), (3, long, 0), (None, "x Y z", 0), (4, "x y z", 0)], "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(1, None), (2, ""), (3, " ".join(f"W{i}" for i in range(5000, 5040))), (4, "X y  z"), (4, "X y  z")], "item_id long, text string")
    got = sorted((tuple(r) for r in ct.contaminated(docs, items).collect()), key=str)
    assert got == sorted([(3, 3, 36, 36, 1.0)] * 2 + [(None, 4, 1, 1, 1.0)] * 2 + [(4, 4, 1, 1, 1.0)] * 2, key=str)
    assert sorted((tuple(r) for r in ct.contaminated(docs, items, block_items=2).collect()), key=str) == got
    left = ct.drop_contaminated(docs, items)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [1, 2]
    assert ct.contaminated(docs.limit(0), items).count() == 0 and ct.contaminated(docs, items.limit(0)).count() == 0


def test_many_short_texts_against_a_long_item():
    """A class of large items allocates nothing for texts that cannot hold its items."""
    import tracemalloc

    rng = random.Random(1)
    index = ct.ItemIndex([(1, " ".join(f"w{rng.randrange(10**6)}" for _ in range(3000)))])
    texts = [f"one line text number {k} of some words" for k in range(10_000)]
    tracemalloc.start()
    assert list(index.contained(texts)) == []
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 << 20, peak


def test_common_headers_make_no_candidates():
    header = "this is the common header of every one of all these items here"
    items = [(k, header + f" then a{k} b{k} c{k} d{k} e{k} f{k} g{k} h{k} i{k}") for k in range(3000)]
    index = ct.ItemIndex(items)
    texts = [header + f" and other words follow here {k}" for k in range(200)]
    hashes, counts = ct.shingle_hashes([t.encode() for t in texts])
    assert len(index.candidates(hashes, counts)) == 0
    assert [x[1] for x in index.contained([items[7][1]])] == [7]


def test_clashing_names_and_equal_items(spark):
    docs = spark.createDataFrame([(7, "lead a b c d e f g tail", 1, 2), (8, "none of it", 3, 4), (7, "another text", 5, 6)], "doc_id long, text string, low int, __key int")
    items = spark.createDataFrame([(1, "A b c d e f g"), (2, "a b c d e f g"), (3, None)], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in ct.contaminated(docs, items).collect()) == [(7, 1), (7, 2)]
    assert ct.contaminated_classes(docs, ct._asked(items)).count() == 1
    for settings in ({}, {"block_items": 1}):
        assert sorted((r.doc_id, r.low, r["__key"]) for r in ct.drop_contaminated(docs, items, **settings).collect()) == [(7, 5, 6), (8, 3, 4)]


def test_long_texts_in_pieces():
    words = [f"w{k}" for k in range(200_000)]
    text = " ".join(words)
    assert len(text) > 2 * ct.PIECE
    h, n = ct.shingle_hashes([b"x", text.encode(), b"y z"])
    assert n.tolist() == [1, 199_996, 1]
    part, _ = ct.shingle_hashes([" ".join(words[100_000:100_005]).encode()])
    assert h[1 + 100_000] == part[0]
    assert [x[:2] for x in ct.ItemIndex([(5, " ".join(words[150_000:150_100]))]).contained([text])] == [(0, 5)]
    assert ct.shingle_hashes([b"q" * (ct.PIECE + 10)])[1].tolist() == [1]
