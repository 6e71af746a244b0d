import zlib
from collections import Counter

import numpy as np

from tracewright.llm import hyperlang as hl

SF = "/root/testdata/sf0.01"


def slow_bundle(text, n=3):
    space = hl.Hypervectors(n)
    s = "".join(c if c.isalpha() else " " for c in text.lower())
    s = f" {' '.join(s.split())} "
    if s == "  ":
        return None
    total = np.zeros(hl.DIM, np.int64)
    for i in range(len(s) - n + 1):
        v = np.ones(hl.DIM, np.int64)
        for k, c in enumerate(s[i : i + n]):
            v *= np.roll(space._letter(ord(c)), n - 1 - k)
        total += v
    return total


def test_bundle_against_brute_force():
    space = hl.Hypervectors()
    for text in ["a", "ab", " a ", "Hello, World! 12 x", "ÀÉ ß漢字", "..a..", "a" * 300, "a1b"]:
        assert (space.bundle(text) == slow_bundle(text)).all()
    for text in ["", " ", "12 !?\n"]:
        assert space.bundle(text) is None


def test_small_table_gives_the_same():
    text = "the quick brown fox jumps over the lazy dog " * 3
    assert (hl.Hypervectors(most=4).bundle(text) == hl.Hypervectors().bundle(text)).all()


def test_held_out_accuracy(spark):
    rows = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = hl.op9_hyperdimensional(spark, SF).collect()
    assert Counter(r.doc_id for r in got) == Counter(list(rows))
    test = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    assert np.mean([r.lang_pred == rows[r.doc_id].lang for r in test]) > 0.95
    assert {r.lang_pred for r in got} <= {"en", "de", "fr", "es", "und"}


def test_odd_rows(spark):
    long = "der und die das " * 30_000
    rows = [(0, "the cat and the dog", "en", 1), (1, "the dog", "en", 1), (4, "der hund und die katze", "de", 1), (3, None, "de", 1), (5, "12 .", None, 1), (None, "the", "en", 1), (7, long, None, 1), (7, long, None, 1), (9, "", "en", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    got = {(r.doc_id, r.lang_pred) for r in hl.identify_languages(docs).collect()}
    assert {(3, "und"), (5, "und"), (9, "und"), (7, "de"), (None, "en")} <= got
    kept = hl.keep_identified(docs)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["0", "1", "4", "7", "7", "None"]
    assert hl.identify_languages(docs.limit(0)).count() == 0
    assert {r.lang_pred for r in hl.identify_languages(docs.withColumn("lang", docs.lang.substr(9, 1)).where("false")).collect()} == set()


def slow_predictions(rows, train):
    """doc_id -> (lang, cosine), from sums over every letter triple of every text."""
    bundles = [slow_bundle(t) if t else None for _, t, _ in rows]
    unit = [None if v is None else v / np.sqrt((v.astype(float) ** 2).sum()) for v in bundles]
    proto = {}
    for (i, _, lang), u in zip(rows, unit):
        if lang is not None and u is not None and train(i):
            proto[lang] = proto.get(lang, 0) + (hl.UNIT * u).round().astype(np.int64)
    names = sorted(proto)
    out = {}
    for (i, _, _), u in zip(rows, unit):
        if u is None:
            out[i] = ("und", 0.0)
            continue
        cos = [float((u * proto[k]).sum() / np.sqrt((proto[k].astype(float) ** 2).sum())) for k in names]
        out[i] = (names[int(np.argmax(cos))], min(1.0, max(0.0, max(cos))))
    return out


def test_whole_result_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, (r.text or "")[:4000], r.lang) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()][:80]
    rows += [(1001, None, "en"), (1002, "12 !", "de"), (1003, "Ünder x", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    want = slow_predictions(rows, lambda i: not out(i))
    got = {r.doc_id: r for r in hl.identify_languages(docs).collect()}
    assert set(got) == set(want)
    for i, (lang, score) in want.items():
        assert (got[i].held_out, got[i].lang_pred) == (out(i), lang) and abs(got[i].score - score) < 1e-9


def test_copies_of_a_text_spread_over_the_training_tasks(spark):
    docs = spark.range(4000).selectExpr("id as doc_id", "'the same text' as text", "'en' as lang")
    sizes = [r.n for r in hl.training_sample(docs, 100_000).selectExpr("spark_partition_id() as p").groupBy("p").agg({"*": "count"}).toDF("p", "n").collect()]
    assert len(sizes) == 8 and max(sizes) < 700


def test_floors():
    counts = np.zeros((32, hl.BINS), np.int64)
    counts[4, 100:200] = 1
    counts[5, 800] = 10
    counts[6, 600] = 1000
    floors = hl.floors_of(counts)
    assert floors[:4] == [0, 0, 0, 0] and floors[4:8] == [0.0505, 0.0505, 0.3, 0.3]


def test_filter_keeps_clean_texts_and_rejects_other_languages(spark):
    import random

    rng = random.Random(2)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randint(2, 9)))
    alphabets = {"latin": "abcdefghijklmnopqrstuvwxyz", "cyrillic": "абвгдежзийклмнопрстуфхцчшщъыьэюя", "greek": "αβγδεζηθικλμνξοπρστυφχψω"}
    other = [(10**6 + k, " ".join(word(a) for _ in range(200)), None, "x", 0) for k, a in enumerate(list(alphabets.values()) * 20)]
    all_of_it = docs.unionByName(spark.createDataFrame(other, docs.schema))
    kept = {r.doc_id for r in hl.keep_identified(all_of_it).select("doc_id").collect()}
    assert not kept & {i for i, *_ in other}
    clean = {r.doc_id for r in docs.where("text rlike '[A-Za-z]{3}'").select("doc_id").collect()}
    assert len(clean & kept) >= 0.99 * len(clean)


def test_every_row_not_held_out_teaches(spark):
    """Over 2000 texts a language: no sample; the floors rest on all of them, too."""
    texts = ["the quick brown fox", "jumps over the lazy dog"]
    docs = spark.range(5000).selectExpr("id as doc_id", f"if(id % 5 = 0, '{texts[0]}', '{texts[1]}') as text", "'en' as lang")
    train = docs.where(~hl.held_out())
    assert hl.training_sample(train).count() == train.count() > 3000
    want = sum(n * (hl.UNIT * hl._normal(slow_bundle(t))).round().astype(np.int64) for t, n in ((r.text, r["count"]) for r in train.groupBy("text").count().collect()))
    got = hl.prototypes(train)
    assert list(got) == ["en"] and (got["en"] == want).all()
    assert hl.keep_identified(docs).count() == 5000
