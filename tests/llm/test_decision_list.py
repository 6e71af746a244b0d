import re
from collections import Counter

import numpy as np

from tracewright.llm import decision_list as dl

SF = "/root/testdata/sf0.01"


def slow(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = Counter(grams)
    hit = {i + k for i, g in enumerate(grams) if seen[g] > 1 for k in range(3)}
    lines, dup, known = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)], 0, set()
    for x in lines:
        dup += x in known
        known.add(x)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit)


def check(row, text):
    n, chars, sym, dup, rep = slow(text)
    assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == (n, chars, sym, dup, rep)
    assert row.base_failed == (n < 50 or 100 * rep > 50 * n)
    assert not (row.base_failed and row.kept)


def test_odd_texts(spark):
    texts = [None, "", " \t\n", "a b c", "a b c a b c", "a a a a a", "x y \x0bz\x0c\r", "a\n\n a\na\nb", "b c d e b c d f c d f", "é€𝄞 #*|<>", "w " * 3000, " ".join(map(str, range(4000)))]
    docs = spark.createDataFrame([(i, t, 1, "k") for i, t in enumerate(texts)], "doc_id long, text string, n_words int, w string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for r in dl.quality_rules(docs, labels).collect():
        check(r, texts[r.doc_id])
        assert r.kept == (not r.base_failed)
    assert dl.quality_rules(docs.limit(0), labels).count() == 0


def test_query_against_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = dl.op10_decision_list(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        check(r, texts[r.doc_id])
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = [r.kept for r in rows if quality.get(r.doc_id) == 1 and not r.base_failed]
    assert np.mean(good) > 0.97


def test_learns_planted_rules_in_order():
    rng = np.random.default_rng(0)
    x = {f: rng.random(3000) for f in dl.FEATURES}
    bad = (x["upper_share"] > 0.8) | ((x["symbols_per_word"] > 0.6) & (x["digit_share"] <= 0.3))
    rules = dl.learn(x, bad, np.arange(3000) % 3 == 0)
    said = np.zeros(3000, bool)
    for r in rules:
        said |= dl._covers(r, x, 3000)
    assert (said == bad).mean() > 0.95
    assert any(r[0].feature == "upper_share" and r[0].above for r in rules)


def test_rules_are_native(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    plan = dl.quality_rules(docs, labels)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert dl.fit(docs, labels)
