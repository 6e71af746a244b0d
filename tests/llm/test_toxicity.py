import math
import re

import pytest
from pyspark.sql import functions as F

from tracewright.llm import toxicity as tx

SF = "/root/testdata/sf0.01"
WORDS = "trash pathetic idiot worthless disgusting stupid clown scum loser moron".split()


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")


@pytest.fixture(scope="module")
def chain(tables):
    docs, labels = tables
    return tx.fit_chain(docs, labels.where("doc_id % 2 = 0"))


def test_held_out_accuracy(tables, chain):
    docs, labels = tables
    rows = tx.classify(docs, chain).join(docs, "doc_id").join(labels, "doc_id").where("doc_id % 2 = 1").collect()
    abusive = lambda t: len(set(re.findall(r"[^\W\d_]+", t.lower())) & set(WORDS))
    hits = [r["toxic"] for r in rows if abusive(r.text) >= 2]
    clean = [r for r in rows if abusive(r.text) == 0 and r.quality == 1]
    said = [r[3] for r in rows if abusive(r.text) >= 2]
    assert sum(said) / len(said) > 0.95
    assert sum(r[3] for r in clean) / len(clean) < 0.02


def test_probabilities_follow_the_models(chain, tables):
    """The chain by hand: logistic of weights over words present, then with the earlier probability."""
    docs, _ = tables
    for r in tx.classify(docs.limit(20), chain).join(docs, "doc_id").collect():
        present = {w for w in re.split(r"[^\w]|[\d_]", r.text.lower()) if w}
        before = []
        for name, model in chain.models:
            z = model.intercept + sum(model.coefficients[i] for i, w in enumerate(chain.words) if w in present)
            z += sum(model.coefficients[len(chain.words) + i] * p for i, p in enumerate(before))
            before.append(1 / (1 + math.exp(-z)))
            assert r[f"p_{name}"] == pytest.approx(before[-1], abs=1e-6)


def test_odd_rows(spark, chain):
    docs = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "you idiot, you worthless scum clown", 0), (3, "ok " * 20_000, 0), (None, "IDIOT! Moron, loser", 0)], "doc_id long, text string, tokens int")
    rows = tx.classify(docs, chain).collect()
    assert sorted((str(r.doc_id), r.toxic) for r in rows) == [("1", False), ("2", False), ("3", False), ("3", True), ("None", True)]
    assert tx.classify(docs.limit(0), chain).count() == 0


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, "idiot")], "doc_id long, text string")
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {(r.p_low_quality, r.p_toxic, r.toxic) for r in tx.classify(docs, tx.fit_chain(docs, empty)).collect()} == {(0.0, 0.0, False)}
    one = spark.createDataFrame([(1, 1, 0), (1, None, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert {r.toxic for r in tx.classify(docs, tx.fit_chain(docs, one)).collect()} == {False}


def test_query(spark):
    rows = tx.op5_classifier_chain(spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(0 <= r.p_toxic <= 1 and r.toxic == (r.p_toxic >= 0.5) for r in rows)


def slow_words(rows, each, min_docs):
    """The words of largest chi-square of each label, from a 2 x 2 table for every word."""
    out = set()
    for k in (0, 1):
        n, p = len(rows), sum(y[k] for _, y in rows)
        chi = {}
        for w in {w for words, _ in rows for w in words}:
            have = [y[k] for words, y in rows if w in words]
            if min_docs <= len(have) < n:
                a, b = sum(have), len(have) - sum(have)
                c, d = p - a, n - p - b
                chi[w] = n * (a * d - b * c) ** 2 / (len(have) * (n - len(have)) * p * (n - p))
        out |= set(sorted(chi, key=lambda w: (-round(chi[w], 9), w))[:each])
    return sorted(out)


def test_chain_against_a_slow_version(spark):
    """Words by tables, folds apart, the second model on probabilities of models that did not see the row."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.linalg import Vectors

    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    chain = tx.fit_chain(docs, labels, words=12, folds=3)
    fold = {r.doc_id: r.f for r in labels.select("doc_id", F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(3)).alias("f")).collect()}
    text = {r.doc_id: r.text for r in docs.collect()}
    rows = [(r.doc_id, {w for w in re.split(r"[\W\d_]+", (text[r.doc_id] or "").lower()) if w}, (int(r.quality == 0), int(r.toxic == 1))) for r in labels.na.drop().collect() if r.doc_id in text]
    assert chain.words == slow_words([(w, y) for _, w, y in rows], 12, 5)

    def fit(part, k, extra):
        df = spark.createDataFrame([(Vectors.dense([float(w in words) for w in chain.words] + extra.get(i, [])), float(y[k])) for i, words, y in part], ["x", "y"])
        return LogisticRegression(featuresCol="x", labelCol="y", regParam=0.001, elasticNetParam=1.0, maxIter=30, standardization=False).fit(df)

    def said(m, words, extra=()):
        z = m.intercept + sum(m.coefficients[i] for i, w in enumerate(chain.words) if w in words) + sum(m.coefficients[len(chain.words) + i] * p for i, p in enumerate(extra))
        return 1 / (1 + math.exp(-z))

    first = fit(rows, 0, {})
    out = {}
    for f in range(3):
        m = fit([r for r in rows if fold[r[0]] != f], 0, {})
        out |= {i: [said(m, words)] for i, words, _ in rows if fold[i] == f}
    second = fit(rows, 1, out)
    got = {r.doc_id: r for r in tx.classify(docs, chain).collect()}
    for i, words, _ in rows:
        p = said(first, words)
        assert got[i].p_low_quality == pytest.approx(p, abs=2e-3)
        assert got[i].p_toxic == pytest.approx(said(second, words, [p]), abs=5e-3)
