"""Every row is a document: stages and operators on repeated and null ids, odd texts, clashing names and empty tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from tracewright.llm import common, hyperlang, mixing, neardup, simhash, spans, toxicity

A = "one two three four five six seven eight nine ten eleven twelve"
B = "entirely other words stand here and nothing of them is like the first text at all"


@pytest.mark.parametrize("groups_of", [simhash.near_duplicate_groups, neardup.similar_groups])
def test_unlike_rows_of_one_id_stay(spark, groups_of):
    docs = spark.createDataFrame([(0, A, 1), (1, A, 2), (1, B, 3), (None, B, 4), (None, A + " new", 5), (2, None, 6), (2, " ", 7), (2, None, 8)], "doc_id long, text string, row int").repartition(3)
    kept = simhash.keep_first_of_groups(docs, groups_of)
    assert kept.columns == docs.columns
    got = {r["row"] for r in kept.collect()}
    assert {1, 3} <= got and 2 not in got and 4 not in got and len(got & {6, 7, 8}) == 1
    assert simhash.keep_first_of_groups(docs.limit(0), groups_of).count() == 0


def test_one_of_equal_rows_stays(spark):
    docs = spark.createDataFrame([(i % 2, A) for i in range(50)], "doc_id long, text string").repartition(7)
    assert [tuple(r) for r in simhash.keep_first_of_groups(docs, neardup.similar_groups).collect()] == [(0, A)]


def odd(spark):
    prose = ["Die Katze sitzt auf dem Dach und schaut den Leuten zu.", "The cat sits on the roof and watches the people pass."]
    rows = [(i, f"{prose[i % 2]} {i} {prose[i % 2][::-1]}", "de" if i % 2 == 0 else "en", "s", 9, "x", 1) for i in range(40)]
    rows += [(None, None, None, None, None, None, None), (3, "", "en", "s", 0, "", 0), (3, " \n", "de", None, 2, "", 0), (4, prose[1] + " one more row of id four", "en", "t", 2, "", 0), (None, prose[0], "de", "t", 1, "", 3)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, h string, row_ int").repartition(3)


def test_stages_on_odd_rows(spark, tmp_path):
    docs = odd(spark)
    spark.createDataFrame([(1, "a benchmark item of more than five words here"), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < len(cp.STAGES) - 1:
            assert out.columns == columns
            out.write.parquet(f"{tmp_path}/{name}")
            docs = spark.read.parquet(f"{tmp_path}/{name}")
            assert docs.count() > 0
        else:
            assert out.count() == docs.count()


def test_stages_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in cp.STAGES:
        assert stage(spark, odd(spark).limit(0), str(tmp_path)).count() == 0


def test_run_on_odd_rows_leaves_only_results(spark, tmp_path):
    odd(spark).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, A)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    before = len(common._MADE)
    rows = cp.run(spark, str(tmp_path)).collect()
    assert rows and all(r.n_tokens >= 1 for r in rows)
    left = [p.rsplit("/", 1)[1].rsplit("-", 1)[0] for p in common._MADE[before:]]
    assert set(left) <= {"language", "near_duplicates", "decontamination", "mixture", "planes", "planes-manifest"}


def test_temporary_tables_go(spark):
    with common.temporary(spark):
        df = common.written(spark.range(5).toDF("x"), "gone")
        path = common._MADE[-1]
        assert df.count() == 5
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    assert not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at) and path not in common._MADE


def test_mixture_partitions_follow_the_size(spark, monkeypatch):
    docs = spark.range(400).selectExpr("id AS doc_id", "repeat('x', 100) AS text", "'s' AS source")
    rates = mixing.source_rates(docs)
    few = mixing.mix_sources(docs, rates)
    assert mixing.mixture_parts(docs, rates) == 4 == mixing.mixture_parts(docs, rates.select("source", "rate"))
    monkeypatch.setattr(mixing, "PARTITION", 2000)
    assert mixing.mixture_parts(docs, rates) == 21
    many = mixing.mix_sources(docs, rates)
    assert many.rdd.getNumPartitions() == 21
    key = lambda r: (r.mix_key, r.doc_id, r.mix_copy)
    got = many.collect()
    assert [r.mix_key for r in got] == sorted(r.mix_key for r in got)
    assert sorted(map(key, got)) == sorted(map(key, few.collect()))


def test_spans_hash_with_128_bits():
    found = spans.sentences("One two three four five six seven eight. Nine ten eleven twelve thirteen fourteen fifteen. End here.")
    h, first, last = spans.spans_of(found)
    assert len(h) == len(first) == len(last) and all(len(x) == 16 for x in h)


def test_languages_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(hyperlang, "LANGUAGES", 2)
    rows = [(i, "the cat and the dog went to the house " * 3, "en") for i in range(30)] + [(100 + i, "der hund und die katze gingen nach hause " * 3, "de") for i in range(20)] + [(200 + i, f"zzz{i}", f"dirt{i}") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert sorted(hyperlang.prototypes(docs)) == ["de", "en"]
    assert {r.lang_pred for r in hyperlang.predict(docs.where("doc_id < 200"), hyperlang.prototypes(docs)).collect()} == {"de", "en"}


def test_chain_on_helper_names(spark):
    docs = spark.createDataFrame([(i, f"word{i % 7} {'vile' if i % 3 == 0 else 'nice'} text") for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, int(i % 3 == 0)) for i in range(200)], "doc_id long, quality int, toxic int")
    chain = toxicity.fit_chain(docs, labels)
    plain = docs.select("doc_id", toxicity.tokens().alias("tokens"))
    names = [*toxicity.HELPERS, "__WORDS_"]
    clash = plain.select("*", *[F.lit(k).alias(n) for k, n in enumerate(names)], F.lit("x").alias("p_toxic"))
    want = {r.doc_id: r.p_toxic for r in chain.score(plain).collect()}
    got = chain.score(clash)
    assert got.columns == ["doc_id", "tokens", *names, "p_low_quality", "p_toxic"]
    assert all(np.isclose(want[r.doc_id], r.p_toxic) and r["__x"] == 1 for r in got.collect())
    none = chain.score(plain.withColumn("tokens", F.lit(None).cast("array<string>"))).collect()
    assert len({r.p_toxic for r in none}) == 1 and chain.score(plain.limit(0)).count() == 0
