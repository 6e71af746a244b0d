from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as cp
from tests.llm.test_containment import slow as slow_containment
from tests.llm.test_mixing import slow_count
from tests.llm.test_neardup import slow as slow_groups
from tests.llm.test_planefile import want as slow_files
from tracewright.llm import hyperlang

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in cp.STAGES:
        stage(spark, out[-1], SF).write.parquet(f"{base}/{name}")
        out.append(spark.read.parquet(f"{base}/{name}"))
    return out


def pairs(df):
    return sorted((r.doc_id, r.text) for r in df.collect())


def test_stages_keep_the_columns(steps):
    assert all(s.columns == steps[0].columns for s in steps[:-1])


def test_language_stage(spark, steps):
    train = hyperlang.training_sample(steps[0].where(~hyperlang.held_out()))
    models = hyperlang.prototypes(steps[0].where(~hyperlang.held_out()))
    score, counts = hyperlang.Scorer(models, 3, hyperlang.DIM), np.zeros((32, hyperlang.BINS), np.int64)
    for _, x, size in score(pa.array([r.text for r in train.collect()])):
        if size >= 0:
            counts[size, min(hyperlang.BINS - 1, int(x * hyperlang.BINS))] += 1
    floors = hyperlang.floors_of(counts)
    rows = pairs(steps[0])
    said = list(score(pa.array([t for _, t in rows])))
    assert pairs(steps[1]) == [r for r, (_, x, size) in zip(rows, said) if size >= 0 and x > floors[size]]
    assert steps[1].count() >= 0.98 * steps[0].count()


def test_near_duplicate_stage(steps):
    rows = pairs(steps[1])
    group = slow_groups(rows)
    assert pairs(steps[2]) == [(i, t) for i, t in rows if group[i] == i] and steps[2].count() < steps[1].count()


def test_decontamination_stage(spark, steps):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = {i for i, *_ in slow_containment(pairs(steps[2]), items)}
    assert bad and pairs(steps[3]) == [(i, t) for i, t in pairs(steps[2]) if i not in bad]


def test_mixture_stage(steps):
    rows = steps[3].collect()
    units = Counter()
    for r in rows:
        units[r.source] += max(1, len(r.text))
    w = {s: n**0.5 for s, n in units.items()}
    rate = {s: w[s] / sum(w.values()) * sum(units.values()) / n for s, n in units.items()}
    assert Counter(r.doc_id for r in steps[4].collect()) == Counter({r.doc_id: n for r in rows if (n := slow_count(rate[r.source], 7, r.doc_id))})


def test_token_stage_and_run(spark, steps):
    want = sorted(slow_files(pairs(steps[4])))
    assert sorted(tuple(r)[:4] for r in steps[5].collect()) == want
    assert sorted(tuple(r)[:4] for r in cp.run(spark, SF).collect()) == want
