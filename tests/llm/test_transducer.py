import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tracewright.llm import transducer as td

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIB = Tokenizer.from_file(PATH)


def want(text):
    return len(LIB.encode(text or "", add_special_tokens=False).ids)


ODD = ["", " ", "  ", "\n", "a", " a", "a  b", "a \n b", "a\n\n\n", "  a", "it's we're I'll 'sam !'s 's's 'x' ''s", "' s'", "'re've'm'd'LL", "x<|endoftext|>y", "<|endoftext|><|endoftext|>", "<|endoftext|> a ",
       "\0a\0\0b", "é\u0301 ß ǅ ٣ ² Ⅷ 漢字 кириллица", "\u00a0\u2003 a\u3000b\u0085", "=" * 300, "a" * 2000, "1234567 12,345.67", "\t\tif x:\n\t\t  y", "😀👍🏽 x", "word " * 3000, "ab'" * 400, "-" * 129 + "x"]


@pytest.fixture(scope="module")
def counter():
    return td.TokenCounter(PATH)


def test_odd_texts(counter):
    assert counter.count(ODD).tolist() == [want(t) for t in ODD]
    assert [int(counter.count([t])[0]) for t in ODD] == [want(t) for t in ODD]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("abst're'vl m\n\t 12!?é漢 \u00a0\0")), max_size=60), max_size=5))
def test_any_text(texts):
    assert td.TokenCounter.of(PATH).count(texts).tolist() == [want(t) for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=80))
def test_unicode(text):
    assert td.TokenCounter.of(PATH).count([text]).tolist() == [want(text)]


def test_scan_equals_a_plain_run(counter):
    rng = random.Random(3)
    text = "".join(rng.choice("ab 's re\n1!") for _ in range(5000))
    points = np.frombuffer((text + "\0").encode("utf-32-le"), np.uint32)
    sym = counter.splitter.symbols(points, np.array([len(text)]))
    state, marks = 0, 0
    for s in sym:
        marks += int(counter.splitter.mark[state, s])
        state = counter.splitter.go[state, s]
    cut = sym[: 4 * 1000].reshape(4, 1000).T
    after, emitted = counter.splitter.scan(*counter.splitter.chunk_maps(cut))
    state = n = 0
    for k, s in enumerate(sym[:4000]):
        n += int(counter.splitter.mark[state, s])
        state = counter.splitter.go[state, s]
        if (k + 1) % 1000 == 0:
            assert (after[k // 1000, 0], emitted[k // 1000, 0]) == (state, n)
    assert len(counter.splitter.starts(points, np.array([len(text)]))) == marks


def test_chunk_maps_of_long_pre_tokens_compose():
    rng = random.Random(9)
    merger = td.Merger(PATH)
    for letters in ("ab", "aeinorst", "qxz", "=", "éa"):
        word = "".join(rng.choice(letters) for _ in range(1500)).encode()
        maps = merger.chunk_maps(word)
        state = total = 0
        for k, after in enumerate(merger.scan(maps)):
            state, n = merger.run(word[k * 256 : (k + 1) * 256], state)
            total += n
            assert after[0] == (state, total)
        assert merger.count(word) == total == want(word.decode())


def test_totals_are_those_of_the_scan():
    for n in (0, 1, 511, 512, 513, 2000):
        e = np.random.default_rng(n).integers(0, 9, n)
        assert td.TokenCounter.totals(e).tolist() == [0, *np.cumsum(e).tolist()]


def test_merger_forgets_and_stays_right():
    small = td.Merger(PATH, most=50)
    for t in ["hello", "unbelievable", "aaaaaaa", "xyzzy", "éèê", "supercalifragilistic"]:
        assert small.count(t.encode()) == want(t)


def test_query_against_the_library(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = td.op1_token_transducer(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n = want(texts[r.doc_id])
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 1024)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 0), (1, "a b", 1), (1, "a b", 1), (None, "x", 2)], "doc_id long, text string, n_tokens int")
    got = sorted((tuple(r) for r in td.token_counts(docs, PATH).collect()), key=str)
    assert got == sorted([(1, 0, 0, False), (1, 3, 2, False), (1, 3, 2, False), (None, 1, 1, False)], key=str)
    assert td.token_counts(docs.limit(0), PATH).count() == 0
