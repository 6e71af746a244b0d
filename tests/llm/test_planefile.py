import io
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tracewright.llm import planefile as pf

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIB = Tokenizer.from_file(PATH)
ANY = pf.Encoder(PATH, most_bytes=1 << 12)


def want(rows):
    at = 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*LIB.encode(text or "", add_special_tokens=False).ids, 2]
        yield doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=70), st.booleans())
def test_planes_round_trip(ids, bits):
    a = np.array(ids, "<u4")
    assert pf.from_planes(pf.to_planes(a, bits), len(a)).tolist() == ids


@pytest.mark.parametrize("bits", [False, True])
def test_shard_round_trip(bits):
    rng = np.random.default_rng(1)
    docs = [(int(k), rng.integers(0, 50257, n).astype("<u4")) for k, n in enumerate([0, 1, 5, 70_000, 0, 65_536, 65_535, 200_001, 3])]
    sink = io.BytesIO()
    w = pf.ShardWriter(sink, bits)
    for k, ids in docs:
        w.add(k, ids.tobytes())
    w.close()
    r = pf.ShardReader(sink, len(sink.getvalue()))
    assert [(a, n, c) for a, n, c in r.documents()] == [(k, len(x), zlib.crc32(x.tobytes())) for k, x in docs]
    assert len(r.chunks) == -(-sum(len(x) for _, x in docs) // pf.BLOCK)
    assert r.block(2).tolist() == np.concatenate([x for _, x in docs])[2 * pf.BLOCK : 3 * pf.BLOCK].tolist()


def test_encoder_equals_the_library():
    texts = ["", "it's  a\n\n b <|endoftext|> c", "x<|endoftext|>", "é" * 50, "a b " * 100, "漢字　x"]
    small = pf.Encoder(PATH, most_bytes=1)
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in small.encode(texts)] == [LIB.encode(t, add_special_tokens=False).ids for t in texts]


class Counted(dict):
    gets = 0

    def get(self, *a):
        self.gets += 1
        return super().get(*a)


def test_a_repeated_piece_is_looked_up_once_a_call():
    encoder = pf.Encoder(PATH)
    encoder.known = Counted()
    text = "a bc def\n" * 20_000
    assert np.frombuffer(encoder.encode([text, text])[1], "<u4").tolist() == LIB.encode(text, add_special_tokens=False).ids
    assert encoder.known.gets < 20


def test_pieces_are_remembered_beyond_24_mib():
    class Model:
        def __init__(self, model):
            self.model, self.calls = model, 0

        def tokenize(self, piece):
            self.calls += 1
            return self.model.tokenize(piece)

    encoder = pf.Encoder(PATH)
    encoder.model = Model(encoder.model)
    alphabet = "abcdefghijklmnopqrstuvwxyz"
    texts = [" ".join(a + b + c + d for b in alphabet for c in alphabet for d in alphabet[:10]) for a in alphabet]
    first = [encoder.encode([t]) for t in texts]
    assert encoder.model.calls >= 170_000
    encoder.model.calls = 0
    assert [encoder.encode([t]) for t in texts] == first and encoder.model.calls == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab 1'st\n\t\0é漢🎉\u00a0\u3000.!\x85"), max_size=30), max_size=5))
def test_encoder_on_any_texts(texts):
    assert [np.frombuffer(x, "<u4").tolist() for x in ANY.encode(texts)] == [LIB.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("bits", [False, True])
def test_odd_rows(spark, bits):
    rows = [(3, None), (1, ""), (2, "a b"), (2, "a b"), (2, "A <|endoftext|>"), (-5, "x " * 5000), (None, "no id")]
    docs = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, shard int")
    got = [tuple(r)[:4] for r in pf.encoded_documents(docs, PATH, bits=bits, shards=3).collect()]
    ends = lambda rs: sorted(((a, n, c) for a, _, n, c in rs), key=str)
    assert min(got, key=lambda r: r[1])[0] is None
    assert ends(got) == ends(want(rows))
    assert [s for _, s, _, _ in sorted(got, key=lambda r: r[1])] == np.concatenate([[0], np.cumsum([n for _, _, n, _ in sorted(got, key=lambda r: r[1])])[:-1]]).tolist()
    assert pf.encoded_documents(docs.limit(0), PATH).count() == 0


def test_query_against_the_library(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted(tuple(r)[:4] for r in pf.op8_bit_plane_files(spark, sf).collect())
    assert got == sorted(want(rows))


def test_shards_follow_the_input_and_long_words(spark, tmp_path):
    rows = [(k, "w" * 5000 + f" {k}") for k in range(40)] + [(7, "same")] * 50
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert pf.shard_count(docs, 20_000) == 11 and pf.shard_count(docs) == 4 and pf.shard_count(docs.limit(0)) == 4
    out = pf.encoded_documents(docs, PATH, folder=f"file://{tmp_path}/x", shards=9)
    assert sorted(tuple(r)[:4] for r in out.collect()) == sorted(want(rows))
    encoder = pf.Encoder(PATH)
    encoder.encode(["v" * 5000])
    assert not any(len(p) >= 64 for p in encoder.known)


def test_failed_attempts_leave_no_file(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    with pytest.raises(Exception):
        pf.write_shards(docs, f"file://{tmp_path}/y", PATH, end_id=-1, shards=1).collect()
    assert not [f for f in (tmp_path / "y").glob(".*")] if (tmp_path / "y").exists() else True
