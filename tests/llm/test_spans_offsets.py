import random

from tracewright.llm import spans as sp


def removed_share(spark, lead):
    """Share of an unpunctuated passage that goes when it comes again after ``lead`` words."""
    rng = random.Random(5)
    passage = [f"p{rng.randrange(10**6)}" for _ in range(80)]
    rows = [(1, " ".join(["first", *passage, "end", "of", "it"])), *((2 + k, " ".join([f"d{k}x{j}" for j in range(k)] + passage + [f"e{k}x{j}" for j in range(20)])) for k in lead)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = {r.doc_id: set(r.text.split()) for r in sp.remove_repeated_spans(docs).collect()}
    return {k: 1 - len(left[2 + k] & set(passage)) / len(passage) for k in lead}


def test_passage_at_every_offset(spark):
    share = removed_share(spark, range(25))
    assert min(share.values()) >= 0.7, share


def test_pieces_come_back():
    rng = random.Random(6)
    words = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    ends = {len(words) - e for e in sp.pieces(words)}
    for k in range(1, 60):
        after = {len(words) - k - e for e in sp.pieces(words[k:])}
        assert {e for e in ends ^ after if e < len(words) - k - 20} == set()
